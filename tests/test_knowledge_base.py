"""Validation, reports, summary trees, diagrams and small functions, beyond what the queries compare with SQL."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import llmjson, text
from tessera.operators import debate, dedup, hierarchy, rounds, tree, validation, vision
from tessera.plans import fixtures, queries
from tessera.sources import html, plugins, schemas, sink


def test_threats_make_no_rows_up(spark):
    rows = [(1, '[1, {"threat_id":"A"}]'), (2, '[{"threat_id":"A"}, null]'), (3, '["{}"]'), (4, '[{}, {"cvss_estimate":"high"}, {"confidence":null}, {}]'), (4, '[{}, {}]'), (4, '[{}, {}]'),
            (5, '[{"cvss_estimate":true,"threat_id":null}]'), (6, '{"a":1}'), (7, "3"), (8, "[]")]
    got = sorted((r.id, r.pos, str(r.threat_id), r.cvss_estimate) for r in llmjson.threats(spark.createDataFrame(rows, "id int, reply string")).collect())
    assert got == sorted([(4, 0, "T-001", 5.0), (4, 3, "T-002", 5.0), *[(4, 0, "T-001", 5.0), (4, 1, "T-002", 5.0)] * 2, (5, 0, "None", 1.0)])


@pytest.mark.parametrize("n", [6, 200])
def test_deep_hierarchies(spark, n):
    links = spark.createDataFrame([(i, i - 1) for i in range(1, n)] + [(n + 1, n + 2), (n + 2, n + 1), (n + 3, n + 1), (n + 4, 10**6)], "node long, parent long")
    nodes = spark.range(n + 5)
    got = {(r.id, r.root, r.depth) for r in hierarchy.trees(nodes, links).collect()}
    assert got == {(i, 0, i) for i in range(n)} | {(n, n, 0)}
    assert {r.id for r in hierarchy.descendants(spark.createDataFrame([(3,), (3,), (n + 2,)], "id long"), links).collect()} == {*range(3, n), n + 1, n + 2, n + 3}


def test_normalize_folds_every_script(spark):
    v = ["ΣΑΣ ﬁ", "İstanbul", "ſtraße ŉ", " A\x1fb ", "µ", "plain “text” – ok", None]
    got = [r.o for r in spark.createDataFrame(list(enumerate(v)), "i int, v string").select("i", text.normalize_text(F.col("v")).alias("o")).orderBy("i").collect()]
    assert got == [None if x is None else " ".join(x.casefold().split()) for x in v]


def test_ordinals_have_no_gaps(spark):
    d = spark.range(0, 5000, 7).select((F.col("id") * 31 % 4999).alias("k"))
    got = rounds.ordinals(d, "k").orderBy("k").collect()
    assert [r.ord for r in got] == list(range(len(got)))
    assert rounds.ordinals(d.limit(0), "k").count() == 0
    assert rounds.first_row(d, "k").first().k == min(r.k for r in got)


@pytest.mark.parametrize("n", [0, 1, 5, 6, 27])
def test_summary_tree(spark, n):
    def join(p):
        return plugins.summarise(p, call=lambda texts: ["<" + "+".join(x.split(": ", 1)[1] for x in t.split("\n\n")) + ">" for t in texts])

    d = spark.createDataFrame([(i, f"t{i}") for i in range(n)], "ord long, text string")
    got = {(r.layer, r.idx): (r.parent_idx, r.text) for r in tree.summaries(d, n, join).collect()}
    want, layer, k = {}, [f"t{i}" for i in range(n)], 0
    while layer:
        last = len(layer) == 1
        want |= {(k, i): (None if last else i // 5, t) for i, t in enumerate(layer)}
        layer, k = ([] if last else ["<" + "+".join(layer[i: i + 5]) + ">" for i in range(0, len(layer), 5)]), k + 1
    assert got == want


def test_validation_without_knowledge_or_reply(spark):
    t = spark.createDataFrame([(1, "T-1", [1.0, 0.0]), (2, "T-2", None)], "event_id long, threat_id string, embedding array<double>").select(
        "*", F.lit("c").alias("category"), F.lit("x").alias("target_component"), F.lit(None).cast("string").alias("attack_vector"))
    n = spark.createDataFrame([(i, [1.0, i / 10], f"text {i}") for i in range(8)], "id long, embedding array<double>, text_content string")
    got = {r.event_id: r.kb_context for r in validation.with_context(t, n, 3).collect()}
    assert got == {1: "text 0\n\ntext 1\n\ntext 2", 2: validation.NO_CONTEXT}
    assert {r.kb_context for r in validation.with_context(t, n.limit(0), 3).collect()} == {validation.NO_CONTEXT}
    seen = {r.threat_id: r for r in validation.validate(t, n, lambda prompts: [None if "T-1" in p else '{"is_valid":false}' for p in prompts], "context", 2).collect()}
    assert seen["T-1"].is_valid and seen["T-1"].citation_reference == validation.MANUAL and not seen["T-2"].is_valid and seen["T-2"].recursion_iteration == 2
    assert validation.validate(t, n, lambda prompts: ["?"] * len(prompts)).count() == 0


def test_report_with_and_without_recommendations(spark):
    t = spark.createDataFrame([(1, "T-1", "c", "x", "v")], "event_id long, threat_id string, category string, target_component string, attack_vector string")
    f = spark.createDataFrame([(1, "T-1", True, "r", "Low", "ref", 0)], "ordinal long, threat_id string, is_valid boolean, validation_reason string, adjusted_severity string, citation_reference string, recursion_iteration int")
    reply = lambda s: spark.createDataFrame([(s,)], "reply string")
    rich = '{"recommendations":[{"threat_id":"Z","severity":"High"},{}]}'
    assert [r.threat_id for r in debate.final_report(t, f, reply(rich)).orderBy("event_id").collect()] == ["Z", ""]
    for s in ('{"recommendations":[]}', "none", None):
        assert [r.threat_id for r in debate.final_report(t, f, reply(s)).collect()] == ["T-1"]
    assert debate.final_report(t, f.withColumn("is_valid", F.lit(False)), reply(rich)).count() == 0


def test_upsert_and_missed_edges(spark):
    known = spark.createDataFrame([(0, "a", "API GATEWAY", "S", "d"), (1, "b", "QUEUE", "S", "d"), (2, "c", "QUEUE", "S", "d")], "ord long, id string, name string, entity_type string, description string")
    c = spark.createDataFrame([(0, "api gateway", "G", (1, 2, 3, 4), ["x"], "Z"), (1, "Api Gatewayy", "G", (5, 6, 7, 8), [], "Y"), (2, "new", "N", (0, 0, 0, 0), ["l", "m"], "Unknown"), (3, "queue", "Q", (9, 9, 9, 9), [], "Z")],
                              f"pos long, name string, type string, coordinates {schemas.COORDINATES}, labels array<string>, trust_zone string")
    u = vision.upsert(known, c, "doc")
    got = {r.id: r for r in u.collect()}
    assert len(got) == 4 and got["a"].visual_name == "Api Gatewayy" and got["a"].spatial_metadata.coordinates.ymin == 5 and got["c"].spatial_metadata is None and got["b"].spatial_metadata.source == "hybrid_merge"
    new = next(r for r in got.values() if r.name == "new")
    assert new.description == "[Vision Extracted] Additional Labels: l; m" and new.id == next(r.id for r in vision.upsert(known, c, "doc").collect() if r.name == "new")
    flows = spark.createDataFrame([("new", "queue"), ("new", "none"), ("new", "none")], "source string, target string")
    assert [tuple(r) for r in vision.missed_edges(flows, u).collect()] == [("new", "none")] * 2


def test_job_result(spark):
    d = spark.createDataFrame([(2, "c", "MERGE", 9, 0.9), (1, "c", "SKIP", 8, 1.0), (3, "c", "INSERT", 3, None)], "id long, category string, decision string, node_id long, similarity double")
    t = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three")], "id long, title string")
    r = dedup.job_result(d, t, "job", 77).first()
    assert (r.job_id, r.status, r.graph_nodes_extracted, r.nodes_inserted, r.nodes_merged, r.nodes_skipped, r.raw_text_length) == ("job", "completed", 3, 1, 1, 1, 77)
    assert [(x.title, x.decision, x.merged_into) for x in r.dedup_decisions] == [("one", "SKIP", None), ("two", "MERGE", 9), ("three", "INSERT", None)]


def test_job_result_query(spark):
    """The query's decisions are those of the fold, whole and in order."""
    sf = "/root/testdata/sf0.001"
    want = {r.id: r for r in queries.QUERIES["kb_dedup_decisions"](spark, sf).collect()}
    got = queries.QUERIES["job_result"](spark, sf).first()
    assert got.decisions == len(want) and got.nodes_merged == sum(r.decision == "MERGE" for r in want.values())


def test_scalars(spark):
    raw = bytes(range(256)) * 3
    d = spark.createDataFrame([(raw, "a", None), (b"", "a", "None")], "c binary, x string, y string")
    rows = d.select(text.data_url(F.col("c"), "image/gif").alias("u"), text.key_id(F.col("x"), F.col("y")).alias("k"), text.json_dump(F.struct("x", F.lit('q" : "r').alias("z"), F.array(F.lit(1)).alias("l"))).alias("j")).collect()
    assert rows[0].u == "data:image/gif;base64," + base64.b64encode(raw).decode() and rows[0].k != rows[1].k
    assert json.loads(rows[0].j) == {"x": "a", "z": 'q" : "r', "l": [1]} and rows[0].j.startswith('{\n  "x": "a",\n  "z": "q')


def test_refresh_has_its_exact_value(spark):
    v = ["<META HTTP-EQUIV='refresh' content='0;url=a'>", "<meta http-equiv='Refresh' content='0;url=a'>", "<meta http-equiv=refresh content='0;URL=b'>", "<meta http-equiv='refreshing' content='0;url=a'>"]
    assert [r.o for r in spark.createDataFrame(list(enumerate(v)), "i int, v string").select("i", html.meta_refresh_target(F.col("v")).alias("o")).orderBy("i").collect()] == ["a", "", "b", ""]


def test_models_and_retries(spark, tmp_path):
    d = spark.createDataFrame([(1, "the API calls DB and API"), (2, None)], "id int, text string")
    assert [(len(r.g.entities), len(r.g.edges)) for r in llmjson.graph(plugins.extract_graph(d)).collect()] == [(2, 1)]
    (tmp_path / "a.bin").write_bytes(b"x\fy")
    (tmp_path / "b.bin").write_bytes(b"")
    images = plugins.binary_images(spark, str(tmp_path), lambda b: b.split(b"\f") if b else 1 / 0)
    assert [(r.image_no, bytes(r.image)) for r in images.orderBy("image_no").collect()] == [(0, b"x"), (1, b"y")]
    assert llmjson.diagram(plugins.read_diagrams(images)).count() == 2
    assert plugins.enrich(d, "text").filter("reply IS NOT NULL").count() == 0
    waits, left = [], [TimeoutError(), ConnectionError(), TimeoutError()]

    def call(texts):
        if left:
            raise left.pop(0)
        return texts

    assert plugins.retried(call, 4, wait=waits.append)(["x"]) == ["x"] and waits == [1.0, 2.0, 4.0]
    left[:] = [ConnectionError()]
    with pytest.raises(ConnectionError):
        plugins.retried(call, 1, wait=waits.append)(["x"])
    left[:] = [TimeoutError(), TimeoutError()]
    with pytest.raises(RuntimeError):
        plugins.retried(call, 2, wait=waits.append)(["x"])


def test_schemas(spark, tmp_path):
    root = str(tmp_path / "kb")
    assert sorted(schemas.bootstrap(spark, root)) == sorted(schemas.TABLES) and schemas.bootstrap(spark, root) == []
    assert sink.read(spark, f"{root}/architecture_entities").schema["spatial_metadata"].dataType.simpleString() == schemas.METADATA
    assert "created_at" in schemas.stamped(spark.range(1)).columns


def test_no_query_brings_rows_of_its_own():
    import inspect

    assert "createDataFrame" not in inspect.getsource(queries) + inspect.getsource(fixtures)
