"""Many queries at once, isolated failures, the index of vectors, fuzzy matches by bounds, and the fold in rounds."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import fuzzy, index
from tessera.functions.vectors import knn_join
from tessera.operators import dedup, graph, hierarchy, retrieve
from tessera.plans import fixtures as X
from tessera.plans import queries as plans
from tessera.sources import plugins

from .test_reference_ops import fold_python

SF = "/root/testdata/sf0.001"


def test_many_queries_equal_one_by_one(spark):
    nodes, entities, edges = X.nodes(spark, SF).filter("id % 3 <> 1 OR id > 30"), X.document_entities(spark, SF), X.edges(spark, SF)
    rng = np.random.default_rng(3)
    q = [(i, f"src{i % 22}", [float(x) for x in rng.normal(size=64)]) for i in range(50)]
    got = {}
    many = retrieve.hybrid_many(spark.createDataFrame(q, "qid long, document_id string, embedding array<float>"), nodes, entities, edges)
    for r in many.collect():
        got.setdefault(r.qid, []).append((r.ord, r.text, None if r.distance is None else round(r.distance, 5)))
    nodes, entities, edges = nodes.cache(), entities.cache(), edges.cache()
    for i, doc, v in q[:12]:
        one = retrieve.hybrid(nodes, entities.filter(F.col("document_id") == doc), edges, [float(np.float32(x)) for x in v], doc)
        names = {r.id: r.name for r in entities.collect()}
        assert names
        want = sorted((r.ord, r.text, None if r.distance is None else round(r.distance, 5)) for r in one.filter("ord < 5").collect())
        assert sorted(x for x in got.get(i, []) if x[0] < 5) == want
    spark.catalog.clearCache()


def test_contexts_do_not_grow_with_texts(spark):
    nodes, entities, edges = X.nodes(spark, SF), X.document_entities(spark, SF), X.edges(spark, SF)
    q = X.table(spark, SF, "embeddings").filter("vec_id < 20").select(F.col("vec_id").alias("qid"), F.concat(F.lit("src"), F.col("vec_id").cast("string")).alias("document_id"), "embedding")
    whole = {r.qid: r.context for r in retrieve.contexts(retrieve.hybrid_many(q, nodes, entities, edges), 300).collect()}
    cut = {r.qid: r.context for r in retrieve.contexts(retrieve.hybrid_many(q, nodes, entities, edges, chars=300), 300).collect()}
    assert whole == cut and len(whole) == 20


def test_one_bad_text_of_many(spark):
    calls = []

    def call(texts):
        if "t77" in texts:
            raise TimeoutError("no answer")
        return [x.upper() for x in texts]

    d = spark.createDataFrame([(i, f"t{i}" if i % 100 else None) for i in range(10_000)], "i int, t string")
    got = {r.i: (r.o, r.error) for r in plugins.map_text(d, "t", "o", "string", call, "error").collect()}
    assert got == {i: (None, "no answer") if i == 77 else (f"T{i}", None) if i % 100 else (None, None) for i in range(10_000)}

    def counted(texts):
        calls.append(len(texts))
        return call(texts)

    assert [e for _, e in plugins.isolated(counted, [f"t{i}" for i in range(1024)]) if e] == ["no answer"] and len(calls) <= 21
    assert plugins.isolated(lambda x: x[1:], ["a"]) == [(None, "0 replies to 1 texts")] and plugins.isolated(call, []) == []
    with pytest.raises(Exception, match="no answer"):
        plugins.map_text(d, "t", "o", "string", call).collect()


def test_index(spark):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(12, 16))
    rows = [(i, "ab"[i % 2], [float(x) for x in centers[i % 12] + rng.normal(size=16) * 0.3]) for i in range(900)]
    rows += [(900, "a", None), (901, "a", [0.0] * 16), (902, "c", rows[0][2])]
    base = spark.createDataFrame(rows, "id long, category string, embedding array<float>")
    i = index.build(base, lists=12, sample=400)
    assert i.rows.count() == 902 and i.centroids.shape == (12, 16)
    q = base.filter("id % 50 = 0")
    every = index.search(q, i, 5, probes=12).select("id", "other", "rk").orderBy("id", "rk").collect()
    assert every == knn_join(q, base, 5).select("id", "other", "rk").orderBy("id", "rk").collect()  # all lists: the exact result
    r = index.recall(q, base, i, 5, probes=2).first()
    assert (r.queries, r.wanted) == (18, 90) and r.recall >= 0.9
    assert index.tune(base, i, 5, queries=40) < 12
    assert index.build(base.filter("embedding IS NULL")) is None


def test_best_matches_verify_few():
    rng = random.Random(4)
    known = ["".join(rng.choice("abcdefghij ") for _ in range(rng.randint(0, 14))) for _ in range(300)]
    found = [k[:5] + rng.choice("xyz") + k[6:] for k in known[:60]] + ["", "zzzz", known[0], known[0]]
    got, verified = fuzzy.best_matches(found, known, 0.75, chunk=7)
    for f, g in zip(found, got):
        top = max(((fuzzy.ratio(f, k), -j) for j, k in enumerate(known)), default=None)
        assert g == ((-top[1], top[0]) if top[0] >= 0.75 else None)
    assert verified < len(found) * len(known) / 10
    assert fuzzy.best_matches(["a"], [], 0.5) == ([None], 0)


def test_reaches(spark):
    pairs = [("abc", "abc"), ("abc", "xyz"), ("abcd", "bcde"), ("", ""), (None, "a"), ("a", None), ("a" * 40, "a"), ("ab", "ba")]
    d = spark.createDataFrame(pairs, "a string, b string")
    for least in (0.3, 0.75, 1.0):
        got = [r.r for r in d.select(fuzzy.reaches("a", "b", least).alias("r")).collect()]
        assert got == [a is not None and b is not None and fuzzy.ratio(a, b) >= least for a, b in pairs]


def test_fold_of_copies_and_chains(spark):
    """Many copies that merge, copies that are inserted and skipped, copies with other vectors, and a chain of close rows."""
    at = lambda deg: [float(np.cos(np.radians(deg))), float(np.sin(np.radians(deg)))]
    kb = [(1000, "c", "Rule one", "kb text", at(0)), (1001, "c", "Other thing", "kb", at(90)), (1002, "e", "Exact", "same", at(10))]
    inc = [(i, "c", "rule one", "copy", at(3)) for i in range(40)]
    inc += [(100 + i, "c", "New rule", "fresh", at(200)) for i in range(30)]
    inc += [(200 + i, "c", "Rule one", "copy of many vectors", at([200, 0, 100][i % 3])) for i in range(9)]
    inc += [(300 + i, "d", f"Chain {i % 4}", f"text {i}", at(7 * i)) for i in range(6)]
    inc += [(400, "e", "EXACT", "Same", at(50)), (401, "e", "exact ", "same", None), (402, "z", "t", "r", None), (403, "z", "t", "r", None), (404, "z", "t", "r", at(1))]
    make = lambda rows: spark.createDataFrame(rows, "id long, category string, title string, rule string, embedding array<double>")
    got = [(x.id, x.decision, x.node_id) for x in dedup.fold_decisions(make(inc), make(kb), 0.9, 0.6, 5).orderBy("id").collect()]
    want = []
    for c in "cdez":
        one = lambda rows: [(i, t, r, v or [0.0, 0.0]) for i, k, t, r, v in rows if k == c]  # noqa: B023, E731
        with np.errstate(invalid="ignore"):
            want += fold_python(one(inc), one(kb), 0.9, 0.6, 5)
    assert got == sorted(want)
    assert sum(d == "MERGE" for _, d, _ in got) > 40 and sum(d == "SKIP" for _, d, _ in got) > 30


def test_fold_beyond_the_candidates_at_hand(spark, monkeypatch, keep=1):
    """Many close rows, of which few are at hand, and those drop out."""
    rng = random.Random(8)
    rows = []
    for i in range(40):
        base = rng.randrange(5)
        rows.append((i, f"Rule {base} " + "x" * rng.randrange(3), f"do {base} {rng.randrange(6)}", [float(np.cos(base) + rng.gauss(0, 0.2)), float(np.sin(base)), rng.gauss(0, 0.2)]))
    kb, inc = rows[:8], rows[8:]
    make = lambda xs: spark.createDataFrame([(i, "c", t, u, v) for i, t, u, v in xs], "id long, category string, title string, rule string, embedding array<double>")
    monkeypatch.setattr(dedup, "KEEP", keep)
    got = [(x.id, x.decision, x.node_id) for x in dedup.fold_decisions(make(inc), make(kb), 0.1, 0.7, 3).orderBy("id").collect()]
    assert got == fold_python(inc, kb, 0.1, 0.7, 3)
    d = make(inc).withColumn("copies", F.col("id"))
    assert dedup.fold_candidates(d, d, 0.1, 0.7, 3 * keep).groupBy("id").count().agg(F.max("count")).first()[0] == 3 * keep


def test_knn_join_streams(spark, monkeypatch):
    """Batches and products smaller than a block: ties by id, earlier rows alone, rows apart, copies, zero vectors, and all close pairs."""
    rng = np.random.default_rng(6)
    rows = [(i, "c", [float(x) for x in rng.integers(-2, 3, size=3)], i % 4) for i in range(120)]
    d = spark.createDataFrame(rows, "id long, category string, embedding array<float>, part long")
    monkeypatch.setitem(knn_join.__globals__, "CELLS", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")

    def near(i, v, p):
        n = lambda x: np.linalg.norm(np.array(x))
        s = [(1 - np.dot(v, w) / n(v) / n(w), j) for j, _, w, q in rows if j < i and q != p and n(v) and n(w)]
        return [(round(x, 9), j) for x, j in s if 1 - x >= 0.3 - 1e-12]

    try:
        for k in (4, None):
            got = {}
            for r in knn_join(d, d, k, 50, 0.3 - 1e-12, True, "part").collect():
                got.setdefault(r.id, []).append((round(r.distance, 9), r.other))
            want = {i: sorted(near(i, v, p))[:k] for i, _, v, p in rows}
            assert {i: sorted(x) for i, x in got.items()} == {i: x for i, x in want.items() if x}
        zero = d.filter("id = 0").withColumn("embedding", F.expr("array(0f, 0f, 0f)"))
        assert [(r.other, str(r.distance)) for r in knn_join(zero, d, 2).orderBy("rk").collect()] == [(0, "nan"), (1, "nan")]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_more_lines_than_a_reader_sees(spark):
    """Of a hub's edges only lines that begin within the budget are given to a query: the same text for its reader."""
    at = [1.0, 0.0]
    q = spark.createDataFrame([(1, "d", at)], "qid long, document_id string, embedding array<float>")
    nodes = spark.createDataFrame([(1, "d", "t", at)], "id long, document_id string, text_content string, embedding array<float>")
    names = [("hub", "HUB", at), ("two", "TWO", at)] + [(f"n{i}", f"N{i:03d} " + "y" * 20, None) for i in range(400)]
    entities = spark.createDataFrame([(i, n, "d", v) for i, n, v in names], "id string, name string, document_id string, embedding array<float>")
    edges = spark.createDataFrame([(s, f"n{i}", "R", "d") for i in range(400) for s in ("hub", "two")] + [("hub", "two", "R", "d")], "source_id string, target_id string, relation_type string, description string")
    find = lambda **x: {r.ord: r.text for r in retrieve.hybrid_many(q, nodes, entities, edges, **x).collect()}
    whole, cut = find(), find(chars=300)
    assert whole[5].count("\n") == 801 and cut == {o: t[:300] for o, t in whole.items()}


def test_cycles_send_no_side_to_the_driver(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 3)], "node long, parent long")
    d = hierarchy.cycles(links)
    assert {(r.id, r.cycle) for r in d.collect()} == {(i, 1) for i in (1, 2, 3, 4)}
    assert "Broadcast" not in d._jdf.queryExecution().executedPlan().toString()


def test_edges_within_ids(spark):
    """Both ends must be there, once or more often; an edge comes as often as before; the ids are not sent to every task."""
    rows = [("a", "b", 1), ("a", "b", 1), ("b", "a", 2), ("a", "x", 3), ("x", "b", 4), (None, "b", 5), ("a", None, 6), ("x", "y", 7)]
    ids = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "id string")
    d = graph.within(spark.createDataFrame(rows, "source_id string, target_id string, n int"), ids)
    assert sorted(tuple(r) for r in d.collect()) == [("a", "b", 1), ("a", "b", 1), ("b", "a", 2)] and d.columns == ["source_id", "target_id", "n"]
    assert "Broadcast" not in d._jdf.queryExecution().executedPlan().toString()


def test_titles_are_not_sent_to_the_driver(spark):
    d = spark.createDataFrame([(1, "A", None, 1.0), (2, "B", "a", 1.0), (3, "C", "z", 1.0)], "id long, title string, is_child_of string, confidence double")
    links, lost = hierarchy.resolve_parents(d), hierarchy.orphans(d)
    assert [tuple(r) for r in links.collect()] == [(2, 1)] and [r.id for r in lost.collect()] == [3]
    assert all("Broadcast" not in x._jdf.queryExecution().executedPlan().toString() for x in (links, lost))


def test_deletion_holds_no_table_in_a_task(spark):
    """What stays of the edges is found before equal ones are, and neither their ends nor the requirements are looked up in a table that each task has."""
    plan = plans.cascade_delete(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not {"source_id", "target_id", "doc_id"} & set(re.findall(r"BroadcastHashJoin \[(\w+)#", plan))
    assert plan.index("keys=[source_id#") < plan.rindex("ShuffledHashJoin [source_id#")  # the distinct stands above the joins


def test_edges_distinct_by_key_and_by_text(spark, tmp_path):
    rows = [(1, 2, "A"), (1, 2, "A"), (1, 2, "R"), (12, 2, "A"), (1, 22, "A"), (None, 2, "A"), (None, 2, "A"), (1, None, "A"), (1, 2, None), (1, 2, None)]
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    every, once = (X.supplied_edges(spark, str(tmp_path), distinct=x) for x in (False, True))
    got = [tuple(r) for r in once.collect()]
    assert every.count() == len(rows) and len(got) == len(set(got)) == len(set(rows)) and set(got) == {tuple(r) for r in every.collect()}
    assert "keys=[l_partkey#" in once._jdf.queryExecution().executedPlan().toString()
