"""The shared tables in the roles that the operators need, in Spark and as SQL (``CTE``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: SQL of the same tables; a query's SQL names those that it needs.
CTE = {
    "fx_req": """select doc_id as id, lang as category, split_part(text, chr(10), 1) as title, text as rule, doc_id % 2 = 0 as in_kb from documents""",
    "fx_vec": "select vec_id as id, label as category, embedding, vec_id % 2 = 0 as in_kb from embeddings",
    "fx_parent": """select doc_id as id, 'R' || doc_id as title, case when doc_id % 7 = 0 then 'R-missing' when doc_id < 5 then null else 'r' || (doc_id // 5) end as is_child_of from documents""",
    "fx_node": "select d.doc_id as id, d.source as document_id, d.text as text_content, e.embedding from documents d left join embeddings e on e.vec_id = d.doc_id",
    "fx_entity": """select 'S' || s_suppkey as id, upper(s_name) as name, 'Supplier' as entity_type, e.embedding from supplier left join embeddings e on e.vec_id = s_suppkey
        union all select 'P' || p_partkey, upper(p_name || ' ' || p_partkey), 'Part', null from part
        union all select 'N' || n_nationkey, upper(n_name), 'Nation', null from nation""",
    "fx_edge": """select 'S' || s_suppkey as source_id, 'N' || s_nationkey as target_id, 'LOCATED_IN' as relation_type, 'nation ' || s_nationkey as description from supplier
        union all select distinct 'P' || l_partkey, 'S' || l_suppkey, 'SUPPLIED_BY', 'flag ' || l_returnflag from lineitem""",
    "fx_docentity": """select 'S' || s_suppkey as id, upper(s_name) as name, 'src' || (s_suppkey % 20) as document_id, e.embedding from supplier left join embeddings e on e.vec_id = s_suppkey and s_suppkey % 3 <> 0
        union all select 'N' || n_nationkey, upper(n_name), 'src' || (n_nationkey % 20), null from nation
        union all select 'P' || p_partkey, upper(p_name || ' ' || p_partkey), 'src' || (p_partkey % 20), null from part""",
    "fx_boundary": """select r_name as boundary_name, 'Region' as boundary_type, n_name as component, n_nationkey as pos from nation join region on n_regionkey = r_regionkey""",
    "fx_threat": """select event_id, printf('T-%03d', event_id) as threat_id, event_type as category, 'user-' || user_id as target_component, props as attack_vector from events""",
    "fx_feedback": """select d.doc_id as ordinal, printf('T-%03d', d.doc_id // 3) as threat_id, l.quality = 1 as is_valid, d.text as validation_reason,
        ['Critical','High','Medium','Low','Informational'][(d.doc_id % 5)::int + 1] as adjusted_severity, d.source as citation_reference, (d.doc_id % 3)::int as recursion_iteration
        from documents d join labels l using (doc_id)""",
    "fx_reply": """select event_id, case event_id % 4 when 0 then props when 1 then '```json' || chr(10) || props || chr(10) || '```' when 2 then '```' || chr(10) || props || chr(10) || '```' else 'no json' end as reply from events""",
    "fx_request": """select page_id, ['OWASP','NIST','INTERNAL','OTHER'][(page_id // 4 % 4)::int + 1] as category, case when page_id % 4 in (0, 2) then url end as source_url,
        case when page_id % 4 in (1, 2) then html end as document_text, html from pages""",
}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _pick(items: tuple[str, ...], i) -> F.Column:
    return F.element_at(F.array(*[F.lit(x) for x in items]), (i + 1).cast("int"))


def requirements(spark, d):
    t = table(spark, d, "documents")
    return t.select(F.col("doc_id").alias("id"), F.col("lang").alias("category"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
                    F.col("text").alias("rule"), (F.col("doc_id") % 2 == 0).alias("in_kb"))


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("category"), "embedding", (F.col("vec_id") % 2 == 0).alias("in_kb"))


def requirement_vectors(spark, d):
    return requirements(spark, d).join(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), "id")


def parents(spark, d):
    i = F.col("doc_id")
    of = F.when(i % 7 == 0, "R-missing").when(i >= 5, F.concat(F.lit("r"), F.floor(i / 5).cast("string")))
    return table(spark, d, "documents").select(i.alias("id"), F.concat(F.lit("R"), i.cast("string")).alias("title"), of.alias("is_child_of"), F.lit(1.0).alias("confidence"))


def nodes(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return table(spark, d, "documents").join(e, "doc_id", "left").select(F.col("doc_id").alias("id"), F.col("source").alias("document_id"), F.col("text").alias("text_content"), "embedding")


def entities(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("s_suppkey"), "embedding")
    none = F.lit(None).cast("array<float>").alias("embedding")
    s = table(spark, d, "supplier").join(e, "s_suppkey", "left").select(F.concat(F.lit("S"), "s_suppkey").alias("id"), F.upper("s_name").alias("name"), F.lit("Supplier").alias("entity_type"), "embedding")
    p = table(spark, d, "part").select(F.concat(F.lit("P"), "p_partkey").alias("id"), F.upper(F.concat("p_name", F.lit(" "), "p_partkey")).alias("name"), F.lit("Part").alias("entity_type"), none)
    n = table(spark, d, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("id"), F.upper("n_name").alias("name"), F.lit("Nation").alias("entity_type"), none)
    return s.unionByName(p).unionByName(n)


def document_entities(spark, d):
    """Entities of documents: of suppliers two thirds have a vector."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("__k"), "embedding").filter("__k % 3 <> 0")
    one = lambda t, letter, key, name: table(spark, d, t).select(F.concat(F.lit(letter), key).alias("id"), name.alias("name"), F.concat(F.lit("src"), (F.col(key) % 20).cast("string")).alias("document_id"), F.col(key).alias("__k"))
    s = one("supplier", "S", "s_suppkey", F.upper("s_name")).join(e, "__k", "left")
    none = F.lit(None).cast("array<float>").alias("embedding")
    rest = one("nation", "N", "n_nationkey", F.upper("n_name")).unionByName(one("part", "P", "p_partkey", F.upper(F.concat("p_name", F.lit(" "), "p_partkey")))).select("*", none)
    return s.unionByName(rest).drop("__k")


def located_edges(spark, d):
    return table(spark, d, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("source_id"), F.concat(F.lit("N"), "s_nationkey").alias("target_id"), F.lit("LOCATED_IN").alias("relation_type"),
                                              F.concat(F.lit("nation "), "s_nationkey").alias("description"))


def supplied_edges(spark, d, distinct: bool = True):
    """Equal ones are told by their three keys: the four texts made of them take more memory. Without ``distinct`` an edge comes as
    often as lineitem has it, for a reader that first takes most of them away."""
    keys = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag")
    return (keys.distinct() if distinct else keys).select(F.concat(F.lit("P"), "l_partkey").alias("source_id"), F.concat(F.lit("S"), "l_suppkey").alias("target_id"),
                                                          F.lit("SUPPLIED_BY").alias("relation_type"), F.concat(F.lit("flag "), "l_returnflag").alias("description"))


def edges(spark, d):
    return located_edges(spark, d).unionByName(supplied_edges(spark, d))


def boundaries(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select(F.col("r_name").alias("boundary_name"), F.lit("Region").alias("boundary_type"), F.col("n_name").alias("component"), F.col("n_nationkey").alias("pos"))


def _threat_id(c):
    return F.format_string("T-%03d", c).alias("threat_id")


def threats(spark, d):
    return table(spark, d, "events").select("event_id", _threat_id(F.col("event_id")), F.col("event_type").alias("category"),
                                                                    F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("target_component"), F.col("props").alias("attack_vector"))


def feedback(spark, d):
    i = F.col("doc_id")
    t = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return t.select(i.alias("ordinal"), _threat_id(F.expr("doc_id div 3")), (F.col("quality") == 1).alias("is_valid"), F.col("text").alias("validation_reason"),
                    _pick(("Critical", "High", "Medium", "Low", "Informational"), i % 5).alias("adjusted_severity"), F.col("source").alias("citation_reference"), (i % 3).cast("int").alias("recursion_iteration"))


def replies(spark, d):
    i, p = F.col("event_id") % 4, F.col("props")
    r = F.when(i == 0, p).when(i == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(i == 2, F.concat(F.lit("```\n"), p, F.lit("\n```"))).otherwise("no json")
    return table(spark, d, "events").select("event_id", r.alias("reply"))


def requests(spark, d):
    i = F.col("page_id")
    return table(spark, d, "pages").select(i, _pick(("OWASP", "NIST", "INTERNAL", "OTHER"), F.floor(i / 4) % 4).alias("category"), F.when((i % 4).isin(0, 2), F.col("url")).alias("source_url"),
                                           F.when((i % 4).isin(1, 2), F.col("html")).alias("document_text"), "html")


def _json(**fields) -> F.Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def threat_replies(spark, d):
    """(event_id, reply): lists of one threat, of several in a fence, with an item that is no object, an object, no JSON; lists
    behind words or JSON, before words, and in a fence that is not closed."""
    i, t = F.col("event_id"), F.col("event_type")
    one = _json(threat_id=F.concat(F.lit("E"), i.cast("string")), category=t, target_component=F.concat(F.lit("user-"), F.col("user_id").cast("string")), attack_vector=F.col("props"), cvss_estimate=F.col("value"), confidence=F.lit(0.9))
    three = F.concat(F.lit("so:\n```json\n["), _json(target_component=t), F.lit(', {"cvss_estimate": "high"}, {"threat_id": null, "cvss_estimate": "7"}]\n```'))
    k, fence = i % 10, F.concat(F.lit("```json\n["), one, F.lit("]\n```"))
    r = F.when(k == 0, F.concat(F.lit("["), one, F.lit("]"))).when(k == 1, three).when(k == 2, F.concat(F.lit("[1, "), one, F.lit("]"))).when(k == 3, one)
    r = r.when(k == 4, F.concat(F.lit("3 threats found:\n"), fence)).when(k == 5, F.concat(F.lit('{"a":1} then '), fence)).when(k == 6, F.concat(F.lit('"x" and '), fence))
    r = r.when(k == 7, F.concat(F.lit("["), one, F.lit("] and more"))).when(k == 8, F.concat(F.lit("```\n["), one, F.lit("]"))).otherwise("no json")
    return table(spark, d, "events").select("event_id", r.alias("reply"))


def feedback_replies(spark, d):
    """(doc_id, reply): a list in a fence, a number for the verdict, a text for it, no JSON that says valid, and nothing; texts
    that begin as JSON and say valid, and keys with null and other kinds of values."""
    i, q = F.col("doc_id"), F.col("quality")
    whole = _json(is_valid=q == 1, validation_reason=F.col("text"), adjusted_severity=F.lit("Critical"), citation_reference=F.col("source"))
    k = i % 9
    r = F.when(k == 0, F.concat(F.lit("```json\n["), whole, F.lit("]\n```"))).when(k == 1, _json(is_valid=q)).when(k == 2, F.concat(F.lit("```\n"), _json(is_valid=F.lit("false"), adjusted_severity=F.lit("Low")), F.lit("\n```")))
    r = r.when(k == 3, F.concat(F.lit("I find Is_Valid: TRUE in "), i.cast("string"))).when(k == 4, "nothing").when(k == 5, F.lit('"is_valid": true')).when(k == 6, F.lit("true, so is_valid: true"))
    r = r.when(k == 7, F.concat(F.lit('{"is_valid": null, "validation_reason": null, "adjusted_severity": null, "citation_reference": true, "n": '), i.cast("string"), F.lit("}"))).otherwise('{"is_valid": true} or not')
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("doc_id", r.alias("reply"))


def recommendation_replies(spark, d):
    """(event_id, reply): one full recommendation and an empty one, one in a fence, no JSON, one behind words, one in a fence that
    is not closed, a severity of null, keys with null and a single citation, an item that is no object."""
    i = F.col("event_id")
    full = _json(threat_id=F.concat(F.lit("E"), i.cast("string")), category=F.col("event_type"), target_component=F.lit("API"), severity=F.lit("Critical"), attack_vector=F.col("props"),
                 mitigation_strategy=F.lit("rotate keys"), citations=F.array(F.lit("A"), F.col("event_type")))
    k, report = i % 8, F.concat(F.lit('{"recommendations":['), full, F.lit("]}"))
    r = F.when(k == 0, F.concat(F.lit('{"recommendations":['), full, F.lit(",{}]}"))).when(k == 1, F.concat(F.lit("x ```json "), F.lit('{"recommendations":[{"threat_id":"T"}]} ```'))).when(k == 2, "none")
    r = r.when(k == 3, F.concat(F.lit("2 items\n```json\n"), report, F.lit("\n```"))).when(k == 4, F.concat(F.lit("```json\n"), report, F.lit(" "))).when(k == 5, '{"recommendations":[{"severity":null}]}')
    r = r.when(k == 6, F.concat(F.lit('{"critical_count":2,"executive_summary":"of '), i.cast("string"), F.lit('","recommendations":[{"threat_id":"N","category":null,"mitigation_strategy":null,"citations":"A"}, {"citations":null}]}')))
    return table(spark, d, "events").select("event_id", r.otherwise('{"recommendations":[1, {}]}').alias("reply"))


def requirement_replies(spark, d):
    """(doc_id, reply): two requirements in a fence, one, one without its rule, no JSON, an empty list; a title that is a number,
    a rule that is an object, words behind the JSON, a parent that is a number."""
    i = F.col("doc_id")
    one = _json(title=F.concat(F.lit("R"), i.cast("string")), actionable_rule=F.col("text"))
    child = _json(title=F.lit("C"), actionable_rule=F.coalesce(F.col("source"), F.lit("-")), is_child_of=F.concat(F.lit("R"), i.cast("string")))
    k = i % 9
    r = F.when(k == 0, F.concat(F.lit('```json\n{"requirements":['), one, F.lit(","), child, F.lit("]}\n```"))).when(k == 1, F.concat(F.lit('{"requirements":['), one, F.lit("]}")))
    r = r.when(k == 2, F.lit('{"requirements":[{"title":"T"}]}')).when(k == 3, "none").when(k == 4, F.lit('{"requirements":[]}')).when(k == 5, F.lit('{"requirements":[{"title":5,"actionable_rule":"a"}]}'))
    r = r.when(k == 6, F.lit('{"requirements":[{"title":"T","actionable_rule":{"x":1}}]}')).when(k == 7, F.concat(F.lit('{"requirements":['), one, F.lit("]} done")))
    r = r.otherwise(F.concat(F.lit('{"requirements":['), child, F.lit(',{"title":"T","actionable_rule":"a","is_child_of":null},{"title":"T","actionable_rule":"a","is_child_of":3}]}')))
    return table(spark, d, "documents").select("doc_id", r.alias("reply"))


def graph_replies(spark, d):
    """(s_suppkey, reply): a supplier, its nation and the edge between them, of six replies one plain and one fenced; the others
    lack a field, have a number for a name, no edges, and words around."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    e = lambda n, t: F.struct(F.col(n).alias("name"), F.lit(t).alias("type"), F.lit("d").alias("description"))
    good = _json(entities=F.array(e("s_name", "Supplier"), e("n_name", "Nation")), edges=F.array(F.struct(
        F.col("s_name").alias("source_entity"), F.col("n_name").alias("target_entity"), F.lit("IN").alias("relation_type"), F.lit("d").alias("description"))))
    k = F.col("s_suppkey") % 6
    r = F.when(k == 0, good).when(k == 1, F.concat(F.lit("```json"), good, F.lit("```"))).when(k == 2, '{"entities":[{"name":"a"}],"edges":[]}').when(k == 3, '{"entities":[{"name":1,"type":"t","description":"d"}],"edges":[]}')
    return s.select("s_suppkey", r.when(k == 4, '{"entities":[]}').otherwise(F.concat(F.lit("see "), good)).alias("reply"))


def diagram_variants(spark, d):
    """(r_regionkey, variant, reply): each region's diagram whole, with coordinates as text and as a number with a fraction of 0,
    without coordinates, with a coordinate that is none or has a fraction, without a boundary's name, and with a flow that is none."""
    c, r = "(?s)", F.col("reply")
    swap = lambda old, new: F.regexp_replace(r, c + old, new)
    ways = [r, swap('"ymin":(\\d+)', '"ymin":"$1"'), swap('"ymax":(\\d+)', '"ymax":$1.0'), swap('"coordinates":\\{[^}]*\\}', '"coordinates":{}'), swap('"ymin":\\d+', '"ymin":"x"'), swap('"xmax":(\\d+)', '"xmax":$1.5'),
            swap('"boundary_name":"[^"]*",', ""), swap('"data_flows":\\[', '"data_flows":[7,')]
    return diagram_replies(spark, d).select("r_regionkey", F.posexplode(F.array(*ways)).alias("variant", "reply"))


def diagram_replies(spark, d):
    """(r_regionkey, reply): a diagram of each region: its nations and a zone that is nowhere else; a flow from the zone to
    each nation, and one to nowhere; a boundary around the nations."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    zone = F.concat(F.lit("QQ#"), F.col("r_regionkey").cast("string"), F.lit("#ZZ"))
    at = lambda x: F.struct(*[x.cast("int").alias(c) for c in ("ymin", "xmin", "ymax", "xmax")])
    part = lambda name, kind, x, label: F.struct(name.alias("name"), F.lit(kind).alias("type"), at(x).alias("coordinates"), F.array(F.lit(kind), label).alias("labels_on_box"))
    flow = lambda to, protocol: F.struct(zone.alias("source"), to.alias("target"), F.lit("Reads").alias("flow_label"), protocol.alias("protocol"))
    key = F.col("n_nationkey")
    g = n.groupBy("r_regionkey", "r_name").agg(F.array_sort(F.collect_list(F.struct(key, part(F.col("n_name"), "Nation", key, F.col("r_name")).alias("c"), flow(F.col("n_name"), F.when(key % 2 == 0, "TCP").otherwise("")).alias("f")))).alias("a"))
    reply = _json(components=F.array_append(F.transform("a", lambda x: x["c"]), part(zone, "Zone", F.lit(0), F.lit("z"))), data_flows=F.array_append(F.transform("a", lambda x: x["f"]), flow(F.lit("NOWHERE"), F.lit(""))),
                  trust_boundaries=F.array(F.struct(F.col("r_name").alias("boundary_name"), F.transform("a", lambda x: x["c"]["name"]).alias("contained_components"), F.lit("VPC").alias("boundary_type"))))
    return g.select("r_regionkey", F.concat(F.lit("```json\n"), reply, F.lit("\n```")).alias("reply"))


def refresh_pages(spark, d):
    """(page_id, url, html): pages that send their reader on to the next, but every seventh."""
    i = F.col("page_id")
    to = F.concat(F.lit("http://h/p/"), (i + 1).cast("string"))
    tag = F.when(i % 7 == 6, "").when(i % 2 == 0, F.concat(F.lit('<meta http-equiv="refresh" content="0; url='), to, F.lit('">'))).otherwise(F.concat(F.lit("<META content=\"5;URL='/p/"), (i + 1).cast("string"), F.lit("'\" http-equiv=refresh>")))
    return table(spark, d, "pages").select("page_id", F.concat(F.lit("http://h/p/"), i.cast("string")).alias("url"), F.concat(tag, F.col("html")).alias("html"))


def query_vector(spark, d) -> list[float]:
    """The vector of id 0: one row."""
    r = table(spark, d, "embeddings").filter("vec_id = 0").select("embedding").first()
    return list(r.embedding) if r else [1.0]
