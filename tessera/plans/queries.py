"""One query for each operator, and SQL that gives the same rows where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import index, llmjson, text
from ..functions import vectors as V
from ..functions.fuzzy import fuzzy_ratio
from ..operators import debate, dedup, graph, hierarchy, retrieve, tree, validation, vision
from ..operators.rounds import first_row, ordinals, shared_folder
from ..sources import html, ingest
from ..streaming import jobs
from . import fixtures as X

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *ctes: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            head = ", ".join(f"{c} as ({X.CTE[c]})" for c in ctes)
            body = sql.strip()
            if head:
                body = f"with {head}, {body[5:]}" if body.lower().startswith("with ") and not body.lower().startswith("with recursive") else (f"with recursive {head}, {body[15:]}" if body.lower().startswith("with recursive") else f"with {head} {body}")
            ORACLES[f.__name__] = body
        return f

    return add


NORM = "trim(regexp_replace(replace(lower({0}), 'ß', 'ss'), '\\s+', ' ', 'g'))"
DIST = "list_cosine_distance(({0})::double[], ({1})::double[])"
Q = "(select embedding from embeddings where vec_id = 0)"


@query(f"select vec_id, round({DIST.format('embedding', Q)}, 6) as distance, 1.0::double as score from embeddings where vec_id <> 0 order by {DIST.format('embedding', Q)} nulls last, vec_id limit 5")
def knn_topk(spark, d):
    t = X.table(spark, d, "embeddings").filter("vec_id <> 0")
    return V.top_k(t, X.query_vector(spark, d), 5, tie="vec_id").select("vec_id", F.round("distance", 6).alias("distance"), F.lit(1.0).alias("score"))


@query(f"""select id, other, distance, rk from (select q.id, k.id as other, round({DIST.format('q.embedding', 'k.embedding')}, 6) as distance,
    row_number() over (partition by q.id order by {DIST.format('q.embedding', 'k.embedding')}, k.id) as rk from fx_vec q join fx_vec k on q.category = k.category where not q.in_kb and k.in_kb) where rk <= 5""", "fx_vec")
def semantic_candidates(spark, d):
    v = X.vectors(spark, d)
    return V.knn_join(v.filter("NOT in_kb"), v.filter("in_kb"), 5).select("id", "other", F.round("distance", 6).alias("distance"), F.col("rk").cast("long").alias("rk"))


def _indexed(spark, d):
    """All vectors in an index of one category, and every fiftieth as a query."""
    v = X.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.lit("all").alias("category"), "embedding")
    return v.filter("id % 50 = 0"), v, index.build(v)


@query()
def knn_index_search(spark, d):
    """The five nearest by the index: for every fiftieth vector among all."""
    q, _, i = _indexed(spark, d)
    return index.search(q, i, 5).select("id", "other", F.round("distance", 6).alias("distance"), "rk")


@query("select count(*) as queries, 5 * count(*) as wanted, true as enough from embeddings where vec_id % 50 = 0")
def knn_index_recall(spark, d):
    """Whether the index finds at least nine in ten of the five nearest that the exact search finds."""
    q, v, i = _indexed(spark, d)
    return index.recall(q, v, i, 5).select("queries", "wanted", (F.col("recall") >= 0.9).alias("enough"))


SIMILARITY = "case when d is null then 0.0 when isnan(d) then 'NaN'::double else greatest(0.0, least(1.0, 1.0 - d)) end"


@query(f"""with x as (select vec_id, case vec_id % 5 when 0 then null when 1 then 'NaN'::double else {DIST.format('embedding', Q)} * 3 - 1.5 end as d from embeddings)
    select vec_id, round({SIMILARITY}, 6) as similarity from x""")
def cosine_clamp(spark, d):
    """Distances to one vector, stretched beyond both ends, some null or no number."""
    k = F.col("vec_id") % 5
    t = X.table(spark, d, "embeddings").withColumn("distance", F.when(k == 1, float("nan")).when(k > 1, V.cosine_to(F.col("embedding"), X.query_vector(spark, d)) * 3 - 1.5))
    return t.select("vec_id", F.round(V.clamp_similarity(F.col("distance")), 6).alias("similarity"))


@query(f"select doc_id, {NORM.format('text')} as norm from documents")
def normalize_text(spark, d):
    return X.table(spark, d, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("norm"))


@query("select distinct p_name, upper(trim(p_name)) as name from part")
def canonical_name(spark, d):
    return X.table(spark, d, "part").select("p_name").distinct().select("p_name", text.canonical_name(F.col("p_name")).alias("name"))


@query("select id, title || ': ' || rule as embed_text from fx_req", "fx_req")
def embed_text_projection(spark, d):
    return X.requirements(spark, d).select("id", text.embed_text(F.col("title"), F.col("rule")).alias("embed_text"))


@query("select doc_id, left(text, 1000) as context, left(text, 50) as attack_vector from documents")
def prompt_budget(spark, d):
    return X.table(spark, d, "documents").select("doc_id", text.budget(F.col("text"), 1000).alias("context"), text.budget(F.col("text"), 50).alias("attack_vector"))


@query(f"""with n as (select *, {NORM.format('title')} as t, {NORM.format('rule')} as r from fx_req), k as (select category, t, r, min(id) as node_id from n where in_kb group by all)
    select n.id, k.node_id, 'SKIP' as decision, 1.0::double as similarity_score from n join k using (category, t, r) where not n.in_kb""", "fx_req")
def exact_dedup(spark, d):
    r = X.requirements(spark, d)
    return dedup.exact_matches(r.filter("NOT in_kb"), r.filter("in_kb")).select("id", "node_id", F.lit("SKIP").alias("decision"), F.lit(1.0).alias("similarity_score"))


@query()
def semantic_dedup(spark, d):
    r = X.requirement_vectors(spark, d)
    return dedup.semantic_matches(r.filter("NOT in_kb"), r.filter("in_kb"), 0.30, 0.30).select("id", "other", F.round("similarity", 4).alias("similarity"))


def _decisions(spark, d):
    r = X.requirement_vectors(spark, d)
    return dedup.fold_decisions(r.filter("NOT in_kb"), r.filter("in_kb"), 0.30, 0.30)


@query()
def kb_dedup_decisions(spark, d):
    return _decisions(spark, d)


@query()
def dedup_decision_counts(spark, d):
    return dedup.decision_counts(_decisions(spark, d))


@query()
def ingest_summary(spark, d):
    return dedup.ingest_summary(_decisions(spark, d), "kb-ingest-0")


@query()
def fuzzy_ratio_names(spark, d):
    n = X.table(spark, d, "part").select("p_name").distinct()
    first = n.agg(F.min("p_name").alias("with_name"))
    return n.join(F.broadcast(first), F.lit(True)).select("p_name", "with_name", F.round(fuzzy_ratio("p_name", "with_name"), 6).alias("ratio"))


QUERIES["fuzzy_ratio"] = QUERIES.pop("fuzzy_ratio_names")


@query()
def fuzzy_entity_match(spark, d):
    p = X.table(spark, d, "part")
    known = p.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("ord"))
    return vision.fuzzy_match(p.select(F.reverse("p_name").alias("name")).unionByName(p.select(F.concat("p_name", F.lit("x")).alias("name"))), known).drop("verified")


@query("""with c as (select id, 'R' || (id // 5) as p from fx_parent where is_child_of is not null and id % 7 <> 0) select c.id as node, f.id as parent from c join fx_parent f on f.title = c.p""", "fx_parent")
def parent_resolution(spark, d):
    return hierarchy.resolve_parents(X.parents(spark, d))


@query("select p.id, p.title, p.is_child_of from fx_parent p where is_child_of is not null and not exists (select 1 from fx_parent q where lower(q.title) = lower(p.is_child_of))", "fx_parent")
def orphan_children(spark, d):
    return hierarchy.orphans(X.parents(spark, d)).select("id", "title", "is_child_of")


@query("""with recursive l as (select c.id as node, p.id as parent from fx_parent c join fx_parent p on lower(p.title) = lower(c.is_child_of) where c.id <> p.id),
    t as (select id, id as root, 0 as depth from fx_parent where id not in (select node from l) union all select l.node, t.root, t.depth + 1 from t join l on l.parent = t.id) select id, root, depth from t""", "fx_parent")
def requirement_tree(spark, d):
    p = X.parents(spark, d)
    return hierarchy.trees(p.select("id"), hierarchy.resolve_parents(p))


@query("""select doc_id as id, case when k % 2 = 1 then k * 10 end as root, case when k % 2 = 1 then (doc_id % 10)::int end as depth, case when k % 2 = 0 then k * 10 end as cycle from (select doc_id, doc_id // 10 as k from documents)""")
def requirement_cycles(spark, d):
    """Parents by tens: in every second ten a chain from a root, in the others a ring of three with a chain below: every row with its
    root or its cycle."""
    i = F.col("id")
    n = X.table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    ten, one = F.expr("id div 10"), i % 10
    up = F.when((ten % 2 == 0) & (one < 3), ten * 10 + (one + 1) % 3).when(one > 0, i - 1)
    links = n.select(i.alias("node"), up.alias("parent")).filter("parent IS NOT NULL")
    return n.join(hierarchy.trees(n, links).hint("merge"), "id", "left").join(hierarchy.cycles(links).hint("merge"), "id", "left")


@query("""with recursive l as (select c.id as node, p.id as parent from fx_parent c join fx_parent p on lower(p.title) = lower(c.is_child_of)),
    gone as (select 1::bigint as id union select l.node from gone join l on l.parent = gone.id)
    select 'requirements' as kept_in, count(*) as n from fx_parent where id not in (select id from gone)
    union all select 'entities', count(*) from fx_entity where entity_type <> 'Supplier'
    union all select 'edges', count(*) from fx_edge where source_id not like 'S%' and target_id not like 'S%'""", "fx_parent", "fx_entity", "fx_edge")
def cascade_delete(spark, d):
    """Requirement 1 and all below it, and the suppliers with the edges at them."""
    p, e = X.parents(spark, d), X.entities(spark, d)
    gone = hierarchy.descendants(p.filter("id = 1").select("id"), hierarchy.resolve_parents(p))
    keep = e.filter("entity_type <> 'Supplier'")
    left = graph.within(X.located_edges(spark, d), keep).unionByName(graph.within(X.supplied_edges(spark, d, distinct=False), keep).distinct())
    n = lambda name, t: t.agg(F.lit(name).alias("kept_in"), F.count(F.lit(1)).alias("n"))
    return n("requirements", p.join(gone.hint("merge"), "id", "left_anti")).unionByName(n("entities", keep)).unionByName(n("edges", left))


@query("select upper(trim(c_name)) as name, min(c_mktsegment) as description from customer group by 1")
def new_entities(spark, d):
    c = X.table(spark, d, "customer").select(F.lower(F.concat(F.lit(" "), "c_name")).alias("name"), F.col("c_mktsegment").alias("description"), F.col("c_custkey").alias("ord"))
    s = X.table(spark, d, "supplier").select(F.lower("s_name").alias("name"), F.lit("known").alias("description"), F.col("s_suppkey").alias("ord"))
    return graph.new_entities(c.unionByName(s), X.entities(spark, d))


@query("select 'S' || s_suppkey as source_id, 'N' || s_nationkey as target_id, 'LOCATED_IN' as relation_type, s_name as description from supplier")
def edge_resolution(spark, d):
    s = X.table(spark, d, "supplier").join(X.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    e = s.select(F.lower("s_name").alias("source"), F.concat(F.lit(" "), F.lower("n_name")).alias("target"), F.lit("located_in ").alias("relation_type"), F.col("s_name").alias("description"))
    lost = s.select("s_name", F.lit("nowhere").alias("target"), F.lit("lost").alias("relation_type"), F.col("s_name").alias("description")).toDF("source", "target", "relation_type", "description")
    return graph.resolve_edges(e.unionByName(lost), X.entities(spark, d))


@query("select relation_type, count(*) as n from fx_edge where target_id in ('N0', 'N1', 'N2', 'S1', 'S2') group by 1", "fx_edge")
def edge_count_for_entities(spark, d):
    return X.edges(spark, d).filter(F.col("target_id").isin("N0", "N1", "N2", "S1", "S2")).groupBy("relation_type").agg(F.count(F.lit(1)).alias("n"))


EDGE = "'[' || s.name || '] --(' || e.relation_type || ')--> [' || t.name || ']: ' || coalesce(e.description, 'None')"
HITS = f"(select id from fx_entity order by {DIST.format('embedding', Q)} nulls last, id limit 3)"
HOP = f"select distinct {EDGE} as edge from fx_edge e join fx_entity s on s.id = e.source_id join fx_entity t on t.id = e.target_id"


@query(f"select e.source_id, e.target_id, {EDGE} as edge from fx_edge e join fx_entity s on s.id = e.source_id join fx_entity t on t.id = e.target_id", "fx_edge", "fx_entity")
def edge_text(spark, d):
    return graph.named_edges(X.edges(spark, d), X.entities(spark, d)).select("source_id", "target_id", "edge")


@query(f"{HOP} where e.source_id in {HITS} or e.target_id in {HITS}", "fx_edge", "fx_entity")
def graph_one_hop(spark, d):
    e = X.entities(spark, d)
    return graph.one_hop(graph.nearest_entities(e, X.query_vector(spark, d)), X.edges(spark, d), e)


HYBRID = f"""texts as (select row_number() over (order by {DIST.format('embedding', Q)} nulls last, id) - 1 as ord, text_content as text, 1.0::double as score, round({DIST.format('embedding', Q)}, 6) as distance
    from fx_node where document_id = 'src0' qualify ord < 5), hop as ({HOP} where e.source_id in {HITS} or e.target_id in {HITS}),
    found as (select ord::int as ord, text, score, distance from texts union all select 5, 'Architecture Topology Context:' || chr(10) || string_agg(edge, chr(10) order by edge), 1.0, null from hop having count(*) > 0)"""


def _hybrid(spark, d):
    return retrieve.hybrid(X.nodes(spark, d), X.entities(spark, d), X.edges(spark, d), X.query_vector(spark, d), "src0")


@query(f"with {HYBRID} select * from found", "fx_node", "fx_entity", "fx_edge")
def hybrid_retrieve(spark, d):
    return _hybrid(spark, d).withColumn("distance", F.round("distance", 6))


@query(f"with {HYBRID} select left(string_agg(text, chr(10) || chr(10) order by ord), 1500) as context from found", "fx_node", "fx_entity", "fx_edge")
def critic_context(spark, d):
    return retrieve.context(_hybrid(spark, d))


PLAIN = "regexp_replace(coalesce({0}, ''), '<!--.*?-->', '', 'gs')"
for _n in html.DROPPED:
    PLAIN = f"regexp_replace({PLAIN}, '<{_n}\\b[^>]*>.*?</{_n}\\s*>', chr(10), 'gsi')"
PLAIN = f"regexp_replace({PLAIN}, '<[^>]*>', chr(10), 'gs')"
for _a, _b in html.ENTITIES:
    PLAIN = "replace({0}, '{1}', '{2}')".format(PLAIN, _a, _b.replace("'", "''"))
TEXT = "array_to_string(list_filter(list_transform(string_split(" + PLAIN + ", chr(10)), lambda x: regexp_replace(regexp_replace(x, '^\\s+', ''), '\\s+$', '')), lambda x: x <> ''), chr(10))"


@query(f"select page_id, {TEXT.format('html')} as text from pages")
def html_to_text(spark, d):
    return X.table(spark, d, "pages").select("page_id", html.html_to_text(F.col("html")).alias("text"))


@query("select page_id, case when page_id % 7 = 6 then '' when page_id % 2 = 0 then 'http://h/p/' || (page_id + 1) else '/p/' || (page_id + 1) end as target from pages")
def meta_refresh_target(spark, d):
    return X.refresh_pages(spark, d).select("page_id", F.coalesce(html.meta_refresh_target(F.col("html")), F.lit("")).alias("target"))


@query("""select 'http://h/p/' || page_id as url, 'http://h/p/' || (page_id + hops) as final_url, hops::int as hops
    from (select page_id, least(5, 6 - page_id % 7, (select max(page_id) from pages) - page_id) as hops from pages)""")
def meta_refresh_chain(spark, d):
    return html.follow_refresh(X.refresh_pages(spark, d).select("url", "html"))


@query("select conv_id, string_agg(text || chr(10), '' order by turn) as text from conversations group by 1")
def page_concat(spark, d):
    return ingest.concat_pages(X.table(spark, d, "conversations"), "conv_id", "turn", "text")


STATUS = "case when category not in ('OWASP', 'NIST', 'INTERNAL') then 'category' when source_url is null and document_text is null then 'no source' when source_url is not null and document_text is not null then 'two sources' end"


@query(f"select page_id, category, case when e is null then 202 when e = 'category' then 422 else 400 end as status, e as error from (select *, {STATUS} as e from fx_request)", "fx_request")
def ingest_validation(spark, d):
    return ingest.validate(X.requests(spark, d)).select("page_id", "category", "status", "error")


@query(f"""select page_id, case when content = '' then 'failed' else 'completed' end as status, content from (select page_id, case when source_url is not null then {TEXT.format('html')}
    else coalesce(document_text, '') end as content from fx_request)""", "fx_request")
def payload_dispatch(spark, d):
    kind = F.when(F.col("source_url").isNotNull(), "url").otherwise("text")
    t = X.requests(spark, d).select("page_id", ingest.payload(kind, F.col("html"), F.col("document_text")).alias("content"))
    return t.select("page_id", F.when(F.col("content") == "", "failed").otherwise("completed").alias("status"), "content")


def _length_reply(text):
    """A model that never answers to texts of a round length."""
    if len(text) % 10 == 0:
        raise ValueError("no reply")
    return f"{len(text)} characters"


@query(f"""select job_id, case when content = '' or length(content) % 10 = 0 then 'failed' else 'completed' end as status, case when content <> '' and length(content) % 10 = 0 then 3 else 0 end::int as retries,
    case when content = '' then 'Empty content' when length(content) % 10 = 0 then 'extract: no reply' end as error, case when content <> '' and length(content) % 10 <> 0 then length(content) || ' characters' end as result
    from (select page_id::varchar as job_id, case when source_url is not null then {TEXT.format('html')} else coalesce(document_text, '') end as content from fx_request)""", "fx_request")
def ingest_jobs(spark, d):
    """All requests as jobs of a stream, run again where a step fails, until none waits."""
    folder = f"{shared_folder(spark)}/jobs-{uuid.uuid4().hex}"
    kind = F.when(F.col("source_url").isNotNull(), "url").otherwise("text")
    t = X.requests(spark, d).select(F.col("page_id").cast("string").alias("job_id"), ingest.payload(kind, F.col("html"), F.col("document_text")).alias("content"))
    t.write.parquet(f"{folder}/in")
    n = spark.read.parquet(f"{folder}/in").count()
    if n:
        q = jobs.start(spark, f"{folder}/in", f"{folder}/out", f"{folder}/state", jobs.steps(_length_reply, str, (1, 1)), every="1 second")
        jobs.drain(q, lambda: jobs.ended(spark, f"{folder}/out").count() >= n)
    return jobs.ended(spark, f"{folder}/out")


def _leaves(spark, d):
    """Documents by id, counted from 0."""
    return ordinals(X.table(spark, d, "documents").select("doc_id", "text"), "doc_id").select("ord", "text")


@query("""with recursive n as (select count(*) as n from documents), l as (select 0 as layer, n as size from n union all select layer + 1, (size + 4) // 5 from l where size > 1)
    select l.layer, i.idx, case when l.size > 1 then i.idx // 5 end as parent_idx, case when l.layer = 0 then 0 else least(5, (select b.size from l b where b.layer = l.layer - 1) - i.idx * 5) end as n_children
    from l, unnest(range(l.size)) i(idx)""")
def raptor_layers(spark, d):
    t = _leaves(spark, d)
    return tree.layers(t, t.count())


@query("select doc_id // 5 as idx, string_agg('Chunk ' || (doc_id % 5 + 1) || ': ' || text, chr(10) || chr(10) order by doc_id) as prompt_text from (select row_number() over (order by doc_id) - 1 as doc_id, text from documents) group by 1")
def raptor_prompt_text(spark, d):
    return tree.prompts(_leaves(spark, d))


TREE = ["l0 as (select row_number() over (order by doc_id) - 1 as idx, text from documents)"]
for _k in range(1, 9):
    TREE.append(f"""l{_k} as (select idx // 5 as idx, left(string_agg('Chunk ' || (idx % 5 + 1) || ': ' || text, chr(10) || chr(10) order by idx), 60) || ' ' || sha256(string_agg('Chunk ' || (idx % 5 + 1) || ': ' || text, chr(10) || chr(10) order by idx)) as text from l{_k - 1} where (select count(*) from l{_k - 1}) > 1 group by 1)""")


@query("with " + ", ".join(TREE) + " " + " union all ".join(f"select {k} as layer, idx, case when (select count(*) from l{k}) > 1 then idx // 5 end as parent_idx, text from l{k}" for k in range(9)))
def raptor_tree(spark, d):
    """The tree with texts folded upwards; a summary is the first 60 characters of a prompt and the digest of all of it here."""
    t = _leaves(spark, d)
    return tree.summaries(t, t.count(), lambda p: p.withColumn("summary", F.concat(text.budget(F.col("prompt_text"), 60), F.lit(" "), F.sha2("prompt_text", 256))))


@query("""select k, name, coalesce(b.boundary_name, 'Unknown') as trust_zone from (select s_suppkey as k, n_name as name from supplier join nation on s_nationkey = n_nationkey union all select -1 - r_regionkey, r_name from region)
    left join fx_boundary b on b.component = name""", "fx_boundary")
def trust_zone_assign(spark, d):
    """Suppliers' nations, and regions, which no boundary holds."""
    s = X.table(spark, d, "supplier").join(X.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("k"), F.col("n_name").alias("name"))
    r = X.table(spark, d, "region").select((-1 - F.col("r_regionkey")).alias("k"), F.col("r_name").alias("name"))
    return vision.trust_zones(s.unionByName(r), X.boundaries(spark, d)).select("k", "name", "trust_zone")


@query("""with b as (select boundary_name, boundary_type, min(pos) as p, string_agg(component, ', ' order by pos) as m from fx_boundary group by 1, 2)
    select 'Architecture Visual Trust Boundaries:' || chr(10) || string_agg('- The ''' || boundary_name || ''' (' || boundary_type || ') explicitly contains: ' || m || '.' || chr(10), '' order by p) as text from b""", "fx_boundary")
def boundary_text(spark, d):
    return vision.boundary_note(X.boundaries(spark, d))


def _diagram(spark, d):
    return llmjson.diagram(X.diagram_replies(spark, d))


def _components(spark, d):
    g = _diagram(spark, d)
    c = g.select("r_regionkey", F.posexplode("g.components").alias("i", "c")).select((F.col("r_regionkey") * 1000 + F.col("i")).alias("pos"), "c.name", "c.type", "c.coordinates", F.col("c.labels_on_box").alias("labels"))
    m = g.select(F.col("r_regionkey").alias("pos"), F.explode("g.trust_boundaries").alias("b")).select("pos", "b.boundary_name", F.explode("b.contained_components").alias("component"))
    return vision.trust_zones(c, m)


def _flows(spark, d):
    return _diagram(spark, d).select(F.explode("g.data_flows").alias("f")).select("f.*")


def _known(spark, d):
    """Nations and suppliers, of which the diagrams show the nations."""
    n = X.table(spark, d, "nation").select(F.col("n_nationkey").alias("ord"), F.concat(F.lit("N"), "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("Known").alias("entity_type"), F.lit("d").alias("description"))
    s = X.table(spark, d, "supplier").select((F.col("s_suppkey") + 1000).alias("ord"), F.concat(F.lit("S"), "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("Known").alias("entity_type"), F.lit("d").alias("description"))
    return n.unionByName(s)


PARTS = """parts as (select n_name as name, 'Nation' as type, r_name as label, r_name as zone, n_nationkey as y, r_regionkey as r from nation join region on n_regionkey = r_regionkey
    union all select 'QQ#' || r_regionkey || '#ZZ', 'Zone', 'z', 'Unknown', 0, r_regionkey from region where r_regionkey in (select n_regionkey from nation))"""


@query(f"""with {PARTS}, n as (select *, row_number() over (partition by r order by type, y) - 1 as pos from parts), m as (select r, count(*) as n from parts group by 1)
    select r as r_regionkey, 'component' as part, pos::int as pos, name as a, type as b, type || '; ' || label as c, printf('%d %d %d %d', y, y, y, y) as d from n
    union all select r, 'flow', case type when 'Nation' then pos else (select n - 1 from m where m.r = n.r) end::int, 'QQ#' || r || '#ZZ', case type when 'Nation' then name else 'NOWHERE' end, 'Reads', case when type = 'Nation' and y % 2 = 0 then 'TCP' else '' end || ' unidirectional' from n
    union all select r, 'boundary', 0, zone, 'VPC', string_agg(name, '; ' order by pos), null from n where type = 'Nation' group by r, zone""")
def diagram_parse(spark, d):
    g = _diagram(spark, d)
    one = lambda part, field, *values: g.select("r_regionkey", F.posexplode(f"g.{field}").alias("pos", "x")).select(
        "r_regionkey", F.lit(part).alias("part"), "pos", *[v.alias(n) for v, n in zip(values, "abcd")])
    x = lambda n: F.col(f"x.{n}")
    at = F.format_string("%d %d %d %d", *[x(f"coordinates.{c}") for c in ("ymin", "xmin", "ymax", "xmax")])
    return (one("component", "components", x("name"), x("type"), F.array_join(x("labels_on_box"), "; "), at)
            .unionByName(one("flow", "data_flows", x("source"), x("target"), x("flow_label"), F.concat_ws(" ", x("protocol"), x("direction"))))
            .unionByName(one("boundary", "trust_boundaries", x("boundary_name"), x("boundary_type"), F.array_join(x("contained_components"), "; "), F.lit(None).cast("string"))))


@query(f"with {PARTS} select name, name || ' (' || type || '): ' || type || '; ' || label as embed_text from parts")
def component_text(spark, d):
    return _components(spark, d).select("name", text.component_text(F.col("name"), F.col("type"), F.col("labels")).alias("embed_text"))


@query(f"with {PARTS} select name, type as entity_type, zone as trust_zone, type || '; ' || label as labels, case type when 'Zone' then 'vision_only' else 'hybrid_merge' end as source from parts")
def vision_merge(spark, d):
    return vision.merge(_components(spark, d), _known(spark, d).select("ord", "name")).drop("visual_name")


@query(f"""with {PARTS} select 'N' || n_nationkey as id, n_name as name, 'Known' as entity_type, 'd' as description, zone as trust_zone, y::int as ymin, 'hybrid_merge' as source from nation join parts on name = n_name
    union all select 'S' || s_suppkey, s_name, 'Known', 'd', null, null, null from supplier
    union all select sha256('["doc","' || name || '","' || (r * 1000 + (select count(*) from nation where n_regionkey = r)) || '"]'), name, 'Zone', '[Vision Extracted] Additional Labels: Zone; z', 'Unknown', 0, 'vision_only' from parts where type = 'Zone'""")
def vision_upsert(spark, d):
    u = vision.upsert(_known(spark, d), _components(spark, d), "doc")
    return u.select("id", "name", "entity_type", "description", "spatial_metadata.trust_zone", F.col("spatial_metadata.coordinates.ymin").alias("ymin"), "spatial_metadata.source")


@query("""select 'QQ#' || n_regionkey || '#ZZ' as source_id, n_name as target_id, case when n_nationkey % 2 = 0 then 'TCP' else 'Reads' end as relation_type, '[Vision Extraction] Flow: Reads (unidirectional)' as description from nation""")
def vision_edges(spark, d):
    merged = vision.merge(_components(spark, d), _known(spark, d).select("ord", "name"))
    return vision.edges(_flows(spark, d), merged)


@query("select distinct 'QQ#' || n_regionkey || '#ZZ' as source, 'NOWHERE' as target from nation")
def vision_missed_edges(spark, d):
    return vision.missed_edges(_flows(spark, d), _components(spark, d).withColumnRenamed("name", "visual_name"))


@query("""select s_suppkey, 'entity' as part, u.pos::int as pos, u.a, u.b, 'd' as c, null as d from supplier join nation on s_nationkey = n_nationkey, (values (0), (1)) p(k),
        lateral (select p.k as pos, case p.k when 0 then s_name else n_name end as a, case p.k when 0 then 'Supplier' else 'Nation' end as b) u where s_suppkey % 6 < 2
    union all select s_suppkey, 'edge', 0, s_name, n_name, 'IN', 'd' from supplier join nation on s_nationkey = n_nationkey where s_suppkey % 6 < 2""")
def graph_parse(spark, d):
    g = llmjson.graph(X.graph_replies(spark, d))
    e = g.select("s_suppkey", F.posexplode("g.entities").alias("pos", "x")).select("s_suppkey", F.lit("entity").alias("part"), "pos", F.col("x.name").alias("a"), F.col("x.type").alias("b"), F.col("x.description").alias("c"), F.lit(None).cast("string").alias("d"))
    f = g.select("s_suppkey", F.posexplode("g.edges").alias("pos", "x")).select(
        "s_suppkey", F.lit("edge").alias("part"), "pos", F.col("x.source_entity").alias("a"), F.col("x.target_entity").alias("b"), F.col("x.relation_type").alias("c"), F.col("x.description").alias("d"))
    return e.unionByName(f)


@query("""select doc_id, 0 as ord, 'R' || doc_id as title, text as actionable_rule, null as is_child_of from documents where doc_id % 9 in (0, 1) and text is not null
    union all select doc_id, 1, 'C', coalesce(source, '-'), 'R' || doc_id from documents where doc_id % 9 = 0 and text is not null""")
def requirements_parse(spark, d):
    return llmjson.requirements(X.requirement_replies(spark, d)).drop("reply")


@query("""select 'requirements' as kind, doc_id as id, case doc_id % 9 when 2 then '$.requirements[0].actionable_rule: missing' when 3 then '$: not JSON' when 5 then '$.requirements[0].title: string expected'
        when 6 then '$.requirements[0].actionable_rule: string expected' when 7 then '$: not JSON' else '$.requirements[2].is_child_of: string expected' end as reason from documents where doc_id % 9 not in (0, 1, 4)
    union all select 'graph', s_suppkey, case s_suppkey % 6 when 2 then '$.entities[0].type: missing' when 3 then '$.entities[0].name: string expected' when 4 then '$.edges: missing' else '$: not JSON' end from supplier where s_suppkey % 6 > 1
    union all select 'diagram', r * 10 + v, case v when 3 then '$.components[0].coordinates.ymin: missing' when 4 then '$.components[0].coordinates.ymin: whole number expected' when 5 then '$.components[0].coordinates.xmax: whole number expected'
        when 6 then '$.trust_boundaries[0].boundary_name: missing' else '$.data_flows[0]: object expected' end from (select distinct n_regionkey as r from nation), range(3, 8) t(v)""")
def reply_rejects(spark, d):
    """Replies that do not fit their schema, and why."""
    one = lambda name, t, schema, key: llmjson.rejects(t, schema).select(F.lit(name).alias("kind"), key.cast("long").alias("id"), "reason")
    return (one("requirements", X.requirement_replies(spark, d), llmjson.REQUIREMENTS, F.col("doc_id")).unionByName(one("graph", X.graph_replies(spark, d), llmjson.GRAPH, F.col("s_suppkey")))
            .unionByName(one("diagram", X.diagram_variants(spark, d), llmjson.DIAGRAM, F.col("r_regionkey") * 10 + F.col("variant"))))


@query("select event_id, case event_id % 4 when 3 then 'no json' else trim(props) end as cleaned from events")
def clean_llm_json(spark, d):
    return X.replies(spark, d).select("event_id", text.clean_llm_json(F.col("reply")).alias("cleaned"))


@query("select event_id, case event_id % 4 when 3 then 'no json' else trim(props) end as json, event_id % 4 <> 3 as parses from events")
def fenced_json(spark, d):
    j = text.fenced_json(F.col("reply"))
    return X.replies(spark, d).select("event_id", j.alias("json"), text.is_json(j).alias("parses"))


@query("select doc_id, doc_id % 9 in (3, 5, 6, 8) as valid from documents join labels using (doc_id)")
def validity_fallback(spark, d):
    return X.feedback_replies(spark, d).select("doc_id", text.says_valid(F.col("reply")).alias("valid"))


@query("""select event_id, 0 as pos, 'E' || event_id as threat_id, event_type as category, 'user-' || user_id as target_component, props as attack_vector, value as cvss_estimate, 0.9::double as confidence from events where event_id % 10 in (0, 4, 5, 6)
    union all select event_id, 0, 'T-001', 'Elevation_of_Privilege', event_type, '', 5.0, 0.5 from events where event_id % 10 = 1
    union all select event_id, 2, null, 'Elevation_of_Privilege', 'Unknown', '', 7.0, 0.5 from events where event_id % 10 = 1""")
def threat_parse(spark, d):
    return llmjson.threats(X.threat_replies(spark, d)).drop("reply")


@query("""with f as (select doc_id, doc_id % 9 as k, quality, text, source from documents join labels using (doc_id))
    select doc_id, case when k in (2, 3, 5, 6) then true when k = 8 then true when k = 7 then false else quality = 1 end as is_valid,
        case k when 0 then coalesce(text, 'No reason provided') when 3 then 'I find Is_Valid: TRUE in ' || doc_id when 5 then '"is_valid": true' when 6 then 'true, so is_valid: true' when 7 then 'None' when 8 then '{"is_valid": true} or not' else 'No reason provided' end as validation_reason,
        case k when 0 then 'Critical' when 2 then 'Low' when 7 then null else 'High' end as adjusted_severity,
        case when k = 0 then coalesce(source, 'Unknown') when k in (3, 5, 6, 8) then 'Extracted via regex fallback' when k = 7 then 'True' else 'Unknown' end as citation_reference from f where k <> 4""")
def feedback_parse(spark, d):
    return llmjson.feedback(X.feedback_replies(spark, d)).drop("reply")


@query("""with full_ as (select event_id, 'E' || event_id as threat_id, event_type as category, 'API' as target_component, props as attack_vector, 'Critical' as severity, 'rotate keys' as mitigation_strategy, 'A, ' || event_type as citations, event_id % 8 as k from events)
    select * exclude (k), 0 as pos from full_ where k in (0, 3)
    union all select event_id, '', 'Unknown', 'Unknown', '', 'High', '', '', 1 from full_ where k = 0
    union all select event_id, 'T', 'Unknown', 'Unknown', '', 'High', '', '', 0 from full_ where k = 1
    union all select event_id, 'N', null, 'Unknown', '', 'High', null, 'A', 0 from full_ where k = 6
    union all select event_id, '', 'Unknown', 'Unknown', '', 'High', '', null, 1 from full_ where k = 6""")
def report_from_recommendations(spark, d):
    t = llmjson.recommendations(X.recommendation_replies(spark, d)).drop("reply")
    return t.withColumn("citations", F.array_join("citations", ", "))


@query("select event_id, case when k = 6 then 'of ' || event_id end as executive_summary, case when k = 6 then '2' end as critical_count, null as total_threats from (select event_id, event_id % 8 as k from events) where k not in (2, 4)")
def report_header(spark, d):
    return llmjson.report_header(X.recommendation_replies(spark, d)).select("event_id", "executive_summary", "critical_count", "total_threats")


@query("select threat_id, ordinal, is_valid from (select *, row_number() over (partition by threat_id order by ordinal desc) as r from fx_feedback) where r = 1", "fx_feedback")
def feedback_last_wins(spark, d):
    return dedup.last_by(X.feedback(spark, d), ["threat_id"], "ordinal").select("threat_id", "ordinal", "is_valid")


@query("select max(recursion_iteration) as final_loop from fx_feedback", "fx_feedback")
def final_loop(spark, d):
    return X.feedback(spark, d).agg(F.max("recursion_iteration").alias("final_loop"))


@query("""select c.count_now, case when c.count_now < 2 and count(*) filter (where not f.is_valid) > 0 then 'hunter' else 'mediator' end as next, count(f.ordinal) as feedbacks,
    count(*) filter (where not f.is_valid) as rejected from (values (1), (2)) c(count_now) left join fx_feedback f on f.recursion_iteration < c.count_now group by 1""", "fx_feedback")
def debate_route(spark, d):
    f = X.feedback(spark, d)
    one = lambda n: debate.route(f.filter(F.col("recursion_iteration") < n), n, 2).select(F.lit(n).alias("count_now"), "next", "feedbacks", "rejected")
    return one(1).unionByName(one(2))


@query("select recursion_iteration, count(*) as feedbacks, count(*) filter (where not is_valid) as rejected from fx_feedback where recursion_iteration < 2 group by 1", "fx_feedback")
def debate_rounds(spark, d):
    f, t = X.feedback(spark, d), X.threats(spark, d)
    _, found, _ = debate.review(lambda n, seen: t, lambda threats, n: f.filter(F.col("recursion_iteration") == n).join(threats.select("threat_id"), "threat_id", "left_semi"), 2)
    return found.groupBy("recursion_iteration").agg(F.count(F.lit(1)).alias("feedbacks"), F.count_if(~F.col("is_valid")).alias("rejected"))


VALID = """v as (select * from (select *, row_number() over (partition by threat_id order by ordinal desc) as r from fx_feedback where is_valid and recursion_iteration = (select max(recursion_iteration) from fx_feedback)) where r = 1)"""


@query(f"with {VALID} select event_id, threat_id from fx_threat where threat_id in (select threat_id from v)", "fx_threat", "fx_feedback")
def valid_threats(spark, d):
    return debate.valid_threats(X.threats(spark, d), X.feedback(spark, d)).select("event_id", "threat_id")


BASIC = f"""{VALID}, b as (select t.event_id, t.threat_id, t.category, t.target_component, t.attack_vector, v.adjusted_severity as severity,
    'Implement controls aligned with ' || v.citation_reference as mitigation_strategy, v.citation_reference as citations from fx_threat t join v using (threat_id))"""
RANK = "coalesce(list_position(['Critical','High','Medium','Low','Informational'], severity) - 1, 5)"


@query(f"with {BASIC} select * from b", "fx_threat", "fx_feedback")
def final_report_basic(spark, d):
    return debate.basic_report(X.threats(spark, d), X.feedback(spark, d)).withColumn("citations", F.array_join("citations", ", "))


@query(f"""with {BASIC} select '# Threat Model Report' || chr(10) || chr(10) || '## Threat Summary' || chr(10) || chr(10) || '- **Total Threats:** ' || count(*) || chr(10) || '- **Critical:** 0' || chr(10) || '- **High:** 0' || chr(10)
    || '- **Medium:** 0' || chr(10) || chr(10) || '## Detailed Findings' || chr(10) || chr(10) || string_agg('### [' || upper(severity) || '] ' || threat_id || ': ' || target_component || chr(10) || chr(10) || '**Category:** ' || category || chr(10) || chr(10)
    || '**Attack Vector:** ' || attack_vector || chr(10) || chr(10) || '**Mitigation Strategy:**' || chr(10) || mitigation_strategy || chr(10) || chr(10) || '**References:**' || chr(10) || '- ' || citations || chr(10) || chr(10) || '---' || chr(10) || chr(10), ''
    order by {RANK}, event_id) as markdown from b""", "fx_threat", "fx_feedback")
def markdown_report(spark, d):
    return debate.markdown(debate.basic_report(X.threats(spark, d), X.feedback(spark, d)))


@query(f"with {BASIC} select count(*) as n from b where threat_id not in (select threat_id from v)", "fx_threat", "fx_feedback")
def report_excludes_invalid(spark, d):
    r = debate.basic_report(X.threats(spark, d), X.feedback(spark, d))
    return r.select("threat_id").join(debate.valid_feedback(X.feedback(spark, d)), "threat_id", "left_anti").agg(F.count(F.lit(1)).alias("n"))


@query("select string_agg('- Rejected Threat ' || threat_id || ': ' || validation_reason, chr(10) order by ordinal) as digest from fx_feedback where not is_valid", "fx_feedback")
def rejection_digest(spark, d):
    return debate.rejections(X.feedback(spark, d))


@query("""select event_id, target_component || ' architecture ' || category || ' threat vulnerability mitigation. Attack vector: ' || left(attack_vector, 50) || '. NIST OWASP security controls guidelines.' as kb_query from fx_threat""", "fx_threat")
def kb_query_text(spark, d):
    return X.threats(spark, d).select("event_id", text.kb_query_text(F.col("target_component"), F.col("category"), F.col("attack_vector")).alias("kb_query"))


@query("""select ordinal, coalesce(list_position(['Critical','High','Medium','Low','Informational'], adjusted_severity) - 1, 5)::int as severity_rank, row_number() over (order by severity_rank, ordinal) as place from fx_feedback""", "fx_feedback")
def severity_sort(spark, d):
    f = X.feedback(spark, d).select("ordinal", debate.severity_rank(F.col("adjusted_severity")).alias("severity_rank"))
    return ordinals(f, "severity_rank", "ordinal", out="place").select("ordinal", "severity_rank", (F.col("place") + 1).cast("long").alias("place"))


FINDING = """'### [' || upper(severity) || '] ' || threat_id || ': ' || target_component || chr(10) || chr(10) || '**Category:** ' || category || chr(10) || chr(10) || '**Attack Vector:** ' || attack_vector || chr(10) || chr(10)
    || '**Mitigation Strategy:**' || chr(10) || mitigation_strategy || chr(10) || chr(10) || '**References:**' || chr(10) || '- ' || citations || chr(10) || chr(10) || '---' || chr(10) || chr(10)"""


@query(f"""with {BASIC}, o as (select (row_number() over (order by {RANK}, event_id) - 1) // 100 + 1 as part, row_number() over (order by {RANK}, event_id) as k, {FINDING} as t from b),
    p as (select part, string_agg(t, '' order by k) as text from o group by 1 union all select 0, '# Threat Model Report' || chr(10) || chr(10) || '## Executive Summary' || chr(10) || chr(10) || 'In brief.' || chr(10) || chr(10) || '## Threat Summary' || chr(10) || chr(10)
        || '- **Total Threats:** 7' || chr(10) || '- **Critical:** ' || (select count(*) from region) || chr(10) || '- **High:** 0' || chr(10) || '- **Medium:** 0' || chr(10) || chr(10) || '## Detailed Findings' || chr(10) || chr(10))
    select part::bigint as part, coalesce(sum(strlen(text)) over (order by part rows between unbounded preceding and 1 preceding), 0)::bigint as start, text from p""", "fx_threat", "fx_feedback")
def markdown_parts(spark, d):
    """The report in parts of 100 findings, with a reply's summary and counts at its head."""
    said = F.concat(F.lit('{"executive_summary":"In brief.","total_threats":7,"critical_count":'), F.count(F.lit(1)).cast("string"), F.lit("}"))
    header = llmjson.report_header(X.table(spark, d, "region").agg(said.alias("reply")))
    return debate.markdown_parts(debate.basic_report(X.threats(spark, d), X.feedback(spark, d)), header=header, rows=100)


@query("""with o as (select row_number() over (order by ordinal) - 1 as k, '- Rejected Threat ' || threat_id || ': ' || validation_reason as t from fx_feedback where not is_valid),
    p as (select k // 50 as part, string_agg(case when k > 0 then chr(10) else '' end || t, '' order by k) as text from o group by 1)
    select part::bigint as part, coalesce(sum(strlen(text)) over (order by part rows between unbounded preceding and 1 preceding), 0)::bigint as start, text from p""", "fx_feedback")
def rejection_parts(spark, d):
    return debate.rejection_parts(X.feedback(spark, d), 50)


@query(f"""with {BASIC} select event_id, threat_id, 'Enriched' as category, severity, 'Do ' || threat_id as mitigation_strategy, citations from b""", "fx_threat", "fx_feedback")
def final_report_enriched(spark, d):
    """A reply that holds a recommendation for each valid threat, in the order of events."""
    t, f = X.threats(spark, d), X.feedback(spark, d)
    b = debate.basic_report(t, f)
    rec = F.struct("threat_id", F.lit("Enriched").alias("category"), "target_component", "severity", "attack_vector", F.concat(F.lit("Do "), "threat_id").alias("mitigation_strategy"), "citations")
    reply = b.agg(F.to_json(F.struct(F.lit("s").alias("executive_summary"), F.transform(F.array_sort(F.collect_list(F.struct("event_id", rec.alias("r")))), lambda x: x["r"]).alias("recommendations"))).alias("reply"))
    r = debate.final_report(t, f, reply).drop("event_id").join(t.select("threat_id", "event_id"), "threat_id")
    return r.select("event_id", "threat_id", "category", "severity", "mitigation_strategy", F.array_join("citations", ", ").alias("citations"))


@query(f"with {BASIC} select threat_id, mitigation_strategy from b", "fx_threat", "fx_feedback")
def final_report_fallback(spark, d):
    """Replies that hold no recommendation leave the basic report."""
    none = X.table(spark, d, "region").select(F.concat(F.lit("no report for "), "r_name").alias("reply"))
    return debate.final_report(X.threats(spark, d), X.feedback(spark, d), none).select("threat_id", "mitigation_strategy")


def verdicts(prompts: list[str]) -> list:
    """A stand-in for an evaluator: by the last digit of the threat's id no reply, a rejection, an error, or a word that it is valid."""
    ids = [p.split("ID: ")[1].split("\n")[0] for p in prompts]
    for i in ids:
        if i[-1] == "9":
            raise TimeoutError(f"{i} waited in vain " + "." * 100)
    return [None if i[-1] == "7" else '{"is_valid": false, "validation_reason": "no"}' if i[-1] == "3" else "is_valid: true" for i in ids]


@query(f"""with near as (select q.vec_id as event_id, k.id as other, row_number() over (partition by q.vec_id order by {DIST.format('q.embedding', 'k.embedding')} nulls last, k.id) as rk
        from embeddings q join fx_node k on true), c as (select event_id, string_agg(coalesce(n.text_content, ''), chr(10) || chr(10) order by rk) as c from near join fx_node n on n.id = other where rk <= 5 group by 1)
    select t.event_id, sha256(coalesce(c.c, '(No knowledge base results available)')) as context_sha256 from fx_threat t left join c using (event_id)""", "fx_threat", "fx_node")
def threat_context(spark, d):
    return validation.with_context(_threat_vectors(spark, d), X.nodes(spark, d)).select("event_id", F.sha2("kb_context", 256).alias("context_sha256"))


MANY = f"""q as (select vec_id as qid, 'src' || (vec_id % 20) as document_id, embedding from embeddings where vec_id in (select event_id from events)),
    n as (select q.qid, n.text_content as text, round({DIST.format('q.embedding', 'n.embedding')}, 6) as distance, row_number() over (partition by q.qid order by {DIST.format('q.embedding', 'n.embedding')} nulls last, n.id) - 1 as ord from q join fx_node n using (document_id)),
    h as (select qid, id from (select q.qid, e.id, row_number() over (partition by q.qid order by {DIST.format('q.embedding', 'e.embedding')} nulls last, e.id) as r from q join fx_docentity e using (document_id)) where r <= 3),
    x as (select distinct h.qid, {EDGE} as edge from h join fx_edge e on e.source_id = h.id or e.target_id = h.id join fx_docentity s on s.id = e.source_id join fx_docentity t on t.id = e.target_id),
    found as (select qid, ord::int as ord, text, distance from n where ord < 5 union all select qid, 5, 'Architecture Topology Context:' || chr(10) || string_agg(edge, chr(10) order by edge), null from x group by qid)"""


def _many(spark, d):
    """Queries within documents: the vectors of threats."""
    q = _threat_vectors(spark, d).select(F.col("event_id").alias("qid"), F.concat(F.lit("src"), (F.col("event_id") % 20).cast("string")).alias("document_id"), "embedding")
    return q, X.nodes(spark, d), X.document_entities(spark, d), X.edges(spark, d)


@query(f"with {MANY} select qid, ord, sha256(coalesce(text, '')) as text_sha256, length(text)::int as chars, distance from found", "fx_node", "fx_docentity", "fx_edge")
def hybrid_many(spark, d):
    """Hybrid retrieval for all threats at once, each in its document."""
    f = retrieve.hybrid_many(*_many(spark, d))
    return f.select("qid", "ord", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), F.length("text").alias("chars"), F.round("distance", 6).alias("distance"))


@query(f"with {MANY} select qid, left(string_agg(coalesce(text, ''), chr(10) || chr(10) order by ord), 1500) as context from found group by 1", "fx_node", "fx_docentity", "fx_edge")
def critic_contexts(spark, d):
    """What the evaluator reads for each threat, cut before anything is sent."""
    return retrieve.contexts(retrieve.hybrid_many(*_many(spark, d), chars=1500), 1500)


def _threat_vectors(spark, d):
    e = X.table(spark, d, "embeddings").select(F.col("vec_id").alias("event_id"), "embedding")
    return X.threats(spark, d).join(e, "event_id", "left")


@query("""select event_id, threat_id, event_id % 10 <> 3 as is_valid, case event_id % 10 when 7 then 'LLM evaluation failed, assuming valid: no reply' when 9 then 'LLM evaluation failed, assuming valid: ' || left(threat_id || ' waited in vain ' || repeat('.', 100), 100)
    when 3 then 'no' else 'is_valid: true' end as validation_reason, 'High' as adjusted_severity, case when event_id % 10 in (7, 9) then 'Manual review required' when event_id % 10 = 3 then 'Unknown' else 'Extracted via regex fallback' end as citation_reference,
    1 as recursion_iteration from fx_threat""", "fx_threat")
def validate_threats(spark, d):
    t = _threat_vectors(spark, d).withColumn("document_id", F.concat(F.lit("src"), (F.col("event_id") % 20).cast("string")))
    return validation.validate(t, X.nodes(spark, d), verdicts, "topology", 1, entities=X.document_entities(spark, d), edges=X.edges(spark, d))


@query()
def job_result(spark, d):
    r = X.requirement_vectors(spark, d)
    length = X.table(spark, d, "documents").agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    j = dedup.job_result(_decisions(spark, d), r, "kb-ingest-0", length)
    return j.withColumn("decisions", F.size("dedup_decisions")).withColumn("dedup_decisions", F.sha2(F.to_json("dedup_decisions"), 256))


@query("select doc_id, sha256(to_json([source, doc_id::varchar])::varchar) as key from documents")
def natural_key_id(spark, d):
    return X.table(spark, d, "documents").select("doc_id", text.key_id(F.col("source"), F.col("doc_id")).alias("key"))


@query("select page_id, 'data:image/png;base64,' || to_base64(encode(html)) as url from pages")
def image_data_url(spark, d):
    return X.table(spark, d, "pages").select("page_id", text.data_url(F.encode("html", "UTF-8")).alias("url"))


@query("""select event_id, '{' || chr(10) || '  "threat_id": "' || threat_id || '",' || chr(10) || '  "category": "' || category || '",' || chr(10) || '  "target_component": "' || target_component || '"' || chr(10) || '}' as dump from fx_threat""", "fx_threat")
def json_dump(spark, d):
    return X.threats(spark, d).select("event_id", text.json_dump(F.struct("threat_id", "category", "target_component")).alias("dump"))


@query("select id, name from fx_entity order by name, id limit 1", "fx_entity")
def first_entity(spark, d):
    return first_row(X.entities(spark, d), "name", "id").select("id", "name")
