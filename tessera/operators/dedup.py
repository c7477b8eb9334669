"""Deduplication of requirements against a knowledge base: exact, semantic with fuzzy titles, and the ordered fold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.fuzzy import reaches
from ..functions.text import normalize_text, with_normalized
from ..functions.vectors import clamp_similarity, knn_join
from .rounds import checkpointed

EXACT, SEMANTIC, TITLE, NEAREST = 1.0, 0.90, 0.75, 5
KEEP = 4  # times k: the close rows before a row that it has at hand


def exact_matches(incoming: DataFrame, kb: DataFrame) -> DataFrame:
    """(id, node_id): the first row of the knowledge base with the category, title and rule of an incoming one."""
    keys = lambda d: with_normalized(d.select("id", "category", "title", "rule"), t=F.col("title"), r=F.col("rule")).select("id", "category", F.sha2(F.concat_ws("\x1f", "t", "r"), 256).alias("key"))
    first = keys(kb).groupBy("category", "key").agg(F.min("id").alias("node_id"))
    return keys(incoming).join(first, ["category", "key"]).select("id", "node_id")


def semantic_matches(incoming: DataFrame, kb: DataFrame, semantic: float = SEMANTIC, title: float = TITLE, k: int = NEAREST) -> DataFrame:
    """(id, other, similarity): of the k nearest rows, cut before any test, the nearest that passes both."""
    near = knn_join(incoming, kb, k).withColumn("similarity", clamp_similarity(F.col("distance"))).filter(F.col("similarity") >= semantic)
    t = near.join(incoming.select("id", F.col("title").alias("t1")), "id").join(kb.select(F.col("id").alias("other"), F.col("title").alias("t2")), "other")
    t = t.filter(reaches(normalize_text(F.col("t1")), normalize_text(F.col("t2")), title))
    best = t.groupBy("id").agg(F.min(F.struct("rk", "other", "similarity")).alias("b"))
    return best.select("id", "b.other", "b.similarity")


def _passes(pairs: DataFrame, incoming: DataFrame, others: DataFrame, title: float) -> DataFrame:
    """(id, other, own, distance, passes): pairs with whether their titles are alike."""
    own = pairs.join(incoming.select("id", normalize_text(F.col("title")).alias("t1")), "id").join(others.select(F.col("id").alias("other"), normalize_text(F.col("title")).alias("t2")), "other")
    return own.select("id", "other", "own", "distance", reaches("t1", "t2", title).alias("passes"))


def fold_candidates(incoming: DataFrame, earlier: DataFrame, semantic: float, title: float, keep: int) -> DataFrame:
    """(id, other, own, distance, passes, reach): the ``keep`` nearest of the close rows among ``earlier``, rows that came in before
    a row of ``incoming`` (both with copies, a number for each key) and have another key; ``passes`` if the titles are
    alike too. ``reach`` is the last of ``keep`` rows, behind which there may be more; null if these are all."""
    near = knn_join(incoming, earlier, keep, least=semantic, earlier=True, apart="copies")
    reach = F.max(F.struct("distance", "other")).over(W.partitionBy("id"))
    near = near.withColumn("reach", F.when(F.max("rk").over(W.partitionBy("id")) == keep, reach)).withColumn("own", F.lit(True))
    return _passes(near, incoming, earlier, title).join(near.select("id", "other", "reach"), ["id", "other"])


def _key():
    return F.sha2(F.concat_ws("\x1f", normalize_text(F.col("title")), normalize_text(F.col("rule"))), 256)


def fold_decisions(incoming: DataFrame, kb: DataFrame, semantic: float = SEMANTIC, title: float = TITLE, k: int = NEAREST) -> DataFrame:
    """(id, category, decision, node_id, similarity): decisions in the order of ids within a category, an inserted row being
    visible to all after it.

    The order is a dependency of few rows on few others, so the fold runs in rounds of joins, all rows side by side. A row is
    decided as soon as no earlier undecided row can change its decision: it is skipped if its key was inserted, merged if
    its nearest visible candidate stands among the k nearest and no undecided one stands before it, inserted if none can
    be eligible. The first undecided row of a category always is, so the rounds end; how many there are follows from the
    longest chain of close rows, not from their number. Copies of one row with one vector do not wait for each other
    where a merge is sure. Nothing is collected for a category or a row.

    Of the close rows before it a row has the ``KEEP`` * k nearest at hand, as candidates that are skipped or merged drop out; a row
    with fewer than k of them left, and more behind them, is given the nearest of those that have not dropped out. So the
    pairs that are written grow with the rows, however many are close.
    """
    keep = KEEP * k
    d = incoming.select("id", "category", _key().alias("key"), F.xxhash64("embedding").alias("v"))
    exact = exact_matches(incoming, kb)
    d = d.join(exact, "id", "left")
    # copies that come after a row of their key: whether all rows of the key have one vector
    same = d.filter("node_id IS NULL").groupBy("category", "key").agg((F.min("v") == F.max("v")).alias("alike"), F.min("id").alias("copies"))
    d = d.join(same, ["category", "key"], "left")
    out = ["id", "category", "decision", "node_id", "similarity"]
    decided = d.filter("node_id IS NOT NULL").select("id", "category", F.lit("SKIP").alias("decision"), "node_id", F.lit(1.0).alias("similarity"))
    left = checkpointed(d.filter("node_id IS NULL").select("id", "category", "key", "copies", "alike"))
    rows = checkpointed(incoming.select("id", "category", "title", "embedding").join(left.select("id", "copies"), "id"))
    # seen: what is still to be told of candidates; a candidate that was skipped or merged is none
    near = knn_join(rows, kb, k).filter(clamp_similarity(F.col("distance")) >= semantic).select("id", "other", F.lit(False).alias("own"), "distance")
    own = checkpointed(fold_candidates(rows, rows, semantic, title, keep))
    seen = checkpointed(_passes(near, rows, kb, title).withColumn("visible", F.lit(True)).unionByName(own.drop("reach").withColumn("visible", F.lit(False))))
    reach = lambda d: d.filter("reach IS NOT NULL").groupBy("id").agg(F.min("reach").alias("reach"))
    reached = checkpointed(reach(own))
    inserted = left.select("category", "key", F.lit(None).cast("long").alias("node_id")).limit(0)  # keys inserted so far
    parts = [decided]
    more = reached.limit(1).count() > 0
    # up to its reach a row's candidates are all that there are
    sure = lambda: seen.join(reached, "id", "left").filter(F.col("reach").isNull() | (F.struct("distance", "other") <= F.col("reach")))
    while left.limit(1).count():
        order = W.partitionBy("id").orderBy("distance", "other", "own")
        c = sure().withColumn("rk", F.row_number().over(order))
        c = c.withColumn("before", F.sum(F.col("visible").cast("int")).over(order.rowsBetween(W.unboundedPreceding, -1)))
        of = c.groupBy("id").agg(
            F.min(F.when(F.col("visible") & F.col("passes"), F.struct("rk", "other", "own", "distance"))).alias("best"),
            F.min(F.when(~F.col("visible") & F.col("passes"), F.col("rk"))).alias("unknown"),
            F.coalesce(F.bool_or(F.col("passes") & (F.coalesce("before", F.lit(0)) < k)), F.lit(False)).alias("hope"), F.count_if("visible").alias("n"))
        r = left.join(of, "id", "left").join(inserted, ["category", "key"], "left").join(reached, "id", "left")
        first = left.groupBy("category", "key").agg(F.min("id").alias("first"))  # of undecided rows with a key
        r = r.join(first, ["category", "key"])
        waits = F.col("first") < F.col("id")
        # best stands for sure among the k nearest, and nothing can come before it
        merge = F.col("best").isNotNull() & (F.col("best.rk") <= k) & (F.col("unknown").isNull() | (F.col("best.rk") < F.col("unknown")))
        alike = F.col("alike") & (~F.col("best.own") | (F.col("best.other") < F.col("first")))
        similarity = F.least(F.lit(1.0), 1.0 - F.col("best.distance"))
        hope = F.coalesce("hope", F.lit(False)) | (F.col("reach").isNotNull() & (F.coalesce("n", F.lit(0)) < k))
        does = F.when(F.col("node_id").isNotNull(), "SKIP").when(waits & ~F.coalesce(merge & alike, F.lit(False)), None).when(merge & (similarity > 0), "MERGE").when(merge | ~hope, "INSERT")
        r = r.withColumn("decision", does).filter("decision IS NOT NULL")
        now = checkpointed(r.select("id", "category", "key", "decision", F.coalesce("node_id", F.when(F.col("decision") == "MERGE", F.col("best.other")).otherwise(F.col("id"))).alias("node_id"),
                                    F.when(F.col("decision") == "SKIP", 1.0).when(F.col("decision") == "MERGE", F.round(similarity, 4)).alias("similarity")))
        parts.append(now.select(*out))
        inserted = checkpointed(inserted.unionByName(now.filter("decision = 'INSERT'").select("category", "key", "node_id")))
        left = checkpointed(left.join(now.select("id"), "id", "left_anti"))
        told = now.select(F.col("id").alias("other"), F.lit(True).alias("own"), (F.col("decision") == "INSERT").alias("__in"))
        seen = seen.join(now.select("id"), "id", "left_anti").join(told, ["other", "own"], "left").filter("__in IS NULL OR __in")
        seen = checkpointed(seen.withColumn("visible", F.col("visible") | F.col("__in").isNotNull()).drop("__in"))
        if more:
            there = sure().groupBy("id").agg(F.count(F.lit(1)).alias("n"))
            short = checkpointed(reached.join(left.select("id"), "id", "left_semi").join(there, "id", "left").filter(F.coalesce("n", F.lit(0)) < k).select("id"))
            if short.limit(1).count():
                stay = left.select("id").unionByName(inserted.select(F.col("node_id").alias("id")))
                own = checkpointed(fold_candidates(rows.join(short, "id", "left_semi"), rows.join(stay, "id", "left_semi"), semantic, title, keep))
                known = inserted.select(F.col("node_id").alias("other"), F.lit(True).alias("visible"))
                again = own.drop("reach").join(known, "other", "left").withColumn("visible", F.coalesce("visible", F.lit(False)))
                seen = checkpointed(seen.join(short.withColumn("own", F.lit(True)), ["id", "own"], "left_anti").unionByName(again))
                reached = checkpointed(reached.join(short, "id", "left_anti").unionByName(reach(own)))
    return reduce(DataFrame.unionByName, parts)


def decision_counts(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


def ingest_summary(decisions: DataFrame, job_id: str) -> DataFrame:
    n = lambda what: F.count_if(F.col("decision") == what)
    return decisions.agg(
        F.lit(job_id).alias("job_id"), F.lit("completed").alias("status"), F.count(F.lit(1)).alias("graph_nodes_extracted"),
        n("INSERT").alias("nodes_inserted"), n("MERGE").alias("nodes_merged"), n("SKIP").alias("nodes_skipped"))


def job_result(decisions: DataFrame, titles: DataFrame, job_id: str, raw_text_length: int) -> DataFrame:
    """One row: the summary, the length of the text, and all decisions in the order of ids. ``titles`` has (id, title)."""
    kind = F.col("decision")
    reason = F.when(kind == "SKIP", "Exact match").when(kind == "MERGE", "Semantic match").otherwise("New requirement")
    d = decisions.join(titles.select("id", "title"), "id", "left").select("id", "decision", F.struct(
        "title", "decision", "node_id", F.when(kind == "MERGE", F.col("node_id")).alias("merged_into"), F.col("similarity").alias("similarity_score"), reason.alias("reason")).alias("d"))
    all_of = F.transform(F.array_sort(F.collect_list(F.struct("id", "d"))), lambda x: x["d"]).alias("dedup_decisions")
    return ingest_summary(d, job_id).join(d.agg(F.lit(raw_text_length).cast("long").alias("raw_text_length"), all_of), F.lit(True))  # one row each


def last_by(d: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of rows with a key the last, as when a map is filled in order."""
    return d.withColumn("__r", F.row_number().over(W.partitionBy(*key).orderBy(F.col(order).desc()))).filter("__r = 1").drop("__r")
