"""Hybrid retrieval: nearest texts of a document, and the edges around its nearest entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import TOPOLOGY_TITLE
from ..functions.vectors import knn_join, top_k
from .graph import named_edges, one_hop


def hybrid(nodes: DataFrame, entities: DataFrame, edges: DataFrame, query: list[float], document: str, k: int = 5, n_entities: int = 3) -> DataFrame:
    """(ord, text, score, distance): the k nearest texts of the document, then one row with the distinct edges of the nearest
    entities, if there are any. Equal texts are kept."""
    near = top_k(nodes.filter(F.col("document_id") == document), query, k)
    ranked = near.agg(F.array_sort(F.collect_list(F.struct(F.coalesce("distance", F.lit(float("inf"))).alias("d"), "id", "text_content"))).alias("a"))  # k rows
    texts = ranked.select(F.posexplode("a").alias("ord", "r")).select(
        "ord", F.col("r.text_content").alias("text"), F.lit(1.0).alias("score"), F.when(F.col("r.d") != float("inf"), F.col("r.d")).alias("distance"))
    e = one_hop(top_k(entities, query, n_entities), edges, entities)
    note = e.agg(F.sort_array(F.collect_list("edge")).alias("e")).filter(F.size("e") > 0)
    note = note.select(F.lit(k).alias("ord"), F.concat(F.lit(TOPOLOGY_TITLE), F.array_join("e", "\n")).alias("text"), F.lit(1.0).alias("score"), F.lit(None).cast("double").alias("distance"))
    return texts.unionByName(note)


def context(found: DataFrame, chars: int = 1500) -> DataFrame:
    """One row, context: the texts found, a blank line between, cut to a budget."""
    a = F.array_sort(F.collect_list(F.struct("ord", "text")))
    return found.agg(F.substring(F.array_join(F.transform(a, lambda x: F.coalesce(x["text"], F.lit(""))), "\n\n"), 1, chars).alias("context"))


def nearest_within(queries: DataFrame, base: DataFrame, k: int, group: Column | None = None) -> DataFrame:
    """For queries (qid, document_id, embedding) the k nearest of ``base`` (id, document_id, embedding) in the query's document:
    (qid, id, distance, rk). Rows without a vector come last, by id, as in ``top_k``; a query without one finds nothing."""
    here = F.col("document_id") if group is None else group
    q = queries.filter("embedding IS NOT NULL").select(F.col("qid").alias("id"), here.alias("category"), "embedding")
    b = base.select("id", here.alias("category"), "embedding")
    near = knn_join(q, b, k).select(F.col("id").alias("qid"), F.col("other").alias("id"), "distance", F.col("rk").cast("long").alias("rk"))
    # a document with fewer than k vectors: its first rows without one
    some = b.filter("embedding IS NOT NULL").groupBy("category").agg(F.count(F.lit(1)).alias("__n"))
    last = b.filter("embedding IS NULL").withColumn("__r", F.row_number().over(W.partitionBy("category").orderBy("id"))).filter(F.col("__r") <= k)
    last = last.join(some, "category", "left").withColumn("rk", F.coalesce("__n", F.lit(0)) + F.col("__r")).filter(F.col("rk") <= k)
    fill = q.select(F.col("id").alias("qid"), "category").join(last.select("category", "id", "rk"), "category").select("qid", "id", F.lit(None).cast("double").alias("distance"), "rk")
    return near.unionByName(fill)


def hybrid_many(queries: DataFrame, nodes: DataFrame, entities: DataFrame, edges: DataFrame, k: int = 5, n_entities: int = 3, chars: int | None = None) -> DataFrame:
    """``hybrid`` for many queries (qid, document_id, embedding) at once: (qid, ord, text, score, distance).

    A query's id goes through two searches within its document, one step along the edges, and the ordering of its texts.
    ``nodes`` and ``entities`` have document_id; entities without that column belong to all documents. Each entity that
    any query hits has its edges written out once. With ``chars`` texts are cut to it, and of a query's edges only as many
    are kept as could reach it: the same for a reader of the first ``chars`` characters, and no text grows with a hub.
    """
    texts = nodes.select("id", (F.substring("text_content", 1, chars) if chars else F.col("text_content")).alias("text"))
    near = nearest_within(queries, nodes, k).join(texts, "id").select("qid", (F.col("rk") - 1).cast("int").alias("ord"), "text", F.lit(1.0).alias("score"), "distance")

    one = F.lit("") if "document_id" not in entities.columns else None
    hits = nearest_within(queries, entities, n_entities, one).select("qid", "id")
    found = hits.select("id").distinct()
    ends = edges.join(found.withColumnRenamed("id", "source_id"), "source_id", "left_semi").withColumn("__hit", F.col("source_id")).unionByName(
        edges.join(found.withColumnRenamed("id", "target_id"), "target_id", "left_semi").withColumn("__hit", F.col("target_id")))
    lines = named_edges(ends, entities).select(F.col("__hit").alias("id"), "edge").distinct()
    if chars:  # lines that begin behind the budget, counted from an entity's first, begin behind it in a query's note as well
        before = F.coalesce(F.sum(F.length("edge") + 1).over(W.partitionBy("id").orderBy("edge").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        lines = lines.withColumn("__b", before).filter(F.col("__b") < chars).drop("__b")
    # an entity's lines travel as one row, and a query gets one for each of its entities
    lists = lines.groupBy("id").agg(F.collect_list("edge").alias("edges"))
    note = hits.join(lists, "id").groupBy("qid").agg(F.flatten(F.collect_list("edges")).alias("edges"))
    note = note.select("qid", F.concat(F.lit(TOPOLOGY_TITLE), F.array_join(F.sort_array(F.array_distinct("edges")), "\n")).alias("text"))
    note = note.select("qid", F.lit(k).alias("ord"), (F.substring("text", 1, chars) if chars else F.col("text")).alias("text"), F.lit(1.0).alias("score"), F.lit(None).cast("double").alias("distance"))
    return near.unionByName(note)


def contexts(found: DataFrame, chars: int | None = 1500) -> DataFrame:
    """(qid, context): each query's texts in order, a blank line between, cut to a budget."""
    a = found.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("a"))
    text = F.array_join(F.transform("a", lambda x: F.coalesce(x["text"], F.lit(""))), "\n\n")
    return a.select("qid", (F.substring(text, 1, chars) if chars else text).alias("context"))
