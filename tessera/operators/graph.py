"""Entities and edges: what is new, how names become ids, which edges stay, and one step from the nearest entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_name, edge_text
from ..functions.vectors import top_k


def new_entities(found: DataFrame, known: DataFrame) -> DataFrame:
    """One row for each canonical name of ``found`` (name, description, ord) that ``known`` has not; its first description."""
    k = known.select(canonical_name(F.col("name")).alias("name")).distinct()
    f = found.withColumn("name", canonical_name(F.col("name"))).join(k, "name", "left_anti")
    return f.groupBy("name").agg(F.min(F.struct("ord", "description")).alias("f")).select("name", F.col("f.description").alias("description"))


def resolve_edges(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """From edges by name (source, target, relation_type, description): those whose both ends are known, by id."""
    names = entities.groupBy(canonical_name(F.col("name")).alias("name")).agg(F.max("id").alias("id"))
    s = names.select(F.col("name").alias("sname"), F.col("id").alias("source_id"))
    t = names.select(F.col("name").alias("tname"), F.col("id").alias("target_id"))
    e = edges.withColumn("sname", canonical_name(F.col("source"))).withColumn("tname", canonical_name(F.col("target")))
    return e.join(s, "sname").join(t, "tname").select("source_id", "target_id", canonical_name(F.col("relation_type")).alias("relation_type"), "description")


def within(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges whose both ends are among the ids (id). Both sides are dealt by id, so a task holds its part of the ids only: columns of ids
    look small in files, and sent to every task they would be in each of them whole."""
    part = lambda end: ids.select(F.col("id").alias(end)).hint("shuffle_hash")
    return edges.join(part("target_id"), "target_id", "left_semi").join(part("source_id"), "source_id", "left_semi").select(*edges.columns)


def named_edges(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges with the text that names their ends."""
    n = entities.select("id", "name")
    e = edges.join(n.select(F.col("id").alias("source_id"), F.col("name").alias("source")), "source_id").join(
        n.select(F.col("id").alias("target_id"), F.col("name").alias("target")), "target_id")
    return e.withColumn("edge", edge_text(F.col("source"), F.col("relation_type"), F.col("target"), F.col("description")))


def one_hop(hits: DataFrame, edges: DataFrame, entities: DataFrame) -> DataFrame:
    """(edge): distinct texts of the edges from and to the hits. The few hits go to the edges, not the reverse."""
    h = F.broadcast(hits.select(F.col("id").alias("__id")))
    touching = edges.join(h, F.col("source_id") == F.col("__id"), "left_semi").unionByName(edges.join(h, F.col("target_id") == F.col("__id"), "left_semi"))
    return named_edges(touching, entities).select("edge").distinct()


def nearest_entities(entities: DataFrame, query: list[float], k: int = 3) -> DataFrame:
    return top_k(entities, query, k)
