"""Diagram readings: trust zones, fuzzy matches with known entities, merged entities, edges, boundary notes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.fuzzy import best_matches, fuzzy_ratio
from ..functions.text import BOUNDARY_TITLE, boundary_sentence, canonical_name, key_id
from .dedup import last_by

THRESHOLD = 0.75


def trust_zones(components: DataFrame, members: DataFrame) -> DataFrame:
    """``components`` (name, ...) with trust_zone: of the boundaries (boundary_name, component, pos) that hold a component the last."""
    w = W.partitionBy("ckey").orderBy(F.col("pos").desc())
    m = members.withColumn("ckey", canonical_name(F.col("component"))).withColumn("__r", F.row_number().over(w)).filter("__r = 1").select("ckey", "boundary_name")
    c = components.withColumn("ckey", canonical_name(F.col("name"))).join(m, "ckey", "left")
    return c.withColumn("trust_zone", F.coalesce("boundary_name", F.lit("Unknown"))).drop("ckey", "boundary_name")


def fuzzy_match(found: DataFrame, known: DataFrame, threshold: float = THRESHOLD, block: int = 5_000) -> DataFrame:
    """(name, match, score, verified): the most similar known name of each found one, the first of equals, if it reaches the
    threshold; ``verified`` counts the pairs of its block that had to be matched character by character.

    ``known`` has (ord, name). Found names meet the known ones in blocks; each block gives only its best, and matches only
    pairs that share enough characters to be it.
    """
    f = found.select(F.col("name")).distinct().withColumn("__c", canonical_name(F.col("name"))).filter("__c IS NOT NULL")
    n, m = known.count(), f.count()
    blocks, rows = max(1, -(-n // block)), max(1, -(-m // block))
    f = f.withColumn("__a", F.pmod(F.xxhash64("name"), F.lit(rows)).cast("int")).withColumn("__b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    k = known.filter("name IS NOT NULL").select("ord", F.col("name").alias("match"), canonical_name(F.col("name")).alias("__k"), F.pmod(F.xxhash64("ord"), F.lit(blocks)).cast("int").alias("__b"))
    k = k.withColumn("__a", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b, out = b.sort_values("ord"), []
        got, verified = best_matches(a["__c"].to_list(), b["__k"].to_list(), threshold) if len(b) else ([None] * len(a), 0)
        ords, names = b["ord"].to_list(), b["match"].to_list()
        for name, x in zip(a["name"], got):
            if x:
                out.append((name, names[x[0]], x[1], ords[x[0]], verified))
        return pd.DataFrame(out, columns=["name", "match", "score", "ord", "verified"]).astype({"score": "float64", "ord": "int64", "verified": "int64"})

    some = f.groupBy("__a", "__b").cogroup(k.groupBy("__a", "__b")).applyInPandas(best, "name string, match string, score double, ord long, verified long")
    w = W.partitionBy("name").orderBy(F.col("score").desc(), "ord")
    return some.withColumn("__r", F.row_number().over(w)).filter("__r = 1").select("name", "match", "score", "verified")


def merge(components: DataFrame, known: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Entities after a diagram: known ones that it shows get its metadata, the others of the diagram are new.

    ``components`` has name, type, labels, trust_zone; ``known`` ord and name.
    """
    m = fuzzy_match(components, known, threshold)
    c = components.join(m.drop("verified"), "name", "left")
    return c.select(
        F.coalesce("match", "name").alias("name"), F.col("name").alias("visual_name"), F.col("type").alias("entity_type"), "trust_zone",
        F.array_join("labels", "; ").alias("labels"), F.when(F.col("match").isNotNull(), "hybrid_merge").otherwise("vision_only").alias("source"))


def edges(flows: DataFrame, entities: DataFrame) -> DataFrame:
    """Flows (source, target, flow_label, protocol, direction) between shown components, names as they stand."""
    s = entities.select(F.col("visual_name").alias("source"), F.col("name").alias("source_id"))
    t = entities.select(F.col("visual_name").alias("target"), F.col("name").alias("target_id"))
    e = flows.join(s, "source").join(t, "target")
    text = F.concat(F.lit("[Vision Extraction] Flow: "), F.col("flow_label"), F.lit(" ("), F.coalesce("direction", F.lit("unidirectional")), F.lit(")"))
    return e.select("source_id", "target_id", F.coalesce(F.nullif(F.col("protocol"), F.lit("")), F.col("flow_label")).alias("relation_type"), text.alias("description"))


def upsert(entities: DataFrame, components: DataFrame, document: str, threshold: float = THRESHOLD) -> DataFrame:
    """``entities`` (ord, id, name, entity_type, description) after a diagram, with spatial_metadata and visual_name: of those
    that it shows what the last component matched to them tells, and a new row for every other component. ``components``
    has pos, name, type, coordinates, labels, trust_zone. Ids of new rows follow from document and name."""
    m = components.join(fuzzy_match(components, entities.select("ord", "name"), threshold).select("name", "match"), "name", "left")
    told = lambda how: F.struct("coordinates", "trust_zone", F.col("labels").alias("labels_on_diagram"), F.lit(how).alias("source"))
    shown = last_by(m.filter("match IS NOT NULL").select("match", "pos", F.col("name").alias("visual_name"), told("hybrid_merge").alias("spatial_metadata")), ["match"], "pos")
    # of known rows with one name the first is the one that was matched
    first = entities.groupBy("name").agg(F.min("ord").alias("ord"))
    shown = shown.join(first, F.col("match") == F.col("name")).select("ord", "visual_name", "spatial_metadata")
    kept = entities.join(shown, "ord", "left").select("id", "name", "entity_type", "description", "visual_name", "spatial_metadata")
    new = m.filter("match IS NULL").select(
        key_id(F.lit(document), F.col("name"), F.col("pos")).alias("id"), "name", F.col("type").alias("entity_type"),
        F.concat(F.lit("[Vision Extracted] Additional Labels: "), F.array_join("labels", "; ")).alias("description"), F.col("name").alias("visual_name"), told("vision_only").alias("spatial_metadata"))
    return kept.unionByName(new)


def missed_edges(flows: DataFrame, entities: DataFrame) -> DataFrame:
    """Flows that an end is not shown for: (source, target)."""
    shown = entities.select("visual_name").distinct()
    both = flows.join(shown.withColumnRenamed("visual_name", "source"), "source", "left_semi").join(shown.withColumnRenamed("visual_name", "target"), "target", "left_semi")
    return flows.select("source", "target").exceptAll(both.select("source", "target"))


def boundary_note(members: DataFrame) -> DataFrame:
    """One row, text: a sentence for each boundary (boundary_name, boundary_type, component, pos) in order."""
    b = members.groupBy("boundary_name", "boundary_type").agg(F.min("pos").alias("first"), F.array_sort(F.collect_list(F.struct("pos", "component"))).alias("m"))
    b = b.withColumn("line", boundary_sentence(F.col("boundary_name"), F.col("boundary_type"), F.array_join(F.transform("m", lambda x: x["component"]), ", ")))
    lines = F.array_sort(F.collect_list(F.struct("first", "line")))
    return b.agg(F.concat(F.lit(BOUNDARY_TITLE), F.array_join(F.transform(lines, lambda x: x["line"]), "")).alias("text"))


__all__ = ["trust_zones", "fuzzy_match", "merge", "edges", "boundary_note", "fuzzy_ratio"]
