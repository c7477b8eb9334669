"""Connected components of a graph of links, by alternating star contractions in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, with_group


def _two_way(e: DataFrame) -> DataFrame:
    return e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))


def connected_components(links: DataFrame, name: str = "links", rounds: int = 60) -> DataFrame:
    """From links (a, b) the table (id, component): every id in a link, with the least id it can reach.

    Each round hangs the larger neighbours of a node on its least one, then its smaller ones. A hub costs a
    row for each of its links, in several places; minima are pre-aggregated. What a round leaves is written to the shared folder.
    """
    e = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, seen = materialize(e, name), None
    for _ in range(rounds):
        both = with_group(_two_way(e), ["u"], "v", F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        hung = with_group(large, ["u"], "v", F.min("v").alias("m"))
        small = hung.filter("v = m").select("u", "m")
        e = hung.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        e = materialize(e, name)
        now = e.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if seen == now:
            break
        seen = now
    else:
        raise RuntimeError("the components did not settle")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
