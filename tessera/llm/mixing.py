"""Mixing sources to target weights: weighted fair queueing.

Every document of a shuffled source, and up to two repeats of it, gets a virtual finish time: the source's
words up to its end, divided by the source's target. All copies are sorted by that time in ranges of it, and
the mix takes them until the total budget is used. Sources thus advance in proportion to their targets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize, n_words, prefix_sums

MAX_REPEAT = 3
BUCKETS = 4096  # ranges of the shuffle within a source, and of virtual time in the mix


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """From (source, source_size) the target of each source: one row per source, the only rows of this step.

    Weights go round in code-point order of the sources, null last. A target stops at ``max_repeat`` times its
    source; what is above is shared again by weight until none is above. In closed form: by rising
    size/weight the first k sources stop, k the least for which the rest's level stops no more of them.
    Empty sources get 0.
    """
    w = W.orderBy(F.col("source").isNull(), F.col("source"))
    s = sizes.withColumn("__i", F.row_number().over(w) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("__i") % len(weights) + 1).cast("int")).cast("long"))
    s = s.withColumn("__cap", F.col("source_size") * max_repeat)
    everything = W.partitionBy()
    s = s.withColumn("__budget", F.sum("source_size").over(everything) * F.lit(float(share)))
    r = W.orderBy(F.col("__cap") / F.col("weight"), "__i")
    # with the sources before this one stopped, the level that the rest would get
    before = r.rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("__stopped", F.coalesce(F.sum("__cap").over(before), F.lit(0)))
    s = s.withColumn("__rest", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    s = s.withColumn("__level", (F.col("__budget") - F.col("__stopped")) / F.col("__rest"))
    free = F.col("__cap") / F.col("weight") >= F.col("__level")
    # the first free source in rising order of cap/weight sets the level of all free ones
    first = F.first(F.when(free, F.col("__level")), ignorenulls=True).over(r.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    s = s.withColumn("__at", first)
    target = F.when(F.col("__at").isNull(), F.col("__cap").cast("double")).otherwise(F.least(F.col("__cap").cast("double"), F.col("weight") * F.col("__at")))
    return s.select("source", "source_size", "weight", target.alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, max_repeat: int = MAX_REPEAT,
                seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, source, size (words), source_size, target, copies, taken (words).

    Null text has size 0, a null source is a source of its own, null ids and repeated rows are rows like any
    other (equal rows are interchangeable), documents without words are taken zero words, an empty table gives
    no rows. Other columns are ignored. The shuffle is a hash of id and size, so reruns agree.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("size").cast("string")))
    d = materialize(d.withColumn("__h", key).withColumn("__b", F.substring("__h", 1, 3)), "sizes")
    t = source_targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_repeat)
    t = materialize(t, "targets").withColumnRenamed("source", "__source")
    c = prefix_sums(d, ["source"], "__b", ["__h", "doc_id"], F.col("size"), "__end")
    # a total over rows of equal order may fall in either order; such rows are equal in id and size
    c = c.join(t, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    c = materialize(c.withColumn("__row", F.struct("__h", "doc_id", "source", "__end")), "queue")
    v = c.filter("size > 0 AND target > 0").withColumn("__epoch", F.explode(F.sequence(F.lit(0), F.lit(max_repeat - 1))))
    done = F.col("__epoch") * F.col("source_size") + F.col("__end")
    v = v.withColumn("__finish", done / F.col("target")).filter((done - F.col("size")) < F.col("target"))
    v = v.withColumn("__range", F.least(F.floor(F.col("__finish") * (BUCKETS - 1)), F.lit(2 * BUCKETS)).cast("int"))
    v = v.select("doc_id", "source", "__h", "__end", "size", "__epoch", "__finish", "__range")
    v = prefix_sums(v, [], "__range", ["__finish", "source", "__h", "doc_id", "__epoch"], F.col("size"), "__total")
    budget = t.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0]  # one number
    v = v.filter(F.col("__total") <= F.lit(budget + 1e-6))
    n = v.groupBy("doc_id", "source", "__h", "__end").agg(F.count(F.lit(1)).alias("copies"), F.max("__epoch").alias("__last"))
    n = n.select(*[F.col(x).alias(f"n_{x}") for x in n.columns])
    on = [F.col(x).eqNullSafe(F.col(f"n_{x}")) for x in ("doc_id", "source", "__h", "__end")]
    out = c.join(n, on, "left").withColumn("copies", F.coalesce(F.col("n_copies"), F.lit(0)).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
