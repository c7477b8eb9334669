"""Summary trees of fixed fan-out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rounds import checkpointed

FANOUT = 5


def depth_of(leaves: int, fanout: int = FANOUT) -> int:
    """Layers above the leaves."""
    n = 0
    while leaves > 1:
        leaves, n = -(-leaves // fanout), n + 1
    return n


def layers(numbered: DataFrame, leaves: int, fanout: int = FANOUT) -> DataFrame:
    """From leaves (ord, counted from 0): (layer, idx, parent_idx, n_children) of all nodes, without a loop: node
    idx of layer L covers the leaves from idx * fanout^L on."""
    depth = depth_of(leaves, fanout)
    size = lambda layer: F.pow(F.lit(float(fanout)), layer).cast("long")
    d = numbered.select("ord", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("layer")).filter(F.col("ord") % size(F.col("layer")) == 0)
    d = d.withColumn("idx", F.floor(F.col("ord") / size(F.col("layer"))).cast("long"))
    below = F.ceil(F.lit(leaves) / size(F.col("layer") - 1)).cast("long")
    children = F.when(F.col("layer") == 0, F.lit(0)).otherwise(F.least(F.lit(fanout), below - F.col("idx") * fanout)).cast("long")
    parent = F.when(F.col("layer") < depth, F.floor(F.col("idx") / fanout).cast("long"))
    return d.select("layer", "idx", parent.alias("parent_idx"), children.alias("n_children"))


def chunk_text(pairs: Column) -> Column:
    """Numbered chunks from an ordered array of texts, a blank line between."""
    return F.array_join(F.transform(pairs, lambda t, i: F.concat(F.lit("Chunk "), (i + 1).cast("string"), F.lit(": "), t)), "\n\n")


def prompts(numbered: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """From (ord, text) the text to summarise for each group: (idx, prompt_text)."""
    g = numbered.groupBy(F.floor(F.col("ord") / fanout).cast("long").alias("idx")).agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("p"))
    return g.select("idx", chunk_text(F.transform("p", lambda x: x["text"])).alias("prompt_text"))


def summaries(numbered: DataFrame, leaves: int, summarise: Callable[[DataFrame], DataFrame], fanout: int = FANOUT) -> DataFrame:
    """The whole tree with its texts: (layer, idx, parent_idx, text). ``numbered`` has (ord, text), counted from 0;
    ``summarise`` adds summary to (idx, prompt_text). A layer is written before the next one reads it; there are
    log(leaves) of them."""
    depth = depth_of(leaves, fanout)
    parent = lambda k: (F.floor(F.col("ord") / fanout) if k < depth else F.lit(None)).cast("long").alias("parent_idx")
    at = numbered.select(F.col("ord").cast("long").alias("ord"), "text")
    row = lambda d, k: d.select(F.lit(k).alias("layer"), F.col("ord").alias("idx"), parent(k), "text")
    out = row(at, 0)
    for k in range(1, depth + 1):
        at = checkpointed(summarise(prompts(at, fanout)).select(F.col("idx").alias("ord"), F.col("summary").alias("text")))
        out = out.unionByName(row(at, k))
    return out
