"""Parents and children: which parent a row gets, rows whose parent is missing, trees, and deletion of subtrees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import normalize_text
from .dedup import last_by
from .rounds import checkpointed


def _titles(d: DataFrame) -> DataFrame:
    """By normalised title the node of the last row that has it."""
    return last_by(d.withColumn("tkey", normalize_text(F.col("title"))), ["tkey"], "id").select("tkey", F.col("id").alias("node"), "confidence")


def _shuffled(d: DataFrame) -> DataFrame:
    """A side of a join that is never sent whole to the driver: columns of ids, and titles made of them, take so few bytes in files that
    many rows look small."""
    return d.hint("merge")


def resolve_parents(d: DataFrame) -> DataFrame:
    """From (id, title, is_child_of, confidence): (node, parent). Of several parents the surest, then the first."""
    t = _titles(d)
    c = d.filter("is_child_of <> ''").select("id", normalize_text(F.col("title")).alias("ckey"), normalize_text(F.col("is_child_of")).alias("pkey"))
    own, above = t.select(F.col("tkey").alias("ckey"), F.col("node")), t.select(F.col("tkey").alias("pkey"), F.col("node").alias("parent"), "confidence")
    c = c.join(_shuffled(own), "ckey").join(_shuffled(above), "pkey")
    w = W.partitionBy("ckey").orderBy(F.col("confidence").desc(), "id")
    return c.withColumn("__r", F.row_number().over(w)).filter("__r = 1").select("node", "parent")


def orphans(d: DataFrame) -> DataFrame:
    """Rows that name a parent that no row has as its title."""
    t = _titles(d).select(F.col("tkey").alias("pkey"))
    return d.filter("is_child_of <> ''").withColumn("pkey", normalize_text(F.col("is_child_of"))).join(_shuffled(t), "pkey", "left_anti").drop("pkey")


def trees(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """From nodes (id) and links (node, parent), one parent a node: (id, root, depth), however deep. A node on a cycle or
    below one, or below a row that is not there, has no root and is left out; ``cycles`` tells the first two.

    Each round the rows without a root take their ancestor's ancestor, so a chain of n rows takes about log2(n)
    rounds; what no root is found for by then is on a cycle.
    """
    links = links.filter("node <> parent")
    left = checkpointed(links.select(F.col("node").alias("id"), F.col("parent").alias("up"), F.lit(1).cast("long").alias("steps")))
    n = left.count()
    done = checkpointed(nodes.join(_shuffled(left), "id", "left_anti").select("id", F.col("id").alias("root"), F.lit(0).cast("long").alias("depth")))
    for _ in range(n.bit_length() + 1):
        d = _shuffled(done.select(F.col("id").alias("up"), "root", "depth"))
        now = left.join(d, "up").select("id", "root", (F.col("steps") + F.col("depth")).alias("depth"))
        above = _shuffled(left.select(F.col("id").alias("up"), F.col("up").alias("over"), F.col("steps").alias("more")))
        rest = left.join(d, "up", "left_anti").join(above, "up").select("id", F.col("over").alias("up"), (F.col("steps") + F.col("more")).alias("steps"))
        done, left = checkpointed(done.unionByName(now)), checkpointed(rest)
        if not left.limit(1).count():
            break
    return done.select("id", "root", F.col("depth").cast("int").alias("depth"))


def cycles(links: DataFrame) -> DataFrame:
    """From links (node, parent), one parent a node: (id, cycle) of the nodes on a cycle or below one, cycle being its least id.

    Each round a row takes its ancestor's ancestor, and the least id on the way. A way that ends at a root, or where a row is
    not there, drops out; the others are, after about log2(n) rounds, at a row of their cycle whose own way has gone all
    around it, and take its least id.
    """
    one = links.filter("node <> parent")
    left = checkpointed(one.select(F.col("node").alias("id"), F.col("parent").alias("up"), F.col("node").alias("least")))
    n = left.count()
    for _ in range(n.bit_length()):
        above = _shuffled(left.select(F.col("id").alias("up"), F.col("up").alias("over"), F.col("least").alias("more")))
        left = checkpointed(left.join(above, "up").select("id", F.col("over").alias("up"), F.least("least", "more").alias("least")))
        if not left.limit(1).count():
            break
    return left.join(_shuffled(left.select(F.col("id").alias("up"), F.col("least").alias("cycle"))), "up").select("id", "cycle")


def descendants(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(id) of the roots and all below them, each once, however deep: with the roots cut off from what is above them, all
    rows whose tree has one of them as its root."""
    top = roots.select("id").distinct()
    below = links.join(top.select(F.col("id").alias("node")), "node", "left_anti")
    ids = top.unionByName(links.select(F.col("node").alias("id"))).distinct()
    return trees(ids, below).join(top.select(F.col("id").alias("root")), "root", "left_semi").select("id")
