"""An index of vectors for nearest neighbours by cosine: inverted lists around centroids.

Centroids are fitted on a bounded sample; every vector is in the list of its nearest centroid, and a search looks into
the lists of a query's nearest ones, in blocks, as the exact search does with whole categories. So a list that holds a
large part of all vectors is spread over many tasks. What a search may miss is measured by ``recall``; the exact way is
``vectors.knn_join``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import BLOCK, knn_join

SAMPLE = 10_000  # vectors at most that centroids are fitted on
LISTS = 4096  # lists at most; about the square root of the number of vectors otherwise
PROBED = 0.6  # part of the lists that a search looks into, unless the caller says how many
ROUNDS = 12


@dataclass
class Index:
    """``rows`` (id, category, embedding, list) of all vectors, and unit ``centroids``."""

    rows: DataFrame
    centroids: np.ndarray

    @property
    def probes(self) -> int:
        return max(1, int(np.ceil(len(self.centroids) * PROBED)))


def unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def centroids(sample: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means; it begins with the first vectors of the sample, and a list without vectors takes up the vector that is
    farthest from its centroid."""
    x = unit(sample)
    c = x[:lists].copy()
    for _ in range(rounds):
        s = x @ c.T
        of, best = s.argmax(1), s.max(1)
        sums = np.zeros_like(c)
        np.add.at(sums, of, x)
        empty = np.flatnonzero(np.bincount(of, minlength=len(c)) == 0)
        sums[empty] = x[np.argsort(best, kind="stable")[: len(empty)]]
        c = unit(sums)
    return c


def assign(d: DataFrame, c: np.ndarray, probes: int) -> DataFrame:
    """Rows of (id, category, embedding) once for each of the ``probes`` nearest lists: with list. Null vectors are left out; a
    zero vector goes to the first lists."""

    def run(batches):
        for b in batches:
            if len(b):
                s = unit(np.stack(b["embedding"].to_list()).astype(np.float64)) @ c.T
                yield b.assign(list=list(np.argsort(-s, axis=1, kind="stable")[:, :probes].astype(np.int32)))

    d = d.filter("embedding IS NOT NULL").select("id", "category", "embedding")
    # a row leaves Python once, with the numbers of its lists
    near = d.mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.schema) + ", list array<int>")
    return near.withColumn("list", F.explode("list"))


def build(base: DataFrame, lists: int | None = None, sample: int = SAMPLE) -> Index | None:
    """An index of all of ``base`` (id, category, embedding); None if it has no vector. The sample is picked by a hash of ids."""
    d = base.filter("embedding IS NOT NULL")
    n = d.count()
    if not n:
        return None
    at = F.xxhash64("id") / F.lit(2.0**64) + F.lit(0.5)
    some = d if n <= sample else d.filter(at < 1.2 * sample / n + 0.001)
    got = some.orderBy(F.xxhash64("id"), "id").select("embedding").limit(sample).toPandas()["embedding"].to_list()
    lists = min(lists or max(1, min(LISTS, round(n**0.5))), len(got))
    c = centroids(np.stack(got).astype(np.float64), lists)
    return Index(assign(d, c, 1), c)


def search(queries: DataFrame, index: Index, k: int, probes: int | None = None, block: int = BLOCK) -> DataFrame:
    """For (id, category, embedding) about the k nearest of the index in a query's category: (id, other, distance, rk). Distances
    are exact; a list that is not probed may hold a nearer one."""
    within = F.concat_ws("\x1f", F.col("category").cast("string"), F.col("list").cast("string")).alias("category")
    q = assign(queries, index.centroids, probes or index.probes).select("id", within, "embedding")
    return knn_join(q, index.rows.select("id", within, "embedding"), k, block)


def recall(queries: DataFrame, base: DataFrame, index: Index, k: int, probes: int | None = None) -> DataFrame:
    """One row: queries, wanted (neighbours that the exact search finds), found (of these, by the index), recall."""
    exact = knn_join(queries, base, k).select("id", "other")
    got = search(queries, index, k, probes).select("id", "other", F.lit(1).alias("hit"))
    return exact.join(got, ["id", "other"], "left").agg(
        F.countDistinct("id").alias("queries"), F.count(F.lit(1)).alias("wanted"), F.count("hit").alias("found"), (F.count("hit") / F.count(F.lit(1))).alias("recall"))


def tune(base: DataFrame, index: Index, k: int, least: float = 0.95, queries: int = 200) -> int:
    """The smallest number of lists to probe, of a few steps, at which that part of the neighbours is found for ``queries`` vectors
    of ``base`` that a hash picks; all lists if none does."""
    some = base.filter("embedding IS NOT NULL").orderBy(F.xxhash64("id", F.lit(7)), "id").limit(queries)
    for part in (0.05, 0.1, 0.2, 0.4, 0.6, 0.8):
        probes = max(1, round(part * len(index.centroids)))
        if (recall(some, base, index, k, probes).first().recall or 0) >= least:
            return probes
    return len(index.centroids)
