"""Cosine distance, and nearest neighbours in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

BLOCK = 20_000  # vectors of one side that meet in a task, until a category has MOST blocks
MOST, GROWS = 16, 4
CELLS = 2_000_000  # distances that a task holds at a time
FAR = 9.0  # stands for no number while distances, at most 2, are ordered


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; NaN where a vector is zero, null where one is null."""
    scale = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    d = F.lit(1.0) - F.try_divide(dot(a, b), scale)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).otherwise(F.coalesce(d, F.lit(float("nan"))))


def cosine_to(a: Column, query: list[float]) -> Column:
    """Distance to one known vector, whose norm is worked out here."""
    norm = float(np.sqrt(np.sum(np.square(np.array(query, np.float64)))))
    q = F.array(*[F.lit(float(x)) for x in query])
    d = F.lit(1.0) - F.try_divide(dot(a, q), F.sqrt(dot(a, a)) * F.lit(norm))
    return F.when(a.isNotNull(), F.coalesce(d, F.lit(float("nan"))))


def clamp_similarity(distance: Column) -> Column:
    """1 - distance within 0 and 1; 0 for null, NaN for NaN."""
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - distance))
    return F.when(F.isnan(distance), F.lit(float("nan"))).otherwise(F.coalesce(F.when(distance.isNotNull(), s), F.lit(0.0)))


def top_k(df: DataFrame, query: list[float], k: int, vector: str = "embedding", tie: str = "id") -> DataFrame:
    """The k rows nearest to one vector, nulls last, then by ``tie``; adds ``distance``."""
    return df.withColumn("distance", cosine_to(F.col(vector), query)).orderBy(F.col("distance").asc_nulls_last(), tie).limit(k)


def knn_join(queries: DataFrame, base: DataFrame, k: int | None, block: int = BLOCK, least: float | None = None, earlier: bool = False, apart: str | None = None) -> DataFrame:
    """For (id, category, embedding) on both sides the k nearest of ``base`` in a query's category:
    (id, other, distance, rk). Null vectors take no part. With ``least`` only pairs of at least that similarity
    count; then k may be None, for all of them. With ``earlier`` only rows of ``base`` with a smaller id count, and with
    ``apart``, a column of whole numbers on both sides, only those with another value.

    Both sides are cut into blocks within a category, and each pair of blocks gives its best k for each query; only these
    leave the task. A task holds one block of queries; the other block passes by in Arrow batches, whose products with the
    queries are taken a few rows at a time. A category has up to ``MOST`` blocks a side before they grow, up to ``GROWS``-fold,
    so what is shuffled grows no faster than the rows do until then.
    """

    def cut(d: DataFrame, name: str) -> DataFrame:
        d = d.filter("embedding IS NOT NULL").select("id", "category", "embedding", (F.col(apart).cast("long") if apart else F.lit(None).cast("long")).alias("apart"))
        n = F.count(F.lit(1))
        size = F.greatest(F.lit(block), F.least(F.lit(GROWS * block), F.ceil(n / MOST)))
        n = d.groupBy("category").agg(F.ceil(n / size).cast("int").alias(f"n_{name}"))
        d = d.join(n, "category")  # one row for each category; small sides are broadcast as they turn out small
        return d.withColumn(name, F.pmod(F.xxhash64("id"), F.col(f"n_{name}")).cast("int"))

    q, b = cut(queries, "q"), cut(base, "b")
    counts = b.select("category", "n_b").distinct()
    q = q.join(counts, "category").withColumn("b", F.explode(F.sequence(F.lit(0), F.col("n_b") - 1)))
    counts = q.select("category", "n_q").distinct()
    b = b.join(counts, "category").withColumn("q", F.explode(F.sequence(F.lit(0), F.col("n_q") - 1)))

    kind, other = (x.schema["id"].dataType for x in (q, b))
    schema = pa.schema([("id", to_arrow_type(kind)), ("other", to_arrow_type(other)), ("distance", pa.float64())])

    def best(batches):
        now, block = None, None
        for batch in batches:
            keys = [batch[c].to_numpy(zero_copy_only=False) for c in ("category", "q", "b", "side")]
            at = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in keys])) + 1
            for lo, hi in zip([0, *at.tolist()], [*at.tolist(), batch.num_rows]):
                if lo == hi:
                    continue
                key, some = tuple(x[lo] for x in keys[:3]), batch.slice(lo, hi - lo)
                if key != now:
                    if block is not None:
                        yield from block.found()
                    now, block = key, _Block(k, least, earlier, apart is not None, schema)
                if keys[3][lo] == 0:
                    block.ask(some["id"], *_matrix(some))
                else:
                    yield from block.offer(some["other"], *_matrix(some))
        if block is not None:
            yield from block.found()

    keys = ["category", "q", "b"]
    rows = q.select(*keys, F.lit(0).alias("side"), "id", F.lit(None).cast(other).alias("other"), "apart", "embedding").unionByName(
        b.select(*keys, F.lit(1).alias("side"), F.lit(None).cast(kind).alias("id"), F.col("id").alias("other"), "apart", "embedding"))
    # work, not bytes, is what is dealt out, so the number of parts is given
    parts = int(q.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = rows.repartition(parts, *keys).sortWithinPartitions(*keys, "side", "other").mapInArrow(best, f"id {kind.simpleString()}, other {other.simpleString()}, distance double")
    if k is None:
        return some.withColumn("rk", F.lit(None).cast("int"))
    w = W.partitionBy("id").orderBy(F.col("distance").asc_nulls_last(), "other")
    return some.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= k)


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of a batch's rows, a zero vector as no numbers, and the column apart."""
    m = batch["embedding"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return m / np.sqrt((m * m).sum(1, keepdims=True)), batch["apart"].fill_null(0).to_numpy(zero_copy_only=False)


class _Block:
    """A block of queries with the best k that were offered so far; rows are offered in the order of their ids."""

    def __init__(self, k: int | None, least: float | None, earlier: bool, apart: bool, schema: pa.Schema):
        self.k, self.least, self.earlier, self.apart, self.schema = k, least, earlier, apart, schema
        self.asked: list[tuple] = []
        self.ids = None
        self.seen = 0

    def ask(self, ids: pa.Array, m: np.ndarray, apart: np.ndarray) -> None:
        self.asked.append((ids, m, apart))

    def _begin(self) -> None:
        ids, m, apart = zip(*self.asked)
        self.ids, self.u, self.own, self.asked = pa.concat_arrays(ids), np.concatenate(m), np.concatenate(apart), []
        n, k = len(self.u), self.k or 0
        self.distance, self.place = np.full((n, k), np.inf), np.zeros((n, k), np.int64)
        self.other = np.empty((n, k), object) if not pa.types.is_integer(self.schema.field("other").type) else np.zeros((n, k), np.int64)

    def offer(self, others: pa.Array, v: np.ndarray, apart: np.ndarray):
        if self.ids is None:
            if not self.asked:
                return
            self._begin()
        step = max(1, CELLS // len(v))
        names = others.to_numpy(zero_copy_only=False)
        mine = self.ids.to_numpy(zero_copy_only=False) if self.earlier else None
        for lo in range(0, len(self.u), step):
            with np.errstate(invalid="ignore"):
                d = 1.0 - self.u[lo: lo + step] @ v.T
            if self.least is not None:
                d[~(1.0 - d >= self.least)] = np.inf
            d[np.isnan(d)] = FAR
            if self.earlier:
                d[names[None, :] >= mine[lo: lo + step, None]] = np.inf
            if self.apart:
                d[apart[None, :] == self.own[lo: lo + step, None]] = np.inf
            if self.k is None:
                rows, pick = np.nonzero(d < np.inf)
                yield from self._rows(self.ids.take(pa.array(lo + rows)), others.take(pa.array(pick)), d[rows, pick])
            else:
                self._merge(lo, d, names)
        self.seen += len(v)

    def _merge(self, lo: int, d: np.ndarray, names: np.ndarray) -> None:
        n, k = len(d), self.k
        near = (d <= self.distance[lo: lo + n, -1:]) & (d < np.inf)
        if d.shape[1] > k and np.count_nonzero(near) > 4 * k * n:
            near &= d <= np.partition(d, k - 1, axis=1)[:, k - 1: k]
        rows, pick = np.nonzero(near)
        if not len(rows):
            return
        hit = np.unique(rows)
        all_rows = np.concatenate([np.repeat(hit, k), rows])
        distance = np.concatenate([self.distance[lo + hit].ravel(), d[rows, pick]])
        place = np.concatenate([self.place[lo + hit].ravel(), self.seen + pick])
        other = np.concatenate([self.other[lo + hit].ravel(), names[pick]])
        order = np.lexsort((place, distance, all_rows))
        of = all_rows[order]
        order = order[np.arange(len(of)) - np.searchsorted(of, of) < k]  # k of each row, as it had k before
        to = lo + hit
        self.distance[to], self.place[to], self.other[to] = (x[order].reshape(-1, k) for x in (distance, place, other))

    def found(self):
        if self.ids is not None and self.k:
            rows, pick = np.nonzero(self.distance < np.inf)
            yield from self._rows(self.ids.take(pa.array(rows)), pa.array(self.other[rows, pick], self.schema.field("other").type), self.distance[rows, pick])

    def _rows(self, ids: pa.Array, others: pa.Array, distance: np.ndarray):
        distance[distance == FAR] = np.nan
        t = pa.Table.from_arrays([ids, others, pa.array(distance)], schema=self.schema)
        yield from t.to_batches(max_chunksize=100_000)
