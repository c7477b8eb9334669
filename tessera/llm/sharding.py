"""Sharding: a Feistel permutation with cycle walking over global row numbers.

Row numbers 0..N-1 come from a two-level count (rows within hash buckets, buckets before them). A keyed
Feistel network permutes them; position p of the shuffle goes to shard ``p mod shards``, slot ``p div shards``.
So shard and slot of a row follow from its number alone, and the row from shard and slot by the inverse.
The law is ``rows``: the shards' row counts are at most one apart. Equal texts may part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, prefix_sums

P = 2147483647  # a prime; products of two residues fit a long
ROUNDS = 6
WALKS = 24  # the domain exceeds N by less than sqrt(N)+1, so more walks than two are very rare
BUCKETS = 4096


def _sides(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(n - 1) + 1 if n > 1 else 1)
    return a, max(1, -(-n // a))


def _key(seed: int, r: int) -> int:
    return (seed * 1_000_003 + (r + 1) * 7_368_787) % P


def _round_py(x: int, key: int) -> int:
    t = (x % P * 48271 + key) % P
    t = (t * t + key) % P
    t = (t * 69621 + x % P) % P
    return t * t % P


def _round(x: Column, key: int) -> Column:
    r = x % F.lit(P)
    t = (r * F.lit(48271) + F.lit(key)) % F.lit(P)
    t = (t * t + F.lit(key)) % F.lit(P)
    t = (t * F.lit(69621) + r) % F.lit(P)
    return (t * t) % F.lit(P)


def feistel_py(x: int, n: int, seed: int) -> int:
    """Where row ``x`` of ``n`` stands in the shuffle."""
    a, b = _sides(n)
    while True:
        left, right = x // b, x % b
        for r in range(ROUNDS):
            if r % 2 == 0:
                left = (left + _round_py(right, _key(seed, r))) % a
            else:
                right = (right + _round_py(left, _key(seed, r))) % b
        x = left * b + right
        if x < n:
            return x


def feistel_inverse_py(p: int, n: int, seed: int) -> int:
    """Which row stands at position ``p`` of the shuffle."""
    a, b = _sides(n)
    while True:
        left, right = p // b, p % b
        for r in reversed(range(ROUNDS)):
            if r % 2 == 0:
                left = (left - _round_py(right, _key(seed, r))) % a
            else:
                right = (right - _round_py(left, _key(seed, r))) % b
        p = left * b + right
        if p < n:
            return p


def _step(key: int, on_left: bool, a: int, b: int):
    def left(s: Column) -> Column:
        return F.struct(((s["l"] + _round(s["r"], key)) % F.lit(a)).alias("l"), s["r"].alias("r"))

    def right(s: Column) -> Column:
        return F.struct(s["l"].alias("l"), ((s["r"] + _round(s["l"], key)) % F.lit(b)).alias("r"))

    return left if on_left else right


def _permute(x: Column, n: int, seed: int) -> Column:
    a, b = _sides(n)
    # one-element transforms bind each half once, so that the rounds do not multiply the expression
    pair = F.array(F.struct(F.floor(x / F.lit(b)).cast("long").alias("l"), (x % F.lit(b)).alias("r")))
    for r in range(ROUNDS):
        pair = F.transform(pair, _step(_key(seed, r), r % 2 == 0, a, b))
    return F.element_at(F.transform(pair, lambda s: s["l"] * F.lit(b) + s["r"]), 1)


def feistel(x: Column, n: int, seed: int) -> Column:
    """``feistel_py`` as a column: walk until the value is below ``n``; it fails rather than leave a row out."""
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALKS)), F.struct(x.cast("long").alias("v"), F.lit(False).alias("ok")),
        lambda acc, _: F.when(acc["ok"], acc).otherwise(
            F.element_at(F.transform(F.array(_permute(acc["v"], n, seed)), lambda v: F.struct(v.alias("v"), (v < F.lit(n)).alias("ok"))), 1)),
    )
    return F.element_at(F.transform(F.array(walked), lambda s: F.when(s["ok"], s["v"]).otherwise(F.raise_error(F.lit("cycle walk too short")).cast("long"))), 1)


def shard_documents(docs: DataFrame, shards: int = 16, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, size (bytes + 1), text_crc32, law, shard, slot, grown_shard, position.

    Null text counts as empty (size 1, crc 0); a null id is a value like any other. Rows equal in id, size and
    crc are interchangeable, so ties and repeated rows cannot change the result. An empty table gives no rows.
    Other columns are ignored.
    """
    d = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    d = d.withColumn("__h", F.xxhash64("doc_id", "size", "text_crc32", F.lit(seed)))
    d = materialize(d.withColumn("__bucket", F.pmod(F.col("__h"), F.lit(BUCKETS)).cast("int")), "rows")
    n = d.count()
    numbered = prefix_sums(d, [], "__bucket", ["__h", "doc_id", "size", "text_crc32"], F.lit(1), "__row")
    p = feistel(F.col("__row") - 1, max(n, 1), seed)
    return numbered.withColumn("position", p).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("position") % shards).cast("int").alias("shard"),
        F.floor(F.col("position") / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "position",
    )
