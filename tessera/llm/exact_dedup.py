"""Exact dedup: composable polynomial fingerprints, then a chunkwise comparison of what they call equal.

A text is cut into chunks of bytes that are hashed in parallel. The hash of bytes b_0..b_(n-1) is
sum(b_i * B^(n-1-i)) modulo a prime, for two primes; a chunk's hash times B^(bytes after it) is its part of
the text's hash, so parts just add up, for texts of any length. Texts with equal length and fingerprint are
compared chunk by chunk with their group's leader; those that differ from it go through another round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SALTS, fits, lean, materialize, semi, with_group

PRIMES = (2147483647, 2147483629)
BASES = (1_000_003, 92_821_357)
CHUNK = 1 << 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """A-Z lower-cased, nothing else; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def chunk_hash(data: bytes, which: int, after: int = 0, powers: np.ndarray | None = None) -> int:
    """The hash of ``data`` shifted by ``after`` bytes: its part of the hash of a text that has those behind it."""
    p, b = PRIMES[which], BASES[which]
    powers = _powers(which, len(data)) if powers is None else powers
    x = np.frombuffer(data, np.uint8).astype(np.uint64)
    return int(np.dot(x, powers[len(powers) - len(data):])) % p * pow(b, after, p) % p


def _powers(which: int, n: int) -> np.ndarray:
    """B^(n-1) ... B^0 modulo the prime."""
    p, out = PRIMES[which], np.ones(max(n, 1), np.uint64)
    size = 1
    while size < n:  # doubling: the block before has the same powers, shifted
        take = min(size, n - size)
        out[size: size + take] = out[:take] * np.uint64(pow(BASES[which], size, p)) % np.uint64(p)
        size += take
    return out[::-1]


def _hash_batches(batches):
    tables = [_powers(k, CHUNK) for k in (0, 1)]
    for batch in batches:
        data, after = batch.column("chunk"), batch.column("after").to_pylist()
        parts = [[chunk_hash(c, k, a, tables[k]) for c, a in zip((x.as_py() for x in data), after)] for k in (0, 1)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("sha"), batch.column("bytes"), batch.column("no"), pa.array(parts[0], pa.int64()), pa.array(parts[1], pa.int64())],
            names=["doc_id", "sha", "bytes", "no", "h1", "h2"],
        )


def _chunks(d: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each chunk of ``norm``: number, bytes, and how many bytes of the text come after it."""
    whole = F.encode("norm", "UTF-8")
    d = d.select(*keep, whole.alias("__b")).withColumn("__n", F.length("__b"))
    last = F.greatest(F.floor((F.col("__n") - 1) / CHUNK), F.lit(0)).cast("int")
    d = d.withColumn("no", F.explode(F.sequence(F.lit(0), last)))
    piece = F.substring(F.col("__b"), F.col("no") * CHUNK + 1, F.lit(CHUNK))
    return d.select(*keep, F.col("__n").cast("long").alias("bytes"), "no", piece.alias("chunk"),
                    F.greatest(F.col("__n").cast("long") - (F.col("no").cast("long") + 1) * CHUNK, F.lit(0).cast("long")).alias("after"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """From (doc_id, norm, sha): a row per distinct (doc_id, sha) with bytes, f1, f2 and rows, its number of rows."""
    parts = _chunks(docs, ["doc_id", "sha"]).mapInArrow(lean(_hash_batches), "doc_id long, sha binary, bytes long, no int, h1 long, h2 long")
    g = parts.groupBy("doc_id", "sha", "bytes").agg(F.sum("h1").alias("s1"), F.sum("h2").alias("s2"), F.count_if(F.col("no") == 0).alias("rows"))
    div = lambda s: F.floor(F.col(s) / F.col("rows"))
    exact = lambda s: F.expr(f"{s} div rows")  # noqa: E731  equal rows have equal sums, so this leaves no remainder
    return g.select("doc_id", "sha", "bytes", (exact("s1") % PRIMES[0]).alias("f1"), (exact("s2") % PRIMES[1]).alias("f2"), "rows")


def exact_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct (doc_id, text): doc_id, sha, rows, keep_id, keep_sha, group_size.

    ``keep_id`` is the largest doc_id of the rows with an equal text; null ids come before all others.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    d = d.withColumn("sha", F.unhex(F.sha2("norm", 256)))
    left = materialize(fingerprints(d), "fingerprints")
    found = None
    while True:
        m = with_group(left, ["bytes", "f1", "f2"], "doc_id", F.max(F.struct("doc_id", "sha")).alias("lead"), F.sum("rows").alias("group_size"), F.count(F.lit(1)).alias("__n"))
        m = materialize(m.select("*", F.col("lead.doc_id").alias("keep_id"), F.col("lead.sha").alias("keep_sha")).drop("lead"), "groups")
        more = m.filter("__n > 1")
        n = more.count()
        if not n:
            return _plus(found, m)
        same = materialize(_compare(d, more, n), "compared")
        differ = same.filter("NOT same").count()
        if not differ:
            return _plus(found, m)
        # only a collision of both fingerprints gets here: the leaders' equals are done, the others have another round
        key = ["doc_id", "sha"]
        rest = left.join(same.filter("NOT same").select(*[F.col(c).alias(f"__{c}") for c in key]), [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key], "left_semi")
        done = m.join(same.filter("NOT same").select(*[F.col(c).alias(f"__{c}") for c in key]), [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key], "left_anti")
        sizes = done.groupBy("keep_id", "keep_sha").agg(F.sum("rows").alias("group_size"))
        done = done.drop("group_size").alias("a").join(
            sizes.alias("b"), F.col("a.keep_id").eqNullSafe(F.col("b.keep_id")) & (F.col("a.keep_sha") == F.col("b.keep_sha"))).select("a.*", "b.group_size")
        found = _plus(found, materialize(done, "classes"))
        left = materialize(rest, "rest")


def _plus(found: DataFrame | None, m: DataFrame) -> DataFrame:
    m = m.select("doc_id", "sha", "rows", "keep_id", "keep_sha", "group_size")
    return m if found is None else found.select(*m.columns).unionByName(m)


def _compare(d: DataFrame, more: DataFrame, n: int) -> DataFrame:
    """Each member of ``more`` against its leader, a chunk at a time: (doc_id, sha, same)."""
    text = semi(d, more, ["doc_id", "sha"], n)
    pieces = _chunks(text, ["doc_id", "sha"]).drop("after", "bytes")
    leads = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("sha") == F.col("keep_sha"))
    # a leader's chunks go to as many places as its group has members, SALTS at most
    places = F.least(F.col("__n"), F.lit(SALTS)).cast("int")
    key = more.select(F.col("doc_id").alias("__id"), F.col("sha").alias("__sha"), F.concat_ws("-", "bytes", "f1", "f2").alias("gid"), leads.alias("leads"),
                      F.pmod(F.xxhash64("doc_id"), places).cast("int").alias("salt"), F.when(leads, F.sequence(F.lit(0), places - 1)).alias("salts"))
    on = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("sha") == F.col("__sha"))
    pieces = pieces.join(F.broadcast(key) if fits(n, 250) else key, on).select("gid", "no", "doc_id", "sha", "leads", "salt", "salts", "chunk")
    lead = pieces.filter("leads").groupBy("gid", "no").agg(F.first("chunk").alias("__lead"), F.first("salts").alias("salts"))  # repeated rows are equal
    lead = lead.select("gid", "no", "__lead", F.explode("salts").alias("salt"))
    both = pieces.join(lead, ["gid", "no", "salt"], "left").select("doc_id", "sha", F.col("chunk").eqNullSafe(F.col("__lead")).alias("eq"))
    return both.groupBy("doc_id", "sha").agg(F.bool_and("eq").alias("same"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty and equals the empty text. Of equal texts the row with the largest doc_id stays; a
    null id is the smallest; of repeated rows with that id one stays. An empty table gives no rows. Other columns
    are ignored, whatever their names. Texts of any length are hashed and compared in chunks of ``CHUNK`` bytes; a row's text
    itself, and its SHA-256, are taken whole by one task.
    """
    c = exact_classes(docs, id_col, text_col)
    c = c.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("__copy") == 1)
    return c.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def keep_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that exact dedup keeps, with all their columns, whatever their names; cases as there."""
    c = exact_classes(docs, id_col, text_col).filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    c = materialize(c.select(F.col("doc_id").alias("__id"), F.col("sha").alias("__sha"), "rows"), "kept")
    n, repeated = c.agg(F.count(F.lit(1)), F.coalesce(F.max("rows"), F.lit(0)) > 1).first()
    d = docs.select(F.struct("*").alias("__row"), F.col(id_col).cast("long").alias("__id"), F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("__sha"))
    d = semi(d, c, ["__id", "__sha"], n)
    if repeated:
        d = d.dropDuplicates(["__id", "__sha"])
    return d.select("__row.*")
