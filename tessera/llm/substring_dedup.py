"""Substring dedup by compaction of a de Bruijn graph of token k-mers.

An edge is a window of ``width`` consecutive words. Edges go about in packs: consecutive windows of a document
whose least seed (hash of ``seed`` words) is the same word place. Equal windows have equal seeds, so a pack's
seed tells which packs can share edges. Seeds of one document only are dropped. A seed with one pack is a
path without a branch: the whole pack repeats where it first stands. At a seed with several packs the path
branches, and its edges are taken one by one, each with its first place. Runs of edges that follow each other both
in a document and at their first places are then compacted into paths by joins, up to whole repeated
spans (document, place, source document, source place). Before a span is removed, its words are compared, by
a cryptographic digest, with those at the source's coordinates.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fits, materialize, partitions, with_group
from .wordhash import M1, grams, mix, starts, word_hashes

WIDTH = 50
SEED = 10
BATCH = 4_000_000  # bytes of text handled at once; a longer text is one batch
SPREAD = 32  # places that the rows of one seed, pack or span are spread over, by their documents
RANGES = 50_000  # ranges of one source that are looked up in a row


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """M1^i and M1^-i modulo 2^64; M1 is odd."""
    inverse = np.uint64(pow(int(M1), -1, 1 << 64))
    up, down = np.full(n, M1), np.full(n, inverse)
    if n:
        up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


class Packs:
    """The packs of some texts: for each the text's number, place of its first window, number of windows, seed,
    and id (a hash of all its words and of the seed's place)."""

    def __init__(self, texts: list[bytes], width: int, seed: int):
        h, n = word_hashes(texts)
        first = starts(n)
        self.edges = np.zeros(0, np.uint64)
        total = len(h)
        full = np.maximum(n - width + 1, 0)
        place = np.repeat(first, full) + np.arange(full.sum()) - np.repeat(starts(full), full)
        doc = np.repeat(np.arange(len(texts)), full)
        if not len(place):
            none = np.zeros(0, np.int64)
            self.doc = self.start = self.n = self.at = none
            self.seed = self.id = np.zeros(0, np.uint64)
            return
        s = grams(h, seed)
        bits = np.uint64(max(1, total.bit_length()))
        low = (np.uint64(1) << bits) - np.uint64(1)
        least = (mix(s + M1) & ~low) | np.arange(len(s), dtype=np.uint64)
        size, span = 1, width - seed + 1
        while size * 2 <= span:
            least = np.minimum(least[: len(least) - size], least[size:])
            size *= 2
        if size < span:
            least = np.minimum(least[: len(least) - (span - size)], least[span - size:])
        chosen = (least[place] & low).astype(np.int64)
        up, down = _powers(total + 1)
        sums = np.zeros(total + 1, np.uint64)
        np.cumsum(h * up[:total], out=sums[1:])
        self.edges = mix((sums[place + width] - sums[place]) * down[place])
        new = np.ones(len(place), bool)
        new[1:] = (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1])
        self.at = np.flatnonzero(new)  # where a pack's edges start
        self.n = np.diff(np.append(self.at, len(place)))
        lo, hi = place[self.at], place[self.at] + self.n - 1 + width
        self.doc = doc[self.at]
        self.start = lo - first[self.doc]
        self.seed = mix(s[chosen[self.at]])
        words = (sums[hi] - sums[lo]) * down[lo]
        self.id = mix(mix(words + self.n.astype(np.uint64)) ^ self.seed ^ (chosen[self.at] - lo).astype(np.uint64) * M1)


def _place(doc: np.ndarray) -> np.ndarray:
    return (mix(np.ascontiguousarray(doc, np.int64).view(np.uint64) + M1) % np.uint64(SPREAD)).astype(np.int64)


def _distinct(p: Packs, ids: np.ndarray):
    """The packs that differ: a number of each at its first place, its largest document, and a bit for each place of its documents."""
    doc = ids[p.doc]
    order = np.lexsort((p.start, doc, p.id))
    key = p.id[order]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    if not len(at):
        return at, at, at
    return order[at], doc[order[np.append(at[1:], len(key)) - 1]], np.bitwise_or.reduceat(1 << _place(doc[order]), at)


def _batches(batches, size: int):
    for batch in batches:
        ids, texts = batch.column("doc_id").to_numpy(), batch.column("text")
        lengths = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
        lo = 0
        while lo < len(ids):
            hi = max(lo + 1, int(np.searchsorted(lengths, (lengths[lo - 1] if lo else 0) + size, side="right")))
            yield ids[lo:hi], [x or b"" for x in texts.slice(lo, hi - lo).cast(pa.binary()).to_pylist()]
            lo = hi


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _seed_rows(width: int, seed: int, size: int):
    """(seed, low, high, doc, last, places): a row for each seed, with the least and the greatest of its packs and documents."""

    def run(batches):
        for ids, texts in _batches(batches, size):
            p = Packs(texts, width, seed)
            one, last, places = _distinct(p, ids)
            order = np.argsort(p.seed[one], kind="stable")
            one, last, places = one[order], last[order], places[order]
            key = p.seed[one]
            at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else one
            if len(at):
                pack, doc = p.id[one].view(np.int64), ids[p.doc[one]]
                yield pa.RecordBatch.from_arrays(
                    [_signed(key[at]), pa.array(np.minimum.reduceat(pack, at)), pa.array(np.maximum.reduceat(pack, at)), pa.array(np.minimum.reduceat(doc, at)),
                     pa.array(np.maximum.reduceat(last, at)), pa.array(np.bitwise_or.reduceat(places, at))], names=["seed", "low", "high", "doc", "last", "places"])

    return run


def _pack_rows(width: int, seed: int, size: int):
    """(seed, salt, pack, doc, start, last, places, edges): a row for each pack that differs, with its first place here, the
    largest id that has it, and the places of all documents that do; it goes to the place of the first."""

    def run(batches):
        for ids, texts in _batches(batches, size):
            p = Packs(texts, width, seed)
            one, last, places = _distinct(p, ids)
            for i in range(0, len(one), 20_000):
                k = one[i: i + 20_000]
                offsets = np.zeros(len(k) + 1, np.int32)
                np.cumsum(p.n[k] * 8, out=offsets[1:])
                take = np.repeat(p.at[k] - (offsets[:-1] // 8), p.n[k]) + np.arange(offsets[-1] // 8)
                data = pa.Array.from_buffers(pa.binary(), len(k), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(p.edges[take].tobytes())])
                doc = ids[p.doc[k]]
                yield pa.RecordBatch.from_arrays(
                    [_signed(p.seed[k]), pa.array(_place(doc)), _signed(p.id[k]), pa.array(doc), pa.array(p.start[k]), pa.array(last[i: i + 20_000]), pa.array(places[i: i + 20_000]), data],
                    names=["seed", "salt", "pack", "doc", "start", "last", "places", "edges"])

    return run


def _place_rows(width: int, seed: int, size: int):
    """(pack, salt, doc, start) of every pack."""

    def run(batches):
        for ids, texts in _batches(batches, size):
            p = Packs(texts, width, seed)
            for i in range(0, len(p.id), 100_000):
                doc = ids[p.doc[i: i + 100_000]]
                yield pa.RecordBatch.from_arrays([_signed(p.id[i: i + 100_000]), pa.array(_place(doc)), pa.array(doc), pa.array(p.start[i: i + 100_000])], names=["pack", "salt", "doc", "start"])

    return run


def _edge_rows(batches):
    """A row for each edge of a pack."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 5000):
            b = batch.slice(lo, 5000)
            edges = b.column("edges")
            n = pc.binary_length(edges).to_numpy() // 8
            flat = np.frombuffer(b"".join(edges.to_pylist()), np.int64)
            row = np.repeat(np.arange(b.num_rows), n)
            j = np.arange(len(flat)) - np.repeat(starts(n), n)
            take = lambda c: b.column(c).to_numpy()[row]
            yield pa.RecordBatch.from_arrays(
                [pa.array(take("seed")), pa.array(flat), pa.array(take("pack")), pa.array(j.astype(np.int32)), pa.array(take("doc")), pa.array(take("start") + j), pa.array(take("last")), pa.array(take("places"))],
                names=["seed", "edge", "pack", "j", "doc", "at", "last", "places"])


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _source_digests(batches):
    for batch in batches:
        for text, ranges in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("ranges").to_pylist()):
            w = (text or b"").split()
            r = [(x["src"], x["src_at"], x["n"], x["places"], _digest(w[x["src_at"]: x["src_at"] + x["n"]])) for x in ranges]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*r), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["src", "src_at", "n", "places", "digest"])


def _remove(batches):
    """Take the spans that agree with their sources out of the texts."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            b = batch.slice(lo, 500)
            total, gone, kept, spans = [], [], [], []
            for text, found in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("spans").to_pylist()):
                w = (text or b"").split()
                stay = np.ones(len(w), bool)
                used = []
                for s in sorted(found or [], key=lambda s: (s["at"], s["n"])):
                    if s["digest"] == _digest(w[s["at"]: s["at"] + s["n"]]):
                        stay[s["at"]: s["at"] + s["n"]] = False
                        used.append({k: s[k] for k in ("at", "n", "src", "src_at")})
                total.append(len(w))
                gone.append(int((~stay).sum()))
                kept.append(b" ".join([x for x, k in zip(w, stay.tolist()) if k] if gone[-1] else w).decode())
                spans.append(used)
            kind = pa.list_(pa.struct([(k, pa.int64()) for k in ("at", "n", "src", "src_at")]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, kind)],
                                             names=["doc_id", "n_words", "n_removed", "kept_text", "spans"])


def _spread(d: DataFrame) -> DataFrame:
    """A row for each place that has rows of it."""
    return d.withColumn("salt", F.explode(F.expr(f"filter(sequence(0L, {SPREAD - 1}L), i -> (places & shiftleft(1L, CAST(i AS INT))) <> 0)"))).drop("places")


def repeated_spans(docs: DataFrame, width: int = WIDTH, seed: int = SEED, size: int = BATCH) -> DataFrame:
    """From (doc_id, text): (doc, at, n, src, src_at): n words from ``at`` stand in the earlier document ``src``
    from ``src_at`` on, in full windows. Together they cover all windows that also start in a smaller id."""
    spark = docs.sparkSession
    parts = partitions(spark)
    d = docs.filter("doc_id IS NOT NULL")
    # seeds first, without their edges: what most rows tell is combined before it is shuffled
    seeds = d.mapInArrow(_seed_rows(width, seed, size), "seed long, low long, high long, doc long, last long, places long")
    seeds = seeds.groupBy("seed").agg(
        F.min("doc").alias("__min"), F.max("last").alias("__max"), (F.min("low") != F.max("high")).alias("branches"), F.bit_or("places").alias("places"))
    seeds = materialize(seeds.filter("__min < __max").select("seed", "branches", "places"), "seeds")
    packs = d.mapInArrow(_pack_rows(width, seed, size), "seed long, salt long, pack long, doc long, start long, last long, places long, edges binary")
    packs = materialize(packs.repartition(parts, "seed", "salt").join(_spread(seeds), ["seed", "salt"]).drop("salt"), "packs")
    one = packs.groupBy("seed", "pack", "branches").agg(
        F.min(F.struct("doc", "start")).alias("f"), F.max("last").alias("last"), F.bit_or("places").alias("places"), F.first("edges").alias("edges"))
    one = one.select("seed", "pack", "branches", F.col("f.doc").alias("doc"), F.col("f.start").alias("start"), "last", "places", "edges")
    straight = one.filter("NOT branches AND doc < last").select(
        "pack", F.lit(0).cast("long").alias("j"), F.expr("octet_length(edges) div 8").alias("n"), F.col("doc").alias("src"), F.col("start").alias("src_at"), "places")
    edges = one.filter("branches").mapInArrow(_edge_rows, "seed long, edge long, pack long, j int, doc long, at long, last long, places long")
    edges = materialize(edges, "edges")
    # an edge that many packs share meets its first place in many places
    shared = with_group(edges, ["seed", "edge"], "pack", F.min(F.struct("doc", "at")).alias("s"))
    shared = shared.filter("s.doc < last").select("pack", "j", F.col("s.doc").alias("src"), F.col("s.at").alias("src_at"), "places")
    # edges that follow each other at both places become one path
    shared = shared.withColumn("__line", F.col("src_at") - F.col("j"))
    shared = shared.withColumn("__run", F.col("j") - F.row_number().over(W.partitionBy("pack", "src", "__line").orderBy("j")))
    paths = shared.groupBy("pack", "src", "__line", "__run").agg(
        F.min("j").cast("long").alias("j"), F.count(F.lit(1)).alias("n"), F.min("src_at").alias("src_at"), F.first("places").alias("places"))
    paths = straight.unionByName(paths.select("pack", "j", "n", "src", "src_at", "places"))
    paths = materialize(paths, "paths")
    places = d.mapInArrow(_place_rows(width, seed, size), "pack long, salt long, doc long, start long")
    spans = places.join(_spread(paths), ["pack", "salt"]).filter("src < doc").select("doc", (F.col("start") + F.col("j")).alias("at"), "n", "src", "src_at")
    # paths that go on where another ended, in the document and at the source, become one span
    spans = spans.distinct().withColumn("__line", F.col("at") - F.col("src_at"))
    line = W.partitionBy("doc", "src", "__line").orderBy("at", "n")
    reach = F.max(F.col("at") + F.col("n")).over(line.rowsBetween(W.unboundedPreceding, -1))
    spans = spans.withColumn("__new", F.when(F.col("at") > F.coalesce(reach, F.lit(-1)), 1).otherwise(0))
    spans = spans.withColumn("__run", F.sum("__new").over(line.rowsBetween(W.unboundedPreceding, 0)))
    spans = spans.groupBy("doc", "src", "__line", "__run").agg(F.min("at").alias("at"), F.max(F.col("at") + F.col("n")).alias("__end"), F.min("src_at").alias("src_at"))
    return spans.select("doc", "at", (F.col("__end") - F.col("at") + (width - 1)).alias("n"), "src", "src_at")


def substring_dedup(docs: DataFrame, width: int = WIDTH, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", size: int = BATCH) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text (kept words, one space between), spans (what
    was removed: at, n, src, src_at, in words).

    Null and empty texts have no words. Rows without an id lose nothing and are no source. Rows that share an id
    are no sources for each other; where their texts differ, each still loses what smaller ids have. An empty
    table gives no rows. Other columns are ignored. ``docs`` is read several times, in any order. Texts are handled in
    batches of ``size`` bytes; a longer one is a batch of its own, taken whole, with about 40 bytes of hashes for a word.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # where rows share an id, a span of one is tried on all of them: the digest decides for each
    spans = materialize(repeated_spans(d, width, seed, size), "spans")
    salt = F.pmod(F.xxhash64("doc"), F.lit(SPREAD)).cast("long")
    spans = spans.withColumn("salt", salt)
    want = spans.groupBy("src", "src_at", "n").agg(F.bit_or(F.expr("shiftleft(1L, CAST(salt AS INT))")).alias("places"))
    # a source that is quoted in very many ways is read several times, each for some of its ranges
    want = with_group(want, ["src"], "src_at", F.count(F.lit(1)).alias("__c"))
    want = want.withColumn("__part", F.expr(f"pmod(xxhash64(src_at, n), (__c div {RANGES}) + 1)"))
    want = want.groupBy("src", "__part").agg(F.collect_list(F.struct("src", "src_at", "n", "places")).alias("ranges"))
    ids = materialize(want.select(F.col("src").alias("__src"), "ranges"), "sources")
    n, ranges = ids.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("ranges")), F.lit(0))).first()
    small = fits(n + ranges, 100)
    text = d.join(F.broadcast(ids) if small else ids, F.col("doc_id") == F.col("__src")).select("text", "ranges")
    digests = text.mapInArrow(_source_digests, "src long, src_at long, n long, places long, digest binary").distinct()
    checked = spans.join(_spread(digests), ["src", "src_at", "n", "salt"])
    mine = checked.groupBy("doc").agg(F.collect_list(F.struct("at", "n", "src", "src_at", "digest")).alias("spans"))
    mine = materialize(mine, "checked")
    out = d.join(mine, F.col("doc_id") == F.col("doc"), "left").select("doc_id", "text", "spans")
    return out.mapInArrow(_remove, "doc_id long, n_words long, n_removed long, kept_text string, spans array<struct<at:long,n:long,src:long,src_at:long>>")
