"""Language-model scores by deleted interpolation.

A token's probability mixes the maximum-likelihood estimates of its n-grams of all orders. How much each counts
depends on how often the longest known context was seen: contexts fall in buckets by the logarithm of their count, and
each bucket has weights of its own. One fold of the training documents is deleted from the counts, and expectation
maximisation on its n-grams finds the weights; then all training documents are counted.

Documents are taken in blocks, written once. A block sends its distinct n-grams, as sorted hashes, to ranges of the
hash; a range adds up the counts of all blocks and sends each block its n-grams' sums, in the order in which they came.
So every n-gram of the corpus is counted, and no row stands for a single occurrence. The longest n-grams go last, and only
those that other blocks can have: where one of the two n-grams within is in no other block, neither is the whole, and the
block's own count is the corpus's.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, materialize_bucketed, partitions
from .wordhash import M1, mix

ORDER = 3
TOKENS = 750_000  # tokens of a block; a longer document goes on in the next, with its last words as context
RANGE = 3_000_000  # n-grams of a range of the hash, about
FOLDS, HELD, DELETED = 7, 2, 5  # remainders of crc32(id): never learned from; deleted from the counts for the weights
ROUNDS, NEAR = 30, 1e-5  # rounds of expectation maximisation, at most; the gain for a token at which it ends
LEVELS = 64  # buckets of a context's length: one for each power of two
TAG = 3  # low bits of a hash that tell the n-gram's order
BEGIN, END = np.uint64(0x1B873593CC9E2D51), np.uint64(0x52DCE729E6546B64)
BLOCKS = "row array<long>, doc_id array<long>, fold array<int>, begins array<boolean>, skip array<int>, n array<long>, codes binary, words binary"
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def squeeze(x: np.ndarray) -> bytes:
    """Whole numbers by planes of bytes, compressed."""
    x = np.ascontiguousarray(x)
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes())


def expand(b: bytes, dtype: str) -> np.ndarray:
    t = np.dtype(dtype)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(t.itemsize, -1).T).view(t).reshape(-1)


def _each(batch: pa.RecordBatch):
    """Rows one after another, as each holds a block."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


class _Words(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def portions(text: bytes, size: int):
    """A text in parts of ``size`` bytes or a little more, cut at white space."""
    at = 0
    while len(text) - at > size:
        cut = SPACE.search(text, at + size)
        if not cut:
            break
        yield text[at: cut.start()]
        at = cut.start()
    yield text[at:] if at else text


class _Block:
    def __init__(self):
        self.words, self.rows, self.parts, self.size = _Words(), [], [], 0

    def add(self, row, doc_id, fold, begins, context: list[bytes], words: list[bytes], ends: bool) -> None:
        codes = np.fromiter(map(self.words.__getitem__, [*context, *words]), np.int64, len(context) + len(words)) + 1
        if ends:
            codes = np.append(codes, 0)  # the end is word 0
        self.rows.append((row, doc_id, fold, begins, len(context), len(codes)))
        self.parts.append(codes)
        self.size += len(codes)

    def batch(self) -> pa.RecordBatch:
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.words), np.uint64, len(self.words))
        lists = [pa.array([list(c)], pa.list_(t)) for c, t in zip(zip(*self.rows), (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int64()))]
        data = [pa.array([squeeze(x)], pa.binary()) for x in (np.concatenate(self.parts).astype("<u4"), hashes)]
        return pa.RecordBatch.from_arrays([*lists, *data], names=["row", "doc_id", "fold", "begins", "skip", "n", "codes", "words"])


def _blocks(tokens: int, order: int, deleted: int, portion: int = 1 << 20):
    def run(batches):
        from pyspark import TaskContext

        row, open_ = TaskContext.get().partitionId() << 40, {}
        for batch in batches:
            for i, fold, text in zip(batch.column("doc_id").to_pylist(), batch.column("fold").to_pylist(), batch.column("text").to_pylist()):
                context, begins, kind = [], True, fold == deleted  # the deleted fold has blocks of its own
                parts = list(portions((text or "").encode().lower(), portion))
                for k, part in enumerate(parts):
                    words, last = part.split(), k == len(parts) - 1
                    b = open_.setdefault(kind, _Block())
                    if words or last:
                        b.add(row, i, fold, begins, context, words, last)
                        context, begins = (context + words)[1 - order:] if order > 1 else [], begins and not words
                    if b.size >= tokens:
                        yield b.batch()
                        del open_[kind]
                row += 1
        for b in open_.values():
            if b.rows:
                yield b.batch()

    return run


def sort_order(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, sorted keys). A hash's high bits with its place below sort much faster than places do; where the high bits are
    not enough, places are sorted."""
    bits = max(1, (len(keys) - 1).bit_length())
    if bits <= 26:
        low = np.uint64((1 << bits) - 1)
        packed = (keys & ~low) | np.arange(len(keys), dtype=np.uint64)
        packed.sort()
        order = (packed & low).astype(np.int64)
        s = keys[order]
        if not (s[1:] < s[:-1]).any():
            return order, s
    order = np.argsort(keys, kind="stable")
    return order, keys[order]


class _Grams:
    """The n-grams that end at each token of a block: their hashes by order, and where documents begin."""

    def __init__(self, row, order: int):
        self.row, self.order = row, order
        self.n = np.array(row["n"], np.int64)
        self.begins, self.skip = np.array(row["begins"], bool), np.array(row["skip"], np.int64)
        start = np.cumsum(self.n) - self.n
        self.start, total = start, int(self.n.sum())
        words = np.concatenate([[END], expand(row["words"], "<u8")])
        h = words[expand(row["codes"], "<u4")]
        self.place = np.arange(total) - np.repeat(start, self.n)  # in the part
        self.doc = np.repeat(np.arange(len(self.n)), self.n)
        self.real = self.place >= self.skip[self.doc]  # what is only context is not counted
        fold = np.array([-1 if f is None else f for f in row["fold"]], np.int64)
        self.fold = fold[self.doc]
        self.keys, sofar, power = [], h.copy(), M1
        tag = np.uint64((1 << TAG) - 1)
        for k in range(1, order + 1):
            if k > 1:
                before = np.full(total, BEGIN)  # before a document's first word stands its beginning
                before[k - 1:] = h[: total - k + 1] if total >= k else before[k - 1:]
                before[self.place < k - 1] = BEGIN
                sofar = sofar + before * power
                power = np.uint64(int(power) * int(M1) & (1 << 64) - 1)
            self.keys.append((mix(sofar + np.uint64(k)) & ~tag) | np.uint64(k))

    def before(self, values: np.ndarray, first) -> np.ndarray:
        """A value of the token before each token; ``first`` for a document's first."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.place == 0] = first
        return out

    def distinct(self, orders):
        """Hashes of some orders, sorted; the order that sorts all; where each distinct one begins; the place of each token's."""
        order, s = sort_order(np.concatenate([self.keys[k - 1] for k in orders]))
        new = np.empty(len(s), bool)
        new[:1] = True
        np.not_equal(s[1:], s[:-1], out=new[1:])
        first = np.flatnonzero(new)
        where = np.empty(len(s), np.int64)
        where[order] = np.cumsum(new) - 1
        return s[first], order, first, where.reshape(len(orders), -1)

    def counts(self, order, first, held: int, deleted: int):
        """How often each distinct n-gram is in the counts, and in the deleted fold."""
        learn = self.real & (self.fold != held)
        one, two = learn & (self.fold != deleted), learn & (self.fold == deleted)
        return [np.add.reduceat(x[order % len(x)].astype(np.int64), first) if x.any() else np.zeros(len(first), np.int64) for x in (one, two)]


class _Counted:
    """A block's n-grams with what came back for them. ``kept`` and ``lost`` are counts of each token's n-grams by order."""

    def __init__(self, row, order: int, held: int, deleted: int):
        self.grams = g = _Grams(row, order)
        low = range(1, max(order, 2))
        keys, at, first, where = g.distinct(low)
        kept, lost, many = _sums(row["back"], len(keys))
        self.kept, self.lost, self.longest = [kept[w] for w in where], [lost[w] for w in where], where[-1]
        if order > 1:
            elsewhere = many[where[-1]]
            self.keys, at, first, (self.longest,) = g.distinct([order])
            self.own = g.counts(at, first, held, deleted)
            #: Which of the longest n-grams other blocks can have.
            self.asked = (elsewhere & g.before(elsewhere, True))[at[first]]

    def finish(self, back) -> None:
        """The longest n-grams' counts: what came back for those that were sent, the block's own for the others."""
        if self.grams.order > 1:
            for mine, all_, into in zip(self.own, _sums(back, int(self.asked.sum())), (self.kept, self.lost)):
                mine[self.asked] = all_
                into.append(mine[self.longest])


def _sums(back, n: int) -> list[np.ndarray]:
    """What came back for a block's ``n`` sorted n-grams: both counts, and whether other blocks have them."""
    back = sorted(back or [], key=lambda x: x["r"])
    out = [[expand(x[c], "<i8") for x in back] for c in ("kept", "lost")]
    out.append([np.unpackbits(np.frombuffer(x["many"], np.uint8), count=len(k)).astype(bool) for x, k in zip(back, out[0])])
    out = [np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(out, (np.int64, np.int64, bool))]
    if len(out[0]) != n:
        raise RuntimeError("a block did not get sums for just its n-grams")
    return out


def _slices(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where each range of the hash begins among sorted keys."""
    edges = (np.arange(1, ranges, dtype=np.uint64) << np.uint64(32)) // np.uint64(ranges)
    return np.concatenate([[0], np.searchsorted(keys, edges << np.uint64(32), "left"), [len(keys)]])


def _send(order: int, ranges: int, held: int, deleted: int, longest: bool):
    def run(batches):
        for batch in batches:
            for row in _each(batch):
                if longest:
                    c = _Counted(row, order, held, deleted)
                    keys, kept, lost = (x[c.asked] for x in (c.keys, *c.own))
                else:
                    g = _Grams(row, order)
                    keys, at, first, _ = g.distinct(range(1, max(order, 2)))
                    kept, lost = g.counts(at, first, held, deleted)
                cut = _slices(keys, ranges).tolist()
                for r, (a, b) in enumerate(zip(cut, cut[1:])):
                    if b > a:
                        step = np.diff(keys[a:b], prepend=np.uint64(0))
                        data = [squeeze(step), squeeze(kept[a:b].astype("<u4")), squeeze(lost[a:b].astype("<u4"))]
                        yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([row["block"]], pa.int64()), *(pa.array([x], pa.binary()) for x in data)], names=["r", "block", "keys", "kept", "lost"])

    return run


def _add_up(batches):
    """Rows come sorted by range. Sums go back to each block, and which n-grams other blocks have; a row of a negative block tells how many distinct tokens were learned."""

    def rows(r, got):
        blocks, keys, kept, lost = zip(*got)
        size = np.cumsum([0, *map(len, keys)])
        order, s = sort_order(np.concatenate(keys))
        new = np.empty(len(s), bool)
        new[:1] = True
        np.not_equal(s[1:], s[:-1], out=new[1:])
        first = np.flatnonzero(new)
        where = np.empty(len(s), np.int64)
        where[order] = np.cumsum(new) - 1
        sums = [np.add.reduceat(np.concatenate(x).astype(np.int64)[order], first) for x in (kept, lost)]
        token = (s[first] & np.uint64((1 << TAG) - 1)) == 1
        known = [int((token & (sums[0] > 0)).sum()), int((token & (sums[0] + sums[1] > 0)).sum())]
        many = np.diff(np.append(first, len(s))) > 1  # a block sends a key once
        out = [(-1 - r, r, b"", b"", b"", *known)]
        for b, lo, hi in zip(blocks, size[:-1].tolist(), size[1:].tolist()):
            i = where[lo:hi]
            out.append((b, r, squeeze(sums[0][i].astype("<i8")), squeeze(sums[1][i].astype("<i8")), np.packbits(many[i]).tobytes(), 0, 0))
        types = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["block", "r", "kept", "lost", "many", "v_kept", "v_all"])

    got, now = [], None
    for batch in batches:
        for r, block, keys, kept, lost in zip(*(batch.column(c).to_pylist() for c in ("r", "block", "keys", "kept", "lost"))):
            if r != now and got:
                yield rows(now, got)
                got = []
            now = r
            got.append((block, np.cumsum(expand(keys, "<u8"), dtype=np.uint64), expand(kept, "<u4"), expand(lost, "<u4")))
    if got:
        yield rows(now, got)


def contexts_of(grams: _Grams, counts: list[np.ndarray], docs: int, tokens: int) -> list[np.ndarray]:
    """How often the context of each token's n-gram was learned: all tokens, then the n-gram before it that is one shorter."""
    return [np.full(len(counts[0]), tokens), *(grams.before(c, docs) for c in counts[:-1])]


def bucket(contexts) -> np.ndarray:
    """The longest context that was learned, and the power of two of its count."""
    out = np.zeros(len(contexts[0]), np.int64)
    for k, c in enumerate(contexts):
        known = c > 0
        out[known] = k * LEVELS + np.log2(c[known]).astype(np.int64) + 1
    return out


def likelihoods(counts, contexts, v: int) -> np.ndarray:
    """Maximum-likelihood estimates (orders + 1, tokens); the first is the same for all words, one of them unknown."""
    p = np.zeros((len(counts) + 1, len(counts[0])))
    p[0] = 1.0 / (v + 1)
    for k, (c, n) in enumerate(zip(counts, contexts)):
        np.divide(c, n, out=p[k + 1], where=n > 0)
    return p


def _held_counts(order: int, docs: int, tokens: int, held: int, deleted: int):
    """For each block the deleted fold's distinct longest n-grams: how often, and all counts that its estimates need."""

    def run(batches):
        for batch in batches:
            for row in _each(batch):
                c = _Counted(row, order, held, deleted)
                c.finish(row["back_longest"])
                g = c.grams
                contexts = contexts_of(g, c.kept, docs, tokens)
                some = np.flatnonzero(g.real & (g.fold == deleted))
                _, first, h = np.unique(c.longest[some], return_index=True, return_counts=True)
                some = some[first]
                data = [squeeze(x.astype("<i8")) for x in (h, *(x[some] for x in c.kept), *(x[some] for x in contexts[1:]))]
                yield pa.RecordBatch.from_arrays([pa.array([data], pa.list_(pa.binary()))], names=["data"])

    return run


def _expect(weights: np.ndarray, order: int, tokens: int, v: int):
    """A round's sums by bucket: how much of each bucket's tokens each estimate explains, and their log likelihood."""

    def run(batches):
        sums = np.zeros((order * LEVELS, order + 2))
        for batch in batches:
            for data in batch.column("data").to_pylist():
                h, *x = [expand(d, "<i8") for d in data]
                counts, contexts = x[:order], [np.full(len(h), tokens), *x[order:]]
                b = bucket(contexts)
                mixed = weights[b].T * likelihoods(counts, contexts, v)
                total = mixed.sum(0)
                for k in range(order + 1):
                    sums[:, k] += np.bincount(b, h * mixed[k] / total, len(sums))
                sums[:, -1] += np.bincount(b, h * np.log(total), len(sums))
        some = np.flatnonzero(sums[:, :-1].any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(list(sums[some]), pa.list_(pa.float64()))], names=["bucket", "sums"])

    return run


def start_weights(order: int) -> np.ndarray:
    """Equal weights for the estimates that a bucket's contexts can give."""
    w = np.zeros((order * LEVELS, order + 1))
    for k in range(order):
        w[k * LEVELS: (k + 1) * LEVELS, : k + 2] = 1.0 / (k + 2)
    w[0] = [1.0] + [0.0] * order  # nothing was learned
    return w


def learn_weights(held: DataFrame, order: int, tokens: int, v: int, rounds: int = ROUNDS, near: float = NEAR) -> np.ndarray:
    """Weights of the estimates by bucket. A round adds one to what each estimate explains, so none that a bucket can have
    ends at zero, and a bucket without held-out tokens has equal weights."""
    w, before = start_weights(order), None
    can = w > 0
    for _ in range(rounds):
        got = held.mapInArrow(_expect(w, order, tokens, v), "bucket int, sums array<double>")
        got = got.groupBy("bucket").agg(*[F.sum(F.get("sums", F.lit(k))).alias(f"s{k}") for k in range(order + 2)]).collect()  # a row for each bucket
        if not got:
            break
        sums = np.zeros((order * LEVELS, order + 2))
        for r in got:
            sums[r.bucket] = list(r)[1:]
        new = np.where(can, sums[:, :-1] + 1, 0)
        w = new / new.sum(1, keepdims=True)
        now = sums[:, -1].sum() / sums[:, :-1].sum()
        if before is not None and now - before < near:
            break
        before = now
    return w


def _score(order: int, weights: np.ndarray, docs: int, tokens: int, v: int, held: int, deleted: int):
    def run(batches):
        for batch in batches:
            for row in _each(batch):
                known = _Counted(row, order, held, deleted)
                known.finish(row["back_longest"])
                g, counts = known.grams, [a + b for a, b in zip(known.kept, known.lost)]
                contexts = contexts_of(g, counts, docs, tokens)
                p = (weights[bucket(contexts)].T * likelihoods(counts, contexts, v)).sum(0)
                c = counts[0]
                add = lambda x: np.add.reduceat(np.where(g.real, x, 0), g.start)
                sums = [add(np.ones(len(c), np.int64)), add((c > 0).astype(np.int64)), add(np.log10((c + 1) / (tokens + v + 1))), add(np.log10(p))]
                yield pa.RecordBatch.from_arrays([pa.array(row["row"], pa.int64()), pa.array(row["doc_id"], pa.int64()), pa.array(row["fold"], pa.int32()), *map(pa.array, sums)],
                                                 names=["row", "doc_id", "fold", "n_tokens", "n_known", "base_score", "score"])

    return run


def score_documents(docs: DataFrame, order: int = ORDER, folds: int = FOLDS, held: int = HELD, deleted: int = DELETED, id_col: str = "doc_id", text_col: str = "text",
                    tokens: int = TOKENS, per_range: int = RANGE, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are words, A-Z lower-cased, and one end. Documents whose crc32 of the id as text leaves ``held`` by ``folds`` are
    never learned from; of the others all are, those that leave ``deleted`` for the weights first. Null text counts as
    empty: its only token is the end. A null id has crc 0. Repeated rows are learned from as often as they are there and
    each have their result; there are no ties, as nothing is chosen. An empty table gives no rows; without a training
    document every token has probability 1. Other columns are ignored, whatever their names. A text of any length is
    cut into portions, and goes on in the next block after about ``tokens`` tokens, so a task holds a text once and one
    block: about 300 bytes for each of its tokens. N-grams are told apart by 61 bits of hash; of 10^9 different ones
    about one pair in five tables would count as one.
    """
    if not 1 <= order < 1 << TAG:
        raise ValueError("the order must be from 1 to 7")
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    d = d.withColumn("fold", (F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % folds).cast("int"))
    n = partitions(spark)
    # the number is given as the block is written, so no two blocks share it
    made = d.mapInArrow(_blocks(tokens, order, deleted), BLOCKS).withColumn("block", F.monotonically_increasing_id())
    blocks = materialize_bucketed(made, "block", n, "blocks")
    size = F.expr("aggregate(zip_with(n, skip, (a, b) -> a - b), 0L, (s, x) -> s + x)")
    of = lambda name, test, what: F.sum(F.when(F.expr(test), F.col(what)).otherwise(0)).alias(name)
    part = blocks.select(F.col("block"), size.alias("size"), F.explode(F.arrays_zip("n", "skip", "fold", "begins")).alias("x")).select(
        (F.col("x.n") - F.col("x.skip")).alias("n"), F.col("x.begins").cast("long").alias("doc"), F.col("x.fold").alias("fold"))
    kept, learned = f"fold not in ({held}, {deleted})", f"fold <> {held}"
    t = part.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"), of("n_kept", kept, "n"), of("n_all", learned, "n"), of("d_kept", kept, "doc"), of("d_all", learned, "doc")).first()

    def exchange(d: DataFrame, orders: int, longest: bool) -> DataFrame:
        """Sums over all blocks of what each block sends, in buckets by block."""
        ranges = max(n, -(-t["all"] * orders // per_range))
        sent = d.mapInArrow(_send(order, ranges, held, deleted, longest), "r int, block long, keys binary, kept binary, lost binary")
        summed = sent.repartitionById(ranges, "r").sortWithinPartitions("r").mapInArrow(_add_up, "block long, r int, kept binary, lost binary, many binary, v_kept long, v_all long")
        return materialize_bucketed(summed.repartition(n, "block"), "block", n, "sums")

    def with_sums(d: DataFrame, back: DataFrame, name: str) -> DataFrame:
        own = back.filter("block >= 0").groupBy("block").agg(F.collect_list(F.struct("r", "kept", "lost", "many")).alias(name))  # a block's own n-grams, no more
        return d.join(own.hint("merge"), "block", "left")

    back = exchange(blocks, max(order - 1, 1), False)
    v = back.filter("block < 0").agg(F.coalesce(F.sum("v_kept"), F.lit(0)).alias("kept"), F.coalesce(F.sum("v_all"), F.lit(0)).alias("all")).first()
    both = with_sums(blocks, back, "back")
    both = with_sums(both, exchange(both, 1, True), "back_longest") if order > 1 else both.withColumn("back_longest", F.lit(None))

    n_kept, d_kept, n_all, d_all = (int(t[c] or 0) for c in ("n_kept", "d_kept", "n_all", "d_all"))
    lost = both.filter(F.array_contains("fold", deleted))  # these blocks have no other documents
    counts = materialize(lost.mapInArrow(_held_counts(order, d_kept, n_kept, held, deleted), "data array<binary>"), "held")
    weights = learn_weights(counts, order, n_kept, v["kept"], rounds)
    s = both.mapInArrow(_score(order, weights, d_all, n_all, v["all"], held, deleted), "row long, doc_id long, fold int, n_tokens long, n_known long, base_score double, score double")
    s = s.groupBy("row").agg(F.first("doc_id").alias("doc_id"), (F.first("fold") == held).alias("held_out"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    return s.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score")
