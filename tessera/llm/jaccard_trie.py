"""N-gram Jaccard join with a prefix tree.

N-grams have one order everywhere: by how often their bucket of hashes occurs in all documents, the rarest first,
then by hash. Documents whose sets can reach the threshold are brought together first: a set's hash range is cut
into more parts than two linked sets can differ in, so linked sets have a part in common, whole and not empty. Short
sets, and those with too many empty parts, give the rarest n-grams of their prefix instead: of two linked sets these
have one in common. Sets so short that no other set can be linked to them give nothing. Who shares such a key is
joined into candidate groups. These chain where documents share passages, so within a group bitmaps are compared, two
to four bits for an n-gram: bits that differ come from n-grams that do, and only sets that may be within the threshold
stay together. Each group that is left goes into a trie in the global order, the most frequent n-gram at its root. Blocks of query sets go down the trie together, each node adding its overlap once for all sets below it,
and leave a subtree as soon as the lengths that remain cannot give the overlap needed. Large groups are cut into
chunks of sets of about one size, and every pair of chunks whose sizes can be linked is a task of its own. A task
counts all links and reports those that span what it found linked, so components lose nothing and no group's pairs
are written out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SALTS, fits, lean, materialize, partitions, with_group
from .components import connected_components
from .wordhash import M1, M2, mix, starts, word_hashes

SPARE = 3  # parts that may be empty in both sets, besides those that chance leaves empty
CHUNK = 400_000  # n-grams in a chunk of a candidate group
CODES = 1 << 32  # a chunk's number is its class times this, and its place in the class
BATCH = 4_000_000  # characters of text handled at once
BUCKETS = 1 << 16  # of hashes, whose occurrences are counted: a bound on the table that gives the global order
WIDER = 32  # a chunk of bitmaps, of five times the n-grams, is at most so many times larger in the largest groups
SHORT = 64  # sets of fewer n-grams, or linked to such, are found by their prefix


def shingle_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles of lower-cased texts as sorted hashes, one text after another, and their counts.

    A text with fewer words has its whole sequence as one; a text without words has none.
    """
    h, words = word_hashes([t.lower() for t in texts])
    first = starts(words)
    full = np.maximum(words - n + 1, 0)
    short = (words > 0) & (words < n)
    count = np.where(short, 1, full)
    doc = np.repeat(np.arange(len(texts)), full)
    at = np.repeat(first, full) + np.arange(full.sum()) - np.repeat(starts(full), full)
    g = np.full(len(at), np.uint64(n))
    for i in range(n):
        g = g * M1 + h[at + i]
    extra_doc = np.flatnonzero(short)
    extra = np.array([_sequence(h[first[d]: first[d] + words[d]]) for d in extra_doc], np.uint64)
    doc, g = np.concatenate([doc, extra_doc]), mix(np.concatenate([g, extra]))
    order = np.lexsort((g, doc))
    doc, g = doc[order], g[order]
    new = np.ones(len(g), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (g[1:] != g[:-1])
    doc, g = doc[new], g[new]
    return g, np.bincount(doc, minlength=len(texts)).astype(np.int64) if len(count) else count


def _sequence(h: np.ndarray) -> int:
    x = len(h)
    for v in h.tolist():
        x = (x * int(M1) + v) & 0xFFFFFFFFFFFFFFFF
    return x


def _buckets(percent: int, upto: int) -> np.ndarray:
    """Lower bounds of size classes; sets that can be linked are in the same class or in neighbours."""
    lo = [1]
    while lo[-1] <= upto:
        lo.append(max(lo[-1] + 1, -(-lo[-1] * 100 // percent)))
    return np.array([*lo, max(lo[-1] + 1, -(-lo[-1] * 100 // percent))], np.int64)


def bucket_of(g: np.ndarray) -> np.ndarray:
    return (mix(g ^ M2) >> np.uint64(48)).astype(np.int64)


def candidate_keys(g: np.ndarray, n: np.ndarray, percent: int, counts: np.ndarray, short: int = SHORT) -> tuple[np.ndarray, np.ndarray]:
    """Keys of which linked sets share one: (key, which set). Equal sets need not: they are linked by their digests."""
    if not len(g):
        return g, np.zeros(0, np.int64)
    lo = _buckets(percent, int(n.max()))
    own = np.searchsorted(lo, n, side="right") - 1
    keys, sets = [], []
    doc = np.repeat(np.arange(len(n)), n)
    value = mix(g + M2)
    prefix = np.zeros(len(n), bool)
    for back in (0, 1):
        k = own - back
        ok = (n > 0) & (k >= 0)
        # of two linked sets the smaller has at most hi - 1 members: they differ in at most (hi - 1)(100 - t)/t
        differ = (lo[np.maximum(k, 0) + 1] - 1) * (100 - percent) // percent
        ok &= differ > 0
        prefix |= ok & (lo[np.maximum(k, 0)] < short)
        ok &= lo[np.maximum(k, 0)] >= short
        # at a low threshold parts hold few n-grams: about `empty` of them none; a class has one number of parts
        few = differ + 1 + SPARE
        empty = few * np.exp(-lo[np.maximum(k, 0)] / few)
        spare = SPARE + np.floor(1.3 * empty + 3 * np.sqrt(empty)).astype(np.int64)
        parts = np.where(ok, differ + 1 + spare, 1)
        part = ((g >> np.uint64(32)) * parts[doc].astype(np.uint64)) >> np.uint64(32)
        first = np.ones(len(g), bool)
        first[1:] = (part[1:] != part[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(first)
        total = np.add.reduceat(value, at)
        d = doc[at]
        key = mix(total ^ mix(part[at] * M1 + k[d].astype(np.uint64) * M2 + np.uint64(1)))
        use = ok[d]
        keys.append(key[use])
        sets.append(d[use])
        prefix |= ok & (parts - np.bincount(d, minlength=len(n)) > spare)
    some = np.flatnonzero(prefix[doc])
    order = some[np.lexsort((g[some], counts[bucket_of(g[some])], doc[some]))]
    size = n[doc[order]]
    place = np.arange(len(order)) - np.repeat(starts(n[prefix]), n[prefix])
    use = order[place < size - -(-size * percent // 100) + 1]
    keys.append(mix(g[use] ^ np.uint64(0x5DEECE66D)))
    sets.append(doc[use])
    return np.concatenate(keys), np.concatenate(sets)


def _batches(batches, size: int):
    """(ids, texts as bytes) of pieces of about ``size`` characters."""
    for batch in batches:
        ids, texts = batch.column("doc_id"), batch.column("text")
        lengths = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
        lo = 0
        while lo < len(ids):
            base = lengths[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(lengths, base + size, side="right")))
            yield ids.slice(lo, hi - lo), [x or b"" for x in texts.slice(lo, hi - lo).cast(pa.binary()).to_pylist()]
            lo = hi


def bitmap(g: np.ndarray) -> bytes:
    """A set's parity bitmap: each n-gram turns one bit over, of at least two for each. The length is a power of two."""
    bits = max(64, 1 << (2 * len(g) - 1).bit_length())
    odd = np.bincount((g & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def bitmap_links(n: np.ndarray, maps: list[bytes], side: np.ndarray, within: bool, percent: int):
    """Pairs (i, j) that tie together all sets that may be linked, within a side or across the two.

    Two sets differ in at least as many n-grams as their bitmaps in bits; linked ones differ in at most
    (a + b)(100 - t)/(100 + t). A bitmap folds to half its length by exclusive or.
    """
    order = np.argsort(n, kind="stable")
    n, side = n[order], side[order]
    maps = [np.frombuffer(maps[i], np.uint64) for i in order.tolist()]
    words = np.array([len(m) for m in maps])
    end = np.searchsorted(n * percent, n * 100, side="right")  # sets behind it that are not too large
    label = np.arange(len(n))
    for w in np.unique(words).tolist():
        own = np.flatnonzero(words == w)
        base, top = int(own[0]), int(end[own[-1]])
        level = np.zeros((top - base, w), np.uint64)
        for i in range(base, top):
            m = maps[i]
            while len(m) > w:
                m = m[: len(m) // 2] ^ m[len(m) // 2:]
            level[i - base] = m
        for i in own.tolist():
            at = np.arange(i + 1, end[i])
            at = at[label[at] != label[i]]
            if not within:
                at = at[side[at] != side[i]]
            # half of the bitmap tells most pairs apart
            for part in (slice(0, w // 2), slice(0, w)):
                if len(at) and part.stop:
                    bits = np.bitwise_count(level[at - base, part] ^ level[i - base, part]).sum(axis=1, dtype=np.int64)
                    at = at[bits * (100 + percent) <= (n[at] + n[i]) * (100 - percent)]
            if len(at):
                other, first = np.unique(label[at], return_index=True)
                for j in at[first].tolist():
                    yield order[i], order[j]
                label[np.isin(label, other)] = label[i]


SETS = "doc_id long, n long, digest binary, bitmap binary, bucket int"


def _set_rows(n: int, size: int):
    """A row for each document; then, with a bucket, how often the task's n-grams fall into it."""

    def run(batches):
        import xxhash

        counts = np.zeros(BUCKETS, np.int64)
        for ids, texts in _batches(batches, size):
            g, sizes = shingle_sets(texts, n)
            counts += np.bincount(bucket_of(g), minlength=BUCKETS)
            ends = np.cumsum(sizes)
            sets = [g[e - s: e] for e, s in zip(ends, sizes)]
            digest, maps = [pa.array([f(x) for x in sets], pa.binary()) for f in (lambda x: xxhash.xxh3_128_digest(x.tobytes()), bitmap)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes), digest, maps, pa.nulls(len(ids), pa.int32())], names=["doc_id", "n", "digest", "bitmap", "bucket"])
        some = np.flatnonzero(counts)
        none = pa.nulls(len(some), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.nulls(len(some), pa.int64()), pa.array(counts[some]), none, none, pa.array(some.astype(np.int32))], names=["doc_id", "n", "digest", "bitmap", "bucket"])

    return run


def _key_rows(n: int, percent: int, counts: np.ndarray, size: int, short: int):
    """Rows (key, a, null): a is the least id with the key in this batch; rows (key, a, b): b has a key of a's."""

    def run(batches):
        for ids, texts in _batches(batches, size):
            g, sizes = shingle_sets(texts, n)
            key, d = candidate_keys(g, sizes, percent, counts, short)
            a, b, key = _stars(key, ids.to_numpy()[d])
            yield from _pairs(key, a, None)
            if len(b):
                yield from _pairs(b[:, 0], b[:, 0], b[:, 1])

    return run


def _pairs(key, a, b):
    for i in range(0, len(a), 200_000):
        j = i + 200_000
        k = pa.array(np.ascontiguousarray(key[i:j]).view(np.int64))
        yield pa.RecordBatch.from_arrays([k, pa.array(a[i:j]), pa.nulls(len(k), pa.int64()) if b is None else pa.array(b[i:j])], names=["key", "a", "b"])


def _stars(key: np.ndarray, ids: np.ndarray):
    """Least id of each key; distinct (least id, other id)."""
    order = np.lexsort((ids, key))
    key, ids = key[order], ids[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    lead = ids[new][np.cumsum(new) - 1] if len(key) else ids
    other = ids != lead
    pairs = np.unique(np.stack([lead[other], ids[other]], 1), axis=0) if other.any() else np.zeros((0, 2), np.int64)
    return ids[new], pairs, key[new]


def _edges(batches):
    """Rows come sorted by key and a: every id that follows the first of its key is tied to it."""
    last_key = lead = None
    for batch in batches:
        key, a = batch.column("key").to_numpy(), batch.column("a").to_numpy()
        b = batch.column("b")
        local = b.is_valid().to_numpy(zero_copy_only=False)
        out = [np.stack([a[local], b.drop_null().to_numpy()], 1)] if local.any() else []
        key, a = key[~local], a[~local]
        if len(key):
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            new[0] = key[0] != last_key
            first = np.where(new, np.arange(len(key)), -1)
            first = np.maximum.accumulate(first)
            to = np.where(first < 0, 0 if lead is None else lead, a[np.maximum(first, 0)])
            last_key, lead = key[-1], to[-1]
            out.append(np.stack([to, a], 1)[~new & (to != a)])
        if out and sum(map(len, out)):
            p = np.unique(np.concatenate(out), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(p[:, 0])), pa.array(np.ascontiguousarray(p[:, 1]))], names=["a", "b"])


class Trie:
    """Sets of ranks in a tree with compressed paths. nodes: (ranks of the path, depth at its end, children,
    sets that end here, least and largest size below)."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        self.nodes: list[tuple] = []
        stack = [(0, len(order), 0, None)]
        while stack:
            lo, hi, depth, parent = stack.pop()
            a, b = sets[order[lo]], sets[order[hi - 1]]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[depth:m] != b[depth:m])
            end = depth + int(differ[0]) if len(differ) else m
            sizes = self.size[order[lo:hi]]
            node = (a[depth:end], end, [], [], int(sizes.min()), int(sizes.max()))
            if parent is not None:
                parent[2].append(len(self.nodes))
            self.nodes.append(node)
            i = lo
            while i < hi and len(sets[order[i]]) == end:
                node[3].append(order[i])
                i += 1
            heads = np.array([sets[order[k]][end] for k in range(i, hi)])
            cuts = [i, *(np.flatnonzero(heads[1:] != heads[:-1]) + i + 1).tolist(), hi] if i < hi else []
            stack += [(x, y, end, node) for x, y in zip(cuts, cuts[1:])]

    def probe(self, member: np.ndarray, n: np.ndarray, percent: int):
        """For query sets as rows of a 0/1 matrix over ranks, of sizes ``n``: (query, set) pairs at the threshold."""
        if not self.nodes:
            return
        least = -(-n * percent // 100)
        stack = [(0, np.arange(len(n)), np.zeros(len(n), np.int64))]
        while stack:
            k, q, overlap = stack.pop()
            path, depth, children, ends, small, large = self.nodes[k]
            fits = (large >= least[q]) & (small * percent <= n[q] * 100)
            q, overlap = q[fits], overlap[fits]
            if len(path) and len(q):
                overlap = overlap + member[np.ix_(q, path)].sum(axis=1, dtype=np.int64)
            # overlap of at least t (a + b) / (1 + t) is needed; what remains below is large - depth at most
            reach = (overlap + (large - depth)) * (100 + percent) >= percent * (n[q] + small)
            q, overlap = q[reach], overlap[reach]
            if not len(q):
                continue
            for s in ends:
                hit = 100 * overlap >= percent * (n[q] + self.size[s] - overlap)
                for x in q[hit].tolist():
                    yield x, s
            stack += [(c, q, overlap) for c in children]


def trie_links(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int, counts: np.ndarray, weight: list[np.ndarray]):
    """Links between sets of ``left`` and ``right`` (or within ``left``): as many as span what is linked, as (number on
    the left, number on the right), and for each side how many each set has, each with the weight of the other set."""
    within = right is None
    queries = left if within else right
    token = np.unique(np.concatenate(left))
    rank = np.empty(len(token), np.int64)
    rank[np.lexsort((token, -counts[bucket_of(token)]))] = np.arange(len(token))
    trie = Trie([np.sort(rank[np.searchsorted(token, s)]).astype(np.uint32) for s in left])
    parent = list(range(len(left) + (0 if within else len(queries))))
    found, links = [], [np.zeros(len(left), np.int64), np.zeros(len(queries), np.int64)]

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    step = max(1, (32 << 20) // max(1, len(token)))
    for lo in range(0, len(queries), step):
        some = queries[lo: lo + step]
        member = np.zeros((len(some), len(token)), np.uint8)
        for i, s in enumerate(some):
            at = np.minimum(np.searchsorted(token, s), len(token) - 1)
            member[i, rank[at[token[at] == s]]] = 1
        for q, s in trie.probe(member, np.array([len(s) for s in some], np.int64), percent):
            if within and s == lo + q:
                continue
            links[0][s] += weight[-1][lo + q]
            if not within:
                links[1][lo + q] += weight[0][s]
            a, b = s, lo + q + (0 if within else len(left))
            if (x := root(a)) != (y := root(b)):
                parent[max(x, y)] = min(x, y)
                found.append((s, lo + q))
    return found, links


MEMBERS = "comp long, i long, j long, side int, doc_id long, copies long, grams binary"
LINKS = "a long, b long, n_links long"


def _member_rows(n: int, size: int):
    """A row for each pair of chunks that a document takes part in."""

    def run(batches):
        for batch in batches:
            lengths = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy())
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(lengths, (lengths[lo - 1] if lo else 0) + size, side="right")))
                some = batch.slice(lo, hi - lo)
                lo = hi
                g, sizes = shingle_sets([x or b"" for x in some.column("text").cast(pa.binary()).to_pylist()], n)
                ends = np.cumsum(sizes)
                rows = []
                for e, s, doc, copies, comp, c, others in zip(ends, sizes, *(some.column(x).to_pylist() for x in ("doc_id", "copies", "comp", "chunk", "others"))):
                    data = g[e - s: e].tobytes()
                    for x in others:
                        for o in range(x["first"], x["first"] + x["chunks"]):
                            rows.append((comp, min(c, o), max(c, o), int(c > o), doc, copies, data))
                for i in range(0, len(rows), 500):
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i: i + 500]), kinds)], names=["comp", "i", "j", "side", "doc_id", "copies", "grams"])

    return run


def _join_sorted(percent: int, counts: np.ndarray):
    """Rows come sorted by (comp, i, j): one trie for each of these. Rows (a, b, null) are links; rows (a, null, n) tell
    how many a has."""

    def links(key, rows):
        sides = [[r for r in rows if r[0] == k] for k in (0, 1)]
        sets = [[np.frombuffer(r[3], np.uint64) for r in side] for side in sides]
        weight = [np.array([r[2] for r in side], np.int64) for side in sides]
        if key[1] == key[2]:
            sides = sides[:1]
            if len(sides[0]) < 2:
                return
            found, many = trie_links(sets[0], None, percent, counts, weight[:1])
        elif sides[0] and sides[1]:
            found, many = trie_links(*sets, percent, counts, weight)
        else:
            return
        for a, b in found:
            yield sides[0][a][1], sides[-1][b][1], None
        for side, m in zip(sides, many):
            for r, x in zip(side, m.tolist()):
                if x:
                    yield r[1], None, x

    def run(batches):
        key, rows, out = None, [], []
        for batch in batches:
            for comp, i, j, side, doc, copies, data in zip(*(batch.column(c).to_pylist() for c in ("comp", "i", "j", "side", "doc_id", "copies", "grams"))):
                if (comp, i, j) != key:
                    if rows:
                        out += links(key, rows)
                    key, rows = (comp, i, j), []
                rows.append((side, doc, copies, data))
            if out:
                yield _link_batch(out)
                out = []
        if rows:
            out += links(key, rows)
        if out:
            yield _link_batch(out)

    return run


def _link_batch(out):
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(3)], names=["a", "b", "n_links"])


def _near_rows(percent: int):
    """Rows come sorted by (comp, i, j): what the bitmaps of each of these tie together."""

    def near(key, rows):
        n, side, doc = (np.array([r[k] for r in rows], np.int64) for k in (0, 1, 2))
        for a, b in bitmap_links(n, [r[3] for r in rows], side, key[1] == key[2], percent):
            if doc[a] != doc[b]:
                yield int(doc[a]), int(doc[b])

    def run(batches):
        key, rows, out = None, [], []
        for batch in batches:
            for comp, i, j, *row in zip(*(batch.column(c).to_pylist() for c in ("comp", "i", "j", "n", "side", "doc_id", "bitmap"))):
                if (comp, i, j) != key:
                    if rows:
                        out += near(key, rows)
                    key, rows = (comp, i, j), []
                rows.append(row)
            if out:
                yield _ab(out)
                out = []
        if rows:
            out += near(key, rows)
        if out:
            yield _ab(out)

    return run


def _ab(out):
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _in_groups(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """``sets`` (doc_id and n among its columns) with comp, their group, and total, its n-grams; groups of one row go."""
    members = sets.join(groups.select(F.col("id").alias("doc_id"), F.col("component").alias("comp")), "doc_id")
    return with_group(members, ["comp"], "doc_id", F.sum("n").alias("total"), F.count(F.lit(1)).alias("__n")).filter("__n > 1").drop("__n")


def _in_chunks(members: DataFrame, percent: int, chunk: Column) -> DataFrame:
    """``members`` of ``_in_groups`` with their chunk and the ranges of chunks that it meets, without total.

    Sets that can be linked are in the same class of sizes or in neighbours; the classes are a little wider than need be.
    """
    width = max(math.log(100 / percent), 0.01) * 1.0001
    members = members.withColumn("class", F.when(F.col("total") > chunk, F.floor(F.log("n") / width)).otherwise(0).cast("long"))
    members = members.withColumn("__chunk", chunk).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).drop("total")
    classes = members.groupBy("comp", "class").agg(
        F.ceil(F.sum("n") / F.first("__chunk")).cast("long").alias("chunks"), F.bit_or(F.expr("shiftleft(1, salt)")).alias("places"))
    near_by = F.explode(F.array(*[F.col("class") + i for i in (-1, 0, 1)]))
    others = classes.select("comp", near_by.alias("class"), F.struct((F.col("class") * CODES).alias("first"), "chunks").alias("o")).groupBy("comp", "class").agg(F.collect_list("o").alias("others"))
    # at most three ranges for a class, in each place that has rows of it
    salts = F.explode(F.expr(f"filter(sequence(0, {SALTS - 1}), s -> (places & shiftleft(1, s)) <> 0)"))
    classes = classes.join(others, ["comp", "class"]).withColumn("salt", salts).drop("places")
    return members.join(classes, ["comp", "class", "salt"]).withColumn(
        "chunk", F.col("class") * CODES + F.pmod(F.xxhash64("doc_id"), F.col("chunks"))).drop("class", "salt", "chunks", "__chunk")


def ngram_jaccard(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, batch: int = BATCH, short: int = SHORT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, n_links (documents that it is linked to).

    Texts are linked when their sets of n-word shingles (A-Z lower-cased) have a Jaccard similarity of at least
    ``percent``; component_id is the least id that links lead to. Texts without words, null or not, have 0
    shingles and no links. A row without an id has no links and no component. Rows that share an id are one
    document as to links (n_links then counts links between their rows' sets), each with its own count. An empty
    table gives no rows. There are no ties: every link counts. Other columns are ignored, whatever their names. A text
    of any length is read whole; a task holds its words' hashes, about 40 bytes a word.
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    both = materialize(d.mapInArrow(lean(_set_rows(n, batch)), SETS), "sets")
    sets = both.filter("bucket IS NULL").drop("bucket")
    counts = np.zeros(BUCKETS, np.int64)
    for r in both.filter("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most BUCKETS rows
        counts[r.bucket] = r.n
    able = sets.filter("n > 0 AND doc_id IS NOT NULL")
    equal = with_group(able.select("doc_id", "digest").distinct(), ["digest"], "doc_id", F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    equal = materialize(equal.filter("copies > 1").select("doc_id", "rep", "copies"), "equal")
    same = equal.filter("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct()
    keys = d.filter("doc_id IS NOT NULL").mapInArrow(lean(_key_rows(n, percent, counts, batch, short)), "key long, a long, b long")
    keys = keys.repartition(parts, "key").sortWithinPartitions("key", "a")
    near = keys.mapInArrow(lean(_edges), "a long, b long")
    groups = connected_components(near, "candidates")
    # of equal sets only the one with the least id is compared, for all its copies; a copy's candidates are the least's too
    many = equal.filter("doc_id = rep").groupBy(F.col("rep").alias("id")).agg(F.sum("copies").alias("copies"))
    rows = able.select("doc_id", "n", "bitmap").join(same.select(F.col("b").alias("doc_id")), "doc_id", "left_anti")
    wide = F.greatest(F.lit(5 * chunk), F.least(F.col("total") / 64, F.lit(5 * chunk * WIDER)))
    first = materialize(_in_groups(groups, rows), "bitmaps")
    first = _in_chunks(first, percent, wide)
    first = first.withColumn("o", F.explode("others")).withColumn("o", F.explode(F.expr("sequence(o.first, o.first + o.chunks - 1)")))
    first = first.select("comp", F.least("chunk", "o").alias("i"), F.greatest("chunk", "o").alias("j"), F.expr("int(chunk > o)").alias("side"), "n", "doc_id", "bitmap")
    first = first.repartition(parts, "comp", "i", "j").sortWithinPartitions("comp", "i", "j")
    groups = connected_components(first.mapInArrow(lean(_near_rows(percent)), "a long, b long"), "near")
    members = _in_groups(groups, rows.groupBy("doc_id").agg(F.sum("n").alias("n"))).join(many.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    members = members.withColumn("copies", F.coalesce("copies", F.lit(1)))
    members = _in_chunks(materialize(members, "classes"), percent, F.lit(chunk)).select("doc_id", "comp", "copies", "chunk", "others")
    members = materialize(members, "members")
    m = members.withColumnRenamed("doc_id", "__id")
    text = d.join(F.broadcast(m) if fits(members.count(), 160) else m, F.col("doc_id") == F.col("__id")).drop("__id")
    shipped = text.mapInArrow(lean(_member_rows(n, batch)), MEMBERS)
    shipped = shipped.repartition(parts, "comp", "i", "j").sortWithinPartitions("comp", "i", "j")
    links = materialize(shipped.mapInArrow(lean(_join_sorted(percent, counts)), LINKS), "links")
    components = connected_components(links.filter("b IS NOT NULL").select("a", "b").unionByName(same), "linked")
    own = links.filter("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n_links").alias("far"))
    # a copy has the links of its set's least id, and one to each other copy
    copies = equal.filter("doc_id = rep").groupBy(F.col("rep").alias("id")).agg(F.sum(F.col("copies") - 1).alias("near"))
    own = materialize(own.join(copies, "id", "full_outer").select("id", (F.coalesce("far", F.lit(0)) + F.coalesce("near", F.lit(0))).alias("n_links"), F.col("near").isNotNull().alias("copied")), "own")
    places = own.filter("copied").select(F.col("id").alias("a"), "n_links", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    of_copy = same.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")).join(places, ["a", "salt"]).select(F.col("b").alias("id"), "n_links")
    own = own.select("id", "n_links").unionByName(of_copy).groupBy("id").agg(F.max("n_links").alias("n_links"))
    out = sets.select("doc_id", F.col("n").alias("n_shingles"))
    out = out.join(components.withColumnRenamed("id", "doc_id"), "doc_id", "left").join(own.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, without those that are linked to one with a smaller id."""
    found = ngram_jaccard(docs, id_col=id_col, **options).filter("doc_id <> component_id")
    found = materialize(found.select("doc_id").distinct(), "dropped")
    r = found.select(F.col("doc_id").alias("__r"))
    d = docs.select(F.struct("*").alias("__row"), F.col(id_col).cast("long").alias("__id"))
    return d.join(F.broadcast(r) if fits(found.count(), 50) else r, F.col("__id") == F.col("__r"), "left_anti").select("__row.*")
