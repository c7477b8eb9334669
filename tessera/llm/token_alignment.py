"""How the tokens of two tokenizers lie over one another, and how often each pair of ids does so in the corpus.

Both tokenizers cut the same bytes, so the ends of their tokens cut a text into stretches that lie in one token of
each: a stretch is a link. Where both end a token, a group of tokens ends. Documents are taken in blocks, written once:
the distinct segments of a block (text between cuts that neither tokenizer joins) with their links, and the documents
as lists of segments. A link is a packed 64-bit key, the id of B above the id of A. Keys are counted in each partition,
dealt by ranges, sorted and summed; the sorted counts are written as shards of two plain arrays, which the tasks that
read the blocks again map into memory and search.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions, scratch
from .deleted_interpolation import _each, expand, squeeze

BLOCK = 12 << 20  # characters of a block; a longer text is a block of its own
PORTION = 4 << 20  # characters of a text that are cut at once
SHARD = 4 << 20  # keys of a shard
BLOCKS = "doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, sha array<string>, n array<long>, codes binary, links binary, keys binary"
SHARDS = "file string, first long, last long, n long, b binary, best binary"
MARK = "▁"


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others in order from U+0100 on."""
    plain = [b for r in ((33, 126), (161, 172), (174, 255)) for b in range(r[0], r[1] + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """The two tokenizers. A encodes space and text, B the text, in front of which it puts a space by itself."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True  # their strings are plain text
        letters, vocabulary = byte_letters(), self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        piece = self.b.id_to_piece
        self.b_bytes = [bytes([int(piece(i)[3:-1], 16)]) if self.b.is_byte(i) else piece(i).replace(MARK, " ").encode() for i in range(self.b.get_piece_size())]
        #: Whether B never joins what stands before a single space with what stands behind it.
        self.cuts = not any(" " in p.decode("utf-8", "replace").lstrip(" ") for p in self.b_bytes)

        self.a_size, self.b_size = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.names = list(map(str, range(max(len(self.a_bytes), len(self.b_bytes)))))
        from .token_files import _Encoder

        self.encoder = _Encoder(a_path, plain=True)  # A's ids of many short texts

    def encode_a(self, text: str) -> np.ndarray:
        return np.array(self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, np.int64)

    def encode_b(self, text: str) -> np.ndarray:
        return np.array(self.b.encode([text], num_threads=1)[0], np.int64)

    def segments(self, texts: list[str]) -> list:
        """For each text its links as ``Links``, None where the tokens do not give it back."""
        e = self.encoder
        e.clear()
        if e.cuts:
            e.learn(set(texts))
            rest = [t for t in texts if t not in e.after and not t[0].isspace()]  # with line ends inside: many in one call
            for t, x in zip(rest, self.a.encode_batch_fast([" " + t for t in rest], add_special_tokens=False)):
                e.after[t] = np.array(x.ids, e.type).tobytes()
            ids = [e.literal(" " + t) if t[0].isspace() else e.after[t] for t in texts]
            a, n_a = np.frombuffer(b"".join(ids), e.type).astype(np.int64), np.array([len(x) // e.type.itemsize for x in ids], np.int64)
        else:
            ids = [self.encode_a(t) for t in texts]
            a, n_a = np.concatenate(ids), np.array(list(map(len, ids)), np.int64)
        ids = self.b.encode(texts, num_threads=1)
        b, n_b = np.array(list(itertools.chain.from_iterable(ids)), np.int64), np.array(list(map(len, ids)), np.int64)
        raw = [b" " + t.encode() for t in texts]
        same = b"".join([self.a_bytes[i] for i in a.tolist()]) == b"".join([self.b_bytes[i] for i in b.tolist()]) == b"".join(raw)
        size = np.array(list(map(len, raw)), np.int64)
        if len(texts) > 1 and not (same and np.array_equal(totals(self.a_size[a], n_a), size) and np.array_equal(totals(self.b_size[b], n_b), size)):
            return [self.segments([t])[0] for t in texts] if len(texts) <= 100 else [x for i in range(0, len(texts), 100) for x in self.segments(texts[i: i + 100])]
        return align(self, a, n_a, b, n_b) if same and texts[0] else [None]


class Links:
    """Of a text: the packed keys of its links in order, its groups as text, their number, the numbers of its tokens."""

    __slots__ = ("keys", "text", "groups", "a", "b")

    def __init__(self, keys: bytes, text: str, groups: int, a: int, b: int):
        self.keys, self.text, self.groups, self.a, self.b = keys, text, groups, a, b


def totals(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of the first n[0], the next n[1], ... of ``x``."""
    ends = np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], np.cumsum(n)])]
    return np.diff(ends)


def align(pair: Pair, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> list[Links]:
    """Links of texts whose tokens, one text after another, cover the same bytes: both end a token where a text ends."""
    end_a, end_b = np.cumsum(pair.a_size[a]), np.cumsum(pair.b_size[b])
    ends = np.union1d(end_a, end_b)
    i, j = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
    keys = (b[j] << 32 | a[i]).tobytes()
    both = np.flatnonzero((end_a[i] == ends) & (end_b[j] == ends))  # links that end a group
    # of each text where its tokens, links and groups end
    to_a, to_b = np.cumsum(n_a).tolist(), np.cumsum(n_b).tolist()
    to_link = (np.searchsorted(ends, end_a[np.array(to_a) - 1]) + 1).tolist()
    to_group = np.searchsorted(both, np.array(to_link) - 1) + 1
    cut_a, cut_b, to_group = (i[both] + 1).tolist(), (j[both] + 1).tolist(), to_group.tolist()
    name_a, name_b = ([pair.names[x] for x in y.tolist()] for y in (a, b))
    out, at, bt, kt, gt = [], 0, 0, 0, 0
    for ae, be, ke, ge in zip(to_a, to_b, to_link, to_group):
        if ge - gt == 1:
            text = f"{','.join(name_a[at:ae])}|{','.join(name_b[bt:be])}"
        else:
            parts, x, y = [], at, bt
            for g in range(gt, ge):
                parts.append(f"{','.join(name_a[x:cut_a[g]])}|{','.join(name_b[y:cut_b[g]])}")
                x, y = cut_a[g], cut_b[g]
            text = ";".join(parts)
        out.append(Links(keys[8 * kt: 8 * ke], text, ge - gt, ae - at, be - bt))
        at, bt, kt, gt = ae, be, ke, ge
    return out


@functools.lru_cache(maxsize=2)
def _pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


class _Pieces(dict):
    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, piece):
        self[piece] = n = len(self)
        self.fresh.append(piece)
        return n


def portions(text: str, size: int):
    """A text in parts at cuts (a single space between other signs, which goes), each ``size`` characters or some more."""
    at = 0
    while len(text) - at > size:
        cut = text.find(" ", at + size)
        while cut >= 0 and (cut + 1 >= len(text) or text[cut - 1].isspace() or text[cut + 1].isspace()):
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut + 1
    yield text[at:] if at else text


def segments(text: str) -> list[str]:
    """What stands between cuts: single spaces with no white space on either side. Joined by spaces they give the text."""
    parts = text.split(" ")
    if all(parts) and not any(map(_edge, parts)):
        return parts
    out, open_ = [], [parts[0]]
    for before, p in zip(parts, parts[1:]):
        if before and p and not before[-1].isspace() and not p[0].isspace():
            out.append(" ".join(open_))
            open_ = [p]
        else:
            open_.append(p)
    return [*out, " ".join(open_)]


def _edge(p: str) -> bool:
    return p[0].isspace() or p[-1].isspace()


class _Block:
    def __init__(self, pair: Pair, known: dict):
        self.pair, self.known = pair, known  # ``known``: links of segments seen by this worker
        self.piece, self.found = _Pieces(), []
        self.docs, self.codes, self.waiting, self.size = [], [], [], 0

    def _learn(self) -> None:
        fresh, self.piece.fresh = self.piece.fresh, []
        new = [p for p in fresh if p not in self.known]
        if len(self.known) + len(new) > 600_000:  # a bound on a worker's memory, not on what is aligned
            self.known.clear()
            new = fresh
        for lo in range(0, len(new), 50_000):
            some = new[lo: lo + 50_000]
            self.known.update(zip(some, self.pair.segments(some)))
        self.found += [self.known[p] for p in fresh]

    def whole(self, text: str):
        """A text that no cut may part, as a segment of its own."""
        a, b = self.pair.encode_a(text), self.pair.encode_b(text)
        ta, tb = (b"".join([t[i] for i in x.tolist()]) for t, x in ((self.pair.a_bytes, a), (self.pair.b_bytes, b)))
        if not ta == tb == b" " + text.encode():
            return None
        k = self.piece.setdefault((len(self.piece), "whole"), len(self.piece))  # a name that no segment has
        self.found += align(self.pair, a, np.array([len(a)]), b, np.array([len(b)]))
        return k

    def add(self, doc_id, text: str) -> None:
        """Segments are learned many at once, so a document's result waits for them."""
        codes = []
        if text and self.pair.cuts:
            for part in portions(text, PORTION):
                codes.append(np.array([self.piece[p] for p in segments(part)], np.int64))
        self.waiting.append((doc_id, text, codes))
        self.size += len(text) + 1
        if len(self.piece.fresh) >= 50_000:
            self.finish()

    def finish(self) -> None:
        self._learn()
        for doc_id, text, codes in self.waiting:
            c = np.concatenate(codes) if codes else np.zeros(0, np.int64)
            found, sha, lost = [self.found[i] for i in c.tolist()], hashlib.sha256(), not codes
            if None in found:
                lost, k = True, self.whole(text)
            elif text and not codes:
                k = self.whole(text)
            else:
                k = None
                for lo in range(0, len(found), 100_000):
                    sha.update((";" if lo else "").encode() + ";".join([s.text for s in found[lo: lo + 100_000]]).encode())
            if k is not None:
                c, sha, lost = np.array([k], np.int64), hashlib.sha256(self.found[k].text.encode()), False
            self.codes.append(np.zeros(0, np.int64) if lost else c)
            self.docs.append((doc_id, "" if lost else sha.hexdigest()))
        self.waiting = []

    def batch(self) -> pa.RecordBatch:
        self.finish()
        n = np.array([len(c) for c in self.codes], np.int64)
        codes = np.concatenate(self.codes)
        used, codes = np.unique(codes, return_inverse=True)  # segments of texts that have no tokens are not sent
        found = [self.found[i] for i in used.tolist()]
        links = np.array([len(f.keys) // 8 for f in found], np.int64)
        doc = np.repeat(np.arange(len(n)), n)
        of = lambda x: np.bincount(doc, np.array(x, np.float64)[codes], len(n)).astype(np.int64) if len(codes) else np.zeros(len(n), np.int64)
        counts = [of([getattr(f, k) for f in found]) for k in ("a", "b", "groups")]
        ids, sha = zip(*self.docs)
        lists = [(ids, pa.int64()), *((c, pa.int64()) for c in (*counts, of(links))), (sha, pa.string()), (n, pa.int64())]
        data = [codes.astype("<u4"), links.astype("<u4"), np.frombuffer(b"".join([f.keys for f in found]), "<i8")]
        columns = [pa.array([list(c)], pa.list_(t)) for c, t in lists] + [pa.array([squeeze(x)], pa.binary()) for x in data]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "sha", "n", "codes", "links", "keys"])


def _blocks(a_path: str, b_path: str, block: int):
    def run(batches):
        pair, known = _pair(a_path, b_path), {}
        b = _Block(pair, known)
        for batch in batches:
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                t = t or ""
                if b.size and b.size + len(t) > block:
                    yield b.batch()
                    b = _Block(pair, known)
                b.add(i, t)
        if b.size:
            yield b.batch()

    return run


def _links(row):
    """A block's links by segment, and how often each segment is there."""
    codes, size, keys = expand(row["codes"], "<u4"), expand(row["links"], "<u4").astype(np.int64), expand(row["keys"], "<i8")
    return codes, size, keys


def total(keys: np.ndarray, counts: np.ndarray):
    """Distinct keys in order, with the sums of their counts."""
    found, where = np.unique(keys, return_inverse=True)
    order = np.argsort(where, kind="stable")
    first = np.searchsorted(where[order], np.arange(len(found)))
    return found, np.add.reduceat(counts[order], first) if len(found) else np.zeros(0, np.int64)


def _count(most: int):
    """Partial counts of a partition: distinct keys of all its blocks so far, sent when they are many."""

    def out(parts):
        keys, counts = total(*(np.concatenate(x) for x in zip(*parts)))
        for lo in range(0, len(keys), 500_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[lo: lo + 500_000]), pa.array(counts[lo: lo + 500_000])], names=["key", "count"])

    def run(batches):
        parts, size = [], 0
        for batch in batches:
            for row in _each(batch):
                codes, n, keys = _links(row)
                parts.append(total(keys, np.repeat(np.bincount(codes, minlength=len(n)), n)))
                size += len(parts[-1][0])
                if size >= most:
                    parts = [total(*(np.concatenate(x) for x in zip(*parts)))]
                    size = len(parts[0][0])
                    if size >= most // 2:
                        yield from out(parts)
                        parts, size = [], 0
        if parts:
            yield from out(parts)

    return run


def _shards(folder: str, most: int):
    """Rows come sorted by key: run lengths are summed and written as sorted arrays; an index row tells each shard's first and
    last key, and the highest count of each id of B in it. Each attempt has files of its own."""

    def write(keys, counts):
        from .token_files import _filesystem

        name = f"{folder}/{uuid.uuid4().hex}.keys"
        fs, path = _filesystem(name)
        fs.create_dir(os.path.dirname(path), recursive=True)
        with fs.open_output_stream(path) as f:
            f.write(keys.astype("<i8").tobytes())
            f.write(counts.astype("<i8").tobytes())
        b = keys >> 32
        first = np.flatnonzero(np.diff(b, prepend=-1))
        row = [[name], [int(keys[0])], [int(keys[-1])], [len(keys)], [squeeze(b[first])], [squeeze(np.maximum.reduceat(counts, first))]]
        types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, types)], names=["file", "first", "last", "n", "b", "best"])

    def run(batches):
        keys, counts, size = [], [], 0
        for batch in batches:
            k, c = total(np.asarray(batch.column("key")), np.asarray(batch.column("count")))
            if not len(k):
                continue
            if keys and keys[-1][-1] == k[0]:
                counts[-1][-1] += c[0]
                k, c = k[1:], c[1:]
            keys.append(k)
            counts.append(c)
            size += len(k)
            keys, counts = [x for x in keys if len(x)], [x for x in counts if len(x)]
            while size > most:  # the last key may go on in the next batch, so it stays
                k, c = np.concatenate(keys), np.concatenate(counts)
                yield write(k[:most], c[:most])
                keys, counts, size = [k[most:]], [c[most:]], size - most
        if keys:
            yield write(np.concatenate(keys), np.concatenate(counts))

    return run


class Shards:
    """Lookup of counts in sorted shards, mapped into memory where they lie in a local or mounted folder."""

    def __init__(self, index: list[tuple[str, int, int, int]]):
        self.index = sorted(index, key=lambda x: x[1])
        self.first = np.array([x[1] for x in self.index], np.int64)

    def open(self, k: int):
        from pyarrow import fs as pafs

        from .token_files import _filesystem

        name, _, _, n = self.index[k]
        fs, path = _filesystem(name)
        if isinstance(fs, pafs.LocalFileSystem):
            m = np.memmap(path, "<i8", "r", shape=(2 * n,))
        else:  # a store without mapping: one shard at a time
            with fs.open_input_stream(path) as f:
                m = np.frombuffer(f.read(), "<i8")
        return m[:n], m[n:]

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted keys, all of which are in the shards."""
        out = np.zeros(len(keys), np.int64)
        of = np.searchsorted(self.first, keys, "right") - 1
        cut = np.searchsorted(of, np.arange(len(self.index) + 1))
        for k, (lo, hi) in enumerate(zip(cut, cut[1:])):
            if hi > lo:
                have, count = self.open(k)
                at = np.searchsorted(have, keys[lo:hi])
                if at[-1] >= len(have) or not np.array_equal(have[at], keys[lo:hi]):
                    raise RuntimeError("a shard lacks a key")
                out[lo:hi] = count[at]
        return out


def _results(index, best: np.ndarray):
    def run(batches):
        shards = Shards(index)
        for batch in batches:
            for row in _each(batch):
                codes, n, keys = _links(row)
                doc = np.repeat(np.arange(len(row["n"])), row["n"])
                sums = [np.zeros(len(row["n"]), np.int64)] * 2
                if len(keys):
                    some, where = np.unique(keys, return_inverse=True)
                    c = shards.counts(some)
                    top = (c == best[some >> 32]).astype(np.int64)[where]
                    start = np.cumsum(n) - n
                    per = [np.add.reduceat(x, start) for x in (top, c[where])]  # each segment has a link
                    first = np.flatnonzero(np.diff(doc, prepend=-1))
                    sums = []
                    for x in per:
                        s = np.zeros(len(row["n"]), np.int64)
                        s[doc[first]] = np.add.reduceat(x[codes], first)
                        sums.append(s)
                columns = [pa.array(row[c], pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
                yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, sums), pa.array(row["sha"], pa.string())],
                                                 names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return run


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs): a row per document with doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; and the
    index of the shards that hold the counts of all pairs.

    ``a_path`` is a byte-level vocabulary of the tokenizers library, ``b_path`` a sentencepiece model. Texts that are null
    or empty, or that the tokens of A or B do not give back, have no tokens. Null ids, repeated ids and repeated rows are
    rows like any other, and their links count as often as they are there; pairs with the same highest count are all the
    best. An empty table gives no rows; other columns are ignored, whatever their names. A text of any length is cut into
    segments ``PORTION`` characters at a time; a text without cuts is encoded whole. A task holds a block, about 40 bytes
    a character. What the driver holds is one number for each id of B, and a row for each shard.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks = materialize(d.mapInArrow(_blocks(a_path, b_path, block), BLOCKS), "blocks")
    partial = materialize(blocks.select("codes", "links", "keys").mapInArrow(_count(shard), "key long, count long"), "partial")
    dealt = partial.repartitionByRange(n, "key").sortWithinPartitions("key")
    index = materialize(dealt.mapInArrow(_shards(scratch(spark, "shards"), shard), SHARDS), "index")
    rows = index.collect()  # a row for each shard; of each id of B a number, or two where it lies in two shards
    best = np.zeros(1 + max([int(expand(r.b, "<i8")[-1]) for r in rows], default=0), np.int64)
    for r in rows:
        np.maximum.at(best, expand(r.b, "<i8"), expand(r.best, "<i8"))
    names = [(r.file, r.first, r.last, r.n) for r in rows]
    out = blocks.mapInArrow(_results(names, best), "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return out, index.select("file", "first", "last", "n")
