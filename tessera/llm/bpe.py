"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Documents are taken in blocks, and each block is written once, with a number of its own: its list of distinct words,
and the pre-tokens' positions as numbers into that list. The words of all blocks are then shuffled and sorted, so
that each distinct word is encoded once (once for each salt; a salt stands for about ``SALTED`` blocks, so a
word that all blocks have does not end in one task). Ids are joined back to the blocks by their number, and a block
puts them in place by position. Decoding looks the ids up in the token-byte table, which is as large as the
vocabulary and part of each task. The exploded form, a row for each pre-token, has the same joins with more rows: a
hot word costs a row for each block here, whatever its count.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialize_bucketed, partitions
from .segments import Odd, Pieces, careful

BLOCK = 24 << 20  # characters of text in a block; a longer document is a block of its own
FLUSH = 400_000  # words whose ids a task of the word shuffle holds before it sends them back
SALTED = 1024  # blocks whose words meet in one task
BLOCKS = "sizes binary, words binary, head binary, data binary"
WORDS = "word binary, block long, idx int"
BACK = "block long, idx binary, data binary"


@functools.lru_cache(maxsize=4)
def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


@functools.lru_cache(maxsize=4)
def _piece_encoder(path: str):
    import tiktoken

    core = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks_of(path), special_tokens={})
    return core._core_bpe.encode_single_piece


@functools.lru_cache(maxsize=4)
def _token_bytes(path: str) -> list[bytes]:
    r = ranks_of(path)
    table = [b""] * (max(r.values()) + 1)
    for b, i in r.items():
        table[i] = b
    return table


class Block:
    """Documents and the distinct words in them."""

    def __init__(self, pattern: str):
        import regex

        self.find = regex.compile(pattern).findall
        self.word = {}
        self.flat: list[int] = []  # word numbers of the segments, one segment after another
        self.start: list[int] = [0]
        self.after = Pieces(self.segment)
        self.other: dict[str, int] = {}
        self.ids: list = []
        self.docs: list[np.ndarray] = []
        self.size = 0

    def segment(self, s: str) -> int:
        w = self.word
        self.flat += [w.setdefault(x, len(w)) for x in self.find(s)]
        self.start.append(len(self.flat))
        return len(self.start) - 2

    def literal(self, s: str) -> int:
        k = self.other.get(s)
        if k is None:
            k = self.other[s] = self.segment(s)
        return k

    def add(self, doc_id, text: str) -> None:
        first, *rest = text.split(" ")
        try:
            codes = [self.literal(first)] if first else []
            codes += map(self.after.__getitem__, rest)
        except Odd:
            codes = [self.literal(s) for s in careful(text)]
        self.docs.append(np.array(codes, np.int32))
        self.ids.append(doc_id)
        self.size += len(text) + 1

    def words(self) -> list[bytes]:
        return [w.encode() for w in self.word]

    def release(self) -> None:
        """Drop what only adding documents needs; ``after`` also holds the block itself."""
        self.word, self.other, self.after = {}, {}, None

    def positions(self):
        """The word numbers of each document, one document at a time: no array of 64 bits is longer than one of them needs."""
        flat, start = np.array(self.flat, np.int32), np.array(self.start, np.int64)
        for codes in self.docs:
            yield flat[spread(start[codes], start[codes + 1] - start[codes])]


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], ... start[0]+size[0]-1, start[1], ..."""
    end = np.cumsum(size)
    return np.repeat(start - (end - size), size) + np.arange(end[-1] if len(end) else 0)


def _blocks(batches, pattern: str, block: int):
    b = [Block(pattern)]  # in a list: a block that is given away is not held here
    for batch in batches:
        for i, t in zip(batch.column("doc_id"), batch.column("text")):  # one text at a time as a Python string
            t = t.as_py() or ""
            if b[0].docs and b[0].size + len(t) > block:
                yield b.pop()
                b.append(Block(pattern))
            b[0].add(i.as_py(), t)
    if b[0].docs:
        yield b.pop()


def _block_rows(pattern: str, block: int):
    """A row for each block: its words (how long each is; all bytes), and its documents."""

    def run(batches):
        for b in _blocks(batches, pattern, block):
            words = b.words()
            b.release()
            row = [pack(np.array([len(w) for w in words], np.int64)), squeeze(b"".join(words))]
            del words
            ids = np.array([0 if i is None else i for i in b.ids], "<i8")
            head = np.array([len(ids)], "<i8").tobytes() + ids.tobytes() + np.array([i is None for i in b.ids], np.uint8).tobytes()
            docs = list(b.positions())
            del b  # it would be held until the next block is made
            row += [head + np.array([len(x) for x in docs], "<i8").tobytes(), pack(np.concatenate(docs))]
            del docs
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in row], names=["sizes", "words", "head", "data"])

    return run


def _word_rows(batches):
    """(word, block, idx), sorted by word within a block, so that neighbours share their beginnings in the shuffle."""
    for batch in batches:
        for sizes, data, block in zip(*(batch.column(c) for c in ("sizes", "words", "block"))):
            ends = np.cumsum(unpack(sizes.as_py()))
            raw = expand(data.as_py())
            words = [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
            order = sorted(range(len(words)), key=words.__getitem__)
            for i in range(0, len(order), 50_000):
                k = order[i: i + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([words[x] for x in k], pa.binary()), pa.array(np.full(len(k), block.as_py(), np.int64)), pa.array(k, pa.int32())], names=["word", "block", "idx"])


def squeeze(b: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b)


def expand(b: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(b)


def pack(x: np.ndarray) -> bytes:
    """Numbers by planes of bytes, compressed: what a block sends of its positions."""
    return squeeze(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack(b: bytes) -> np.ndarray:
    raw = np.frombuffer(expand(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)


def _encode_sorted(path: str, most: int):
    """Rows come sorted by word: one call for each distinct word; what goes back to a block is packed in a row."""

    def run(batches):
        encode, last, ids = _piece_encoder(path), None, b""
        back: dict[int, tuple[list[int], list[bytes]]] = {}
        held = 0

        def flush():
            for key, (idx, data) in back.items():
                idx = np.array(idx, np.int64)
                order = np.argsort(idx)
                steps = np.diff(idx[order], prepend=0)
                n = np.array([len(d) // 4 for d in data], np.int64)[order]
                ids = np.frombuffer(b"".join([data[k] for k in order.tolist()]), "<u4")
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([pack(np.concatenate([steps, n]))], pa.binary()), pa.array([pack(ids)], pa.binary())], names=["block", "idx", "data"])

        for batch in batches:
            for w, key, i in zip(*(batch.column(c).to_pylist() for c in ("word", "block", "idx"))):
                if w != last:
                    last, ids = w, np.array(encode(w), "<u4").tobytes()
                to = back.get(key)
                if to is None:
                    to = back[key] = ([], [])
                to[0].append(i)
                to[1].append(ids)
                held += 1
            if held >= most:
                yield from flush()
                back.clear()
                held = 0
        yield from flush()

    return run


def _reassemble(path: str):
    """A row is a block with the ids of its words."""

    def run(batches):
        table = _token_bytes(path)
        for batch in batches:
            for head, data, back in zip(*(batch.column(c) for c in ("head", "data", "back"))):
                idx, size, ids = [], [], []
                for x in back.as_py() or []:
                    both = unpack(x["idx"])
                    idx.append(np.cumsum(both[: len(both) // 2]))
                    size.append(both[len(both) // 2:])
                    ids.append(unpack(x["data"]).astype("<u4"))
                yield from _documents(head.as_py(), data.as_py(), *_dictionary(idx, size, ids, table))

    return run


def _dictionary(idx, size, data, table):
    """By word number: where its ids start, how many there are; the ids; the bytes that they stand for."""
    none = np.zeros(0, np.int64)
    idx, size, data = (np.concatenate(x) if x else none for x in (idx, size, data))
    n = len(idx)
    order = np.argsort(idx, kind="stable")
    if n and not np.array_equal(idx[order], np.arange(n)):
        raise RuntimeError("a block did not get ids for just its words")
    start = (np.cumsum(size) - size)[order]
    ids = data.astype("<u4")
    size = size[order]
    ends = start + size
    as_list = ids.tolist()
    words = [b"".join([table[t] for t in as_list[s:e]]) for s, e in zip(start.tolist(), ends.tolist())]
    return start, size, ids, words


def _documents(head: bytes, packed: bytes, start, size, ids, words):
    n = int(np.frombuffer(head, "<i8", 1)[0])
    doc = np.frombuffer(head, "<i8", n, 8)
    null = np.frombuffer(head, np.uint8, n, 8 + 8 * n)
    counts = np.frombuffer(head, "<i8", n, 8 + 9 * n)
    flat = unpack(packed)
    if len(flat) and (not len(start) or flat.max() >= len(start)):
        raise RuntimeError("a block got no ids for its words")
    at, rows, held = 0, [], 0
    for k in range(n):
        codes = flat[at: at + counts[k]]
        at += counts[k]
        got = ids[spread(start[codes], size[codes])].tobytes()
        text = b"".join([words[c] for c in codes.tolist()])
        rows.append((None if null[k] else int(doc[k]), got, text))
        held += len(got) + len(text)
        if held > 8 << 20 or k == n - 1:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))], names=["doc_id", "ids", "decoded"])
            rows, held = [], 0


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                  block: int = BLOCK, flush: int = FLUSH, salted: int = SALTED) -> DataFrame:
    """One row per document: doc_id, ids (little-endian unsigned 32-bit integers, as bytes), decoded (bytes).

    Null text counts as empty and has no ids. Null ids, repeated ids and repeated rows are rows like any other (there
    are no ties: nothing is chosen); an empty table gives no rows; other columns are ignored, whatever their names.
    A text longer than ``block`` characters is a block of its own: a task holds one block at a time, about 60 bytes a
    character of Python objects at the most. ``docs`` is read once, in any order.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n = partitions(spark)
    # the number is given as the block is written, so no two blocks share it, equal as they may be
    made = d.mapInArrow(lean(_block_rows(pattern, block)), BLOCKS).withColumn("block", F.monotonically_increasing_id())
    blocks = materialize_bucketed(made, "block", n, "blocks")
    salts = blocks.count() // salted + 1
    words = blocks.select("sizes", "words", "block").mapInArrow(lean(_word_rows), WORDS)
    words = words.repartition(n, "word", F.pmod(F.xxhash64("block"), F.lit(salts))).sortWithinPartitions("word")
    back = words.mapInArrow(lean(_encode_sorted(ranks_path, flush)), BACK)
    back = back.groupBy("block").agg(F.collect_list(F.struct("idx", "data")).alias("back"))
    # sorted by block on both sides: the blocks lie in buckets already, and only the ids move
    both = blocks.select("block", "head", "data").join(back.hint("merge"), "block", "left").select("head", "data", "back")
    return both.mapInArrow(lean(_reassemble(ranks_path)), "doc_id long, ids binary, decoded binary")
