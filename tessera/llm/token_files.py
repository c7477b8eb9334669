"""Token-ID output: Arrow files of fixed-size-list batches.

A file holds the ids of a range of documents as one stream, cut into sequences of equal length; the last one is
filled up, and a mask tells ids (1) from filling (0). Columns: ``ids`` fixed_size_list<uint16 or uint32>[L] and ``mask``
fixed_size_list<uint8>[L], a byte each, as bits could not be viewed. Every batch but the last has the same number of
sequences, so sequence s is row s mod B of batch s div B, and ids and mask are views into the mapped file: random
access copies nothing. An index table tells where each document's ids are.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize, partitions, scratch
from .segments import Odd, Pieces, careful

LENGTH = 2048
BATCH = 256  # sequences in a record batch
CACHE = 1_600_000  # segments whose ids a Python worker keeps; then it starts anew
JOIN = 256
MARKS = ".,"
ROLL = 256 << 20  # bytes of ids after which a task begins another file
FILES = 1 << 20  # files that a task can write
INDEX = "file string, part long, no long, doc_id long, at long, n_tokens long"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class _Encoder:
    """Ids of texts as bytes, each distinct segment encoded once while it is in the cache. A text that spells an added
    token of the vocabulary is encoded whole, as the library does; with ``plain`` such a spelling is text like any other."""

    def __init__(self, path: str, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.t.encode_special_tokens = plain
        self.type = np.dtype("<u2" if self.t.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.newline = self._one("\n")
        spec = json.loads(self.t.to_str())
        before = spec.get("pre_tokenizer") or {}
        self.added = [a["content"] for a in spec.get("added_tokens") or [] if not (plain and a.get("special"))]
        #: Whether ids of segments, joined, are the ids of the text: true of a byte-level pattern alone.
        self.cuts = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec.get("normalizer")
        self.clear()

    def _one(self, s: str) -> list[int]:
        return self.t.encode_batch_fast([s], add_special_tokens=False)[0].ids

    def clear(self):
        self.after = Pieces(lambda s: np.array(self._one(s), self.type).tobytes())
        self.other: dict[str, bytes] = {}

    def learn(self, pieces: set[str]) -> None:
        """Encode many new pieces in few calls: plain words are joined by line ends, which no word's ids can hold. Of
        a word with a mark behind it the word and the mark are learned, as the pattern parts letters from marks."""
        new = [p for p in pieces if p not in self.after and p and not p[0].isspace()]
        if len(self.after) + len(new) > CACHE:
            self.clear()
            new = [p for p in pieces if p and not p[0].isspace()]
        marked = [p for p in new if p[-1] in MARKS and p[:-1].isalpha()]
        new = {p for p in new if not (p[-1] in MARKS and p[:-1].isalpha())}
        new.update(w for p in marked if (w := p[:-1]) not in self.after)
        plain = [p for p in new if len(p.split()) == 1 and not any(map(str.isspace, p))] if len(self.newline) == 1 else []
        for i in range(0, len(plain), JOIN):
            g = plain[i: i + JOIN]
            a = np.array(self._one(" " + "\n ".join(g)), self.type)
            cuts = np.flatnonzero(a == self.newline[0]).tolist()
            if len(cuts) != len(g) - 1:
                continue  # left to a call for each piece
            data, size = a.tobytes(), self.type.itemsize
            for p, lo, hi in zip(g, [-1, *cuts], [*cuts, len(a)]):
                self.after[p] = data[(lo + 1) * size: hi * size]
        for p in marked:
            self.after[p] = self.after[p[:-1]] + self.literal(p[-1])

    def literal(self, s: str) -> bytes:
        got = self.other.get(s)
        if got is None:
            if len(self.other) > CACHE // 4:
                self.other.clear()
            got = self.other[s] = np.array(self._one(s), self.type).tobytes()
        return got

    def encode(self, first: str, rest: list[str]) -> bytes:
        try:
            return b"".join([self.literal(first) if first else b"", *map(self.after.__getitem__, rest)])
        except Odd:
            return b"".join([self.literal(s) for s in careful(" ".join([first, *rest]))])

    def encode_all(self, texts: list[str]):
        if not self.cuts:
            for e in self.t.encode_batch_fast(texts, add_special_tokens=False):
                yield np.array(e.ids, self.type).tobytes()
            return
        split = [None if any(a in t for a in self.added) else t.split(" ") for t in texts]
        self.learn(set(itertools.chain.from_iterable(s[1:] for s in split if s)))
        for t, s in zip(texts, split):
            yield self.encode(s[0], s[1:]) if s else np.array(self._one(t), self.type).tobytes()


@functools.lru_cache(maxsize=2)
def _encoder(path: str, plain: bool) -> _Encoder:
    return _Encoder(path, plain)


def _schema(dtype: np.dtype, length: int) -> pa.Schema:
    kind = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
    return pa.schema([("ids", pa.list_(pa.field("item", kind, False), length)), ("mask", pa.list_(pa.field("item", pa.uint8(), False), length))])


class SequenceWriter:
    """Writes a stream of ids as sequences of equal length."""

    def __init__(self, sink, dtype: np.dtype, length: int, batch: int, fill: int):
        self.schema, self.dtype, self.length, self.batch, self.fill = _schema(dtype, length), dtype, length, batch, fill
        self.out = pa.ipc.new_file(sink, self.schema)
        self.parts: list[bytes] = []
        self.size = self.total = 0

    def add(self, ids: bytes) -> None:
        self.parts.append(ids)
        self.size += len(ids)
        self.total += len(ids) // self.dtype.itemsize
        whole = self.length * self.batch * self.dtype.itemsize
        if self.size >= whole:
            data = b"".join(self.parts)
            for i in range(0, len(data) - whole + 1, whole):
                self._write(np.frombuffer(data, self.dtype, self.length * self.batch, i), self.length * self.batch)
            rest = data[len(data) - len(data) % whole:]
            self.parts, self.size = [rest], len(rest)

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = pa.array((np.arange(len(ids)) < real).view(np.uint8))
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(ids), type=self.schema.field(0).type), pa.FixedSizeListArray.from_arrays(mask, type=self.schema.field(1).type)]
        self.out.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        ids = np.frombuffer(b"".join(self.parts), self.dtype)
        if len(ids):
            full = -(-len(ids) // self.length) * self.length
            self._write(np.concatenate([ids, np.full(full - len(ids), self.fill, self.dtype)]), len(ids))
        self.out.close()


class SequenceReader:
    """Sequences, masks, or any range of the stream of ids in a file."""

    def __init__(self, uri: str):
        fs, path = _filesystem(uri)
        from pyarrow import fs as pafs

        self.source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("ids").type.list_size
        self.n = self.file.num_record_batches
        self.rows = self.file.get_batch(0).num_rows if self.n else 0
        self._last = (None, None)

    def _batch(self, b: int) -> pa.RecordBatch:
        if self._last[0] != b:
            self._last = (b, self.file.get_batch(b))
        return self._last[1]

    def sequence(self, s: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence ``s``, views into the file."""
        batch, r = self._batch(s // self.rows), s % self.rows
        return batch.column("ids")[r].values.to_numpy(), batch.column("mask")[r].values.to_numpy()

    def ids(self, start: int, n: int) -> np.ndarray:
        """``n`` ids of the stream from ``start``."""
        per, out = self.rows * self.length, []
        while n > 0:
            b, i = divmod(start, per)
            flat = self._batch(b).column("ids").flatten().to_numpy()
            take = min(n, len(flat) - i)
            out.append(flat[i: i + take])
            start, n = start + take, n - take
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.uint16)

    def close(self) -> None:
        self._last = (None, None)
        self.source.close()


def _encode_rows(tokenizer: str, end_id: int, plain: bool, bounds: list[int]):
    """Texts become ids before anything is moved: part (the range of the document's id; null ids are in the first), ids with the
    end, compressed."""

    def run(batches):
        enc, small = _encoder(tokenizer, plain), zstandard.ZstdCompressor(level=1).compress
        end, edges = np.array([end_id], enc.type).tobytes(), np.array(bounds, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                some = batch.slice(lo, 2000)
                ids = [small(x + end) for x in enc.encode_all([t or "" for t in some.column("text").to_pylist()])]
                doc = some.column("doc_id")
                part = np.where(np.asarray(doc.is_null()), 0, np.searchsorted(edges, np.asarray(doc.fill_null(0)), "left"))
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), doc, some.column("h"), pa.array(ids, pa.binary())], names=["part", "doc_id", "h", "ids"])

    return run


def _write_files(folder: str, dtype: str, end_id: int, length: int, batch_rows: int, roll: int):
    class File:
        def __init__(self, part: int):
            # each attempt has files of its own; the index names those whose attempt succeeded
            self.part, self.uri = part, f"{folder}/part-{part:015d}-{uuid.uuid4().hex}.arrow"
            fs, path = _filesystem(self.uri)
            fs.create_dir(os.path.dirname(path), recursive=True)
            self.sink = fs.open_output_stream(path)
            self.writer = SequenceWriter(self.sink, np.dtype(dtype), length, batch_rows, end_id)

        def close(self):
            self.writer.close()
            self.sink.close()

    def run(batches):
        size, large = np.dtype(dtype).itemsize, zstandard.ZstdDecompressor().decompress
        part = TaskContext.get().partitionId() * FILES
        file, no = None, 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                some = batch.slice(lo, 2000)
                uri, parts, at, n = [], [], [], []
                for ids in map(large, some.column("ids").to_pylist()):
                    if file is not None and file.writer.total * size >= roll:
                        file.close()
                        part, file = part + 1, None
                    if file is None:
                        file = File(part)
                    at.append(file.writer.total)
                    file.writer.add(ids)
                    n.append(file.writer.total - at[-1])
                    uri.append(file.uri)
                    parts.append(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uri), pa.array(parts, pa.int64()), pa.array(range(no, no + len(n)), pa.int64()), some.column("doc_id"), pa.array(at, pa.int64()), pa.array(n, pa.int64())],
                    names=["file", "part", "no", "doc_id", "at", "n_tokens"])
                no += len(n)
        if file is not None:
            file.close()

    return run


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, length: int = LENGTH, batch_rows: int = BATCH,
                      folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", roll: int = ROLL, plain: bool = False) -> DataFrame:
    """Write the files in ascending id order; return the index: file, part, no, doc_id, at, n_tokens, start.

    ``at`` is the place in the file's stream, ``start`` the place among the ids of all documents. Null text counts
    as empty: its ids are the end id alone. Null ids come first; rows of equal id keep the order of their texts'
    hashes; that settles all ties but those of equal rows. An empty table writes no file and gives no rows. Other
    columns are ignored, whatever their names. ``folder`` defaults to one in the shared folder; any store that pyarrow can
    write to will do. A file ends with the document that takes its ids beyond ``roll`` bytes. A text of any length is
    encoded whole and held once, with its ids, by one task. What spells an added token of the vocabulary becomes that
    token, as the library has it, unless ``plain``.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "tokens")
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n, kind = partitions(spark), _encoder(tokenizer, plain).type
    if end_id >= 1 << (8 * kind.itemsize):
        raise ValueError("the end id does not fit the ids' type")
    # ranges come from the ids alone: a range shuffle would sample its input, and so encode it twice
    at = [k / n for k in range(1, n)]
    bounds = sorted(set(d.agg(F.percentile_approx("doc_id", at, 10_000)).first()[0] or [])) if at else []
    d = d.withColumn("h", F.xxhash64("text")).mapInArrow(_encode_rows(tokenizer, end_id, plain, bounds), "part int, doc_id long, h long, ids binary")
    d = d.repartitionById(n, "part").sortWithinPartitions("doc_id", "h").select("doc_id", "ids")
    index = materialize(d.mapInArrow(_write_files(folder, kind.str, end_id, length, batch_rows, roll), INDEX), "index")
    w = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row for each file; ids grow with the number
    base = index.groupBy("part").agg(F.sum("n_tokens").alias("__n")).select("part", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__base"))
    return index.join(F.broadcast(base), "part").withColumn("start", F.col("__base") + F.col("at")).drop("__base")


def _read_rows(batches):
    """crc32 of each document's ids as 32-bit integers, read from the files; rows come sorted by file and place."""
    uri = reader = None
    for batch in batches:
        crc = []
        for f, at, n in zip(*(batch.column(c).to_pylist() for c in ("file", "at", "n_tokens"))):
            if f != uri:
                if reader:
                    reader.close()
                uri, reader = f, SequenceReader(f)
            crc.append(zlib.crc32(reader.ids(at, n).astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, pa.int64())],
                                         names=["doc_id", "start", "n_tokens", "ids_crc32"])
    if reader:
        reader.close()


def read_checksums(index: DataFrame) -> DataFrame:
    """From the index of ``write_token_files``: doc_id, start, n_tokens, ids_crc32 of the ids that the files hold."""
    n = partitions(index.sparkSession)
    i = index.select("file", "part", "at", "doc_id", "start", "n_tokens").repartition(n, "part").sortWithinPartitions("part", "at")
    return i.mapInArrow(_read_rows, "doc_id long, start long, n_tokens long, ids_crc32 long")
