"""Token files and byte-level BPE against the libraries, text by text."""

import hashlib
import random
import weakref
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from tessera.llm import bpe, segments, token_files

from .cases import SCHEMA, none, odd, odd_rows, small, small_rows

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
ALPHABET = ["a", "b", "'s", "'ll", " ", "  ", "\n", "\t", "é", "1", "22", "!?", "\x1c", "\x85", "　", "ß", "中", "\r\n", " x", "﻿", "​", "<|endoftext|>"]


def mixed(n):
    r = random.Random(5)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randrange(25))) for _ in range(n)]


def rows_of(spark, which):
    if which == "odd":
        return odd(spark), [dict(zip(SCHEMA.names, r)) for r in odd_rows()]
    if which == "mixed":
        t = mixed(1500)
        return spark.createDataFrame(list(enumerate(t)), "doc_id long, text string"), [{"doc_id": i, "text": x} for i, x in enumerate(t)]
    return small(spark), small_rows()


def test_other_tokenizers_encode_whole_texts():
    e = token_files._Encoder(P.path("word_bpe_49k.json"))
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = ["Hello  World, twice. ", "", "a\nb"]
    assert [np.frombuffer(x, e.type).tolist() for x in e.encode_all(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert not e.cuts and token_files._Encoder(JSON).cuts


def test_segments_join():
    for t in mixed(500):
        assert "".join(segments.careful(t)) == t


@pytest.mark.parametrize("which", ["odd", "mixed", "small"])
def test_bpe(spark, which):
    df, rows = rows_of(spark, which)
    got = Counter((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in bpe.encode_decode(df, RANKS, P.PATTERN, block=5000, flush=700, salted=3).collect())
    assert got == encoded(rows)
    assert bpe.encode_decode(none(spark), RANKS, P.PATTERN).count() == 0


def encoded(rows):
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks_of(RANKS), special_tokens={})
    return Counter((r["doc_id"], np.array(e.encode_ordinary(r["text"] or ""), "<u4").tobytes(), (r["text"] or "").encode()) for r in rows)


def test_bpe_of_equal_blocks(spark, tmp_path):
    """Equal texts in separate tasks and files, and equal texts above the size of a block."""
    long = " ".join(f"w{i % 91}" for i in range(4000))
    rows = [{"doc_id": i % 2, "text": t} for i, t in enumerate(["a b", "a b", "a b", "a b", long, long, long, long, None, None])]
    for k in range(2):
        spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    d = spark.read.parquet(str(tmp_path / "t"))
    for df in (d, d.repartition(7)):
        got = bpe.encode_decode(df, RANKS, P.PATTERN, block=1000, flush=50, salted=2).collect()
        assert Counter((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in got) == encoded(rows + rows)


def test_op9_query(spark):
    from tessera.llm.queries import op9_bpe_words

    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op9_bpe_words(spark, "/root/testdata/sf0.001").collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == Counter((i, len(ids) // 4, sha(ids), sha(text)) for (i, ids, text), n in encoded(small_rows()).items() for _ in range(n))


@pytest.mark.parametrize("which", ["odd", "mixed", "small"])
def test_token_files(spark, which):
    df, rows = rows_of(spark, which)
    t = Tokenizer.from_file(JSON)
    index = token_files.write_token_files(df, JSON, end_id=2, length=64, batch_rows=4, roll=3000)
    got = sorted(token_files.read_checksums(index).collect(), key=lambda r: r.start)
    want = Counter()
    for r in rows:
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        want[(r["doc_id"], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    order = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert order == sorted(order)
    one = index.orderBy("part", "at").first()
    reader = token_files.SequenceReader(one.file)
    ids, mask = reader.sequence(0)
    assert len(ids) == len(mask) == 64 and not ids.flags.owndata and not mask.flags.owndata
    assert index.select("part").distinct().count() > df.rdd.getNumPartitions()  # files rolled over
    total = index.filter(index.part == one.part).agg({"n_tokens": "sum"}).first()[0]
    seqs = [reader.sequence(s) for s in range(-(-total // 64))]
    assert sum(int(m.sum()) for _, m in seqs) == total
    assert np.array_equal(np.concatenate([s for s, _ in seqs])[:total], reader.ids(0, total))
    assert token_files.read_checksums(token_files.write_token_files(none(spark), JSON)).count() == 0


def test_added_tokens():
    t = "x <|endoftext|> y"
    ids = lambda e: np.frombuffer(next(e.encode_all([t])), e.type).tolist()
    own, plain = Tokenizer.from_file(JSON), Tokenizer.from_file(JSON)
    plain.encode_special_tokens = True
    assert ids(token_files._Encoder(JSON)) == own.encode(t, add_special_tokens=False).ids
    assert ids(token_files._Encoder(JSON, plain=True)) == plain.encode(t, add_special_tokens=False).ids != own.encode(t, add_special_tokens=False).ids


def test_op1_query(spark):
    from tessera.llm.queries import op1_token_files

    t, at, want = Tokenizer.from_file(JSON), 0, []
    for r in sorted(small_rows(), key=lambda r: r["doc_id"]):
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        want.append((r["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, op1_token_files(spark, "/root/testdata/sf0.001").select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == want


def test_bpe_holds_one_block_at_a_time(monkeypatch):
    live = weakref.WeakSet()

    class Counted(bpe.Block):
        def __init__(self, pattern):
            assert not live, "a block is made while another is held"
            super().__init__(pattern)
            live.add(self)

    monkeypatch.setattr(bpe, "Block", Counted)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(6)), "text": ["some words here", None, "  odd  ", "", "more", "some more"]})
    assert len(list(bpe._block_rows(P.PATTERN, 10)([batch, batch]))) > 4
