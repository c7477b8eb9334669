"""The pipeline, stage by stage, against plain Python on each stage's own input."""

import hashlib
import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline as C
from tessera.llm import bpe, quality
from tessera.llm.mixing import mix_sources

from .cases import SCHEMA, odd
from .test_jaccard import brute as jaccard
from .test_jaccard import shingles


@pytest.mark.parametrize("which", ["odd", "small"])
def test_stages(spark, which, tmp_path):
    docs = odd(spark) if which == "odd" else spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    up = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = [r.asDict() for r in docs.collect()]
    for k, (name, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, "")
        out.write.parquet(path := str(tmp_path / str(k)))
        docs = spark.read.parquet(path)
        got = [r.asDict() for r in docs.collect()]
        if k < 4:
            assert docs.columns == list(C.COLUMNS)
        as_rows = lambda rs: Counter(tuple(r[c] for c in C.COLUMNS) for r in rs)
        if k == 0:
            kept = {r.doc_id: r.clean_text for r in quality.quality(spark.createDataFrame([(i, r["text"]) for i, r in enumerate(rows)], "doc_id long, text string")).collect() if r.kept}  # the operator's own verdict has its tests elsewhere
            assert as_rows(got) == Counter((rows[i]["doc_id"], t, rows[i]["lang"], rows[i]["source"], len(t)) for i, t in kept.items())
        if k == 1:
            groups = {}
            for r in rows:
                t = (r["text"] or "").translate(up)
                if t not in groups or (groups[t]["doc_id"] is None or (r["doc_id"] or -1) > groups[t]["doc_id"]):
                    groups[t] = r
            assert as_rows(got) == as_rows(groups.values())
        if k == 2:
            keep = {k[2] for k in jaccard(rows, 80, 5)}
            assert as_rows(got) == as_rows([r for r in rows if r["doc_id"] is None or r["doc_id"] in keep])
        if k == 3:
            copies = Counter()
            for r in mix_sources(spark.createDataFrame([tuple(r[c] for c in C.COLUMNS) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")).collect():
                copies[r.doc_id] += r.copies
            assert Counter(r["doc_id"] for r in got) == +copies
            assert set(as_rows(got)) <= set(as_rows(rows))
        if k == 4:
            e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks_of(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
            want = Counter()
            for r in rows:
                ids = np.array(e.encode_ordinary(r["text"]), "<u4").tobytes()
                want[(r["doc_id"], len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest(), ids)] += 1
            assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], bytes(r["ids"])) for r in got) == want
        rows = got


def test_repeated_rows_in_the_mix(spark):
    df = spark.createDataFrame([(1, "a b", None, "s", 3), (1, "a b", None, "s", 3), (1, "b c", None, "s", 3), (2, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    got = C.source_mix(spark, df, "").collect()
    assert len(got) == 3 and {r.text for r in got} == {"a b", "b c"}


def test_run(spark):
    assert C.run(spark, "/root/testdata/sf0.001").count() > 0


def test_near_copies_at_five_words_and_80_percent(spark):
    """Near copies between this threshold and three words at 0.9, a pair below both, and one with its order changed."""
    w = [f"v{i}" for i in range(50)]
    other = lambda words, *at: " ".join("new" + x if i in at else x for i, x in enumerate(words))
    x = [f"x{i}" for i in range(50)]
    texts = [other(w), other(w, 25), other(w, 10, 40), other(x), other(x, 12, 13), " ".join([*x[25:], *x[:25]])]
    rows = [{"doc_id": i, "text": t} for i, t in enumerate(texts)]

    def linked(a, b, n, percent):
        k = len(shingles(a, n) & shingles(b, n))
        return 100 * k >= percent * (len(shingles(a, n)) + len(shingles(b, n)) - k)

    assert linked(texts[0], texts[1], 5, 80) and not linked(texts[0], texts[1], 3, 90)
    want = {r["doc_id"] for r in rows if not any(linked(r["text"], o["text"], 5, 80) for o in rows[:r["doc_id"]])}
    df = spark.createDataFrame([(r["doc_id"], r["text"], None, "s", len(r["text"])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in C.near_duplicates(spark, df, "").collect()} == want


def test_workers_give_memory_back():
    """A generator's rows pass unchanged, and at its end the process is about as small as before: Arrow's buffers and the C library's blocks go."""
    code = """
import re
from pathlib import Path
import pyarrow as pa
from tessera.llm import common

def held():
    return int(re.search(r"Anonymous:\\s+(\\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024

def run(batches):
    for n in batches:
        blocks = [bytes([n]) * 100_000 for _ in range(2_000)]
        last = blocks.pop()
        yield pa.array(blocks)
        del blocks
        yield last  # the block at the top of the heap: the ones below it stay without a trim

run_lean = common.lean(run)
before, most, last = held(), 0, []
for x in run_lean([1, 2]):
    most = max(most, held())
    last.append(len(x))
assert last == [1999, 100_000] * 2, last
del x
common.give_back()
assert most > before + 150, (before, most)
assert held() < before + 40, (before, held())
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(C.__file__).parent)


@pytest.mark.parametrize("module", ["bpe", "exact_dedup", "jaccard_trie"])
def test_stages_of_python_are_lean(module):
    source = (Path(C.__file__).parent / f"tessera/llm/{module}.py").read_text()
    assert source.count(".mapInArrow(") == source.count(".mapInArrow(lean(") > 0
