"""Substring dedup against a table of all windows."""

import random
from collections import Counter

import pytest

from tessera.llm import substring_dedup as S

from .cases import SCHEMA, none, odd, odd_rows, small, small_rows


def brute(rows, width):
    first = {}
    split = [(r["doc_id"], (r["text"] or "").encode().split()) for r in rows]
    for i, w in split:
        if i is not None:
            for p in range(len(w) - width + 1):
                k = tuple(w[p: p + width])
                first[k] = min(first.get(k, i), i)
    out = Counter()
    for i, w in split:
        stay = [True] * len(w)
        if i is not None:
            for p in range(len(w) - width + 1):
                if first[tuple(w[p: p + width])] < i:
                    stay[p: p + width] = [False] * width
        out[(i, len(w), stay.count(False), b" ".join(x for x, k in zip(w, stay) if k).decode())] += 1
    return out


def passage_rows():
    """Documents of shared passages in changing company, with overlaps, repeats in one text and near copies."""
    r = random.Random(8)
    pool = [[f"p{i}w{r.randrange(30)}" for _ in range(r.choice([8, 12, 20, 40, 70]))] for i in range(12)]
    rows = []
    for i in range(120):
        w = []
        for _ in range(r.randrange(1, 6)):
            p = r.choice(pool)
            a = r.randrange(len(p))
            w += p[a // 2: len(p) - a // 3] + [f"own{r.randrange(10**6)}" for _ in range(r.randrange(4))]
        rows.append({"doc_id": r.randrange(1000), "text": " ".join(w)})
    rows += [{"doc_id": 2000 + i, "text": "la " * (20 + i)} for i in range(8)]
    seen = set()
    return [x for x in rows if x["doc_id"] not in seen and not seen.add(x["doc_id"])]


@pytest.mark.parametrize("which,width,seed", [("odd", 50, 10), ("small", 50, 10), ("passages", 12, 4), ("passages", 9, 9)])
@pytest.mark.parametrize("size", [300, 20_000])
def test_removal(spark, which, width, seed, size):
    if which == "odd":
        df, rows = odd(spark), [dict(zip(SCHEMA.names, r)) for r in odd_rows()]
    elif which == "small":
        df, rows = small(spark), small_rows()
    else:
        rows = passage_rows()
        df = spark.createDataFrame([(x["doc_id"], x["text"]) for x in rows], "doc_id long, text string").repartition(5)
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in S.substring_dedup(df, width, seed, size=size).collect())
    assert got == brute(rows, width)


def test_spans_point_at_their_source(spark):
    rows = passage_rows()
    df = spark.createDataFrame([(x["doc_id"], x["text"]) for x in rows], "doc_id long, text string")
    text = {x["doc_id"]: x["text"].split() for x in rows}
    n = 0
    for r in S.substring_dedup(df, 12, 4).collect():
        for s in r.spans:
            n += 1
            assert s.n >= 12 and s.src < r.doc_id
            assert text[r.doc_id][s.at: s.at + s.n] == text[s.src][s.src_at: s.src_at + s.n]
    assert n


def test_one_passage_in_most_documents(spark, monkeypatch):
    """A hot passage in changing company, and a source quoted in more ways than are looked up in a row."""
    monkeypatch.setattr(S, "RANGES", 5)  # read on the driver
    r = random.Random(3)
    hot = [f"h{i}" for i in range(60)]
    rows = [{"doc_id": i, "text": " ".join([f"a{r.randrange(10**6)}"] * (i % 3) + hot[r.randrange(20):40 + r.randrange(20)] + [f"b{r.randrange(10**6)}"])} for i in range(1, 300)]
    rows.append({"doc_id": 0, "text": " ".join(hot)})
    df = spark.createDataFrame([(x["doc_id"], x["text"]) for x in rows], "doc_id long, text string").repartition(7)
    got = Counter((x.doc_id, x.n_words, x.n_removed, x.kept_text) for x in S.substring_dedup(df, 12, 4, size=2000).collect())
    assert got == brute(rows, 12)


def test_empty(spark):
    assert S.substring_dedup(none(spark)).count() == 0
