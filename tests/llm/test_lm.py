"""Deleted interpolation against a plain version: dictionaries, loops, and the same rounds of expectation maximisation."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm.deleted_interpolation import LEVELS, score_documents, start_weights

from .cases import none, odd, odd_rows, small, small_rows


def tokens(t):
    return [*(t or "").encode().lower().split(), "END"]


def fold(i):
    return (zlib.crc32(str(i).encode()) if i is not None else 0) % 7


def counts(texts, order):
    c = [Counter() for _ in range(order)]
    for t in texts:
        w = ["BEGIN"] * (order - 1) + t
        for i in range(len(t)):
            for k in range(order):
                c[k][tuple(w[i + order - 1 - k: i + order])] += 1
    return c, sum(map(len, texts)), len(texts)


def estimates(t, model, order):
    """Of each token its bucket and its estimates."""
    c, n, docs = model
    v = len(c[0])
    w = ["BEGIN"] * (order - 1) + t
    for i in range(len(t)):
        p, bucket = [1 / (v + 1)], 0
        for k in range(order):
            g = tuple(w[i + order - 1 - k: i + order])
            context = n if k == 0 else docs if g[-2] == "BEGIN" else c[k - 1][g[:-1]]
            p.append(c[k][g] / context if context else 0.0)
            if context:
                bucket = k * LEVELS + int(math.log2(context)) + 1
        yield bucket, p


def brute(rows, order, rounds=30):
    texts = [(i, fold(i), tokens(t)) for i, t in rows]
    kept = counts([t for _, f, t in texts if f not in (2, 5)], order)
    held = Counter((b, tuple(p)) for _, f, t in texts if f == 5 for b, p in estimates(t, kept, order))
    w, before = start_weights(order), None
    can = w > 0
    for _ in range(rounds if held else 0):
        sums, ll = np.zeros(w.shape), 0.0
        for (b, p), h in held.items():
            m = w[b] * np.array(p)
            sums[b] += h * m / m.sum()
            ll += h * math.log(m.sum())
        w = np.where(can, sums + 1, 0)
        w /= w.sum(1, keepdims=True)
        now = ll / sum(held.values())
        if before is not None and now - before < 1e-5:
            break
        before = now
    model = counts([t for _, f, t in texts if f != 2], order)
    c, n, _ = model
    out = []
    for i, f, t in texts:
        base = sum(math.log10((c[0][(x,)] + 1) / (n + len(c[0]) + 1)) for x in t)
        score = sum(math.log10(float(w[b] @ np.array(p))) for b, p in estimates(t, model, order))
        out.append((i, f == 2, len(t), sum(c[0][(x,)] > 0 for x in t), n, base, score))
    return out


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, *r[2:4], round(r[5], 3))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9)
        assert g[6] == pytest.approx(w[6], rel=1e-6, abs=1e-9)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_small(spark, order):
    """Small blocks and ranges, so that documents run over several blocks and n-grams over many ranges."""
    same(score_documents(small(spark), order=order, tokens=700, per_range=5000).collect(), brute([(r["doc_id"], r["text"]) for r in small_rows()], order))


def test_odd(spark):
    rows = [(r[0], r[1]) for r in odd_rows()]
    same(score_documents(odd(spark), tokens=5000).collect(), brute(rows, 3))
    assert score_documents(none(spark)).collect() == []


def test_nothing_learned(spark):
    """All documents are held out: every token has probability 1."""
    out = [i for i in range(200) if fold(i) == 2][:3]
    got = score_documents(spark.createDataFrame([(i, "a b") for i in out], "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == [(i, True, 3, 0, 0, 0.0, 0.0) for i in out]


def test_probabilities_add_up(spark):
    """After a context the known words and one unknown share all of the probability."""
    text = "a b c a b a c c b a"
    docs = [(i, text) for i in range(40) if fold(i) != 2]
    one = next(i for i in range(1000, 2000) if fold(i) == 2)
    words = ["a", "b", "c", "unknown"]
    asked = [(one + 7 * k, f"a {w}") for k, w in enumerate(words)] + [(one + 70, "a")]
    asked = [(next(i for i in range(2000 + 100 * k, 2100 + 100 * k) if fold(i) == 2), t) for k, (_, t) in enumerate(asked)]
    got = {r.doc_id: r.score for r in score_documents(spark.createDataFrame(docs + asked, "doc_id long, text string")).collect()}
    want = {r[0]: r[6] for r in brute(docs + asked, 3)}
    assert all(got[i] == pytest.approx(want[i], rel=1e-9) for i, _ in asked)
    assert got[asked[0][0]] > got[asked[3][0]]
