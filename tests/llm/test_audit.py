"""The audit of sources against plain Python with exact integers."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm.source_audit import pieces, share, source_divergence

from .cases import none, odd, odd_rows, small, small_rows

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=30, top=50):
    count, df = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        w = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
        count[lang or "", source or ""].update(w)
        df[lang or ""].update(set(w))
    out = []
    for lang in df:
        kept = sorted(t for t, n in df[lang].items() if n >= least)
        v = len(kept)
        sources = sorted(s for la, s in count if la == lang)
        n = {s: sum(count[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: 1 + 10**9 * (count[lang, s][t] + 5) // (n[s] + 5 * v) for t in kept} for s in sources}
        q = {t: 1 + 10**9 * (sum(count[lang, s][t] for s in sources) + 5) // (sum(n.values()) + 5 * v) for t in kept}
        for s in sources:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s), key=lambda x: (x[0], x[1].encode()))
            terms = sorted(((q[t] - p[s][t], t) for t in kept if count[lang, s][t] and p[s][t] > q[t]), key=lambda x: (x[0], x[1].encode()))[:top]
            out += [(lang, s, part, item, -f, k + 1) for part, found in (("pair", pairs), ("term", terms)) for k, (f, item) in enumerate(found)]
    return sorted(out)


def got(d, **kw):
    return sorted(map(tuple, source_divergence(d, **kw).collect()))


@pytest.mark.parametrize("sizes", [{}, {"tile": 3, "per_cell": 20, "words": 3000, "piece": 200, "dense": 40}])
def test_small(spark, sizes):
    """Also with small tiles, cells, blocks, pieces and matrices."""
    rows = [(r["lang"], r["source"], r["text"]) for r in small_rows()]
    assert got(small(spark), least=5, **sizes) == brute(rows, 5)


def test_many_sources_without_common_terms(spark):
    """Terms that neither of two sources has count towards their distance, in whatever tiles they are."""
    rows = [("en", f"s{k:02d}", " ".join(f"w{(k * 7 + i) % 23}a" for i in range(k % 5)) if k % 4 else None) for k in range(40)]
    d = spark.createDataFrame(rows, "lang string, source string, text string")
    assert got(d, least=1, tile=4, per_cell=3) == brute(rows, 1)


def test_odd(spark):
    rows = [(r[2], r[3], r[1]) for r in odd_rows()]
    assert got(odd(spark), least=1) == brute(rows, 1)
    assert got(odd(spark)) == brute(rows)  # no term is in 30 documents: all distances are 0
    assert got(none(spark)) == []


def test_share_is_exact():
    c = [0, 1, 7, 10**12, 9 * 10**15 - 5]
    assert share(np.array(c), 9 * 10**15 - 35, 7).tolist() == [1 + 10**9 * (x + 5) // (9 * 10**15) for x in c]


def test_pieces():
    t = b"aa bb " * 100 + b"c" * 500 + b" d"
    assert b"".join(pieces(t, 7)) == t and all(p[:1] == b" " or t.startswith(p) for p in pieces(t, 7))
