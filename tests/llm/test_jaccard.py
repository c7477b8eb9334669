"""N-gram Jaccard join against all pairs."""

import random
from collections import Counter

import numpy as np
import pytest

from tessera.llm import jaccard_trie as J

from .cases import SCHEMA, none, odd, odd_rows, small, small_rows


COUNTS = np.random.default_rng(9).integers(0, 50, J.BUCKETS)


def shingles(t, n=3):
    w = (t or "").encode().lower().split()
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, percent=90, n=3):
    s = [shingles(r["text"], n) for r in rows]
    ids = [r["doc_id"] for r in rows]
    comp = {i: i for i in ids if i is not None}
    links = {i: set() for i in comp}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if ids[i] is None or ids[j] is None or not s[i] or not s[j]:
                continue
            k = len(s[i] & s[j])
            if 100 * k >= percent * (len(s[i]) + len(s[j]) - k):
                links[ids[i]] |= {ids[j]} - {ids[i]}
                links[ids[j]] |= {ids[i]} - {ids[j]}
                a, b = root(ids[i]), root(ids[j])
                comp[max(a, b)] = min(a, b)
    return Counter((i, len(x), None if i is None else root(i), len(links.get(i, ()))) for i, x in zip(ids, s))


def near_rows():
    """Near copies around the threshold, short and long, with shared passages."""
    r, rows = random.Random(4), []
    for base in range(25):
        w = [f"v{r.randrange(400)}" for _ in range(r.choice([2, 3, 5, 11, 12, 13, 25, 60, 150, 300]))]
        for _ in range(12):
            c = list(w)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
                c[r.randrange(len(c))] = f"v{r.randrange(400)}"
            if r.random() < 0.3:
                c.insert(r.randrange(len(c)), "new")
            rows.append({"doc_id": r.randrange(10**6) * 100 + base, "text": " ".join(c)})
    return rows


@pytest.mark.parametrize("which,chunk", [("odd", 10**6), ("small", 10**6), ("near", 10**6), ("near", 150)])
def test_join(spark, which, chunk):
    if which == "odd":
        df, rows = odd(spark), [dict(zip(SCHEMA.names, r)) for r in odd_rows()]
    elif which == "small":
        df, rows = small(spark), small_rows()
    else:
        rows = near_rows()
        df = spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string").repartition(5)
    want = brute(rows)
    for batch in (20_000, 300):
        got = Counter(tuple(r) for r in J.ngram_jaccard(df, 3, 90, chunk=chunk, batch=batch).collect())
        if which == "odd":  # ids that several rows share have links of each of these
            got, want = (Counter({k[:3]: n for k, n in x.items()}) for x in (got, want))
        assert got == want
    if which != "odd":
        kept = {r.doc_id for r in J.keep_one(df.withColumnRenamed("text", "text").selectExpr("*", "1 as __id", "2 as __r", "3 as component_id"), n=3, percent=90).collect()}
        assert kept == {k[2] for k in want}


def test_keys_lose_no_pair():
    """Every pair at the threshold shares a key, for sets of all small sizes and some larger ones."""
    r = np.random.default_rng(2)
    for n in [*range(1, 60), 100, 333, 1000]:
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        for gone in range(0, n // 9 + 1):
            b = np.sort(np.concatenate([a[gone:], r.integers(0, 2**63, max(0, int(n * 0.1) - gone)).astype(np.uint64)]))
            i = len(np.intersect1d(a, b))
            if not len(b) or i == len(a) == len(b) or 100 * i < 90 * (len(a) + len(b) - i):
                continue
            key, which = J.candidate_keys(np.concatenate([a, b]), np.array([len(a), len(b)]), 90, COUNTS)
            assert set(key[which == 0]) & set(key[which == 1]), (n, gone)


def test_empty(spark):
    assert J.ngram_jaccard(none(spark)).count() == 0
    assert J.keep_one(none(spark)).count() == 0


def test_join_at_five_words_and_80_percent(spark):
    df, rows = small(spark), small_rows() + [dict(r, doc_id=-1 - r["doc_id"]) for r in near_rows()]
    df = df.select("doc_id", "text").unionByName(spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows if r["doc_id"] < 0], "doc_id long, text string"))
    want = brute(rows, 80, 5)
    assert Counter(tuple(r) for r in J.ngram_jaccard(df, n=5, percent=80, chunk=5000).collect()) == want


def test_keys_lose_no_pair_at_80_percent_and_large_sets_give_few():
    r = np.random.default_rng(3)
    for n in [*range(1, 60), 100, 333, 1000, 5000]:
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64) << np.uint64(1))
        for gone in sorted({*range(0, n // 5 + 1, max(1, n // 60)), n // 5}):
            b = np.sort(np.concatenate([a[r.permutation(len(a))[gone:]], r.integers(0, 2**63, max(0, int(n * 0.2) - gone)).astype(np.uint64)]))
            i = len(np.intersect1d(a, b))
            if not len(b) or i == len(a) == len(b) or 100 * i < 80 * (len(a) + len(b) - i):
                continue
            key, which = J.candidate_keys(np.concatenate([a, b]), np.array([len(a), len(b)]), 80, COUNTS)
            assert set(key[which == 0]) & set(key[which == 1]), (n, gone)
    # fewer than two numbers of parts and the prefix together
    assert len(J.candidate_keys(a, np.array([len(a)]), 80, COUNTS)[0]) < 0.6 * len(a)


def test_common_phrases_make_no_large_groups(spark):
    """4,000 short texts of common words and phrases: candidate groups are about as large as the true ones."""
    r = random.Random(8)
    phrases = [" ".join(f"p{r.randrange(50)}" for _ in range(6)) for _ in range(8)]
    texts = [" ".join([r.choice(phrases), *(f"q{r.randrange(3000)}" for _ in range(r.randrange(1, 14))), r.choice(phrases)]) for _ in range(4000)]
    g, n = J.shingle_sets([t.encode() for t in texts], 3)
    counts = np.bincount(J.bucket_of(g), minlength=J.BUCKETS)
    key, which = J.candidate_keys(g, n, 90, counts)
    boss = list(range(len(texts)))

    def root(x):
        while boss[x] != x:
            boss[x] = boss[boss[x]]
            x = boss[x]
        return x

    lead = {}
    for k, w in zip(key.tolist(), which.tolist()):
        boss[root(w)] = root(lead.setdefault(k, w))
    assert max(Counter(map(root, range(len(texts)))).values()) <= 40


def test_op3_query(spark):
    from tessera.llm.queries import op3_jaccard_trie

    got = Counter(tuple(r) for r in op3_jaccard_trie(spark, "/root/testdata/sf0.001").collect())
    assert got == brute(small_rows())


@pytest.mark.parametrize("percent", [80, 90, 30])
@pytest.mark.parametrize("within", [True, False])
def test_bitmaps_lose_no_link(percent, within):
    r = np.random.default_rng(7)
    sets = []
    for size in r.integers(1, 700, 25):
        base = r.integers(0, 2**63, int(size)).astype(np.uint64)
        for _ in range(8):
            kept = base[r.random(len(base)) > r.choice([0, 0.05, 0.1, 0.2])]
            sets.append(np.unique(np.concatenate([kept, r.integers(0, 2**63, int(size * r.choice([0, 0.05, 0.1]))).astype(np.uint64)])))
    side, label = r.integers(0, 2, len(sets)), np.arange(len(sets))
    for i, j in J.bitmap_links(np.array([len(s) for s in sets]), [J.bitmap(s) for s in sets], side, within, percent):
        assert within or side[i] != side[j]
        label[label == label[j]] = label[i]
    for i in range(len(sets)):
        for j in range(i):
            k = len(np.intersect1d(sets[i], sets[j]))
            if (within or side[i] != side[j]) and k and 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                assert label[i] == label[j]
    if percent == 90:  # unrelated sets of some size stay apart
        assert len(np.unique(label)) > 25
