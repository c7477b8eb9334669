"""Mixing, sharding, quality rules and exact dedup against plain Python."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, mixing, quality, sharding

from .cases import SCHEMA, none, odd, odd_rows, small, small_rows, words


def rows_of(spark, which):
    if which == "odd":
        return odd(spark), [dict(zip(SCHEMA.names, r)) for r in odd_rows()]
    return small(spark), small_rows()


@pytest.mark.parametrize("which", ["odd", "small"])
def test_quality(spark, which):
    df, rows = rows_of(spark, which)
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.quality(df).collect())
    want = Counter()
    for r in rows:
        t, w = r["text"] or "", words(r["text"])
        grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
        cover = {j for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in t.split("\n") if words(x)]
        n = len(w)
        want[(r["doc_id"], n, sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover), n < 50 or 100 * len(cover) > 50 * n)] += 1
    assert got == want
    if which == "odd":
        assert all(r["__t"] == "__t" and r["__chars"] == "__chars" for r in quality.quality(df).collect())
        kept = quality.keep_quality(df.withColumn("text", F.lit("A sentence of its own ends here. " * 20)), min_words=1, max_lost=100)
        assert kept.columns == [c for c in df.columns if c not in quality.ADDED]


def test_quality_verdict(spark):
    good = "\n".join(f"Sentence {i} has words{i} of{i} its own{i}, all{i} unlike{i} others{i} here{i}, ending{i} in {i * i}." for i in range(10))
    nav = "\n".join("Home | About | News | Shop | Contact | More" for _ in range(1)) + "\n" + "\n".join(f"a{i} | b{i} | c{i} | d{i}" for i in range(30))
    mixed = good + "\nAll rights reserved."
    df = spark.createDataFrame([(1, good), (2, nav), (3, mixed)], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.quality(df).collect()}
    assert got[1].kept and got[1].clean_text == good
    assert not got[2].kept and not got[2].base_failed
    assert got[3].kept and got[3].clean_text == good
    assert quality.quality(none(spark)).count() == 0


@pytest.mark.parametrize("which", ["odd", "small"])
def test_exact(spark, which):
    df, rows = rows_of(spark, which)
    up = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = defaultdict(list)
    for r in rows:
        groups[(r["text"] or "").translate(up)].append(r["doc_id"])
    want = Counter()
    for t, ids in groups.items():
        keep = max(ids, key=lambda x: -1 if x is None else x)
        for k, i in enumerate(sorted(ids, key=lambda x: -1 if x is None else x)):
            want[(i, keep, len(ids), k == len(ids) - 1, hashlib.sha256(t.encode()).hexdigest())] += 1
    got = Counter(tuple(r) for r in exact_dedup.exact_dedup(df).collect())
    assert got == want
    kept = exact_dedup.keep_exact(df)
    assert kept.columns == df.columns and kept.count() == len(groups)
    if which == "odd":
        assert all(r["__id"] == "__id" and r["__sha"] == "__sha" for r in kept.collect())
    assert exact_dedup.exact_dedup(none(spark)).count() == 0


def test_fingerprint_composes_and_collisions_are_found_out(spark, monkeypatch):
    data = bytes(range(256)) * 300
    whole = exact_dedup.chunk_hash(data, 0)
    assert whole == sum(exact_dedup.chunk_hash(data[i:i + 1000], 0, len(data) - min(len(data), i + 1000)) for i in range(0, len(data), 1000)) % exact_dedup.PRIMES[0]
    real = exact_dedup.fingerprints
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup, "fingerprints", lambda d: real(d).withColumns({"f1": F.lit(1).cast("long"), "f2": F.lit(1).cast("long"), "bytes": F.lit(9).cast("long")}))
    df = spark.createDataFrame([(1, "aaa"), (2, "bbb"), (3, "aaa"), (4, "ccc"), (5, "bbb")], "doc_id long, text string")
    assert {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(df).collect()} == {(1, 3, 2), (3, 3, 2), (2, 5, 2), (5, 5, 2), (4, 4, 1)}


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_feistel_is_a_permutation(n):
    got = [sharding.feistel_py(x, n, 42) for x in range(n)]
    assert sorted(got) == list(range(n))
    assert all(sharding.feistel_inverse_py(p, n, 42) == x for x, p in enumerate(got))


@pytest.mark.parametrize("which", ["odd", "small"])
def test_sharding(spark, which):
    df, rows = rows_of(spark, which)
    got = sharding.shard_documents(df, 16).collect()
    again = sharding.shard_documents(df.repartition(3), 16).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in rows)
    assert sorted(r.position for r in got) == list(range(len(rows)))
    per = defaultdict(list)
    for r in got:
        assert (r.shard, r.slot) == (r.position % 16, r.position // 16)
        per[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in per.values())
    assert sharding.shard_documents(none(spark)).count() == 0
    # the row numbers, by one sort of all rows
    from pyspark.sql import Window as W

    h = F.xxhash64("doc_id", "size", "text_crc32", F.lit(42))
    d = sharding.shard_documents(df, 16).withColumn("row", F.row_number().over(W.orderBy(F.pmod(h, F.lit(sharding.BUCKETS)), h, "doc_id", "size", "text_crc32")) - 1)
    d = d.collect()  # equal rows may change places
    assert Counter((r.doc_id, r.size, r.text_crc32, r.position) for r in d) == Counter((r.doc_id, r.size, r.text_crc32, sharding.feistel_py(r.row, len(rows), 42)) for r in d)
    order = spark.range(200).select(sharding.feistel(__import__("pyspark").sql.functions.col("id"), 200, 42).alias("p")).collect()
    assert [r.p for r in order] == [sharding.feistel_py(x, 200, 42) for x in range(200)]


@pytest.mark.parametrize("which", ["odd", "small"])
def test_mixing(spark, which):
    df, rows = rows_of(spark, which)
    got = mixing.mix_sources(df).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((r["doc_id"], r["source"], len(words(r["text"]))) for r in rows)
    size = Counter()
    for r in rows:
        size[r["source"]] += len(words(r["text"]))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: [1, 2, 3][i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(size.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 3 * size[s]}
        if not over:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
        open_ -= over
    taken, largest = Counter(), Counter()
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6 * max(1, r.target)
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in order:
        assert abs(taken[s] - target[s]) <= largest[s]
    assert sum(taken.values()) <= sum(target.values()) + 1e-3
    assert sorted(map(str, mixing.mix_sources(df.repartition(3)).collect())) == sorted(map(str, got))
    assert mixing.mix_sources(none(spark)).count() == 0


def test_queries_give_what_the_operators_tell(spark):
    from tessera.llm import queries as Q

    sf, rows = "/root/testdata/sf0.001", small_rows()
    up = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = defaultdict(list)
    for r in rows:
        groups[(r["text"] or "").translate(up)].append(r["doc_id"])
    want = {(i, max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids}
    assert {tuple(r) for r in Q.op5_exact_dedup(spark, sf).collect()} == want
    got = Q.op6_feistel_sharding(spark, sf).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in got) == Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode()), "rows", None) for r in rows)
    assert sorted((r.slot * 16 + r.shard) for r in got) == list(range(len(rows)))
    mix = Q.op4_source_mixing(spark, sf)
    assert mix.columns == ["doc_id", "size", "source_size", "target", "taken"] and mix.count() == len(rows)
    q = {r.doc_id: r for r in Q.op10_quality_rules(spark, sf).collect()}
    assert all(not r.kept for r in q.values() if r.base_failed) and any(r.kept for r in q.values())
    assert all(q[r["doc_id"]].n_words == len(words(r["text"])) for r in rows)
