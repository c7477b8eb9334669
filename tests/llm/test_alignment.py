"""Alignment of two tokenizers against the libraries themselves and overlaps found pair by pair."""

import hashlib
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tessera.llm.token_alignment import Pair, Shards, align_tokenizers, portions, segments

from .cases import none, odd, odd_rows, small, small_rows

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def spans(sizes):
    at, out = 0, []
    for n in sizes:
        out.append((at, at + n))
        at += n
    return out


def brute(rows):
    """Bytes of A by the library's own decoder, token by token; overlaps by comparing ranges."""
    pair = Pair(A, B)
    a_enc, b_enc = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_enc.encode_special_tokens = True
    docs, counts = [], Counter()
    for i, t in rows:
        t = t or ""
        a, b = a_enc.encode(" " + t, add_special_tokens=False).ids, b_enc.encode(t)
        raw = (" " + t).encode()
        ta, tb = [pair.a_bytes[x] for x in a], [pair.b_bytes[x] for x in b]
        if not t or b"".join(ta) != raw or b"".join(tb) != raw:
            docs.append((i, [], [], [], ""))
            continue
        sa, sb = spans(map(len, ta)), spans(map(len, tb))
        links, j0 = [], 0
        for x, (lo, hi) in zip(a, sa):
            while sb[j0][1] <= lo:
                j0 += 1
            j = j0
            while j < len(sb) and sb[j][0] < hi:
                links.append((x, b[j]))
                j += 1
        ends = sorted({hi for _, hi in sa} & {hi for _, hi in sb})
        groups, pa_, pb_ = [], 0, 0
        for e in ends:
            na, nb = pa_, pb_
            while na < len(sa) and sa[na][1] <= e:
                na += 1
            while nb < len(sb) and sb[nb][1] <= e:
                nb += 1
            groups.append(",".join(map(str, a[pa_:na])) + "|" + ",".join(map(str, b[pb_:nb])))
            pa_, pb_ = na, nb
        docs.append((i, a, b, links, ";".join(groups)))
        counts.update(links)
    best = {}
    for (_, b), c in counts.items():
        best[b] = max(best.get(b, 0), c)
    return [(i, len(a), len(b), len(g.split(";")) if g else 0, len(k), sum(counts[x] == best[x[1]] for x in k), sum(counts[x] for x in k),
             hashlib.sha256(g.encode()).hexdigest() if g else "") for i, a, b, k, g in docs], counts


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


@pytest.mark.parametrize("shard", [1 << 20, 500])
def test_small(spark, shard):
    """Also with small blocks and shards, so that an id of B lies in several."""
    got, index = align_tokenizers(small(spark), A, B, block=20_000, shard=shard)
    want, counts = brute([(r["doc_id"], r["text"]) for r in small_rows()])
    assert ordered(got.collect()) == ordered(want)
    rows = [tuple(r) for r in index.collect()]
    keys = sorted(b << 32 | a for a, b in counts)
    import numpy as np

    assert Shards(rows).counts(np.array(keys)).tolist() == [counts[k & 0xFFFFFFFF, k >> 32] for k in keys]
    assert sum(r[3] for r in rows) == len(keys) and (shard > 1000 or len(rows) > 4)


def test_odd(spark):
    more = ["<|endoftext|> <s> </s>", "<0x41> a", "▁x y", "é ü  x", "  lead", "trail  ", "a  b", "a \n b", " x y", "x　y z", "\x00 a", "日本語 テキスト", "😀 a"]
    rows = [(r[0], r[1]) for r in odd_rows()] + [(100 + k, t) for k, t in enumerate(more)]
    got, _ = align_tokenizers(spark.createDataFrame(rows, "doc_id long, text string"), A, B)
    assert ordered(got.collect()) == ordered(brute(rows)[0])
    got, _ = align_tokenizers(odd(spark), A, B)
    assert got.count() == len(odd_rows())
    got, index = align_tokenizers(none(spark), A, B)
    assert got.collect() == [] and index.collect() == []


def test_cuts():
    for t in ("a b", "a  b", " a b ", "a\nb c", "a \nb", "a b\n c d", " ", "a"):
        assert " ".join(segments(t)) == t and all(segments(t))
    long = " ".join(f"w{i}" for i in range(1000)) + "  x \n y z"
    assert " ".join(portions(long, 50)) == long and max(map(len, portions(long, 50))) < 70
