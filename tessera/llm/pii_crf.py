"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans, which stay. Tokens with a digit or an at sign are the nodes of the field (no kind
of span is without one). Neighbours in the text are linked, and so is each token to the last one in the document that
it repeats or resembles: the same letters, the same digits however they are set apart (of the token, of the run of
number tokens or of the base span that it stands in), or the same last nine digits. Loopy message passing over
a batch of documents gives each token's kinds their marginals. What is marked with confidence, has the form of its
kind and touches no base span is added.

Weights come from pseudo-likelihood on a bounded sample of whole documents with the base spans as labels. Of each
document's spans, and of numbers that are none, a copy in another spelling is put behind the text, with the label of
what it copies; and tokens' own features are left out now and then. So links learn to carry a label where a token's
form alone does not tell.
"""

from __future__ import annotations

import bisect
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample

KINDS = ("email", "ip", "card", "phone")
NONE = len(KINDS)
DIMENSIONS = 4096
SAMPLE = 1500  # the bound on training documents, which are taken whole
ROUNDS = 15
SIMILAR = 9  # last digits that make two numbers similar
LONGEST = 19  # digits of the longest kind of number
SURE = 0.9
KNOWN = -100.0  # potential of the kinds that a base span's token does not have

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MARK = re.compile(r"[0-9@]+")
TRIM = ".,;:!?()[]{}<>\"'|"
WHITE = " \t\n\x0b\f\r"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def is_octet(s: str) -> bool:
    s = s.lstrip("0")
    return len(s) < 3 or len(s) == 3 and int(s) <= 255


def is_card(s: str) -> bool:
    d = digits_of(s)
    return 16 <= len(d) <= 19 and luhn(d)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns' matches, in the order of kinds, then of start; linear in the text."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        lo = at
        while lo > end and text[lo - 1] in LOCAL:
            lo -= 1
        m = DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            end = m.end()
            out.append((0, lo, end))
        at = text.find("@", max(at + 1, end))
    out += [(1, *m.span()) for m in IP.finditer(text) if all(is_octet(p) for p in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(text) if is_card(m[0])]
    out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]
    return out


def tokens(text: str) -> list[tuple[int, int, int]]:
    """(start, end, end with what was trimmed) of the white-space tokens that hold a digit or an at sign."""
    out, done = [], 0
    for m in MARK.finditer(text):
        if m.start() < done:
            continue
        lo, hi = m.start(), m.end()
        while lo > done and text[lo - 1] not in WHITE:
            lo -= 1
        while hi < len(text) and text[hi] not in WHITE:
            hi += 1
        done = hi
        a, b = lo, hi
        while a < b and text[a] in TRIM:
            a += 1
        while b > a and text[b - 1] in TRIM:
            b -= 1
        out.append((a, b, hi))
    return out


def _features(text: str, a: int, b: int) -> list[int]:
    s = text[a:b]
    d = digits_of(s)
    shape = re.sub(r"[A-Za-z]+", "a", re.sub(r"[0-9]+", "0", s))
    parts = s.split(".")
    names = [
        f"shape {shape}", f"digits {min(len(d), 24)}", f"dots {min(s.count('.'), 5)}", f"at {s.count('@') > 0} {'.' in s.rpartition('@')[2]}",
        f"plus {a > 0 and text[a - 1] == '+' or s[:1] == '+'}", f"luhn {len(d) > 12 and luhn(d)} {16 <= len(d) <= 19}",
        f"octets {len(parts) == 4 and all(p.isdigit() and p.isascii() and is_octet(p) for p in parts)}", f"only {len(d) == len(s)}", f"length {min(len(s) // 4, 12)}",
        f"signs {''.join(sorted(set(c for c in s if not c.isalnum())))}",
    ]
    return [zlib.crc32(f"{k} {x}".encode()) % DIMENSIONS for k, x in enumerate(names)]


N_FEATURES = 10
LETTERS = re.compile(r"[^\W\d_]|@")


def _keys(s: str, wholes: list[str]) -> set[str]:
    """What a token is known by: its letters and digits, and the digits of the numbers that it is or stands in."""
    if "@" in s:
        return {"".join(c for c in s.lower() if c.isalnum() or c == "@")}
    numbers = [d for d in (digits_of(s), *wholes) if len(d) > 6]
    parts = re.findall("[0-9]+", s)
    if len(parts) == 4 and not LETTERS.search(s):
        numbers.append(".".join(parts))
    return {*numbers, *(f"~{d[-SIMILAR:]}" for d in numbers if len(d) >= SIMILAR)} or {s.lower()}


class Graph:
    """Nodes and links of a batch of texts."""

    def __init__(self):
        self.span: list[tuple[int, int, int]] = []  # text, start, end
        self.features: list[list[int]] = []
        self.label: list[int] = []
        self.base: list[list[tuple[int, int, int]]] = []
        self.links: tuple[list, list] = ([], [])  # neighbours, repeated or similar

    def add(self, text: str, told: dict[int, int] | None = None) -> None:
        """``told``: labels of tokens by their start, before those of the base spans."""
        base, k = base_spans(text), len(self.base)
        self.base.append(base)
        marks = sorted((a, b, kind) for kind, a, b in base)
        found = [t for t in tokens(text) if t[0] < t[1]]
        # runs of number tokens with nothing but white space and marks between them
        run, runs = [], []
        for i, (a, b, hi) in enumerate(found):
            near = i > 0 and not text[found[i - 1][2]:a].strip(WHITE + TRIM)
            if near:
                self.links[0].append((len(self.span) + i - 1, len(self.span) + i))
            number = not LETTERS.search(text, a, b)
            if not (near and number and run[-1] >= 0):
                runs.append([])
            runs[-1].append(i)
            run.append(len(runs) - 1 if number else -1)
        whole = ["".join(digits_of(text[found[i][0]: found[i][1]]) for i in r) if len(r) > 1 else "" for r in runs]
        seen: dict[str, tuple[int, int]] = {}
        m = 0
        for r, members in enumerate(runs):
            mine: dict[str, int] = {}
            for i in members:
                a, b, _ = found[i]
                node = len(self.span)
                self.span.append((k, a, b))
                self.features.append(_features(text, a, b))
                while m < len(marks) and marks[m][1] <= a:
                    m += 1
                inside = m < len(marks) and marks[m][0] < b
                self.label.append(told[a] if told and a in told else marks[m][2] if inside else NONE)
                spanned = digits_of(text[marks[m][0]: marks[m][1]]) if inside and marks[m][2] else ""
                keys = _keys(text[a:b], [whole[r], spanned])
                self.links[1].extend((x, node) for x in sorted({seen[key] for key in keys if key in seen}))
                for key in keys:
                    mine.setdefault(key, node)
            seen.update(mine)

    def arrays(self):
        f = np.array(self.features, np.int64).reshape(-1, N_FEATURES)
        return f, [np.array(x, np.int64).reshape(-1, 2) for x in self.links]


class SkipChain:
    """Weights of features, and of label pairs over both sorts of links (symmetric)."""

    def __init__(self):
        k = NONE + 1
        self.w = np.zeros((DIMENSIONS, k))
        self.pair = [np.zeros((k, k)), np.zeros((k, k))]

    def train(self, f: np.ndarray, links: list[np.ndarray], label: np.ndarray, steps: int = 250, rate: float = 0.1, drop: float = 0.3, decay: float = 1e-3) -> None:
        y = np.eye(NONE + 1)[label]
        around = []
        for e in links:
            c = np.zeros_like(y)
            np.add.at(c, e[:, 0], y[e[:, 1]])
            np.add.at(c, e[:, 1], y[e[:, 0]])
            around.append(c)
        rng = np.random.default_rng(3)
        weights = [self.w, *self.pair]
        m, v = [np.zeros_like(x) for x in weights], [np.zeros_like(x) for x in weights]
        for t in range(1, steps + 1):
            on = (rng.random(len(f)) >= drop)[:, None]
            u = self.w[f].sum(1) * on + around[0] @ self.pair[0] + around[1] @ self.pair[1]
            p = np.exp(u - u.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            d = (p - y) / len(y)
            gw = np.zeros_like(self.w)
            np.add.at(gw, f.reshape(-1), np.repeat(d * on, N_FEATURES, axis=0))
            grads = [gw, *(c.T @ d for c in around)]
            grads[1:] = [(a + a.T) / 2 for a in grads[1:]]
            for x, a, m1, v1 in zip(weights, grads, m, v):
                a = a + decay * x / len(y)
                m1 += 0.1 * (a - m1)
                v1 += 0.01 * (a * a - v1)
                x -= rate * (m1 / (1 - 0.9**t)) / (np.sqrt(v1 / (1 - 0.99**t)) + 1e-8)

    def marginals(self, g: Graph) -> np.ndarray:
        """By loopy message passing; chains without loops come out exact. Tokens of base spans are sure of their kind,
        so that it is carried from them."""
        f, links = g.arrays()
        u = self.w[f].sum(1)
        sure = np.flatnonzero(np.array(g.label) != NONE)
        u[sure] = KNOWN
        u[sure, np.array(g.label)[sure]] = 0
        src = np.concatenate([links[0][:, 0], links[0][:, 1], links[1][:, 0], links[1][:, 1]])
        to = np.concatenate([links[0][:, 1], links[0][:, 0], links[1][:, 1], links[1][:, 0]])
        n0, n1 = len(links[0]), len(links[1])
        other = np.concatenate([np.arange(n0) + n0, np.arange(n0), 2 * n0 + n1 + np.arange(n1), 2 * n0 + np.arange(n1)])
        pair = np.concatenate([np.repeat(self.pair[0][None], 2 * n0, 0), np.repeat(self.pair[1][None], 2 * n1, 0)])
        msg = np.zeros((len(src), NONE + 1))
        belief = u
        for _ in range(ROUNDS if len(src) else 0):
            x = (belief[src] - msg[other])[:, :, None] + pair
            top = x.max(1)
            new = top + np.log(np.exp(x - top[:, None, :]).sum(1))
            new -= new.max(1, keepdims=True)
            msg = 0.5 * msg + 0.5 * new
            belief = u.copy()
            np.add.at(belief, to, msg)
        p = np.exp(belief - belief.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def _plausible(kind: int, s: str) -> bool:
    d = digits_of(s)
    if kind == 0:
        return "@" in s.strip("@")
    if kind == 1:
        parts = [p for p in re.split(r"[^0-9]+", s) if p]
        return len(parts) == 4 and all(map(is_octet, parts))
    if kind == 2:
        return is_card(s)
    return 8 <= len(d) <= 15


def find(texts: list[str], model: SkipChain | None) -> list[list[tuple[int, int, int, bool]]]:
    """For each text (kind, start, end, whether it is a base span), sorted by kind, then start."""
    g = Graph()
    for t in texts:
        g.add(t)
    out = [[(*s, True) for s in b] for b in g.base]
    if model is not None and g.span:
        p = model.marginals(g)
        best = p.argmax(1)
        marked = [int(k) if k != NONE and p[i, k] >= SURE else NONE for i, k in enumerate(best)]
        near = {int(b) for _, b in g.links[0]}
        taken = [_Taken(x) for x in g.base]
        i = 0
        while i < len(marked):
            kind, (k, a, b) = marked[i], g.span[i]
            j = i + 1
            if kind != NONE:
                for end in _ends(g, marked, near, i, texts[k]):
                    b = g.span[end - 1][2]
                    if _plausible(kind, texts[k][a:b]) and not taken[k].touches(a, b):
                        out[k].append((kind, a, b, False))
                        j = end
                        break
            i = j
    return [sorted(s) for s in out]


def _ends(g: Graph, marked: list[int], near: set[int], i: int, text: str) -> list[int]:
    """Where a span from token ``i`` may end: behind it, or behind any of its neighbours with the same mark, as long as
    the digits are not more than the longest number has; the longest first."""
    ends, j, digits = [i + 1], i + 1, len(digits_of(text[g.span[i][1]: g.span[i][2]]))
    while j < len(marked) and j in near and marked[j] == marked[i]:
        digits += len(digits_of(text[g.span[j][1]: g.span[j][2]]))
        j += 1
        if digits > LONGEST:
            break
        ends.append(j)
    return ends[::-1]


class _Taken:
    """Spans, which may overlap, by start, with the furthest end so far."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        both = sorted((a, b) for _, a, b in spans)
        self.start = [a for a, _ in both]
        self.reach = list(itertools.accumulate((b for _, b in both), max))

    def touches(self, a: int, b: int) -> bool:
        k = bisect.bisect_left(self.start, b)
        return k > 0 and self.reach[k - 1] > a


def respelled(kind: int, s: str, rng: random.Random) -> str:
    """The same address or number, written so that no pattern need find it."""
    sign = rng.choice("._/-:")
    if kind == 0:
        return s.replace(".", rng.choice(["[.]", ",", "(.)"]))
    if kind == 1:
        return s.replace(".", sign if sign != "." else "_")
    d = digits_of(s)
    cut = rng.choice([3, 4])
    return sign.join(d[x: x + cut] for x in range(0, len(d), cut))


def with_copies(text: str) -> tuple[str, dict[int, int]]:
    """``text`` with other spellings of its spans, and of as many numbers that are none, behind it; labels of these."""
    rng = random.Random(zlib.crc32(text.encode()))
    base = base_spans(text)
    taken = _Taken(base)
    others = [(NONE, a, b) for a, b, _ in tokens(text) if len(digits_of(text[a:b])) > 6 and "@" not in text[a:b] and not taken.touches(a, b)]
    rng.shuffle(others)
    out, told, at = [text], {}, len(text)
    for kind, a, b in base + others[: len(base) + 1]:
        word = respelled(kind, text[a:b], rng)
        told[at + 3] = kind
        out.append(" x " + word)
        at += 3 + len(word)
    return "".join(out), told


def _graph_rows(batches):
    """Features, labels and links of each training text, as arrays."""
    for batch in batches:
        for t in batch.column("t").to_pylist():
            g = Graph()
            g.add(*with_copies(t))
            f, links = g.arrays()
            row = (zlib.crc32(t.encode()), f.astype("<u2").tobytes(), np.array(g.label, np.uint8).tobytes(), *(x.astype("<u4").tobytes() for x in links))
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, (pa.int64(), *[pa.binary()] * 4))], names=["key", "features", "label", "chain", "skip"])


def train_field(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> SkipChain | None:
    """From at most ``sample`` whole documents with a digit or an at sign; None if these hold no base span. What comes to
    the driver are about 30 bytes for each of their tokens with a digit or an at sign."""
    d = docs.filter(F.col(text_col).rlike("[0-9@]"))
    rows = bounded_sample(d, text_col, sample).mapInArrow(_graph_rows, "key long, features binary, label binary, chain binary, skip binary").collect()
    g = Graph()
    features, links = [np.zeros((0, N_FEATURES), np.int64)], ([np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)])
    for r in sorted(rows):
        n = len(g.label)
        g.label += list(r.label)
        features.append(np.frombuffer(r.features, "<u2").reshape(-1, N_FEATURES).astype(np.int64))
        for to, x in zip(links, (r.chain, r.skip)):
            to.append(np.frombuffer(x, "<u4").reshape(-1, 2).astype(np.int64) + n)
    if all(x == NONE for x in g.label):
        return None
    model = SkipChain()
    model.train(np.concatenate(features), [np.concatenate(x) for x in links], np.array(g.label))
    return model


def _find_rows(model: SkipChain | None):
    kind_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                b = batch.slice(lo, 2000)
                text = b.column("text")
                some = np.flatnonzero(pc.fill_null(pc.match_substring_regex(text, "[0-9@]"), False).to_numpy(zero_copy_only=False))
                spans: list = [[] for _ in range(b.num_rows)]
                for k, s in zip(some.tolist(), find(text.take(pa.array(some)).to_pylist(), model)):
                    spans[k] = [{"kind": KINDS[a], "start": x, "end": y, "base": z} for a, x, y, z in s]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(spans, kind_type)], names=["doc_id", "spans"])

    return run


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: SkipChain | None = None) -> DataFrame:
    """One row per document: doc_id, spans (kind, start, end, base), by kind, then start; places in code points.

    Null text counts as empty and has no spans. Null ids and repeated rows are rows like any other; an empty table
    gives no rows; other columns are ignored, whatever their names. Texts are read whole, in time that grows with
    their length, and a long one is held by one task with about 3,000 bytes for each token with a digit or an at sign.
    Ties: of spans that could be added from one token the longest of the right form is; a token whose kinds are equally
    likely is not marked. Without ``model`` one is trained on the documents themselves.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    model = model or train_field(d)
    return d.mapInArrow(_find_rows(model), "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>")
