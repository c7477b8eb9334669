"""Language identification: a bidirectional gated recurrent network over bytes, trained here in numpy.

A document runs through the network as one sequence, forward and backward. Every byte's position gets a
probability for each language from the two states there; a document's probabilities are the mean over all its
positions. Documents run side by side, the longest first, and leave as they end; none is cut or padded: what stands
in a column behind a text's last byte comes after all its states.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample

HIDDEN = 12
BLOCK = 16  # steps after which texts that have ended leave
PORTION = 8 << 20  # bytes of text that run side by side; a longer text goes through in pieces of this size
LONG = 8_192  # bytes from which on texts wait for others as long, so that they run side by side
REFRESH = 2  # epochs for which the states at the windows' edges hold
STEPS = 64  # steps of backpropagation through time in training
PER_LANGUAGE = 250  # the bound on training documents for each language
TOTAL = 1000  # and on those of all languages; documents are taken whole
WINDOWS = 16_000  # places in these documents from which an epoch learns
EPOCHS = 6
FOLDS = 5
SMALL = np.float32


class Direction:
    """One gated recurrent layer. Inputs are bytes, so the input weights are a table of 256 columns; rows are the update
    gate, the reset gate and the candidate, ``hidden`` of each."""

    def __init__(self, rng, hidden: int):
        self.hidden = hidden
        self.e = rng.normal(0, 0.5, (3 * hidden, 256)).astype(SMALL)
        self.u = rng.normal(0, 1 / np.sqrt(hidden), (3 * hidden, hidden)).astype(SMALL)

    def parameters(self):
        return [self.e, self.u]

    def run(self, x: np.ndarray, h: np.ndarray, keep: list | None = None, wide: np.ndarray | None = None) -> np.ndarray:
        """States (steps, hidden, width) after each of the bytes ``x`` (steps, width), from ``h`` (hidden, width). With ``wide``
        a step is made in so many columns, the first ones; in the others the state stays ``h`` until they begin."""
        k, one, two = self.hidden, SMALL(1), SMALL(2)
        # gates are 1 / (1 + exp(-v)), and the candidate's hyperbolic tangent is 1 - 2 / (1 + exp(2 v)); an infinite power gives its limit
        e = self.e * np.repeat(np.array([-1, -1, 2], SMALL), k)[:, None]
        u = self.u * np.repeat(np.array([-1, -1, 2], SMALL), k)[:, None]
        out = np.empty((len(x), *h.shape), SMALL)
        width = h.shape[1]
        wide = [width] * len(x) if wide is None else wide.tolist()
        if min(wide, default=0) < width:
            out[:] = h
        room = np.empty((2, 3 * k * width), SMALL)
        take, matmul, add, subtract, multiply, divide, exp = e.take, np.matmul, np.add, np.subtract, np.multiply, np.divide, np.exp
        now = -1
        with np.errstate(over="ignore"):
            for b, state, w in zip(x, out, wide):
                if w != now:
                    g, a = room[:, : 3 * k * w].reshape(2, 3 * k, w)
                    now = w
                    gates, z, r, n, a_gates, a_n = g[: 2 * k], g[:k], g[k: 2 * k], g[2 * k:], a[: 2 * k], a[2 * k:]
                o = state
                if w < width:
                    b, o, h = b[:w], o[:, :w], h[:, :w]
                take(b, 1, g, "clip")
                matmul(u, h, a)
                add(gates, a_gates, gates)
                exp(gates, gates)
                add(gates, one, gates)
                divide(one, gates, gates)
                if keep is not None:
                    un = a_n * SMALL(0.5)
                multiply(a_n, r, a_n)
                add(n, a_n, n)
                exp(n, n)
                add(n, one, n)
                divide(two, n, n)
                subtract(one, n, n)
                if keep is not None:
                    keep.append((h, z.copy(), r.copy(), un, n.copy()))
                subtract(h, n, o)
                multiply(o, z, o)
                add(o, n, o)
                h = state
        return out

    def back(self, x: np.ndarray, keep: list, d_out: np.ndarray) -> list[np.ndarray]:
        """Gradients of the parameters by backpropagation through time."""
        k = self.hidden
        g_u = np.zeros_like(self.u)
        d_gate = np.empty((len(x), 3 * k, x.shape[1]), SMALL)
        dh = np.zeros_like(d_out[0])
        for t in reversed(range(len(x))):
            h, z, r, un, n = keep[t]
            dh = dh + d_out[t]
            d = d_gate[t]
            d[:k] = dh * (h - n) * z * (1 - z)
            d[2 * k:] = dh * (1 - z) * (1 - n * n)
            d[k: 2 * k] = d[2 * k:] * un * r * (1 - r)
            inner = d.copy()
            inner[2 * k:] *= r  # what the candidate's product with the state gets
            g_u += inner @ h.T
            dh = dh * z + self.u.T @ inner
        flat = x.reshape(-1)
        one = np.zeros((len(flat), 256), SMALL)
        one[np.arange(len(flat)), flat] = 1
        return [d_gate.transpose(1, 0, 2).reshape(3 * k, -1) @ one, g_u]

    def flow(self, flat: np.ndarray, n: np.ndarray, w: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Texts of ``n`` bytes (at least one), one after another in ``flat``, each a sequence that begins at ``start``
        (hidden, texts): the states at all bytes times ``w``, and the last state of each text."""
        order = np.argsort(-n, kind="stable")
        size, at = n[order], (np.cumsum(n) - n)[order]
        h = np.zeros((self.hidden, len(n)), SMALL) if start is None else np.ascontiguousarray(start[:, order])
        out, last = np.empty((len(flat), w.shape[1]), SMALL), np.empty_like(h)
        steps, t = np.arange(BLOCK)[:, None], 0
        while h.shape[1]:
            place = at + (t + steps)
            states = self.run(flat[np.minimum(place, len(flat) - 1)], h)
            real = t + steps < size
            out[place[real]] = np.matmul(w.T, states).transpose(0, 2, 1)[real]
            t += BLOCK
            stay = int(np.searchsorted(-size, -t))  # texts longer than t
            done = np.arange(stay, len(size))
            last[:, order[stay: len(size)]] = states[size[done] - 1 - (t - BLOCK), :, done].T
            h, at, size = np.ascontiguousarray(states[-1][:, :stay]), at[:stay], size[:stay]
        return out, last


def backwards(n: np.ndarray) -> np.ndarray:
    """Places that read each of the texts of ``n`` bytes from its end; it is its own inverse."""
    start = np.cumsum(n) - n
    return np.repeat(2 * start + n - 1, n) - np.arange(int(n.sum()))


def softmax(v: np.ndarray) -> np.ndarray:
    """Of each row, in place."""
    v -= v.max(axis=1, keepdims=True)
    np.exp(v, out=v)
    v /= v.sum(axis=1, keepdims=True)
    return v


class Network:
    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.forward, self.backward = Direction(rng, hidden), Direction(rng, hidden)
        self.w = [rng.normal(0, 0.3, (hidden, len(labels))).astype(SMALL) for _ in range(2)]
        self.b = np.zeros(len(labels), SMALL)

    def parameters(self):
        return [*self.forward.parameters(), *self.backward.parameters(), *self.w, self.b]

    def gradients(self, x: np.ndarray, n: np.ndarray, y: np.ndarray, h: np.ndarray, g: np.ndarray):
        """The loss over windows of ``n`` bytes, in the columns of ``x``, of languages ``y``, and its gradients; ``h`` and
        ``g`` are the states before the window and, of the backward layer, behind it. What fills a column up comes after
        its bytes in both directions, so no state ever sees it."""
        steps = np.arange(len(x))[:, None]
        real = steps < n
        mirror = np.where(real, n - 1 - steps, 0)
        cols = np.arange(x.shape[1])[None, :]
        x_back = np.where(real, x[mirror, cols], 0).astype(np.uint8)
        keep: list = [[], []]
        f = self.forward.run(x, h, keep[0])
        b = self.backward.run(x_back, g, keep[1])[mirror, :, cols].transpose(0, 2, 1)
        p = softmax((np.matmul(self.w[0].T, f) + np.matmul(self.w[1].T, b) + self.b[:, None]).transpose(0, 2, 1).reshape(-1, len(self.b))).reshape(*x.shape, -1)
        share = real / real.sum()
        at = p[steps, cols, y[None, :]]
        loss = float(-(np.log(np.maximum(at, 1e-30)) * share).sum())
        p[steps, cols, y[None, :]] -= 1
        d = (p * share[:, :, None]).astype(SMALL).transpose(0, 2, 1)  # (steps, labels, width)
        d_back = np.where(real[:, None, :], d[mirror, :, cols].transpose(0, 2, 1), 0)
        grads = [*self.forward.back(x, keep[0], np.matmul(self.w[0], d)), *self.backward.back(x_back, keep[1], np.matmul(self.w[1], d_back))]
        return loss, [*grads, np.einsum("thw,tkw->hk", f, d), np.einsum("thw,tkw->hk", b, d), d.sum((0, 2))]

    def train(self, texts: list[bytes], y: np.ndarray, epochs: int = EPOCHS, windows: int = WINDOWS, width: int = 256, rate: float = 0.02, seed: int = 11) -> None:
        """Adam over windows of whole texts: an epoch draws texts, and of each a place, anywhere in it. States at the
        windows' edges come from running the texts through the network as it was up to ``REFRESH`` epochs ago; gradients go
        back through the window."""
        rng = np.random.default_rng(seed)
        order = sorted(range(len(texts)), key=lambda k: len(texts[k]))  # texts of like length run side by side
        texts, y = [texts[k] for k in order], y[order]
        m = [np.zeros_like(p) for p in self.parameters()]
        v = [np.zeros_like(p) for p in self.parameters()]
        size = np.array([len(t) for t in texts])
        total, step = epochs * max(1, -(-windows // width)), 0
        for epoch in range(epochs):
            if epoch % REFRESH == 0:  # the places of some epochs at once; before anything is learned states tell nothing
                docs = rng.integers(0, len(texts), (REFRESH, windows))
                places = (rng.random(docs.shape) * -(-size[docs] // STEPS)).astype(np.int64) * STEPS
                edges = self._edges(texts, docs.reshape(-1), places.reshape(-1)) if epoch else [np.zeros((self.forward.hidden, docs.size), SMALL)] * 2
            part = epoch % REFRESH
            doc, lo = docs[part], places[part]
            h, g = (x[:, part * windows: (part + 1) * windows] for x in edges)
            n = np.minimum(STEPS, size[doc] - lo)
            x = np.zeros((windows, STEPS), np.uint8)
            for k in range(windows):
                x[k, : n[k]] = np.frombuffer(texts[doc[k]], np.uint8, n[k], lo[k])
            x = np.ascontiguousarray(x.T)
            for at in range(0, windows, width):
                k = slice(at, at + width)
                step += 1
                _, grads = self.gradients(np.ascontiguousarray(x[:, k]), n[k], y[doc[k]], h[:, k], g[:, k])
                lr = rate * (1 - (step - 1) / total)
                norm = np.sqrt(sum(float((a * a).sum()) for a in grads))
                for p, a, m1, v1 in zip(self.parameters(), grads, m, v):
                    a = a * min(1.0, 1.0 / max(norm, 1e-9))
                    m1 += 0.1 * (a - m1)
                    v1 += 0.01 * (a * a - v1)
                    p -= (lr * (m1 / (1 - 0.9**step)) / (np.sqrt(v1 / (1 - 0.99**step)) + 1e-6)).astype(SMALL)

    def _edges(self, texts: list[bytes], doc: np.ndarray, lo: np.ndarray) -> list[np.ndarray]:
        """States before window ``lo`` of text ``doc``, and of the backward layer behind it."""
        one = np.eye(self.forward.hidden, dtype=SMALL)
        h, g = [np.zeros((len(one), len(doc)), SMALL) for _ in range(2)]
        order = np.argsort(doc, kind="stable")
        for some, who in portions(texts, PORTION // 8):
            n = np.array([len(t) for t in some])
            start = np.cumsum(n) - n
            k = order[np.searchsorted(doc[order], who[0]): np.searchsorted(doc[order], who[-1], side="right")]
            mine = doc[k] - who[0]
            flat = np.frombuffer(b"".join(some), np.uint8)
            a = lo[k] > 0
            f, _ = self.forward.flow(flat, n, one)
            h[:, k[a]] = f[start[mine[a]] + lo[k[a]] - 1].T
            back = backwards(n)
            b, _ = self.backward.flow(flat[back], n, one)
            end = lo[k] + STEPS
            a = end < n[mine]
            g[:, k[a]] = b[back[start[mine[a]] + end[a]]].T
        return [h, g]

    def documents(self, texts: list[bytes], portion: int = PORTION) -> np.ndarray:
        """Mean probabilities over all positions of each text; zeros for an empty one."""
        total = np.zeros((len(texts), len(self.labels)))
        order = np.array(sorted(range(len(texts)), key=lambda k: len(texts[k])), np.int64)
        for some, who in portions([texts[k] for k in order], portion):
            who = order[who]
            if len(some) == 1 and len(some[0]) > portion:
                total[who[0]] = self._long(some[0], portion)
                continue
            n = np.array([len(t) for t in some])
            total[who] = self._sums(np.frombuffer(b"".join(some), np.uint8), n)[0]
        return total / np.maximum([[len(t)] for t in texts], 1) if texts else total

    def _sums(self, flat: np.ndarray, n: np.ndarray, h: np.ndarray | None = None, g: np.ndarray | None = None):
        """Sums of the probabilities in each text, and the last state of the forward layer. Texts begin side by side, the
        longest in the first column, and a step has those that are so long: both layers, the backward one from the last
        step on, have their states in the same places."""
        order = np.argsort(-n, kind="stable")
        size, at = n[order], (np.cumsum(n) - n)[order]
        wide = np.searchsorted(-size, -np.arange(size[0]))  # texts longer than each step
        none = np.zeros((self.forward.hidden, len(n)), SMALL)
        h, g = (none.copy() if x is None else np.ascontiguousarray(x[:, order]) for x in (h, g))
        w, w_back, bias = np.ascontiguousarray(self.w[0].T), np.ascontiguousarray(self.w[1].T), self.b[:, None]
        blocks = []
        for t in range(0, len(wide), BLOCK):
            k = wide[t: t + BLOCK]
            x = flat[np.minimum(at[: k[0]] + np.arange(t, t + len(k))[:, None], len(flat) - 1)]
            states = self.forward.run(x, np.ascontiguousarray(h[:, : k[0]]), wide=k)
            ends = np.minimum(size[: k[0]] - t, len(k)) - 1
            h[:, : k[0]] = states[ends, :, np.arange(k[0])].T if ends[-1] < len(k) - 1 else states[-1]
            f = np.matmul(w, states)
            f += bias
            blocks.append((k, x, f))
        total = np.zeros((len(self.labels), len(n)))
        while blocks:
            k, x, f = blocks.pop()
            states = self.backward.run(x[::-1], np.ascontiguousarray(g[:, : k[0]]), wide=k[::-1])
            g[:, : k[0]] = states[-1]
            f += np.matmul(w_back, states)[::-1]
            f -= f.max(axis=1, keepdims=True)
            np.exp(f, out=f)
            f /= f.sum(axis=1, keepdims=True)
            if k[-1] < k[0]:
                f *= (np.arange(k[0]) < k[:, None])[:, None, :]
            total[:, : k[0]] += f.sum(axis=0)
        out, last = np.empty((len(n), len(self.labels))), np.empty_like(h)
        out[order], last[:, order] = total.T, h
        return out, last

    def _long(self, text: bytes, portion: int) -> np.ndarray:
        """A text in pieces: the states of the backward layer behind each of them first, then the sums from the front."""
        data = np.frombuffer(text, np.uint8)
        pieces = [data[lo: lo + portion] for lo in range(0, len(data), portion)]
        behind = [np.zeros((self.backward.hidden, 1), SMALL)]
        for p in pieces[:0:-1]:
            behind.append(self.backward.flow(p[::-1], np.array([len(p)]), self.w[1], behind[-1])[1])
        total, h = np.zeros(len(self.labels)), np.zeros((self.forward.hidden, 1), SMALL)
        for p, g in zip(pieces, behind[::-1]):
            s, h = self._sums(p, np.array([len(p)]), h, g)
            total += s[0]
        return total


def portions(texts: list[bytes], most: int):
    """Texts that are not empty, in lists of about ``most`` bytes, and their numbers; a longer one is alone."""
    some, who, size = [], [], 0
    for k, t in enumerate(texts):
        if not t:
            continue
        if some and size + len(t) > most:
            yield some, np.array(who)
            some, who, size = [], [], 0
        some.append(t)
        who.append(k)
        size += len(t)
    if some:
        yield some, np.array(who)


def _train(batches):
    """The network that the rows of the one task teach, pickled; nothing without rows."""
    rows = sorted((lang, t.encode()) for batch in batches for lang, t in zip(batch.column("lang").to_pylist(), batch.column("t").to_pylist()))
    if rows:
        net = Network(sorted({x for x, _ in rows}))
        if len(net.labels) > 1:
            net.train([t for _, t in rows], np.array([net.labels.index(a) for a, _ in rows]))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], names=["net"])


def train_network(docs: DataFrame, per_language: int = PER_LANGUAGE, total: int = TOTAL) -> Network | None:
    """Train on at most ``per_language`` labelled documents of each language, and ``total`` in all, that a hash of the text
    picks; they are taken whole, in one task. The result is None without any labelled text."""
    d = docs.filter("text IS NOT NULL AND lang IS NOT NULL").filter(F.col("text").rlike(r"\p{L}"))
    sample = bounded_sample(d, "text", per_language, by="lang", total=total)
    made = sample.repartition(1).mapInArrow(_train, "net binary").first()
    return pickle.loads(made.net) if made else None


def _predict(net: Network | None, portion: int, long: int):
    def rows(waiting):
        ids, held, texts = zip(*waiting)
        p = net.documents(list(texts), portion) if net else None
        known = [net is not None and bool(t) for t in texts]
        best = [int(p[i].argmax()) if k else -1 for i, k in enumerate(known)]
        lang = [net.labels[b] if k else "und" for b, k in zip(best, known)]
        score = [min(1.0, max(0.0, float(p[i, b]))) if k else 0.0 for i, (b, k) in enumerate(zip(best, known))]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(lang), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    def run(batches):
        waiting, size = {False: [], True: []}, {False: 0, True: 0}
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "held_out", "letters")]
            for i, held, letters, t in zip(*columns, batch.column("text").cast(pa.binary())):
                t = t.as_py() if letters else b""
                k = len(t) > long
                if waiting[k] and (size[k] + len(t) > portion or len(waiting[k]) >= 10_000):
                    yield rows(waiting[k])
                    waiting[k], size[k] = [], 0
                waiting[k].append((i, held, t))
                size[k] += len(t)
        for w in waiting.values():
            if w:
                yield rows(w)

    return run


def predict_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, folds: int = FOLDS,
                     portion: int = PORTION, long: int = LONG) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (the mean probability of that language).

    Rows whose crc32 of the id as text is divisible by ``folds`` are held out of training (a null id counts as
    the empty text, crc 0: held out). Null texts and texts without a letter give ``und`` and 0, as does every text
    when no row can be learned from. Repeated rows each get the same result. An empty table gives no rows. Of
    languages that are equally likely the first by code point is taken. Other columns are ignored, whatever their names.
    Texts of any length run through whole; one longer than ``portion`` goes in pieces, states carried from one to the next.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    d = d.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % folds == 0)
    net = train_network(d.filter("NOT held_out"), per_language)
    d = d.select("doc_id", "held_out", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return d.mapInArrow(_predict(net, portion, long), "doc_id long, held_out boolean, lang_pred string, score double")
