"""How the sources of a language differ in their words: a sort-based, streaming audit.

Rows are dealt and sorted by (lang, term, source, document), so that a scan over runs of equal keys gives counts and
document frequencies with a few rows in memory. The scan runs three times: over a block of documents in the task that
reads them, whose runs leave as one row each; over the runs of all blocks; and over the counts of kept terms, dealt
in cells of a language's sources and terms, where each cell gives its part of the sums over terms for pairs of
sources, and its best terms.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, partitions

LEAST = 30  # documents that a kept term must be in
SMOOTH = 5
SCALE = 1_000_000_000
TOP = 50
WORDS = 2_000_000  # terms of a block of documents that are sorted at once
PIECE = 1 << 20  # bytes of a text that are cut into terms at once
TILE = 128  # sources that stand side by side in a cell
TERMS = 500  # terms of a cell, about; more where a language has many sources, as a cell answers for all pairs of them
DENSE = 1 << 20  # numbers of a matrix of terms by sources

#: Bytes as terms have them: A-Z lower, letters and all beyond ASCII as they are, anything else a space.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
RUNS = "lang string, source string, term string, block long, df long, count long"


def pieces(text: bytes, size: int):
    """A text in parts of about ``size`` bytes, cut at spaces."""
    at = 0
    while len(text) - at > size:
        cut = text.find(b" ", at + size)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


class _Ids(dict):
    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class _Block:
    """Documents of a task, as numbers of groups, terms and documents."""

    def __init__(self):
        self.groups, self.terms = _Ids(), _Ids()
        self.of, self.parts, self.lengths, self.size = [], [], [], 0

    def add(self, lang: str, source: str, text: str, piece: int) -> None:
        g, n = self.groups[(lang, source)], 0
        for p in pieces(text.encode().translate(TABLE), piece):
            words = p.split()
            self.parts.append(np.fromiter(map(self.terms.__getitem__, words), np.int32, len(words)))
            n += len(words)
        self.of.append(g)
        self.lengths.append(n)
        self.size += n

    def runs(self):
        """(group, term, documents, occurrences) of each group and term, sorted by language, term and source."""
        terms = list(self.terms)
        order = sorted(range(len(terms)), key=terms.__getitem__)
        rank = np.empty(len(terms), np.int64)
        rank[order] = np.arange(len(terms))
        groups = sorted(self.groups)
        place = {g: i for i, g in enumerate(groups)}
        where = np.array([place[g] for g in self.groups], np.int64)
        docs = len(self.of)
        doc = np.repeat(np.arange(docs), self.lengths)
        g = where[np.array(self.of, np.int64)][doc]
        t = rank[np.concatenate(self.parts)] if self.parts else np.zeros(0, np.int64)
        key = np.sort((g * max(len(terms), 1) + t) * docs + doc)
        first = np.flatnonzero(np.diff(key, prepend=-1))  # a run for each document
        run = key[first] // docs
        start = np.flatnonzero(np.diff(run, prepend=-1))  # and for each group and term
        df = np.diff(np.append(start, len(run)))
        count = np.diff(np.append(first[start], len(key)))
        return groups, [terms[i] for i in order], run[start] // max(len(terms), 1), run[start] % max(len(terms), 1), df, count


def _map_runs(words: int, piece: int):
    """The scan over the documents of a task. Each group has a row without a term in each block, so none is lost."""

    def rows(b: _Block, number: int):
        groups, terms, g, t, df, count = b.runs()
        langs, sources = pa.array([x for x, _ in groups], pa.string()), pa.array([x for _, x in groups], pa.string())
        n = len(groups)
        g, df, count = np.concatenate([np.arange(n), g]), np.concatenate([np.zeros(n, np.int64), df]), np.concatenate([np.zeros(n, np.int64), count])
        names = pa.array([b"", *terms], pa.binary()).cast(pa.string())
        at = np.concatenate([np.zeros(n, np.int64), t + 1])
        for lo in range(0, len(g), 100_000):
            s = slice(lo, lo + 100_000)
            yield pa.RecordBatch.from_arrays(
                [langs.take(pa.array(g[s])), sources.take(pa.array(g[s])), names.take(pa.array(at[s])), pa.array(np.full(len(g[s]), number)), pa.array(df[s]), pa.array(count[s])],
                names=["lang", "source", "term", "block", "df", "count"])

    def run(batches):
        b, number = _Block(), 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
                b.add(lang, source, text, piece)
                if b.size >= words:
                    yield from rows(b, number)
                    b, number = _Block(), number + 1
        if b.of:
            yield from rows(b, number)

    return run


def _run_starts(*columns) -> np.ndarray:
    """Where a sorted batch's key changes."""
    n = len(columns[0])
    change = np.zeros(n, bool)
    change[0] = True
    for c in columns:
        change[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(change)


def _sum_runs(batches):
    """The scan over sorted runs: a row for each (lang, term, source). A run may go on in the next batch."""
    keys = ("lang", "term", "source")

    def out(columns, df, count):
        return pa.RecordBatch.from_arrays([*columns, pa.array(df, pa.int64()), pa.array(count, pa.int64())], names=[*keys, "df", "count"])

    last = None  # the run that may go on: its key, and its sums
    for batch in batches:
        if not batch.num_rows:
            continue
        at = _run_starts(*(batch.column(c) for c in keys))
        df, count = (np.add.reduceat(np.asarray(batch.column(c)), at) for c in ("df", "count"))
        columns = [batch.column(c).take(pa.array(at)) for c in keys]
        if last is not None:
            if last[0] == [c[0].as_py() for c in columns]:
                df[0] += last[1]
                count[0] += last[2]
            else:
                yield out([pa.array([x], pa.string()) for x in last[0]], [last[1]], [last[2]])
        last = [c[-1].as_py() for c in columns], int(df[-1]), int(count[-1])
        if len(at) > 1:
            yield out([c[:-1] for c in columns], df[:-1], count[:-1])
    if last is not None:
        yield out([pa.array([x], pa.string()) for x in last[0]], [last[1]], [last[2]])


def share(count: np.ndarray, n, v) -> np.ndarray:
    """1 + floor(SCALE * (count + SMOOTH) / (n + SMOOTH * v)), exact: three divisions by 1000ths keep all numbers small."""
    d = np.asarray(n, np.int64) + SMOOTH * np.asarray(v, np.int64)
    rest, out = np.asarray(count, np.int64) + SMOOTH, 0
    for _ in range(3):
        q, rest = np.divmod(rest * 1000, d)
        out = out * 1000 + q
    return 1 + out


def _cells(top: int, dense: int):
    """Partial sums and best terms of cells. A cell's rows come sorted: its groups first, then its counts by term and source."""

    class Cell:
        def __init__(self, a: int, b: int, part: int):
            self.a, self.b, self.part, self.last = a, b, part, None
            self.names, self.index, self.n, self.side, self.v, self.all = [], {}, [], [], 0, 0

        def group(self, source, side, n, v, every):
            self.index[source] = len(self.names)
            self.names.append(source)
            self.n.append(n)
            self.side.append(side)
            self.v, self.all = v, every

        def begin(self):
            k = len(self.names)
            self.zero = share(np.zeros(k, np.int64), np.array(self.n, np.int64), self.v) if self.v else np.ones(k, np.int64)
            # terms that none of these sources has come to no cell: all are summed here once, as if no source had them
            self.apart = np.abs(self.zero[:, None] - self.zero[None, :])
            self.sums, self.best = self.apart * (self.v if self.part == 0 else 0), [[] for _ in range(k)]
            self.rows, self.places = max(1, dense // k), []
            self.terms, self.totals, self.counts = [], [], []

        def add(self, term, source, count, total):
            if self.last is None:
                self.begin()
            if term != self.last:
                if len(self.terms) >= self.rows:
                    self.flush()
                self.last = term
                self.terms.append(term)
                self.totals.append(total)
            self.places.append((len(self.terms) - 1, self.index[source]))
            self.counts.append(count)

        def flush(self):
            k, at = len(self.names), np.array(self.places, np.int64)
            c = np.zeros((len(self.terms), k), np.int64)
            c[at[:, 0], at[:, 1]] = self.counts
            p = share(c, np.array(self.n, np.int64)[None, :], self.v)
            own = np.arange(k) if self.a == self.b else np.flatnonzero(np.array(self.side) == self.a)
            other = own if self.a == self.b else np.flatnonzero(np.array(self.side) == self.b)
            for i in own.tolist():
                self.sums[i, other] += np.abs(p[:, other] - p[:, i: i + 1]).sum(0) - len(c) * self.apart[i, other]
            if self.a == self.b:  # a term's part of the report comes from one cell
                q = share(np.array(self.totals, np.int64), self.all, self.v)
                terms = np.array([t.encode() for t in self.terms], object)
                for i in own.tolist():
                    pick = np.flatnonzero((c[:, i] > 0) & (p[:, i] > q))
                    f = p[pick, i] - q[pick]
                    found = self.best[i] + list(zip((-f).tolist(), terms[pick].tolist()))
                    self.best[i] = sorted(found)[:top]
            self.terms, self.totals, self.counts, self.places = [], [], [], []

        def rest(self, lang):
            if self.last is None:
                self.begin()
            else:
                self.flush()
            for i, s in enumerate(self.names):
                for j, o in enumerate(self.names):
                    if self.a == self.b and i < j or self.a != self.b and self.side[i] == self.a and self.side[j] == self.b:
                        yield (lang, s, "pair", o, int(self.sums[i, j]))
                for f, t in self.best[i]:
                    yield (lang, s, "term", t.decode(), -f)

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(),) * 4 + (pa.int64(),))], names=["lang", "source", "part", "item", "value"])

    def run(batches):
        key, cell, ready = None, None, []
        names = ("lang", "a", "b", "part", "kind", "term", "source", "count", "total", "side", "v")
        for batch in batches:
            for lang, a, b, part, kind, term, source, count, total, side, v in zip(*(batch.column(c).to_pylist() for c in names)):
                if (lang, a, b, part) != key:
                    if cell:
                        ready += cell.rest(key[0])
                    key, cell = (lang, a, b, part), Cell(a, b, part)
                if kind == 0:
                    cell.group(source, side, count, v, total)
                else:
                    cell.add(term, source, count, total)
            if ready:
                yield out(ready)
                ready = []
        if cell:
            ready += cell.rest(key[0])
        if ready:
            yield out(ready)

    return run


def source_divergence(docs: DataFrame, least: int = LEAST, top: int = TOP, tile: int = TILE, per_cell: int = TERMS, words: int = WORDS, piece: int = PIECE, dense: int = DENSE,
                      text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Rows lang, source, part, item, value, rank: for each group of a language and a source its distance to every other
    source of the language (``pair``), and the ``top`` terms that it has more of than the language (``term``).

    Null text, lang and source count as ''. Each row is a document: rows that are repeated or share an id count as often as
    they are there. Ties are ordered by the item, as UTF-8. Groups without terms have their pairs; a language of one source
    has none; where no term is kept, distances are 0. An empty table gives no rows; other columns are ignored, whatever
    their names. A text of any length is cut into terms ``piece`` bytes at a time, so a task holds it once, in UTF-8, besides
    four bytes for each of its terms. Counts up to 9e15 are exact.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    d = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    runs = d.mapInArrow(_map_runs(words, piece), RUNS)
    # a term's rows lie apart by source, so that no term has more rows in one task than there are blocks
    runs = runs.repartition(n, "lang", "term", "source").sortWithinPartitions("lang", "term", "source", "block")
    counts = materialize(runs.mapInArrow(_sum_runs, "lang string, term string, source string, df long, count long"), "counts")

    groups = counts.filter("term = ''").select("lang", "source")
    per_term = counts.filter("term <> ''").groupBy("lang", "term").agg(F.sum("df").alias("__df"), F.sum("count").alias("total")).filter(F.col("__df") >= least)
    kept = materialize(counts.filter("term <> ''").join(per_term.drop("__df"), ["lang", "term"]).select("lang", "term", "source", "count", "total"), "kept")
    v = kept.groupBy("lang", "term").agg(F.min("total").alias("total")).groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("every"))
    of_group = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    # sources of a language by number, in tiles; a row for each group
    groups = groups.join(of_group, ["lang", "source"], "left").join(v, "lang", "left").fillna(0, ["n", "v", "every"])
    groups = groups.withColumn("tile", F.floor((F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1) / tile).cast("int"))
    tiles = W.partitionBy("lang")
    groups = materialize(groups.withColumn("tiles", F.max("tile").over(tiles) + 1).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("v") / F.greatest(F.lit(per_cell), 25 * F.count(F.lit(1)).over(tiles)))).cast("int")), "groups")

    # a cell is a pair of tiles and a part of the terms; its groups come to it, and the counts of its sources
    pair = F.expr("transform(sequence(0, tiles - 1), t -> struct(least(t, tile) as a, greatest(t, tile) as b))")
    cell = ["lang", "a", "b", "part"]
    none = F.lit("").alias("term")
    heads = groups.withColumn("__c", F.explode(pair)).withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).select(
        "lang", "__c.a", "__c.b", "part", F.lit(0).alias("kind"), none, "source", F.col("n").alias("count"), F.col("every").alias("total"), F.col("tile").alias("side"), "v")
    rows = kept.join(groups.select("lang", "source", "tile", "tiles", "parts"), ["lang", "source"]).withColumn("__c", F.explode(pair))
    rows = rows.select("lang", "__c.a", "__c.b", F.pmod(F.xxhash64("term"), "parts").cast("int").alias("part"), F.lit(1).alias("kind"), "term", "source", "count", "total", F.lit(0).alias("side"), F.lit(0).cast("long").alias("v"))
    cells = heads.unionByName(rows).repartition(n, *cell).sortWithinPartitions(*cell, "kind", "term", "source")
    found = materialize(cells.mapInArrow(_cells(top, dense), "lang string, source string, part string, item string, value long"), "found")

    half = found.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = half.unionByName(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    terms = found.filter("part = 'term'").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return pairs.unionByName(terms.select(*pairs.columns))
