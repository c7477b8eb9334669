"""Gestalt similarity of strings; it depends on the order of its arguments.

The ratio is twice the characters in matching blocks by the length of both. It cannot exceed twice the characters that
both have by that length, so most pairs are told apart by counting characters, without any matching.
"""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ratio(a: str | None, b: str | None) -> float | None:
    return None if a is None or b is None else SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(T.DoubleType())
def fuzzy_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def most(a: str, b: str) -> float:
    """The ratio's upper bound."""
    n = len(a) + len(b)
    return 2.0 * (Counter(a) & Counter(b)).total() / n if n else 1.0


def reaches(a, b, least: float) -> Column:
    """Whether the ratio of two columns is at least ``least``: equal texts and those of too different lengths are settled by
    expressions, and of the others only those that share enough characters are matched. False for nulls."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (a, b))

    @F.pandas_udf(T.BooleanType())
    def verified(s: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([p is not None and q is not None and most(p, q) >= least and ratio(p, q) >= least for p, q in zip(s, t)], dtype="bool")

    lengths = F.length(x) + F.length(y)
    apart = 2.0 * F.least(F.length(x), F.length(y)) < F.lit(least) * lengths
    known = F.when(x.isNull() | y.isNull(), False).when(x == y, F.lit(least <= 1.0)).when(apart, False)
    return F.coalesce(known, verified(F.when(known.isNull(), x), F.when(known.isNull(), y)))


def shares(texts: list[str], columns: dict[tuple[str, int], int]) -> np.ndarray:
    """A row of 0 and 1 for each text over numbered characters: the second a of a text is another one than the first. Products of
    rows count the characters that two texts share."""
    out = np.zeros((len(texts), len(columns)), np.float32)
    for i, t in enumerate(texts):
        seen: Counter = Counter()
        for c in t:
            j = columns.get((c, seen[c]))
            seen[c] += 1
            if j is not None:
                out[i, j] = 1
    return out


def best_matches(found: list[str], known: list[str], least: float, chunk: int = 500) -> tuple[list[tuple[int, float] | None], int]:
    """For each of ``found`` the first of the most similar ``known`` and its ratio, if that is at least ``least``; and how many pairs
    were matched. Bounds come from a product of matrices; a text's candidates are matched from the highest bound down, until
    no bound left can beat, or equal from an earlier place, what was found."""
    columns: dict[tuple[str, int], int] = {}
    for t in known:
        seen: Counter = Counter()
        for c in t:
            columns.setdefault((c, seen[c]), len(columns))
            seen[c] += 1
    right, n_right = shares(known, columns), np.array(list(map(len, known)), np.float64)
    out, verified = [], 0
    for lo in range(0, len(found), chunk):
        some = found[lo: lo + chunk]
        n = np.array(list(map(len, some)), np.float64)[:, None] + n_right[None, :]
        bound = np.divide(2.0 * (shares(some, columns) @ right.T), n, out=np.ones_like(n), where=n > 0)
        for text, b in zip(some, bound):
            best, at = least, None
            pick = np.flatnonzero(b >= least - 1e-12)
            for j in pick[np.lexsort((pick, -b[pick]))].tolist():
                if b[j] < best - 1e-12:
                    break
                verified += 1
                r = ratio(text, known[j])
                if r > best or (r == best and (at is None or j < at)):
                    best, at = r, j
            out.append(None if at is None else (at, best))
    return out, verified
