"""Words of many texts as arrays of 64-bit hashes."""

from __future__ import annotations

import itertools

import numpy as np
import xxhash

M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:  # a bound on a worker's memory, not on what is hashed
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * M2
    x = (x ^ (x >> np.uint64(32))) * M3
    return x ^ (x >> np.uint64(30))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, one text after another, and how many each text has.

    ``bytes.split`` parts words at just the bytes 9 to 13 and 32.
    """
    words = [t.split() for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    return np.fromiter(map(_hashes.__getitem__, itertools.chain.from_iterable(words)), np.uint64, int(n.sum())), n


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place on; places near the end of the array are cut off."""
    if len(h) < k:
        return h[:0]
    out = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        out = (out * M1) + h[i: len(h) - k + 1 + i]
    return mix(out)


def starts(n: np.ndarray) -> np.ndarray:
    return np.cumsum(n) - n
