"""Words as the corpus operators count them: runs of letters or digits, lower-cased."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class WordIds:
    """64-bit ids of words, the same on every machine; keeps those of frequent words at hand."""

    def __init__(self, keep: int = 200_000):
        self._ids: dict[str, int] = {}
        self._keep = keep

    def __call__(self, found: list[str]) -> np.ndarray:
        ids = self._ids
        if len(ids) > self._keep:
            ids.clear()
        for w in set(found).difference(ids):
            ids[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(ids.__getitem__, found), dtype=np.uint64, count=len(found))


_M = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * _M[0]
    h = h ^ (h >> np.uint64(29))
    h = h * _M[1]
    return h ^ (h >> np.uint64(32))


def shingles(ids: np.ndarray, width: int) -> np.ndarray:
    """One 64-bit value per run of ``width`` words, in order; empty where the text is shorter."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        h = mix(h * _M[2] + ids[k : k + n])
    return h
