"""Counter-based Poisson draws in numpy: every count by the same inverse distribution function."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

#: The finalizer of a common 32-bit hash and the step between counters.
FIRST, SECOND, STEP = 0x85EBCA6B, 0xC2B2AE35, 0x9E3779B9
WORD = 2**32
#: Deviations on each side of the count that a table spans, and entries added on each side.
SPAN, MARGIN = 12, 40
#: Top bits of a word that are looked up before its place among the thresholds is searched.
GUIDE = 14


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit words that spreads every bit, in place."""
    t = x >> np.uint32(16)
    x ^= t
    x *= np.uint32(FIRST)
    np.right_shift(x, np.uint32(13), out=t)
    x ^= t
    x *= np.uint32(SECOND)
    np.right_shift(x, np.uint32(16), out=t)
    x ^= t
    return x


def words(w0: np.ndarray, w1: np.ndarray, n: int) -> np.ndarray:
    """``n`` words for each pair of key words: column r depends on the keys and r alone."""
    counter = np.arange(n, dtype=np.uint32) * np.uint32(STEP)
    x = mixed(w0.astype(np.uint32)[:, None] + counter)
    x ^= w1.astype(np.uint32)[:, None]
    return mixed(x)


@lru_cache(maxsize=4096)
def poisson_table(count: int) -> tuple[int, np.ndarray]:
    """(smallest value, word thresholds): a word w draws the smallest value plus the number of thresholds <= w.

    Probabilities follow from that of the mode by ratios, so no count under- or overflows.
    """
    width = math.floor(SPAN * math.sqrt(count)) + MARGIN
    low, high = max(0, count - width), count + width
    k = np.arange(low, high + 1, dtype=np.float64)
    ratios = math.log(count) - np.log(np.maximum(k, 1.0))
    logs = np.cumsum(ratios) - ratios[0]
    logs += count * math.log(count) - count - math.lgamma(count + 1) - logs[count - low]
    limits = np.floor(np.cumsum(np.exp(logs)) * WORD)
    return low, limits[limits < WORD].astype(np.uint32)


@lru_cache(maxsize=512)
def poisson_guide(count: int) -> np.ndarray:
    """Thresholds at or below a word, by the word's top ``GUIDE`` bits; -1 where a threshold lies among words with these bits."""
    limits = poisson_table(count)[1]
    first = np.arange(2**GUIDE, dtype=np.int64) << (32 - GUIDE)
    least = np.searchsorted(limits, first, side="right")
    most = np.searchsorted(limits, first + (1 << (32 - GUIDE)) - 1, side="right")
    return np.where(least == most, least, -1).astype(np.int16 if len(limits) < 2**15 else np.int32)


def poisson(counts: np.ndarray, w0: np.ndarray, w1: np.ndarray, n: int, dtype: type = np.int64) -> np.ndarray:
    """Matrix of ``n`` Poisson draws with mean ``counts[i]`` in row i.

    Most words are settled by their top bits, the others by a search; both give the same numbers.
    """
    drawn = words(w0, w1, n)
    out = np.empty(drawn.shape, dtype)
    for count in np.unique(counts).tolist():
        rows = np.flatnonzero(counts == count)
        low, limits = poisson_table(count)
        at = drawn if len(rows) == len(counts) else drawn[rows]
        got = poisson_guide(count)[at >> np.uint32(32 - GUIDE)]
        unsure = got < 0
        got[unsure] = np.searchsorted(limits, at[unsure], side="right")
        if len(rows) == len(counts):
            np.add(got, dtype(low), out=out, casting="unsafe")
        else:
            out[rows] = got.astype(dtype) + dtype(low)
    return out
