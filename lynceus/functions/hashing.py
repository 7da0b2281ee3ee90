"""Seeded randomness from md5.

``rand(seed)`` depends on how rows are partitioned; a hash of (seed, key) does not, so every
split and draw in this package is reproducible after a repartition, a retry or a resize.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

WORD = 2**32


def hash_word(*parts: Column | str | int, word: int = 0) -> Column:
    """One unsigned 32-bit word of md5(parts joined by ':'), as a long."""
    cols = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *cols)), 1 + 8 * word, 8), 16, 10).cast("long")


def uniform(*parts: Column | str | int, word: int = 0) -> Column:
    """Uniform in (0, 1)."""
    return (hash_word(*parts, word=word) + F.lit(0.5)) / F.lit(float(WORD))


def gaussian(*parts: Column | str | int) -> Column:
    """Standard normal by Box-Muller on two words of one digest."""
    u1, u2 = uniform(*parts, word=0), uniform(*parts, word=1)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2 * math.pi) * u2)
