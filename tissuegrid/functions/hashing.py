"""Repeatable pseudo-random numbers: pure functions of keys and a seed."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCALE = float(2**52)


def _key(seed, cols) -> Column:
    parts = [F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]
    return F.concat_ws("|", *parts, F.lit(str(seed)))


def md5_key(seed, *cols) -> Column:
    """Hex digest that serves as a random sort key."""
    return F.md5(_key(seed, cols))


def uniform01(seed, *cols) -> Column:
    """Uniform in [0, 1) from the first 52 bits of an md5 digest."""
    return F.conv(F.substring(md5_key(seed, *cols), 1, 13), 16, 10).cast("bigint") / F.lit(_SCALE)


def _fast01(*cols) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11) + F.lit(0.5)) / F.lit(float(2**53))


def normal01(seed, *cols) -> Column:
    """Standard normal by the Box-Muller transform of two md5 uniforms."""
    u1 = 1 - uniform01(f"{seed}a", *cols)
    u2 = uniform01(f"{seed}b", *cols)
    return F.sqrt(-2 * F.log(u1)) * F.cos(F.lit(2 * math.pi) * u2)


def fast_normal01(seed: int, *cols: Column) -> Column:
    """Standard normal from 64-bit hashes; cheap enough for every vector element."""
    u1 = _fast01(*cols, F.lit(2 * seed))
    u2 = _fast01(*cols, F.lit(2 * seed + 1))
    return F.sqrt(-2 * F.log(u1)) * F.cos(F.lit(2 * math.pi) * u2)


def laplace01(seed, *cols) -> Column:
    """Standard Laplace by inverse distribution function."""
    u = uniform01(seed, *cols) - 0.5
    return -F.signum(u) * F.log(F.greatest(1 - 2 * F.abs(u), F.lit(1e-300)))
