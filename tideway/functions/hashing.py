"""Reproducible pseudo-random columns: the same keys give the same draw on any partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def keyed_hash(seed: int, *cols: Column | str) -> Column:
    """Signed 64-bit hash of the key columns and a seed."""
    return F.xxhash64(F.lit(int(seed)), *[F.col(c) if isinstance(c, str) else c for c in cols])


def keyed_pick(seed: int, *cols: Column | str) -> Column:
    """Non-negative hash, to be reduced modulo a group size."""
    return F.shiftrightunsigned(keyed_hash(seed, *cols), 1)


def keyed_uniform(seed: int, *cols: Column | str) -> Column:
    """Uniform double in [0, 1) from the top 53 bits of the hash."""
    return F.shiftrightunsigned(keyed_hash(seed, *cols), 11).cast("double") * F.lit(2.0**-53)


def portable_uniform(seed: int, *cols: Column | str) -> Column:
    """Uniform double in [0, 1) from an MD5 of the seed and the keys as text: other engines draw the same."""
    text = F.concat_ws("|", F.lit(str(int(seed))), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") * F.lit(2.0**-52)


def uniform_between(low: float, high: float, seed: int, *cols: Column | str, portable: bool = False) -> Column:
    """Uniform double in [low, high)."""
    draw = portable_uniform if portable else keyed_uniform
    return F.lit(float(low)) + draw(seed, *cols) * F.lit(float(high) - float(low))
