"""Hierarchical cells: an equal-area quadtree whose code of a parent is a shift and whose children are a range.

Longitude and the sine of latitude are halved in turn, so cells of one level have equal areas. A code is a one followed by two
bits a level; the leading one tells levels apart, and codes of a level sort along a Z-curve.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideway.functions.scalar import as_col

DEEPEST = 30
#: Steps that spread 32 bits to every second place of a long: shift and mask.
_SPREAD = [(16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)]


def _spread(x: Column) -> Column:
    for by, mask in _SPREAD:
        x = x.bitwiseOR(F.shiftleft(x, by)).bitwiseAND(F.lit(mask))
    return x


def _gathered(x: Column) -> Column:
    x = x.bitwiseAND(F.lit(_SPREAD[-1][1]))
    for by, mask in [*[(by, mask) for (by, _), (_, mask) in zip(_SPREAD[::-1], _SPREAD[-2::-1])], (16, 0xFFFFFFFF)]:
        x = x.bitwiseOR(F.shiftrightunsigned(x, by)).bitwiseAND(F.lit(mask))
    return x


def quad_cell(lat: Column | str, lon: Column | str, level: int) -> Column:
    """Code of a point at ``level``; longitudes wrap, null and NaN give null."""
    if not 0 <= level <= DEEPEST:
        raise ValueError(f"level must lie in 0..{DEEPEST}")
    la, lo, n = as_col(lat).cast("double"), as_col(lon).cast("double"), 1 << level
    row = F.least(F.floor((F.sin(la * F.lit(0.017453292519943295)) + 1) / 2 * n), F.lit(n - 1)).cast("long")
    col = F.least(F.floor(F.pmod(lo + 180, F.lit(360.0)) / 360 * n), F.lit(n - 1)).cast("long")
    code = F.shiftleft(_spread(row), 1).bitwiseOR(_spread(col)).bitwiseOR(F.lit(1 << (2 * level)))
    return F.when(la.isNotNull() & lo.isNotNull() & ~F.isnan(la) & ~F.isnan(lo), code)


def quad_parent(cell: Column | str, up: int = 1) -> Column:
    """The cell ``up`` levels above; null beyond the top."""
    out = F.shiftrightunsigned(as_col(cell), 2 * up)
    return F.when(out > 0, out)


def quad_children(cell: Column | str, down: int = 1) -> tuple[Column, Column]:
    """(first, last) code of the cells ``down`` levels below."""
    first = F.shiftleft(as_col(cell), 2 * down)
    return first, first + F.lit((1 << (2 * down)) - 1)


def quad_level(cell: Column | str) -> Column:
    return ((F.length(F.bin(as_col(cell))) - 1) / 2).cast("int")


def quad_center(cell: Column | str, level: int) -> tuple[Column, Column]:
    """(latitude, longitude) of the middle of a cell of ``level``."""
    code, n = as_col(cell).bitwiseAND(F.lit((1 << (2 * level)) - 1)), 1 << level
    row, col = _gathered(F.shiftrightunsigned(code, 1)), _gathered(code)
    return F.degrees(F.asin((row + 0.5) * 2 / n - 1)), (col + 0.5) * 360 / n - 180


def rolled_up(df: DataFrame, lat: str, lon: str, value: str, levels: list[int], name: str = "mean") -> DataFrame:
    """(level, cell, n, mean) of ``value`` for every cell of every level, from one scan.

    Points are summed in the cells of the deepest level, before and after one exchange; coarser levels add those sums up. Null
    values and unknown places do not count.
    """
    deepest = max(levels)
    fine = df.select(quad_cell(lat, lon, deepest).alias("cell"), F.col(value).cast("double").alias("v")).filter("cell is not null and v is not null")
    fine = fine.groupBy("cell").agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    steps = F.array(*[F.struct(F.lit(lv).alias("level"), F.shiftrightunsigned("cell", 2 * (deepest - lv)).alias("at")) for lv in sorted(set(levels))])
    up = fine.select(F.explode(steps).alias("to"), "s", "n")
    out = up.groupBy(F.col("to.level").alias("level"), F.col("to.at").alias("cell")).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    return out.select("level", "cell", "n", (F.col("s") / F.col("n")).alias(name))
