"""Small scalar expressions shared by the operators."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def at_least(x: Column | str, bound: float) -> Column:
    """max(x, bound) that keeps nulls; ``greatest`` would skip them."""
    v = as_col(x)
    return F.when(v < F.lit(bound), F.lit(bound)).otherwise(v)


def at_most(x: Column | str, bound: float) -> Column:
    """min(x, bound) that keeps nulls."""
    v = as_col(x)
    return F.when(v > F.lit(bound), F.lit(bound)).otherwise(v)


def floor_to(epoch: Column | str, seconds: int) -> Column:
    """Floor an epoch to a multiple of ``seconds``; also right before 1970."""
    e = as_col(epoch)
    return e - F.pmod(e, F.lit(int(seconds)))


def epoch_timestamp(epoch: Column | str) -> Column:
    """Epoch seconds to a zone-free timestamp. The session runs in UTC."""
    return F.timestamp_seconds(as_col(epoch)).cast("timestamp_ntz")


def epoch_date(epoch: Column | str) -> Column:
    """UTC calendar day of an epoch, by integer arithmetic alone."""
    days = F.floor(as_col(epoch) / F.lit(86400)).cast("int")
    return F.date_add(F.lit("1970-01-01").cast("date"), days)


def epoch_second_of_day(epoch: Column | str) -> Column:
    return F.pmod(as_col(epoch), F.lit(86400))


def iso_date(day: Column | str) -> Column:
    return F.date_format(as_col(day), "yyyy-MM-dd")


def common_year(day: Column | str, year: int = 2020) -> Column:
    """Move a date to one common (leap) year, so that seasons overlay."""
    d = as_col(day)
    return F.make_date(F.lit(year), F.month(d), F.dayofmonth(d))


def half_even(x: Column | str, per_unit: int | float = 1) -> Column:
    """Round to the nearest 1/per_unit; halves go to the even neighbour."""
    k = F.lit(float(per_unit))
    return F.bround(as_col(x) * k) / k


def half_even_step(x: Column | str, step: float) -> Column:
    """Round to the nearest multiple of ``step`` (for example an angle), halves to even."""
    s = F.lit(float(step))
    return F.bround(as_col(x) / s) * s


def floor_bin(x: Column | str, width: float = 10) -> Column:
    w = F.lit(float(width))
    return F.floor(as_col(x) / w) * w


def wrap_angle(x: Column | str) -> Column:
    return F.pmod(as_col(x), F.lit(2 * math.pi))


def prefix_class(x: Column | str, prefixes: Sequence[str], missing: int = -1) -> Column:
    """Index of the first prefix that ``x`` starts with, else ``missing``."""
    out = F.lit(missing)
    for i in range(len(prefixes) - 1, -1, -1):
        out = F.when(as_col(x).startswith(prefixes[i]), F.lit(i)).otherwise(out)
    return out


def code_table(x: Column | str, codes: Mapping, default) -> Column:
    """Look a value up in a short literal table."""
    out = F.lit(default)
    for key, value in reversed(list(codes.items())):
        out = F.when(as_col(x) == F.lit(key), F.lit(value)).otherwise(out)
    return out


def negative_part(x: Column | str, scale: float = 1.0) -> Column:
    """max(0, -x) / scale: an elevation turned into a water depth."""
    return at_least(-as_col(x), 0.0) / F.lit(float(scale))


def right_closed_bin(x: Column | str, edges: Sequence[float]) -> Column:
    """Upper edge of the bin (lo, hi] holding ``x``; null outside (edges[0], edges[-1]]."""
    v = as_col(x)
    out = F.lit(None).cast("double")
    for hi in reversed(edges[1:]):
        out = F.when(v <= F.lit(float(hi)), F.lit(float(hi))).otherwise(out)
    return F.when(v > F.lit(float(edges[0])), out)


def edge_class(x: Column | str, classes: Sequence[float]) -> Column:
    """First class value >= x; values above the last class take the last class, null and NaN none."""
    v = as_col(x)
    out = F.lit(float(classes[-1]))
    for c in reversed(classes[:-1]):
        out = F.when(v <= F.lit(float(c)), F.lit(float(c))).otherwise(out)
    return F.when(v.isNotNull() & ~F.isnan(v.cast("double")), out)


def within_tolerance(pairs: Mapping[str, float], tolerance: float = 0.001) -> Column:
    """All named columns lie within ``tolerance`` of their given value."""
    out = F.lit(True)
    for name, value in pairs.items():
        v = F.lit(float(value))
        out = out & F.col(name).between(v - F.lit(tolerance), v + F.lit(tolerance))
    return out
