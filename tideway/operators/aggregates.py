"""Aggregations. All of them combine on the map side; none gathers a group's rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideway.functions.scalar import floor_to, half_even, right_closed_bin
from tideway.operators.columns import computed
from tideway.operators.joins import join_totals, scalars
from tideway.operators.ranking import ROWS_PER_PART, running_total
from tideway.session import materialise


def bucket_mean(
    df: DataFrame, keys: Sequence[str], epoch: str, seconds: int, cols: Sequence[str]
) -> DataFrame:
    """Means per key and time bucket over rows where all ``cols`` are present."""
    kept = df.filter(" and ".join(f"`{c}` is not null" for c in cols))
    bucket = floor_to(epoch, seconds).alias(epoch)
    return kept.groupBy(*keys, bucket).agg(*[F.avg(c).alias(c) for c in cols])


def bucket_first(
    df: DataFrame, keys: Sequence[str], epoch: str, seconds: int, col: str, tie: Sequence[str] = ()
) -> DataFrame:
    """Earliest reading per key and time bucket, null readings included."""
    kept = df.select(*keys, epoch, col, *tie)
    first = F.min_by(F.struct(F.col(col)), F.struct(epoch, *tie, *([] if tie else [col])))
    out = kept.groupBy(*keys, floor_to(epoch, seconds).alias("__b")).agg(first.alias("__f"))
    return out.select(*keys, F.col("__f")[col].alias(col), F.col("__b").alias(epoch))


def agg_by_name(
    df: DataFrame, groups: Sequence[str], aggs: Sequence[tuple[str, str] | tuple[str, str, str]]
) -> DataFrame:
    """Aggregate by (column, function name[, output name]); without groups over the table."""
    made = []
    for column, function, *name in aggs:
        made.append(getattr(F, function)(column).alias(name[0] if name else f"{function}_{column}"))
    return df.groupBy(*groups).agg(*made) if groups else df.agg(*made)


def first_row(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """One row per key, the smallest by ``order_by``: drop-duplicates with a fixed outcome."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order_by)).alias("__f")
    return df.groupBy(*keys).agg(first).select(*keys, *[F.col("__f")[c].alias(c) for c in rest])


def rate(df: DataFrame, by: Sequence[str | Column], flag: str, name: str = "rate") -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.col(flag).cast("double")).alias(name))


def macro_mean(
    df: DataFrame, unit: Sequence[str], value: Column, name: str, by: Sequence[str] = ()
) -> DataFrame:
    """Mean over units of the mean inside each unit, so long histories do not dominate."""
    inner = df.groupBy(*by, *unit).agg(F.avg(value).alias("__m"))
    return inner.groupBy(*by).agg(F.avg("__m").alias(name))


def duplicates_only(df: DataFrame, keys: Sequence[str], more_than: int = 1) -> DataFrame:
    """Detail rows of the groups that hold more than ``more_than`` rows.

    Counting first and semi-joining keeps hot groups in pieces.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > more_than)
    return join_totals(df, counts.select(*keys), keys, "left_semi")


def bin_mean(
    df: DataFrame, depth: str, edges: Sequence[float], point: Sequence[str], keys: Sequence[str],
    values: Sequence[str], name: str = "depth_bin",
) -> DataFrame:
    """Mean per point and right-closed depth bin, then the mean of those per key.

    The result is a mean of means: every point counts once, however many levels it has.
    """
    binned = df.withColumn(name, right_closed_bin(depth, edges)).filter(F.col(name).isNotNull())
    extra = [k for k in keys if k not in point]
    inner = binned.groupBy(*point, *extra, name).agg(*[F.avg(v).alias(v) for v in values])
    complete = inner.dropna(subset=list(values))
    return complete.groupBy(*keys, name).agg(*[F.avg(v).alias(v) for v in values])


def pivot_mean(df: DataFrame, x: str, y: str, value: str, columns: Sequence) -> DataFrame:
    """Mean per (x, y) laid out as a matrix; the column values are given, so no extra pass."""
    return df.groupBy(x).pivot(y, list(columns)).agg(F.avg(value))


def histogram(df: DataFrame, col: str, bins: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """Counts in equal bins; the last bin is closed on both sides."""
    if low is None or high is None:
        bounds = scalars(df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")))
        lo, hi = bounds["lo"], bounds["hi"]
    else:
        lo, hi = F.lit(float(low)), F.lit(float(high))
    width = (hi - lo) / F.lit(bins)
    inside = df.filter(F.col(col).isNotNull() & F.col(col).between(lo, hi))
    number = F.least(
        F.floor((F.col(col) - lo) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1).cast("long")
    )
    return inside.groupBy(F.coalesce(number, F.lit(0).cast("long")).alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )


def shares(df: DataFrame, by: Sequence[str | Column]) -> DataFrame:
    """Count per category and its share of all rows."""
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("t")).scalar()
    return counts.withColumn("share", F.col("n") / total)


def melt(df: DataFrame, ids: Sequence[str], values: Mapping[str, str], case: str, value: str) -> DataFrame:
    """Stack measures: {column: case label}."""
    renamed = df.select(*ids, *[F.col(c).alias(label) for c, label in values.items()])
    return renamed.unpivot(list(ids), list(values.values()), case, value)


def rounded_counts(df: DataFrame, bins: Mapping[str, Column]) -> DataFrame:
    """Log group size over rounded columns."""
    out = df.groupBy(*[c.alias(n) for n, c in bins.items()]).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("log_n", F.log("n"))


def quantiles(
    df: DataFrame, col: str, probabilities: Mapping[str, float], by: Sequence[str] = (), accuracy: int = 10000,
    extra: Sequence[Column] = (), window_rows: int = ROWS_PER_PART,
) -> DataFrame:
    """Exact quantiles with linear interpolation, one column per name, for groups of any size, in one pass over the ranks.

    ``percentile`` would gather every distinct value of a group in one task. Here a mergeable sketch first brackets each
    rank (its error bound proves the brackets), then values inside a bracket are counted exactly and ranked with running
    totals. Values between brackets collapse to one count each, so nothing large is sorted or moved. A plain window ranks
    them where the longest group has at most ``window_rows`` counts, a range sort that cuts groups beyond that; both are
    exact. ``extra`` aggregates of the same groups ride along. Groups without a value have null quantiles; null keys are groups like any other.
    """
    keys, ps = list(by), list(probabilities.values())
    value = F.col(col).cast("double")
    margin = 2.0 / accuracy
    cuts = [c for p in ps for c in (max(p - margin, 0.0), min(p + margin, 1.0))]
    stats = df.groupBy(*keys).agg(
        F.count(value).alias("__n"), F.min(value).alias("__min"), F.max(value).alias("__max"),
        F.percentile_approx(value, F.array(*[F.lit(c) for c in cuts]), F.lit(accuracy)).alias("__q"), *extra,
    )
    # Small groups are taken whole: a sketch margin of under two ranks proves nothing.
    large = F.col("__n") >= 4 * accuracy
    ends = [
        (F.when(large & F.lit(p > margin), F.col("__q")[2 * i]).otherwise(F.col("__min")),
         F.when(large & F.lit(p + margin < 1), F.col("__q")[2 * i + 1]).otherwise(F.col("__max")))
        for i, p in enumerate(ps)
    ]
    # Sorted starts, and the furthest end of the brackets up to each: a value is inside one if the furthest end before it is not below.
    brackets = F.sort_array(F.array(*[F.struct(lo.alias("lo"), hi.alias("hi")) for lo, hi in ends]))
    stats = stats.withColumn("__brackets", brackets).withColumns({
        "__lo": F.col("__brackets.lo"),
        "__hi": F.transform("__brackets", lambda b, i: F.array_max(F.slice("__brackets.hi", 1, i + 1))),
    })
    stats = materialise(stats.drop("__q", "__min", "__max", "__brackets"), "quantile-brackets")
    side = stats.select(*[F.col(k).alias(f"__on_{k}") for k in keys], "__n", "__lo", "__hi")

    rows = df.filter(value.isNotNull()).select(*keys, value.alias("__v"))
    if keys:
        rows = rows.join(side, [F.col(k).eqNullSafe(F.col(f"__on_{k}")) for k in keys])
    else:
        rows = rows.withColumns(scalars(side))
    # Starts that are not above the value, by bisection: a lambda over the brackets would be interpreted for every row.
    rows = rows.withColumn("__at", F.lit(0))
    step = 1 << (len(ps).bit_length() - 1)
    while step:
        rows = computed(rows.withColumnRenamed("__at", "__was"), {"__at": F.when(
            (F.col("__was") + step <= len(ps)) & (F.get("__lo", F.col("__was") + step - 1) <= F.col("__v")), F.col("__was") + step
        ).otherwise(F.col("__was"))}).drop("__was")
        step >>= 1
    real = (F.col("__at") > 0) & (F.get("__hi", F.col("__at") - 1) >= F.col("__v"))
    above = F.get("__lo", "__at")
    counts = (
        computed(rows, {"__real": real, "__above": above}).withColumns({"__x": F.when(F.col("__real"), F.col("__v")).otherwise(F.col("__above"))})
        .filter("__x is not null")
        .groupBy(*keys, "__n", "__x", "__real").agg(F.count(F.lit(1)).alias("__c"))
    )
    # The counts are stored, so that one pass over the rows serves the size, the ranks and their range bounds.
    counts = materialise(counts, "quantile-counts")
    longest = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if longest <= window_rows:
        along = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__x", "__real").rowsBetween(Window.unboundedPreceding, 0)
        ranked = counts.withColumn("__end", F.sum("__c").over(along))
    else:
        ranked = running_total(counts, keys, ["__x", "__real"], "__c", "__end")

    def at(p: float) -> Column:
        return F.lit(float(p)) * (F.col("__n") - 1)

    def value_at(rank: Column) -> Column:
        hit = F.col("__real") & (F.col("__end") > rank) & (F.col("__end") - F.col("__c") <= rank)
        return F.max(F.when(hit, F.col("__x")))

    picked = ranked.groupBy(*keys).agg(*[
        c for i, p in enumerate(ps)
        for c in (value_at(F.floor(at(p))).alias(f"__a{i}"), value_at(F.ceil(at(p))).alias(f"__b{i}"),
                  F.max(at(p) - F.floor(at(p))).alias(f"__f{i}"))
    ])
    made = {
        name: F.col(f"__a{i}") + (F.col(f"__b{i}") - F.col(f"__a{i}")) * F.col(f"__f{i}") for i, name in enumerate(probabilities)
    }
    picked = picked.select(*[F.col(k).alias(f"__on_{k}") for k in keys], *[c.alias(n) for n, c in made.items()])
    kept = stats.drop("__n", "__lo", "__hi")
    if not keys:
        return kept.withColumns(scalars(picked)) if extra else picked
    return kept.join(picked, [F.col(k).eqNullSafe(F.col(f"__on_{k}")) for k in keys], "left").drop(*[f"__on_{k}" for k in keys])


def quantile(
    df: DataFrame, col: str, p: float, by: Sequence[str] = (), name: str = "quantile", accuracy: int = 10000
) -> DataFrame:
    """One exact quantile; see ``quantiles``."""
    return quantiles(df, col, {name: p}, by, accuracy)


def describe(df: DataFrame, col: str) -> DataFrame:
    """count, mean, std, min, max and quartiles of one column, as one row."""
    base = (
        F.count(col).alias("count"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"),
        F.min(col).alias("min"), F.max(col).alias("max"),
    )
    return quantiles(df, col, {f"q{int(p * 100)}": p for p in (0.25, 0.5, 0.75)}, extra=base)


def response_curve(
    df: DataFrame, col: str, per_unit: float, value: Column, by: Sequence[str] = (), name: str = "value"
) -> DataFrame:
    """Mean of ``value`` by a feature rounded to 1/per_unit (halves to even)."""
    return df.groupBy(*by, half_even(col, per_unit).alias("bin")).agg(F.avg(value).alias(name))
