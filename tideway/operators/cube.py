"""Feature grids: generated from a range of ids, so that any size is built in parallel."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideway.functions.calendar import DAY, sun_phase
from tideway.functions.scalar import epoch_date, epoch_second_of_day, within_tolerance
from tideway.operators.aggregates import pivot_mean, quantiles
from tideway.operators.joins import scalars
from tideway.operators.seasons import circle_columns, date_phases, sun_times
from tideway.session import materialise


def hypercube(
    spark: SparkSession, grids: Mapping[str, tuple[int, object]], classes: Sequence[float],
    class_name: str = "depth_class",
) -> DataFrame:
    """Every combination of the grids, times every class.

    ``grids`` maps a column to (size, function of the 0-based index column). The decision id is
    a mixed-radix number, first grid slowest, and each coordinate is decoded from it: no cross
    join, and no single task that emits all rows.
    """
    total = 1
    for size, _ in grids.values():
        total *= size
    n = len(classes)
    rows = spark.range(total * n).select(
        F.col("id").alias("_choice"), F.floor(F.col("id") / n).alias("_decision")
    )
    stride = total
    made: dict[str, Column] = {}
    for name, (size, fn) in grids.items():
        stride //= size
        made[name] = fn(F.pmod(F.floor(F.col("_decision") / stride), F.lit(size)))
    at = F.pmod(F.col("_choice"), F.lit(n)) + 1
    made[class_name] = F.element_at(F.array(*[F.lit(float(c)) for c in classes]), at.cast("int"))
    constants = {"_individual": F.lit(0), "_train": F.lit(False), "_selected": F.lit(False)}
    return rows.withColumns({**made, **constants})


def linear_grid(start: float, step: float):
    """Values start, start + step, ..."""
    return lambda i: F.lit(float(start)) + i * F.lit(float(step))


def power_grid(base: float, start: float, step: float):
    return lambda i: F.pow(F.lit(float(base)), F.lit(float(start)) + i * F.lit(float(step)))


def quantile_grid(df: DataFrame, sizes: Mapping[str, int]) -> DataFrame:
    """One row with an array per feature: ``size`` exact quantiles, evenly spaced from the least value to the greatest.

    The features are stacked, so that one pass ranks them all. Null and NaN are no values; a feature without values has an
    array of nulls. Quantiles that coincide, as those of a feature with few values, are kept, so arrays have their size.
    """
    if any(size < 2 for size in sizes.values()):
        raise ValueError("a grid of quantiles has two ends")
    steps = {f"q{i}_{size}": i / (size - 1) for size in sorted(set(sizes.values())) for i in range(size)}
    numbers = [F.col(c).cast("double").alias(c) for c in sizes]
    stacked = df.select(*numbers).unpivot([], list(sizes), "__feature", "__x").filter("not isnan(__x)")
    found = quantiles(stacked, "__x", steps, ["__feature"])
    arrays = {
        c: F.coalesce(
            F.max(F.when(F.col("__feature") == c, F.array(*[F.col(f"q{i}_{size}") for i in range(size)]))),
            F.array_repeat(F.lit(None).cast("double"), size),
        )
        for c, size in sizes.items()
    }
    return materialise(found.agg(*[a.alias(c) for c, a in arrays.items()]), "grid")


def grid_values(grid: DataFrame, sizes: Mapping[str, int]) -> dict[str, tuple[int, object]]:
    """The arrays of ``quantile_grid`` as grids for ``hypercube``."""
    row = scalars(grid)
    return {c: (size, lambda i, c=c: F.element_at(row[c], (i + 1).cast("int"))) for c, size in sizes.items()}


def feature_sweeps(df: DataFrame, grid: DataFrame, sizes: Mapping[str, int], feature: str = "_feature", step: str = "_step") -> DataFrame:
    """Every row once per feature and grid value, that feature set to the value and the others left as they are.

    Scored, these are the response curves of single rows, and their mean is the partial dependence. ``feature`` and ``step``
    name the swept feature and the place of its value in the grid. No exchange: each row expands where it is.
    """

    def points_of(c: str) -> Column:
        return F.transform(c, lambda x, i: F.struct(F.lit(c).alias("f"), i.alias("i"), x.alias("x")))

    points = F.flatten(F.array(*[points_of(c) for c in sizes]))
    out = df.withColumn("__point", F.explode(grid.select(points).scalar()))
    swept = {c: F.when(F.col("__point.f") == c, F.col("__point.x")).otherwise(F.col(c).cast("double")) for c in sizes}
    return out.withColumns({**swept, feature: F.col("__point.f"), step: F.col("__point.i")}).drop("__point")


def sweep_means(df: DataFrame, grid: DataFrame, sizes: Mapping[str, int], by: Sequence[str], n: str = "n") -> DataFrame:
    """Rows and mean of every feature by ``by``, swept feature and step: ``feature_sweeps`` and its mean per group.

    A sweep sets one feature for all rows of a group alike and leaves the others, so the means of a group are swept in place of
    its rows. What is not linear in the features, as a score, needs the rows of ``feature_sweeps``.
    """
    groups = df.groupBy(*by).agg(F.count(F.lit(1)).alias(n), *[F.avg(F.col(c).cast("double")).alias(c) for c in sizes])
    return feature_sweeps(materialise(groups, "sweep-groups"), grid, sizes)


def hypercube_slice(
    df: DataFrame, x: str, y: str, fixed: Mapping[str, float], value: str = "odds",
    tolerance: float = 0.001,
) -> DataFrame:
    """Mean value by (x, y) where the other features sit at their fixed values."""
    return df.filter(within_tolerance(fixed, tolerance)).groupBy(x, y).agg(F.avg(value).alias(value))


def hypercube_pivot(
    df: DataFrame, x: str, y: str, fixed: Mapping[str, float], columns: Sequence, value: str = "odds",
    tolerance: float = 0.001,
) -> DataFrame:
    """``hypercube_slice`` as a matrix: one row per ``x``, one column per given value of ``y``."""
    return pivot_mean(df.filter(within_tolerance(fixed, tolerance)), x, y, value, columns)


def daily_spine(
    df: DataFrame, start_epoch: int, end_epoch: int, spread: Sequence[str] = (), name: str = "__day"
) -> DataFrame:
    """One row per input row and day from start to end.

    ``spread`` names the columns that, with the day, spread the result over the cluster: a
    short input table would otherwise expand inside the one task that holds it.
    """
    days = F.sequence(F.lit(start_epoch).cast("long"), F.lit(end_epoch).cast("long"), F.lit(DAY).cast("long"))
    out = df.withColumn(name, F.explode(days))
    return out.repartition(*spread, name) if spread else out


def day_steps(
    df: DataFrame, start_epoch: int, end_epoch: int, step: int = 3600, name: str = "epoch",
    closed: bool = True, day: str = "__day",
) -> DataFrame:
    """Expand days into steps; the end point is included when ``closed``."""
    if DAY % step:
        raise ValueError("step must divide a day")
    inner = F.sequence(F.col(day), F.col(day) + F.lit(DAY - step).cast("long"), F.lit(step).cast("long"))
    out = df.withColumn(name, F.explode(inner)).drop(day)
    end = F.lit(end_epoch)
    return out.filter(F.col(name) <= end if closed else F.col(name) < end)


def hourly_spine(
    df: DataFrame, start_epoch: int, end_epoch: int, step: int = 3600, name: str = "epoch",
    closed: bool = True, spread: Sequence[str] = (),
) -> DataFrame:
    """One row per input row and step from start to end."""
    days = daily_spine(df, start_epoch, end_epoch, spread)
    return day_steps(days, start_epoch, end_epoch, step, name, closed)


def state_space(
    cells: DataFrame, start_epoch: int, end_epoch: int, lat: str = "lat", lon: str = "lon",
    cell: str = "cell", step: int = 3600, closed: bool = True,
) -> DataFrame:
    """Cells by steps with sun, moon and orbit phases.

    What depends on the day alone is computed before the day is cut into steps, and what depends on the date alone on
    the days between start and end, so the spine is built once.
    """
    spark = cells.sparkSession
    dates = spark.range(start_epoch, end_epoch + 1, DAY).select(epoch_date("id").alias("date"))
    dates = materialise(date_phases(dates, "date"), "dates")
    days = daily_spine(cells, start_epoch, end_epoch, [cell])
    days = days.withColumn("date", epoch_date("__day"))
    days = sun_times(days, lat, lon, "date", "__rise", "__set").join(dates, "date")
    out = day_steps(days, start_epoch, end_epoch, step, closed=closed)
    phase = sun_phase(epoch_second_of_day("epoch"), "__rise", "__set")
    return circle_columns(out.withColumn("sun_radians", phase), "sun", "moon", "orbit").drop("__rise", "__set")
