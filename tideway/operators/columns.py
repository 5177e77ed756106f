"""Projections and filters driven by data: maps, structs, tables of codes."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def constants(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def add_column(df: DataFrame, fn: Callable[..., Column], inputs: Sequence[str], name: str) -> DataFrame:
    """One new column from a column function."""
    return df.withColumn(name, fn(*[F.col(c) for c in inputs]))


def add_columns(
    df: DataFrame, fn: Callable[..., Sequence[Column]], inputs: Sequence[str], fields: Sequence[str]
) -> DataFrame:
    """Several new columns from one function that returns as many expressions."""
    made = fn(*[F.col(c) for c in inputs])
    if len(made) != len(fields):
        raise ValueError(f"function gave {len(made)} columns for {len(fields)} names")
    return df.withColumns(dict(zip(fields, made)))


def computed(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add columns that are evaluated once and never folded into what uses them.

    When a filter or projection reads a column several times, Catalyst may push copies of its
    expression into each place; for long arithmetic that multiplies the work at every step.
    Output of a generator cannot be folded, and a one-row ``inline`` stays inside
    whole-stage code generation.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def require(df: DataFrame, *cols: str) -> DataFrame:
    """Keep rows where every named column is present, and a number where it is floating."""
    kinds = dict(df.dtypes)
    for c in cols:
        df = df.filter(F.col(c).isNotNull())
        if kinds[c] in ("double", "float"):
            df = df.filter(~F.isnan(c))
    return df


def in_box(
    df: DataFrame, lat: str, lon: str, lat_range: tuple[float, float], lon_range: tuple[float, float]
) -> DataFrame:
    """Open box: strictly inside both ranges."""
    return df.filter(
        (F.col(lat) > lat_range[0]) & (F.col(lat) < lat_range[1])
        & (F.col(lon) > lon_range[0]) & (F.col(lon) < lon_range[1])
    )


def replace_where(df: DataFrame, name: str, condition: Column, value) -> DataFrame:
    """Overwrite one column where the condition holds; a null condition keeps the value."""
    new = value if isinstance(value, Column) else F.lit(value)
    return df.withColumn(name, F.when(condition, new).otherwise(F.col(name)))


def impute_mean(df: DataFrame, name: str, known: Column) -> DataFrame:
    """Overwrite the rows that are not ``known`` with the mean over those that are.

    The mean is one scalar subquery: one extra pass that ships a single number.
    """
    mean = df.filter(known).agg(F.avg(name).alias("m")).scalar()
    return replace_where(df, name, ~F.coalesce(known, F.lit(False)), mean)


def role_tag(
    df: DataFrame, cell: str, current: str, selected: str, name: str = "role",
    labels: Sequence[str] = ("current", "selected", "other"),
) -> DataFrame:
    """Tag each alternative: where the individual is, where it goes next, or neither."""
    tag = (
        F.when(F.col(cell) == F.col(current), labels[0])
        .when(F.col(cell) == F.col(selected), labels[1])
        .otherwise(labels[2])
    )
    return df.withColumn(name, tag)


def invert_groups(groups: Mapping[str, Sequence]) -> dict:
    """{group: members} -> {member: group}."""
    return {member: group for group, members in groups.items() for member in members}


def label_by_groups(df: DataFrame, key: str, groups: Mapping[str, Sequence], name: str) -> DataFrame:
    """Attach the group that lists ``key``; null when no group does.

    The literal table is as large as the Python mapping it came from, so it is broadcast.
    """
    inverted = invert_groups(groups)
    kind = dict(df.dtypes)[key]
    table = df.sparkSession.createDataFrame(
        list(inverted.items()), f"{key} {kind}, {name} string"
    )
    return df.join(F.broadcast(table), key, "left")


def keep_selected_known(df: DataFrame, selected: str = "_selected") -> DataFrame:
    """Drop rows whose selection is unknown (the last fix of a track has no next one)."""
    return df.filter(F.col(selected).isNotNull())


def affine_inverse(df: DataFrame, cols: Sequence[str], mean: str = "avg_", std: str = "std_") -> DataFrame:
    """x * std_x + avg_x for columns that carry their own parameters."""
    return df.withColumns({c: F.col(c) * F.col(f"{std}{c}") + F.col(f"{mean}{c}") for c in cols})
