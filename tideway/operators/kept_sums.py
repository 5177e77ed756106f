"""A stored table of mergeable partial sums per key and date, kept up to date a day at a time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What is kept of a value: enough for counts, means, deviations and extremes of any union of rows.
PARTS = ("n", "sum", "squares", "least", "most")


def _kept(value: str) -> dict[str, Column]:
    v = F.col(value).cast("double")
    return {f"{value}_n": F.count(v), f"{value}_sum": F.sum(v), f"{value}_squares": F.sum(v * v), f"{value}_least": F.min(v), f"{value}_most": F.max(v)}


def keep_days(df: DataFrame, path: str, keys: Sequence[str], date: str, values: Sequence[str]) -> None:
    """Write the partial sums of the dates in ``df`` to the table at ``path``, one folder a date.

    A date is written whole: ``df`` holds all its rows, and a date that was kept before is replaced, so an append that is repeated
    changes nothing and a corrected day takes effect. Other dates are neither read nor written. Null keys are keys like any
    other; null values do not count. Rows without a date are left out, as no later day could replace them.
    """
    sums = {n: c for v in values for n, c in _kept(v).items()}
    per = df.filter(F.col(date).isNotNull()).groupBy(*keys, F.col(date).cast("date").alias(date)).agg(*[c.alias(n) for n, c in sums.items()])
    hint = per.hint("rebalance", F.col(date))
    hint.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date).parquet(path)


def kept_sums(spark: SparkSession, path: str, keys: Sequence[str], values: Sequence[str], between: tuple[str, str] | None = None, date: str = "date") -> DataFrame:
    """Partial sums merged over dates (of a range, read by folder) and over all keys but ``keys``."""
    rows = spark.read.parquet(path)
    if between:
        rows = rows.filter(F.col(date).between(*[F.to_date(F.lit(d)) for d in between]))
    how = {"n": F.sum, "sum": F.sum, "squares": F.sum, "least": F.min, "most": F.max}
    return rows.groupBy(*keys).agg(*[how[p](f"{v}_{p}").alias(f"{v}_{p}") for v in values for p in PARTS])


def means_of(merged: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Keys with mean, sample deviation, count and extremes of every value; null where nothing counts."""
    out = [F.col(k) for k in keys]
    for v in values:
        n, total, squares = (F.col(f"{v}_{p}") for p in ("n", "sum", "squares"))
        spread = F.greatest(squares - total * total / F.nullif(n, F.lit(0)), F.lit(0.0)) / F.nullif(n - 1, F.lit(0))
        out += [n.alias(f"{v}_n"), (total / F.nullif(n, F.lit(0))).alias(f"{v}_mean"), F.sqrt(spread).alias(f"{v}_std"),
                F.col(f"{v}_least").alias(f"{v}_min"), F.col(f"{v}_most").alias(f"{v}_max")]
    return merged.select(*out)
