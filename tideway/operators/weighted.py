"""Weighted draws with replacement from groups of any size: alias tables, two hashes a draw and level."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideway.functions.hashing import keyed_pick, portable_uniform
from tideway.session import materialise

#: Rows of a group that share one alias table, on average; larger groups get a table of tables.
SLICE = 4096


def alias_table(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(share of its own place that each row keeps, row that has the rest): every place has the mean weight."""
    n = len(weights)
    scaled = weights * (n / weights.sum())
    keep, other = np.ones(n), np.arange(n)
    small, large = [int(i) for i in np.flatnonzero(scaled < 1)], [int(i) for i in np.flatnonzero(scaled >= 1)]
    while small and large:
        s, b = small.pop(), large[-1]
        keep[s], other[s] = scaled[s], b
        scaled[b] -= 1 - scaled[s]
        if scaled[b] < 1:
            small.append(large.pop())
    return keep, other


def alias_levels(df: DataFrame, group: str, key: str, weight: str, slice_rows: int = SLICE) -> list[DataFrame]:
    """Alias tables, the level of the rows first: (group, slice, place, size, total, keep, item, other).

    A group is dealt by hash of its keys to slices of about ``slice_rows``; each slice gets its own table in one task, and the
    weights of slices are rows of the level above, until every group has one slice. Null, NaN, infinite and non-positive weights
    are never drawn. Null keys and null groups are keys and groups like any other.
    """
    w = F.col(weight).cast("double")
    fit = w.isNotNull() & ~F.isnan(w) & (w > 0) & (w < F.lit(float("inf")))
    rows = df.filter(fit).select(F.col(group).alias("group"), F.col(key).alias("item"), w.alias("weight"))
    levels = []
    while True:
        sizes = materialise(rows.groupBy("group").agg(F.ceil(F.count("*") / slice_rows).cast("long").alias("slices")), "slices")
        most = sizes.agg(F.max("slices")).first()[0] or 1
        dealt = rows.join(sizes.withColumnRenamed("group", "of"), F.col("group").eqNullSafe(F.col("of"))).drop("of")
        dealt = dealt.withColumn("slice", F.pmod(F.xxhash64(F.lit(len(levels)), "item"), F.col("slices"))).select("group", "slice", "item", "weight")
        kind = {f.name: f for f in dealt.schema.fields}
        schema = T.StructType([kind["group"], kind["slice"], T.StructField("place", T.LongType()), T.StructField("size", T.LongType()),
                               T.StructField("total", T.DoubleType()), T.StructField("keep", T.DoubleType()), kind["item"],
                               T.StructField("other", kind["item"].dataType)])

        def build(table: pa.Table) -> pa.Table:
            table = table.sort_by([("item", "ascending"), ("weight", "ascending")])
            weights, n = table.column("weight").to_numpy(), table.num_rows
            keep, other = alias_table(weights)
            cols = [table.column("group"), table.column("slice"), pa.array(np.arange(n)), pa.array(np.full(n, n)),
                    pa.array(np.full(n, weights.sum())), pa.array(keep), table.column("item"), table.column("item").take(pa.array(other))]
            return pa.table(cols, names=["group", "slice", "place", "size", "total", "keep", "item", "other"])

        level = materialise(dealt.groupBy("group", "slice").applyInArrow(build, schema), f"alias-{len(levels)}")
        levels.append(level)
        if most == 1:
            return levels
        rows = level.filter("place = 0").select("group", F.col("slice").alias("item"), F.col("total").alias("weight"))


def weighted_draws(
    df: DataFrame, group: str, key: str, weight: str, draws: int, seed: int = 0, slice_rows: int = SLICE,
) -> DataFrame:
    """(group, _draw, key): ``draws`` keys of each group, drawn with chances in proportion to their weights.

    A draw hashes its group and number, so neither partitions nor retries change it; a level costs two hashes and one equi-join.
    Repeated keys add their weights. Groups without a positive weight give no rows; an empty table gives none.
    """
    levels = alias_levels(df, group, key, weight, slice_rows)
    top = levels[-1].filter("place = 0").select("group", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("_draw"))
    at = top.withColumn("slice", F.lit(0).cast("long"))
    for n, level in reversed(list(enumerate(levels))):
        sizes = level.filter("place = 0").select(F.col("group").alias("of"), F.col("slice").alias("in"), "size")
        at = at.join(sizes, F.col("group").eqNullSafe(F.col("of")) & (F.col("slice") == F.col("in"))).drop("of", "in")
        at = at.withColumn("at", F.pmod(keyed_pick(seed, F.lit(f"place {n}"), F.col("group").cast("string"), F.col("_draw")), F.col("size"))).drop("size")
        table = level.select(F.col("group").alias("of"), F.col("slice").alias("in"), "place", "keep", "item", "other")
        at = at.join(table, F.col("group").eqNullSafe(F.col("of")) & (F.col("slice") == F.col("in")) & (F.col("at") == F.col("place")))
        stay = portable_uniform(seed, F.lit(f"keep {n}"), F.col("group"), F.col("_draw")) < F.col("keep")
        at = at.select("group", "_draw", F.when(stay, F.col("item")).otherwise(F.col("other")).alias("slice"))
    return at.select(F.col("group").alias(group), "_draw", F.col("slice").alias(key))
