"""Stored sketches: quantiles and distinct counts of any grouping without the rows.

Each group of a table leaves one row of mergeable states: KLL for quantiles, HLL for distinct values. Coarser groupings merge
states, so a question reads rows per group, and new parts of a table add rows of their own. Errors are bounded in
probability: the rank of a quantile is off by about 2.3 / k^0.9, a distinct count by about 1.04 / sqrt(2^bits) relative to it.
The exact operators (``aggregates.quantile``, ``count_distinct``) stay the default.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS = "rows"


def sketch_table(
    df: DataFrame, by: Sequence[str | Column], ranked: Sequence[str] = (), distinct: Sequence[str] = (), k: int = 400, bits: int = 14
) -> DataFrame:
    """One row per group of ``by``: its number of rows, ``<col>_kll`` for ``ranked`` and ``<col>_hll`` for ``distinct`` columns.

    Null and NaN values are in no sketch; a column without others has a null state. Null group keys are a group.
    """
    def value(c: str) -> Column:
        x = F.col(c).cast("double")
        return F.when(~F.isnan(x), x)

    # A distinct value is told by its text, so that integers of different widths meet.
    states = [F.count(F.lit(1)).alias(ROWS)]
    states += [F.when(F.count(value(c)) > 0, F.kll_sketch_agg_double(value(c), F.lit(k))).alias(f"{c}_kll") for c in ranked]
    states += [F.when(F.count(c) > 0, F.hll_sketch_agg(F.col(c).cast("string"), F.lit(bits))).alias(f"{c}_hll") for c in distinct]
    return df.groupBy(*by).agg(*states)


def merge_sketches(stored: DataFrame, by: Sequence[str | Column] = ()) -> DataFrame:
    """States of coarser groups, in the same columns; merging in any order or in steps keeps the error bounds."""
    states = [F.sum(ROWS).alias(ROWS)]
    for c in stored.columns:
        if c.endswith("_kll"):
            states.append(F.when(F.count(c) > 0, F.kll_merge_agg_double(c)).alias(c))
        elif c.endswith("_hll"):
            states.append(F.when(F.count(c) > 0, F.hll_union_agg(c)).alias(c))
    return stored.groupBy(*by).agg(*states)


def read_sketches(states: DataFrame, quantiles: Mapping[str, tuple[str, float]] = {}, counts: Mapping[str, str] = {}) -> DataFrame:
    """``quantiles`` maps an output to (column, share), ``counts`` an output to its column; states are replaced by these."""
    made = {n: F.kll_sketch_get_quantile_double(f"{c}_kll", F.lit(float(q))) for n, (c, q) in quantiles.items()}
    made |= {n: F.hll_sketch_estimate(f"{c}_hll") for n, c in counts.items()}
    kept = [c for c in states.columns if not c.endswith(("_kll", "_hll"))]
    return states.select(*kept, *[v.alias(n) for n, v in made.items()])
