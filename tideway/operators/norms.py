"""Feature scaling: fit the parameters in one pass, apply and invert them as expressions."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideway.functions.scalar import at_least
from tideway.operators.joins import scalars


@dataclass(frozen=True)
class Norm:
    """value -> shape(value) -> (shape - shift) / scale, with fitted shift and scale."""

    def shape(self, x: Column) -> Column:
        return x

    def unshape(self, y: Column) -> Column:
        return y

    def fit(self, x: Column) -> dict[str, Column]:
        return {}

    def shift(self, p: Mapping[str, Column]) -> Column:
        return F.lit(0.0)

    def scale(self, p: Mapping[str, Column]) -> Column:
        return F.lit(1.0)

    def apply(self, x: Column, p: Mapping[str, Column]) -> Column:
        return (self.shape(x) - self.shift(p)) / F.nullif(self.scale(p), F.lit(0.0))

    def invert(self, y: Column, p: Mapping[str, Column]) -> Column:
        return self.unshape(y * self.scale(p) + self.shift(p))


@dataclass(frozen=True)
class ZScore(Norm):
    def fit(self, x):
        return {"mean": F.avg(x), "std": F.stddev_samp(x)}

    def shift(self, p):
        return p["mean"]

    def scale(self, p):
        return p["std"]


@dataclass(frozen=True)
class MinMax(Norm):
    def fit(self, x):
        return {"min": F.min(self.shape(x)), "max": F.max(self.shape(x))}

    def shift(self, p):
        return p["min"]

    def scale(self, p):
        return p["max"] - p["min"]


@dataclass(frozen=True)
class LogMinMax(MinMax):
    tolerance: float = 0.001

    def shape(self, x):
        return F.log(x + F.lit(self.tolerance))

    def unshape(self, y):
        return F.exp(y) - F.lit(self.tolerance)


@dataclass(frozen=True)
class LogCentre(Norm):
    tolerance: float = 0.001

    def shape(self, x):
        return F.log(x + F.lit(self.tolerance))

    def unshape(self, y):
        return F.exp(y) - F.lit(self.tolerance)

    def fit(self, x):
        return {"mean": F.avg(self.shape(x))}

    def shift(self, p):
        return p["mean"]


@dataclass(frozen=True)
class LogRatio(Norm):
    """ln(x + tolerance) / ln(max + tolerance)."""

    tolerance: float = 0.01

    def shape(self, x):
        return F.log(x + F.lit(self.tolerance))

    def unshape(self, y):
        return F.exp(y) - F.lit(self.tolerance)

    def fit(self, x):
        return {"max": F.max(x)}

    def scale(self, p):
        return F.log(p["max"] + F.lit(self.tolerance))


@dataclass(frozen=True)
class Scale(Norm):
    """Divide by a constant."""

    by: float = 1.0

    def scale(self, p):
        return F.lit(float(self.by))


@dataclass(frozen=True)
class WaterDepth(MinMax):
    """Elevation to water depth max(0, -x), then min-max. Land cannot be inverted."""

    def shape(self, x):
        return at_least(-x, 0.0)

    def unshape(self, y):
        return -y


@dataclass(frozen=True)
class LogWaterDepth(Norm):
    """ln of the water depth, at least e, over its largest value."""

    def shape(self, x):
        return F.log(at_least(-x, math.e))

    def unshape(self, y):
        return -F.exp(y)

    def fit(self, x):
        return {"max": F.max(self.shape(x))}

    def scale(self, p):
        return p["max"]


def fit_norm(df: DataFrame, spec: Mapping[str, Norm]) -> DataFrame:
    """All parameters of all columns in one aggregation: a table of one row.

    Pass the training rows to fit on them alone. The row can be written and read back for
    serving, so constants are never copied by hand.
    """
    made = [
        expression.alias(f"{column}__{stat}")
        for column, norm in spec.items()
        for stat, expression in norm.fit(F.col(column)).items()
    ]
    return df.agg(*made) if made else df.sparkSession.range(1).select()


def _params(params: DataFrame | Mapping[str, Column], column: str) -> dict[str, Column]:
    cols = scalars(params) if isinstance(params, DataFrame) else params
    start = f"{column}__"
    return {k[len(start):]: v for k, v in cols.items() if k.startswith(start)}


def apply_norm(df: DataFrame, spec: Mapping[str, Norm], params: DataFrame, prefix: str = "n_") -> DataFrame:
    cols = scalars(params)
    return df.withColumns(
        {f"{prefix}{c}": norm.apply(F.col(c), _params(cols, c)) for c, norm in spec.items()}
    )


def invert_norm(df: DataFrame, spec: Mapping[str, Norm], params: DataFrame, prefix: str = "n_") -> DataFrame:
    """Overwrite the plain columns with values recovered from the scaled ones."""
    cols = scalars(params)
    return df.withColumns(
        {c: norm.invert(F.col(f"{prefix}{c}"), _params(cols, c)) for c, norm in spec.items()}
    )


def standardise_in_place(df: DataFrame, cols: list[str]) -> DataFrame:
    """Replace columns by z-scores and keep their parameters as ``avg_``/``std_`` columns.

    What ``avg(x) over ()`` asks for, without a window over one partition.
    """
    stats = df.agg(
        *[F.avg(c).alias(f"avg_{c}") for c in cols], *[F.stddev_samp(c).alias(f"std_{c}") for c in cols]
    )
    s = scalars(stats)
    made = {c: (F.col(c) - s[f"avg_{c}"]) / F.nullif(s[f"std_{c}"], F.lit(0.0)) for c in cols}
    return df.withColumns({**made, **s})
