"""Log-odds models and the probabilities they give inside a decision."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideway.operators.choices import DECISION
from tideway.operators.joins import join_totals


@dataclass(frozen=True)
class LinearModel:
    """phi = intercept + sum of weight * feature; a column expression."""

    weights: Mapping[str, float]
    intercept: float = 0.0

    def log_odds(self) -> Column:
        out = F.lit(float(self.intercept))
        for name, w in self.weights.items():
            out = out + F.lit(float(w)) * F.col(name)
        return out


@dataclass(frozen=True)
class MlpModel:
    """Dense layers with ReLU in between and one linear output. Dropout is identity here.

    ``layers`` holds (weights[inputs][outputs], biases[outputs]) per layer. Only the feature
    columns and the score pass through Arrow; all other columns stay in the JVM.
    """

    features: Sequence[str]
    layers: Sequence[tuple[Sequence[Sequence[float]], Sequence[float]]]

    def log_odds(self) -> Column:
        layers = [(np.asarray(w, dtype=float), np.asarray(b, dtype=float)) for w, b in self.layers]

        def forward(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for part in parts:
                columns = part if isinstance(part, tuple) else (part,)  # one feature comes bare
                x = np.column_stack([s.to_numpy(dtype=float) for s in columns])
                for i, (w, b) in enumerate(layers):
                    x = x @ w + b
                    if i < len(layers) - 1:
                        x = np.maximum(x, 0.0)
                yield pd.Series(x[:, 0])

        # annotations decide the kind of a pandas UDF, so give them explicitly
        forward.__annotations__ = {
            "parts": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.Series]
        }
        return F.pandas_udf(forward, "double")(*[F.col(f).cast("double") for f in self.features])


def score(df: DataFrame, model: LinearModel | MlpModel, name: str = "log_odds") -> DataFrame:
    return df.withColumn(name, model.log_odds())


def _predict(predict: Callable, features: Sequence[str], name: str, parts: Iterator[pd.DataFrame]):
    for part in parts:
        yield part.assign(**{name: np.asarray(predict(part[list(features)]), dtype=float).reshape(-1)})


def score_with(
    df: DataFrame, predict: Callable[[pd.DataFrame], Sequence[float]], features: Sequence[str],
    name: str = "log_odds",
) -> DataFrame:
    """Score with any picklable model function that maps a feature batch to log-odds."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])
    return df.mapInPandas(partial(_predict, predict, features, name), schema)


def choice_probability(
    df: DataFrame, decision: Sequence[str] = DECISION, log_odds: str = "log_odds", wide: bool = False
) -> DataFrame:
    """Adds odds, sum_odds, probability and log_probability over the alternatives of each decision.

    The probability subtracts the decision's largest log-odds before ``exp``, so it cannot
    overflow; its logarithm is log-odds less their log-sum-exp and stays finite where the
    probability itself is too small for a double. ``odds`` and ``sum_odds`` are the plain values.

    The default is one window per decision, whose size is the number of alternatives. Use
    ``wide`` when a decision may hold any number of rows: totals are then combined on the map
    side and joined back.
    """
    if wide:
        return _wide_probability(df, decision, log_odds)
    w = Window.partitionBy(*decision)
    phi = F.col(log_odds)
    out = df.withColumns({"odds": F.exp(phi), "__peak": F.max(phi).over(w)})
    out = out.withColumn("__e", F.exp(phi - F.col("__peak")))
    return out.withColumns(
        {
            "sum_odds": F.sum("odds").over(w), "probability": F.col("__e") / F.sum("__e").over(w),
            "log_probability": phi - F.col("__peak") - F.log(F.sum("__e").over(w)),
        }
    ).drop("__peak", "__e")


def _wide_probability(df: DataFrame, decision: Sequence[str], log_odds: str) -> DataFrame:
    # Sums of exp(phi - 64 k) per band of 64 log-odds never overflow and merge on the map side.
    band = 64.0
    phi = F.col(log_odds)
    k = F.floor(phi / band).cast("double")
    bands = df.groupBy(*decision, k.alias("__k")).agg(
        F.sum(F.exp(phi - k * band)).alias("__s"), F.sum(F.exp(phi)).alias("__odds")
    )
    w = Window.partitionBy(*decision)  # a handful of bands
    top = bands.withColumn("__top", F.max("__k").over(w))
    totals = top.groupBy(*decision).agg(
        F.max("__top").alias("__top"),
        F.sum(F.col("__s") * F.exp((F.col("__k") - F.col("__top")) * band)).alias("__total"),
        F.sum("__odds").alias("sum_odds"),
    )
    out = join_totals(df.withColumn("odds", F.exp(phi)), totals, decision)
    shifted = phi - F.col("__top") * band
    return out.withColumns(
        {"probability": F.exp(shifted) / F.col("__total"), "log_probability": shifted - F.log("__total")}
    ).drop("__top", "__total")


def renormalise(
    df: DataFrame, keep: Column, decision: Sequence[str] = DECISION, log_odds: str = "log_odds"
) -> DataFrame:
    """Drop alternatives and share their probability among the rest, again from the log-odds."""
    return choice_probability(df.filter(keep), decision, log_odds)


def null_model(
    df: DataFrame, decision: Sequence[str] = DECISION, probability: str = "probability"
) -> DataFrame:
    """Every alternative alike: 1 / number of alternatives."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*decision))
    return df.withColumns({probability: F.lit(1.0) / n, "log_probability": -F.log(n.cast("double"))})


def scored_back(rows: DataFrame, scores: DataFrame, value: str = "probability") -> DataFrame:
    """Attach scores kept apart from their features, by decision and choice."""
    on = ["_decision", "_choice"]
    return rows.join(scores.select(*on, value), on)
