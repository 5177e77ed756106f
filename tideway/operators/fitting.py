"""Fitting log-odds from choices with Spark: weights of a linear model, or one odds per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideway.operators.scoring import LinearModel
from tideway.session import materialise


def contrast_differences(pairs: DataFrame, features: Sequence[str], weight: str | None = None) -> DataFrame:
    """Selected minus other features, and the mirror image with the opposite label.

    P(selected beats other) = sigmoid(phi_selected - phi_other); the mirror makes it a
    two-class problem without changing its solution. With ``weight`` equal differences are
    one row, counted in a column of that name.
    """
    rows = pairs.select(*[(F.col(f"selected_{f}") - F.col(f"other_{f}")).alias(f) for f in features])
    if weight:
        rows = rows.groupBy(*features).agg(F.count(F.lit(1)).cast("double").alias(weight))
    signs = rows.withColumn("__s", F.explode(F.array(F.lit(1.0), F.lit(-1.0))))
    return signs.select(
        *[(F.col("__s") * F.col(f)).alias(f) for f in features], *([weight] if weight else []),
        (F.col("__s") > 0).cast("double").alias("label"),
    )


def fit_contrast_logit(
    pairs: DataFrame, features: Sequence[str], max_iter: int = 100, reg: float = 0.0
) -> LinearModel:
    """Weights of phi = w . x by logistic regression without intercept on differences.

    Equal differences are counted and enter once: features of few values leave few rows to iterate over, others all.
    """
    rows = materialise(contrast_differences(pairs, features, "__weight"), "contrast-differences")
    vectors = VectorAssembler(inputCols=list(features), outputCol="features").transform(rows)
    trainer = LogisticRegression(
        fitIntercept=False, standardization=False, maxIter=max_iter, regParam=reg, tol=1e-9,
        weightCol="__weight",
    )
    fitted = trainer.fit(vectors.select("features", "label", "__weight"))
    return LinearModel(dict(zip(features, [float(w) for w in fitted.coefficients])))


def choice_patterns(df: DataFrame, key: str, decision: Sequence[str], selected: str = "_selected") -> DataFrame:
    """Decisions that offer the same keys and pick the same one, counted.

    Rounds of ``fit_tabular_odds`` depend on a decision only through this pattern, so they run
    on the distinct patterns instead of on all rows.
    """
    offer = F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), F.col(selected).alias("s"))))
    per = df.groupBy(*decision).agg(offer.alias("offer"))
    return per.groupBy("offer").agg(F.count(F.lit(1)).alias("n"))


def tabular_round(patterns: DataFrame, odds: DataFrame) -> DataFrame:
    """One round: each odds moves by the mean of what it won and lost."""
    rows = patterns.select("offer", "n", F.inline("offer")).join(
        odds, F.col("k") == F.col("__key")
    )
    total = F.sum("odds").over(Window.partitionBy("offer"))
    p = F.col("odds") / total
    gain = F.when(F.col("s"), 1 - p).otherwise(-p)
    moved = rows.select("k", "n", (F.col("odds") * (1 + gain)).alias("u"))
    return moved.groupBy(F.col("k").alias("__key")).agg(
        (F.sum(F.col("u") * F.col("n")) / F.sum("n")).alias("odds")
    )


def fit_tabular_odds(
    df: DataFrame, key: str, rounds: int, decision: Sequence[str] = ("_individual", "_decision"),
    checkpoint_every: int = 5,
) -> DataFrame:
    """Odds per key after ``rounds`` rounds from even odds.

    Between written tables at most ``checkpoint_every`` rounds of plan pile up.
    """
    patterns = materialise(choice_patterns(df, key, decision), "choice-patterns")
    odds = (
        patterns.select(F.explode("offer").alias("o")).select(F.col("o.k").alias("__key")).distinct()
        .withColumn("odds", F.lit(1.0))
    )
    for i in range(1, rounds + 1):
        odds = tabular_round(patterns, odds)
        if i % checkpoint_every == 0 and i < rounds:
            odds = materialise(odds, f"tabular-odds-{i}")
    return odds.withColumnRenamed("__key", key)
