"""Conditional logit: weights of a linear model from whole decisions, by Newton steps."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideway.operators.columns import computed
from tideway.operators.scoring import LinearModel
from tideway.session import materialise


@dataclass
class ChoiceFit:
    """Result of a fit: the model, the last gradient by feature, the log likelihood, decisions and steps."""

    model: LinearModel
    gradient: dict[str, float]
    log_likelihood: float
    decisions: int
    steps: int


def offers(df: DataFrame, decision: Sequence[str], features: Sequence[str], selected: str = "_selected") -> DataFrame:
    """One row per decision: the chosen alternative's features and every feature as an array over its alternatives.

    Alternatives with a null or NaN feature or an unknown selection are left out, then decisions that do not choose exactly one of
    what is left. A decision holds as many alternatives as its class list or its cells in reach, whatever the table holds.
    """
    usable = F.col(selected).isNotNull()
    for f in features:
        usable = usable & F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double"))
    row = F.struct(*[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)])
    chosen = F.when(F.col(selected), row)
    per = df.filter(usable).groupBy(*decision).agg(
        F.collect_list(row).alias("all"), F.first(chosen, ignorenulls=True).alias("chosen"), F.count(chosen).alias("n")
    )
    return per.filter("n = 1").select(
        *[F.col(f"chosen.f{i}").alias(f"s{i}") for i in range(len(features))], *[F.col(f"all.f{i}").alias(f"x{i}") for i in range(len(features))]
    )


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, v: t + v)


def _scaled(a: Column, by: float) -> Column:
    return F.transform(a, lambda x: x * F.lit(by))


def logit_moments(offered: DataFrame, weights: Sequence[float]) -> DataFrame:
    """One row: decisions n, log likelihood ll, gradient g0.. and information h0_0.. at ``weights``.

    A decision's softmax is taken inside its row; the sums merge on the map side, so a step moves one row per task.
    """
    k = len(weights)
    shifted = [_scaled(F.col(f"x{i}"), float(w)) for i, w in enumerate(weights)]
    # Held columns: without them every use would repeat the whole softmax, beyond what one generated method can hold.
    d = computed(offered, {"u": reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), shifted)})
    d = computed(d, {"top": F.array_max("u")})
    d = computed(d, {"e": F.transform("u", lambda v: F.exp(v - F.col("top")))})
    d = computed(d, {"z": F.aggregate("e", F.lit(0.0), lambda t, v: t + v)})
    d = computed(d, {f"m{i}": _dot(F.col("e"), F.col(f"x{i}")) / F.col("z") for i in range(k)})
    chosen = reduce(lambda a, b: a + b, [F.col(f"s{i}") * F.lit(float(w)) for i, w in enumerate(weights)])
    sums = {"n": F.count(F.lit(1)), "ll": F.sum(chosen - F.col("top") - F.log("z"))}
    sums |= {f"g{i}": F.sum(F.col(f"s{i}") - F.col(f"m{i}")) for i in range(k)}
    for i in range(k):
        for j in range(i, k):
            both = F.zip_with(f"x{i}", f"x{j}", lambda x, y: x * y)
            sums[f"h{i}_{j}"] = F.sum(_dot(F.col("e"), both) / F.col("z") - F.col(f"m{i}") * F.col(f"m{j}"))
    return d.agg(*[c.alias(n) for n, c in sums.items()])


def fit_choice_logit(
    df: DataFrame, decision: Sequence[str], features: Sequence[str], selected: str = "_selected", max_steps: int = 25,
    tol: float = 1e-9, ridge: float = 0.0,
) -> ChoiceFit:
    """Weights that maximise the likelihood of the choices, each decision a softmax over its alternatives.

    Decisions are put together and written once; a step reads that table and sends one row of sums a task. A step that lowers the
    likelihood is halved. ``ridge`` is a penalty on squared weights; without it, directions that no decision tells apart stay at
    zero. Without usable decisions the weights are zero.
    """
    k = len(features)
    offered = materialise(offers(df, decision, features, selected), "offers")

    def at(w: np.ndarray):
        r = logit_moments(offered, w).first()
        if not r.n:
            return 0, 0.0, np.zeros(k), np.zeros((k, k))
        h = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        return r.n, r.ll - ridge * float(w @ w) / 2, np.array([r[f"g{i}"] for i in range(k)]) - ridge * w, h + ridge * np.eye(k)

    w = np.zeros(k)
    n, ll, g, h = at(w)
    steps = 0
    while n and steps < max_steps and np.abs(g).max() > tol * max(1, n):
        move, steps = np.linalg.lstsq(h, g, rcond=1e-12)[0], steps + 1
        while True:
            _, new_ll, new_g, new_h = at(w + move)
            if new_ll >= ll - 1e-12 * abs(ll) or np.abs(move).max() < 1e-12:
                break
            move = move / 2
        w, ll, g, h = w + move, new_ll, new_g, new_h
    named = dict(zip(features, map(float, w)))
    return ChoiceFit(LinearModel(named), dict(zip(features, map(float, g))), float(ll), int(n), steps)
