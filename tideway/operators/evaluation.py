"""Likelihood scores, model comparison, calibration and run tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideway.functions import grid
from tideway.operators.aggregates import macro_mean, response_curve
from tideway.operators.joins import join_totals, paired


def log_chance(df: DataFrame, probability: str = "probability") -> Column:
    """Log probability: the scored column where there is one, else the logarithm, minus infinity for zero.

    Spark's logarithm of zero is null, which a mean would skip: the worst misses would leave the score.
    """
    if probability == "probability" and "log_probability" in df.columns:
        return F.col("log_probability")
    return F.when(F.col(probability) == 0, F.lit(float("-inf"))).otherwise(F.log(probability))


def selected_only(df: DataFrame, selected: str = "_selected") -> DataFrame:
    return df.filter(F.col(selected))


def nlp(
    df: DataFrame, level: str = "decision", by: Sequence[str] = (), individual: str = "_individual",
    selected: str = "_selected", probability: str = "probability",
) -> DataFrame:
    """Mean log probability of what was chosen.

    ``level="contrast"`` averages all selected rows alike; ``"decision"`` averages inside each
    individual first. Both come with the geometric mean probability and, over plain rows, the
    expected rate of right guesses.
    """
    rows = selected_only(df, selected)
    p, log_p = F.col(probability), log_chance(df, probability)
    plain = rows.groupBy(*by).agg(
        F.avg(log_p).alias("nlp"), F.avg(p).alias("correct_rate"), F.count(F.lit(1)).alias("n")
    )
    if level == "contrast":
        return plain.withColumn("geometric_p", F.exp("nlp"))
    if level != "decision":
        raise ValueError("level is 'contrast' or 'decision'")
    per = rows.groupBy(*by, individual).agg(
        F.avg(log_p).alias("__l"), F.sum(p).alias("__p"), F.count(F.lit(1)).alias("__n")
    )
    out = per.groupBy(*by).agg(
        F.avg("__l").alias("nlp"), (F.sum("__p") / F.sum("__n")).alias("correct_rate"),
        F.sum("__n").alias("n"),
    )
    return out.withColumn("geometric_p", F.exp("nlp"))


def macro_loss(df: DataFrame, individual: str = "_individual", name: str = "loss") -> DataFrame:
    return macro_mean(selected_only(df), [individual], -log_chance(df), name)


def compare_models(
    new: DataFrame, old: DataFrame, on: Sequence[str], by: Sequence[str], how: str = "avg",
    name: str = "difference",
) -> DataFrame:
    """Paired difference in log likelihood of the selected alternatives, new minus old.

    Both sides keep one row per decision before the join. ``how`` names the aggregate.
    """
    def side(df: DataFrame, extra: Sequence[str]) -> DataFrame:
        return selected_only(df).select(*on, *extra, log_chance(df).alias("ll"))

    extra = [c for c in by if c not in on]
    joined = paired(side(old, extra), side(new, []), on, ["ll"], ("_old", "_new"))
    difference = F.col("ll_new") - F.col("ll_old")
    return joined.groupBy(*by).agg(
        getattr(F, how)(difference).alias(name), F.count(F.lit(1)).alias("n")
    )


def compare_chain(
    models: Sequence[tuple[str, DataFrame]], on: Sequence[str], by: Sequence[str], how: str = "avg",
    incremental: bool = True,
) -> DataFrame:
    """Compare each model with the one before it, or with the first."""
    out = None
    for i in range(1, len(models)):
        base_name, base = models[i - 1] if incremental else models[0]
        name, model = models[i]
        step = compare_models(model, base, on, by, how).withColumn("step", F.lit(f"{name} - {base_name}"))
        out = step if out is None else out.unionByName(step)
    return out


def calibration(
    df: DataFrame, by: Sequence[str], selected: str = "_selected", probabilities: Sequence[str] = ("probability",)
) -> DataFrame:
    """Observed selection rate against mean predicted probability."""
    return df.groupBy(*by).agg(
        F.avg(F.col(selected).cast("double")).alias("selected_rate"),
        *[F.avg(p).alias(p) for p in probabilities],
    )


def selection_curve(df: DataFrame, col: str, per_unit: float, by: Sequence[str] = ()) -> DataFrame:
    return response_curve(df, col, per_unit, F.col("_selected").cast("double"), by, "fraction")


def probability_curve(df: DataFrame, col: str, per_unit: float, by: Sequence[str] = ()) -> DataFrame:
    return response_curve(df, col, per_unit, F.col("probability"), by, "probability")


def monthly_score(df: DataFrame, time: str, train: str = "_train") -> DataFrame:
    """Mean log likelihood and count per month over held-out selections."""
    rows = selected_only(df).filter(~F.col(train))
    return rows.groupBy(F.month(time).alias("month")).agg(
        F.avg(log_chance(df)).alias("mean"), F.count(F.lit(1)).alias("count")
    )


def best_run(log: DataFrame, run: str = "run_id", epoch: str = "epoch", loss: str = "val_loss") -> DataFrame:
    """The run with the smallest loss in the last epoch; ties go to the smaller id."""
    last = log.agg(F.max(epoch).alias("e")).scalar()
    final = log.filter(F.col(epoch) == last)
    return final.agg(F.min_by(run, F.struct(loss, run)).alias(run), F.min(loss).alias(loss))


def run_table(configs: DataFrame, log: DataFrame, epoch_number: int, drop: Sequence[str] = ()) -> DataFrame:
    """Flatten (run_id, config struct) and attach the losses of one epoch."""
    flat = configs.select("run_id", "config.*").drop(*drop)
    return flat.join(log.filter(F.col("epoch") == epoch_number), "run_id")


def displacement(df: DataFrame, origin: str, nxt: str, res: int = 4) -> DataFrame:
    """Start (x, y) and step (u, v) in degrees of the selected moves."""
    rows = selected_only(df)
    x, y = grid.cell_lon(origin, res), grid.cell_lat(origin, res)
    rows = rows.withColumns({"x": x, "y": y})
    return rows.withColumns(
        {"u": grid.cell_lon(nxt, res) - F.col("x"), "v": grid.cell_lat(nxt, res) - F.col("y")}
    )


def relative_density(df: DataFrame, region: str, origin: str, number: str, density: str) -> DataFrame:
    """N_o * rho / sum over origins of N * rho, per region.

    The sum is combined on the map side and joined back, so a region may hold many rows.
    """
    weight = F.col(number) * F.col(density)
    totals = df.groupBy(region).agg(F.sum(weight).alias("__t"))
    return join_totals(df, totals, [region]).withColumn(
        "relative_density", weight / F.nullif(F.col("__t"), F.lit(0.0))
    ).drop("__t")


def density_weights(real: DataFrame, simulated: DataFrame, region: str, count: str = "n") -> DataFrame:
    """rho / p per region: how much an individual found there should count."""
    total_real = real.agg(F.sum(count).alias("t")).scalar()
    total_sim = simulated.agg(F.sum(count).alias("t")).scalar()
    p = real.select(region, (F.col(count) / total_real).alias("rho"))
    q = simulated.select(region, (F.col(count) / total_sim).alias("p"))
    return p.join(q, region).withColumn("weight", F.col("rho") / F.col("p"))
