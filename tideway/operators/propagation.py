"""Transition tables over the grid and mass carried through them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideway.functions import calendar, grid
from tideway.operators.joins import neighbors
from tideway.operators.norms import Norm, apply_norm
from tideway.operators.scoring import LinearModel, MlpModel, choice_probability, score
from tideway.session import scratch_path


def move_features(df: DataFrame, date: str = "date", res: int = 4) -> DataFrame:
    """Heading, season and stay-put columns of (origin_cell, cell, distance, date) rows."""
    out = df.withColumns(
        {
            "lat": grid.cell_lat("cell", res), "lon": grid.cell_lon("cell", res),
            "origin_lat": grid.cell_lat("origin_cell", res),
            "origin_lon": grid.cell_lon("origin_cell", res),
        }
    )
    out = out.withColumns(
        {
            "movement_heading": grid.movement_heading("origin_lat", "origin_lon", "lat", "lon"),
            "month_radians": calendar.month_circle(date),
            "stay_put": (F.col("distance") == 0).cast("double"),
        }
    )
    return out.withColumns(
        {
            "cos_mh": F.cos("movement_heading"), "sin_mh": F.sin("movement_heading"),
            "cos_time": F.cos("month_radians"), "sin_time": F.sin("month_radians"),
        }
    )


def transition_table(
    context: DataFrame, model: LinearModel | MlpModel, max_km: float, spec: Mapping[str, Norm],
    params: DataFrame, origins: DataFrame | None = None, date: str = "date", res: int = 4,
    method: str = "ellipsoid",
) -> DataFrame:
    """probability(origin -> cell, date) for all origins and all dates in one plan.

    ``context`` has one row per (cell, date) with the model's environment columns. Reach is
    symmetric, so each context row is expanded to the origins it can be reached from. The
    environment is then already in place: the large join of alternatives to environment
    disappears, and the only exchange left is the one that brings an origin's alternatives
    together. ``origins`` (cells) restricts the starting points; by default every cell of the
    context is one, on every date.
    """
    cells = (origins if origins is not None else context).select(F.col("cell").alias("origin_cell"))
    reach = neighbors(context, "cell", max_km, res, "origin_cell", "distance", method)
    reach = reach.join(cells.distinct(), "origin_cell", "left_semi")
    normed = apply_norm(move_features(reach, date, res), spec, params)
    scored = choice_probability(score(normed, model), ["origin_cell", date])
    return scored.select("origin_cell", "cell", date, "probability")


def step_mass(state: DataFrame, transitions: DataFrame) -> DataFrame:
    """One step: mass(t + 1, cell) = sum over origins of mass(t, origin) * probability."""
    moved = state.withColumnRenamed("cell", "origin_cell").join(transitions, ["origin_cell", "date"])
    summed = moved.groupBy("cell", "date").agg(
        F.sum(F.col("_quanta") * F.col("probability")).alias("_quanta")
    )
    return summed.withColumn("date", F.date_add("date", 1))


def store_bucketed(transitions: DataFrame, table: str, buckets: int | None = None, path: str | None = None) -> DataFrame:
    """Write transitions as a catalog table in buckets of (origin_cell, date), sorted by date; returned from the catalog.

    Steps over such a table exchange the state only, one row per cell, and never the transitions, one row per pair of cells. A
    bucket is one file, as rows are dealt by bucket before they are written; rows sorted by date let a step skip what it does not need.
    There are as many buckets as the session has shuffle partitions by default: with fewer Spark prefers an exchange of both sides.
    """
    buckets = buckets or int(transitions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = transitions.repartition(buckets, "origin_cell", "date")
    writer = rows.write.mode("overwrite").format("parquet").bucketBy(buckets, "origin_cell", "date").sortBy("date", "origin_cell")
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return transitions.sparkSession.table(table)


def propagate(
    seed: DataFrame, transitions: DataFrame, steps: int, history: str | None = None
) -> DataFrame:
    """Mass per cell and date after each of ``steps`` steps, the seed included.

    Each state is written below ``history`` (a fresh folder in the shared scratch space by
    default) and read back, so the plan never grows and a lost executor costs one step. Only
    the transitions of the state's dates take part in a step; keep that table partitioned by
    date and the others are never read. Steps of a longer earlier run in the same folder are not returned.
    """
    spark = seed.sparkSession
    root = history or scratch_path(spark, "mass")
    schema = "cell long, date date, _quanta double"
    state = seed.select(F.col("cell").cast("long").alias("cell"), "date", F.col("_quanta").cast("double"))
    dates = None
    for i in range(steps + 1):
        path = f"{root}/step={i}"
        state.write.mode("overwrite").parquet(path)
        written = spark.read.schema(schema).parquet(path)
        if dates is None:
            dates = written.agg(F.min("date"), F.max("date")).first()  # pruned by literals
        step = transitions
        if dates[0] is not None:
            step = transitions.filter(F.col("date").between(F.date_add(F.lit(dates[0]), i), F.date_add(F.lit(dates[1]), i)))
        state = step_mass(written, step)
    paths = [f"{root}/step={i}" for i in range(steps + 1)]
    return spark.read.schema(f"{schema}, step int").option("basePath", root).parquet(*paths)


def mass_balance(history: DataFrame) -> DataFrame:
    """Total mass per step and how much left the table since the step before.

    Mass is lost where a cell has no outgoing row on its date.
    """
    totals = history.groupBy("step").agg(F.sum("_quanta").alias("mass"))
    before = totals.select((F.col("step") + 1).alias("step"), F.col("mass").alias("__before"))
    out = totals.join(before, "step", "left")
    return out.select("step", "mass", F.coalesce(F.col("__before") - F.col("mass"), F.lit(0.0)).alias("lost"))


def stationary_seed(cells: DataFrame, date, quanta: float = 1.0, keep: Sequence[str] = ()) -> DataFrame:
    """Equal mass on every distinct cell."""
    return cells.select("cell", *keep).distinct().select(
        "cell", F.lit(date).cast("date").alias("date"), F.lit(float(quanta)).alias("_quanta")
    )


def log10_mass(df: DataFrame, tolerance: float = 0.001) -> DataFrame:
    return df.withColumn("log_quanta", F.log10(F.col("_quanta") + tolerance))
