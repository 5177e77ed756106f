"""Telemetry to normalised depth choices."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideway.functions import calendar, grid
from tideway.functions.scalar import epoch_date, epoch_second_of_day
from tideway.operators.aggregates import bucket_first
from tideway.operators.choices import drop_trivial, expand_by_context, expand_classes, mark_selected, require_selected
from tideway.operators.environment import DEPTH_CLASSES
from tideway.operators.joins import join_floored
from tideway.operators.norms import Norm, apply_norm, fit_norm, standardise_in_place
from tideway.operators.ranking import dense_ids, reindex
from tideway.operators.sampling import depth_class
from tideway.operators.seasons import circle_columns, date_phases, sun_times
from tideway.session import materialise


def depth_decisions(
    telemetry: DataFrame, tracks: DataFrame, splits: DataFrame, classes: Sequence[float] = DEPTH_CLASSES,
    seconds: int = 900, mode: str = "draw", uniform: Column | None = None, tie: Sequence[str] = (),
    res: int = 4,
) -> DataFrame:
    """First reading per bucket, its class, its split and the cell of its day.

    A decision is identified by (individual, bucket), so it needs no numbering pass.
    """
    first = bucket_first(telemetry, ["tag_key"], "epoch", seconds, "depth", tie)
    first = first.filter(F.col("depth").isNotNull() & ~F.isnan(F.col("depth").cast("double")))
    first = depth_class(
        first, "depth", classes, key=["tag_key", "epoch"], uniform=uniform, mode=mode, name="depth_bin_selected"
    )
    first = first.withColumn("date", epoch_date("epoch"))
    cells = tracks.select("tag_key", "date", grid.cell_of("latitude", "longitude", res).alias("cell"))
    out = first.join(splits, "tag_key").join(cells, ["tag_key", "date"])
    return out.withColumns({"_individual": F.col("tag_key"), "_decision": F.col("epoch")})


def add_phases(decisions: DataFrame, res: int = 4) -> DataFrame:
    """Sun, moon and orbit as sines and cosines. The moon is computed per distinct date."""
    out = decisions.withColumns({"lat": grid.cell_lat("cell", res), "lon": grid.cell_lon("cell", res)})
    out = sun_times(out, "lat", "lon", "date", "__rise", "__set")
    phase = calendar.sun_phase(epoch_second_of_day("epoch"), "__rise", "__set")
    out = date_phases(out.withColumn("sun_radians", phase), "date")
    return circle_columns(out, "sun", "moon", "orbit").drop("__rise", "__set", "lat", "lon")


def depth_choices(
    decisions: DataFrame, elevation: DataFrame, facts: Sequence[DataFrame],
    classes: Sequence[float] = DEPTH_CLASSES,
) -> DataFrame:
    """Alternatives per decision, labelled; decisions whose own class was lost are dropped.

    The first fact table does the expansion (see ``expand_by_context``). Further ones join on
    cell, date and depth bin.
    """
    first, *others = facts
    out = decisions.join(elevation, "cell")
    out = expand_by_context(out, first, ["cell", "date"], "depth_bin", classes)
    for fact in others:
        out = out.join(fact, ["cell", "date", "depth_bin"])
    return require_selected(mark_selected(out, "depth_bin_selected", "depth_bin"))


def depth_features(choices: DataFrame, spec: Mapping[str, Norm], train: str = "_train") -> tuple[DataFrame, DataFrame]:
    """(features, parameters): scaled by the training rows, trivial decisions dropped.

    The choices are written to the shared folder once: both the fit and the result read them.
    """
    stored = materialise(choices, "depth-choices")
    params = materialise(fit_norm(stored.filter(F.col(train)), spec), "depth-params")
    return drop_trivial(apply_norm(stored, spec, params)), params


def daily_depth_features(
    readings: DataFrame, days: DataFrame, elevation: DataFrame, classes: Sequence[float] = DEPTH_CLASSES,
    selected: str = "selected_depth_class",
) -> DataFrame:
    """The first-generation dataset in one plan: labelled class alternatives with standardised features.

    ``readings`` (tag_key, epoch, selected class) meet the day of their individual, ``days`` (tag_key, day_epoch, cell,
    sunrise, sunset), and the elevation of its cell. Decisions are numbered by (tag_key, epoch), which must be unique,
    individuals by tag_key; two thirds of them train. Means and deviations run over all rows and stay as columns.
    """
    rows = join_floored(readings, days, ["tag_key"], "epoch", calendar.DAY, "day_epoch").join(elevation, "cell")
    rows = rows.withColumns(
        {"hour": F.floor(epoch_second_of_day("epoch") / 3600), "month": F.month(epoch_date("epoch")).cast("double")}
    )
    daytime, _, progress = calendar.day_period("hour", "sunrise", "sunset")
    rows = rows.withColumns({"daytime": daytime.cast("double"), "period_progress": progress})
    rows = reindex(dense_ids(rows, ["tag_key", "epoch"], "_decision"), "tag_key", "_individual", 1)
    out = expand_classes(rows, classes, "depth_class")
    out = out.withColumns(
        {
            "_selected": F.col("depth_class") == F.col(selected),
            "_choice": (F.col("_decision") - 1) * len(classes) + F.col("_choice"),
            "_train": F.col("_individual") % 3 != 0,
        }
    )
    return standardise_in_place(out, ["depth_class", "period_progress", "elevation", "month"])


def inference_choices(
    space: DataFrame, elevation: DataFrame, facts: Sequence[DataFrame], classes: Sequence[float] = DEPTH_CLASSES
) -> DataFrame:
    """Unlabelled alternatives of every state (cell, epoch, date and phases) that has an elevation and an environment.

    Every state is a decision and an individual of its own, numbered by (cell, epoch).
    """
    first, *others = facts
    rows = dense_ids(space, ["cell", "epoch"], "_decision").join(elevation, "cell")
    out = expand_by_context(rows, first, ["cell", "date"], "depth_bin", classes)
    for fact in others:
        out = out.join(fact, ["cell", "date", "depth_bin"])
    return out.withColumns({"_individual": F.col("_decision"), "_train": F.lit(False)})


def inference_features(choices: DataFrame, spec: Mapping[str, Norm], params: DataFrame) -> DataFrame:
    """Alternatives scaled by the stored parameters of a training run, never by their own."""
    return apply_norm(choices, spec, params)
