"""Tracks to labelled movement choices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideway.functions import grid
from tideway.operators.choices import expand_neighbors, mark_selected, sequence_decisions
from tideway.operators.joins import join_context


def movement_decisions(
    tracks: DataFrame, individual: str = "tag_key", lat: str = "latitude", lon: str = "longitude",
    date: str = "date", res: int = 4,
) -> DataFrame:
    """Fixes as numbered decisions with origin and next cell."""
    cells = tracks.withColumn("origin_cell", grid.cell_of(lat, lon, res)).drop(lat, lon)
    cells = cells.withColumn("_individual", F.col(individual))
    return sequence_decisions(cells, "_individual", date, "origin_cell", next_name="next_cell")


def movement_choices(
    decisions: DataFrame, facts: Sequence[DataFrame], max_km: float, date: str = "date", res: int = 4,
    method: str = "ellipsoid", water: tuple[str, str] | None = None,
) -> DataFrame:
    """All cells in reach of every decision, with environment, geometry and label.

    Decisions become alternatives by generation, then meet the facts on (cell, date) once.
    ``water`` names the (north, east) current columns for a water heading.
    """
    choices = expand_neighbors(decisions, "origin_cell", max_km, res, "cell", method=method)
    joined = join_context(choices, facts, ["cell", date])
    joined = joined.withColumns(
        {
            "lat": grid.cell_lat("cell", res), "lon": grid.cell_lon("cell", res),
            "origin_lat": grid.cell_lat("origin_cell", res),
            "origin_lon": grid.cell_lon("origin_cell", res),
        }
    )
    made = {"movement_heading": grid.movement_heading("origin_lat", "origin_lon", "lat", "lon")}
    if water:
        made["water_heading"] = grid.heading(*water)
    joined = joined.withColumns(made).drop("lat", "lon", "origin_lat", "origin_lon")
    return mark_selected(joined, "next_cell", "cell")
