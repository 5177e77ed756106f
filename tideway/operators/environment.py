"""Gridded environment tables from points, and per-individual attributes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideway.functions import grid
from tideway.operators.aggregates import bin_mean
from tideway.operators.joins import scalars, to_cell

# Study boxes, (lon from, lon to), (lat from, lat to).
REGION_BOXES = {
    "chinook_study": (
        ((-180, -100), (30, 75)),
        ((130, 180), (30, 75)),
    ),
}

# Class edges in metres.
DEPTH_EDGES = (0.0, 25.0, 50.0, 75.0, 100.0, 150.0, 200.0, 250.0, 300.0, 400.0, 500.0)
DEPTH_CLASSES = DEPTH_EDGES[1:]

# Home position per region.
HOME_POSITIONS = {
    "WA/OR": (46.0, -125.0),
    "SEAK": (53.0, -130.0),
    "BC": (57.0, -136.0),
}
# Fixed value: what stands for a home that is not known.
UNKNOWN_HOME = 360.0

# Source names of the ocean variables and the names used here.
PHYSICS_NAMES = {
    "mlotst": "mixed_layer_thickness",
    "thetao": "temperature",
    "uo": "velocity_east",
    "vo": "velocity_north",
    "so": "salinity",
}
CHEMISTRY_NAMES = {
    "chl": "chlorophyll",
    "no3": "nitrate",
    "nppv": "net_primary_production",
    "o2": "oxygen",
    "po4": "phosphate",
    "si": "silicate",
}


def in_region(df: DataFrame, lat: str, lon: str, boxes: Sequence) -> DataFrame:
    """Rows inside any closed box; one predicate over one scan, so it reaches the reader."""
    keep = F.lit(False)
    for (west, east), (south, north) in boxes:
        keep = keep | (F.col(lon).between(west, east) & F.col(lat).between(south, north))
    return df.filter(keep)


def grid_environment(
    df: DataFrame, region: str, names: Mapping[str, str], lat: str = "latitude",
    lon: str = "longitude", depth: str = "depth", time: str = "time", res: int = 4,
    edges: Sequence[float] = DEPTH_EDGES, boxes: Sequence | None = None,
) -> DataFrame:
    """Points of (time, depth, lat, lon) to means per (time, cell, depth bin).

    Levels are averaged per point first, then points per cell; a point with a missing mean is
    left out. Adds the partition columns resolution, region and date.
    """
    inside = in_region(df, lat, lon, boxes or REGION_BOXES[region])
    inside = inside.withColumn("cell", grid.cell_of(lat, lon, res))
    means = bin_mean(inside, depth, edges, [lat, lon, time, "cell"], [time, "cell"], list(names))
    return means.withColumnsRenamed(dict(names)).withColumns(
        {
            "cell_resolution": F.lit(res),
            "region": F.lit(region),
            "date": F.date_format(time, "yyyy-MM-dd"),
        }
    )


def mean_by_cell(df: DataFrame, value: str, lat: str = "lat", lon: str = "lon", res: int = 4) -> DataFrame:
    """Distinct points averaged per cell."""
    points = to_cell(df.dropDuplicates(), lat, lon, res)
    return points.groupBy("cell_resolution", "cell", "cell_lon_bin", "cell_lat_bin").agg(
        F.avg(value).alias(value)
    )


def attach_home(
    regions: DataFrame, key: str = "tag_key", region: str = "region",
    positions: Mapping[str, tuple[float, float]] = HOME_POSITIONS, unknown: float = UNKNOWN_HOME,
) -> DataFrame:
    """Home position per individual, unknowns filled.

    The literal region table is broadcast, so individuals of one region stay where they are. A region without
    individuals is kept with a null key, as an outer join does.
    """
    table = regions.sparkSession.createDataFrame(
        [(r, lat, lon) for r, (lat, lon) in positions.items()],
        f"{region} string, home_lat double, home_lon double",
    )
    known = regions.select(key, region)
    empty = table.join(known.select(region).distinct(), region, "left_anti")
    out = known.join(F.broadcast(table), region, "left").unionByName(empty, allowMissingColumns=True)
    out = out.fillna({"home_lat": unknown, "home_lon": unknown})
    return out.withColumns(
        {"normed_home_lat": F.col("home_lat") / 90.0, "normed_home_lon": F.col("home_lon") / 180.0}
    )


def home_attributes(
    df: DataFrame, region: str = "region", positions: Mapping[str, tuple[float, float]] = HOME_POSITIONS,
) -> DataFrame:
    """Home of each row with unknown regions at the mean of the known rows, both coordinates scaled to 0..1, and a flag.

    The mean of known rows lies between their extremes, so one aggregate gives all three; rows do not move.
    """
    table = df.sparkSession.createDataFrame(
        [(r, lat, lon) for r, (lat, lon) in positions.items()], f"{region} string, home_lat double, home_lon double"
    )
    placed = df.drop("home_lat", "home_lon").join(F.broadcast(table), region, "left")
    stats = scalars(placed.agg(*[
        f(c).alias(f"{f.__name__}_{c}") for c in ("home_lat", "home_lon") for f in (F.avg, F.min, F.max)
    ]))
    out = placed.withColumn("region_unknown", F.col("home_lat").isNull().cast("double"))
    for c in ("home_lat", "home_lon"):
        low, high = stats[f"min_{c}"], stats[f"max_{c}"]
        out = out.withColumn(c, F.coalesce(c, stats[f"avg_{c}"]))
        out = out.withColumn(f"normed_{c}", (F.col(c) - low) / F.nullif(high - low, F.lit(0.0)))
    return out
