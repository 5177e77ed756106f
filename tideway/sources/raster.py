"""Rasters held as arrays to long rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideway.functions.scalar import floor_bin


def explode_raster(
    df: DataFrame, lats: str, lons: str, values: str, bin_deg: float = 10, value: str = "value"
) -> DataFrame:
    """One row per raster point with its degree bins.

    Each input row is a tile: ``lats`` and ``lons`` are arrays and ``values[i][j]`` belongs to
    (lats[i], lons[j]). Tiles are the unit of parallelism, so cut a large raster into bands.
    """
    keep = [c for c in df.columns if c not in (lats, lons, values)]
    lines = df.select(*keep, lons, values, F.posexplode(lats).alias("__i", "lat"))
    lines = lines.withColumn("__line", F.get(F.col(values), F.col("__i")))
    points = lines.select(*keep, "lat", lons, F.posexplode("__line").alias("__j", value))
    points = points.withColumn("lon", F.get(F.col(lons), F.col("__j")))
    return points.select(
        *keep, "lat", "lon", value,
        floor_bin("lon", bin_deg).alias("lon_bin"), floor_bin("lat", bin_deg).alias("lat_bin"),
    )
