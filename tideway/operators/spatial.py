"""Points of two tables within a distance: a spatial hash join on the sphere, for any ids and any grid."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideway.functions import grid
from tideway.operators.joins import distance_km
from tideway.session import materialise

#: Points of the left table in one bucket before it is split into slices.
CROWDED = 20_000


def _along(lat: str, lon: str) -> list[Column]:
    """Coordinates on the unit sphere: no seam at 180 degrees and no poles."""
    la, lo = F.col(lat) * grid.RAD, F.col(lon) * grid.RAD
    return [F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la)]


def _bucket(places: Sequence[Column], bits: int) -> Column:
    """Three cube coordinates in one long."""
    x, y, z = [p.cast("long") + F.lit(1 << (bits - 1)) for p in places]
    return F.shiftleft(F.shiftleft(x, bits).bitwiseOR(y), bits).bitwiseOR(z)


def within_km(
    left: DataFrame, right: DataFrame, max_km: float, left_at: tuple[str, str], right_at: tuple[str, str], distance: str = "distance",
    method: str = "ellipsoid", crowded: int = CROWDED,
) -> DataFrame:
    """Pairs of rows of ``left`` and ``right`` at most ``max_km`` apart, with their distance.

    Space is cut into cubes twice as wide as the distance. A left point has one cube; a right point goes to the one to eight cubes
    that its surroundings touch, so every pair meets in exactly one cube and an equi-join finds it. A cube with more than
    ``crowded`` left points is cut into slices by hash, and the right points around it go to every slice. Points with a null
    or NaN coordinate meet nothing. Column names of the two tables must differ.
    """
    if shared := {c.lower() for c in left.columns} & {c.lower() for c in right.columns}:
        raise ValueError(f"columns of both tables: {sorted(shared)}")
    reach = max_km * 1.006 + 1e-6  # the ellipsoid may shorten a spherical distance this much
    chord = 2 * math.sin(min(reach / (2 * grid.EARTH_KM), math.pi / 2)) + 1e-12
    width, bits = 2 * chord, 21
    if 1 / width >= 1 << (bits - 2):
        raise ValueError("distance too small for cubes of 21 bits")

    def known(df: DataFrame, at: tuple[str, str]) -> DataFrame:
        ok = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in at]
        df = df.filter(ok[0] & ok[1])
        return df.withColumns(dict(zip(("__x", "__y", "__z"), _along(*at))))

    axes = [F.col("__x"), F.col("__y"), F.col("__z")]
    a = known(left, left_at).withColumn("__cube", _bucket([F.floor(v / width) for v in axes], bits)).drop("__x", "__y", "__z")
    b = known(right, right_at)
    for name in ("__x", "__y", "__z"):
        v = F.col(name)
        b = b.withColumn(f"{name}c", F.explode(F.sequence(F.floor((v - chord) / width), F.floor((v + chord) / width))))
    b = b.withColumn("__cube", _bucket([F.col("__xc"), F.col("__yc"), F.col("__zc")], bits))
    b = b.drop("__x", "__y", "__z", "__xc", "__yc", "__zc")
    full = a.groupBy("__cube").agg(F.ceil(F.count("*") / crowded).cast("int").alias("__slices")).filter("__slices > 1")
    full = materialise(full, "crowded-cubes")
    slices = F.coalesce("__slices", F.lit(1))
    a = a.join(full, "__cube", "left").withColumn("__slice", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), slices).cast("int"))
    b = b.join(full, "__cube", "left").withColumn("__slice", F.explode(F.sequence(F.lit(0), slices - 1)))
    met = a.drop("__slices").join(b.drop("__slices"), ["__cube", "__slice"]).drop("__cube", "__slice")
    return distance_km(met, left_at[0], left_at[1], right_at[0], right_at[1], distance, method).filter(F.col(distance) <= max_km)


def edges_within(
    cells: DataFrame, max_km: float, cell: str = "cell", lat: str = "lat", lon: str = "lon", neighbor: str = "neighbor",
    distance: str = "distance", method: str = "ellipsoid",
) -> DataFrame:
    """(cell, neighbor, distance) of a grid with ids of its own, each cell its own neighbour: what ``neighbors_from_edges`` wants."""
    one = cells.select(cell, F.col(lat).alias("__la1"), F.col(lon).alias("__lo1"))
    two = cells.select(F.col(cell).alias(neighbor), F.col(lat).alias("__la2"), F.col(lon).alias("__lo2"))
    met = within_km(one, two, max_km, ("__la1", "__lo1"), ("__la2", "__lo2"), distance, method)
    return met.select(cell, neighbor, distance)
