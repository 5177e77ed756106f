"""Equal-area cell grid on the sphere, as arithmetic on one long per cell.

Rows run along parallels; row r holds round(circumference / spacing) equal cells and odd
rows are shifted by half a cell, so that every cell has about six neighbours at one
spacing. A resolution step changes the cell area by seven. Ids of other grids can be used
with every operator that only compares cells; see ``neighbors_from_edges``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideway.functions.scalar import as_col, at_most, floor_bin

EARTH_KM = 6371.0088
# WGS 84 ellipsoid.
EQUATOR_KM = 6378.137
FLATTENING = 1 / 298.257223563

SPACING_KM_AT_4 = 45.2
ROW_BITS, COL_BITS = 25, 25
COL_MASK = (1 << COL_BITS) - 1
RAD = math.pi / 180


def spacing_km(res: int) -> float:
    if not 0 <= res <= 10:
        raise ValueError("resolution must lie in 0..10")
    return SPACING_KM_AT_4 * 7 ** ((4 - res) / 2)


def row_height_deg(res: int) -> float:
    return spacing_km(res) * math.sqrt(3) / 2 / EARTH_KM / RAD


def row_count(res: int) -> int:
    return math.ceil(180 / row_height_deg(res))


# The expressions below read each input once where they can: they get nested in one another,
# and every second copy would double the work. ``least`` and ``greatest`` skip nulls, so the
# public functions test for them at the end.


def row_latitude(row: Column, res: int) -> Column:
    """Latitude of a row's centre, for a row that is not null."""
    return F.least(F.lit(-90.0) + (row + F.lit(0.5)) * row_height_deg(res), F.lit(90.0))


def row_cells(lat: Column, res: int) -> Column:
    """Number of cells in the row centred at ``lat``."""
    n = F.round(F.lit(2 * math.pi * EARTH_KM / spacing_km(res)) * F.cos(lat * RAD))
    return F.greatest(n, F.lit(1.0))


def row_shift(row: Column) -> Column:
    return F.pmod(row, F.lit(2)) * F.lit(0.5)


def pack(res: int, row: Column, col: Column) -> Column:
    return (
        F.lit(res << (ROW_BITS + COL_BITS)).cast("long")
        + row.cast("long") * F.lit(1 << COL_BITS)
        + col.cast("long")
    )


def cell_row(cell: Column | str) -> Column:
    return F.shiftright(as_col(cell), COL_BITS).bitwiseAND(F.lit(COL_MASK))


def cell_col(cell: Column | str) -> Column:
    return as_col(cell).bitwiseAND(F.lit(COL_MASK))


def cell_of(lat: Column | str, lon: Column | str, res: int = 4) -> Column:
    """Cell id of a point."""
    row = F.floor((as_col(lat) + 90) / row_height_deg(res))
    row = F.greatest(F.lit(0), F.least(row, F.lit(row_count(res) - 1)))
    n = row_cells(row_latitude(row, res), res)
    col = F.pmod(F.floor((as_col(lon) + 180) / 360 * n - row_shift(row)), n.cast("long"))
    return F.when(as_col(lat).isNotNull(), pack(res, row, col))


def cell_lat(cell: Column | str, res: int = 4) -> Column:
    return F.when(as_col(cell).isNotNull(), row_latitude(cell_row(cell), res))


def column_longitude(row: Column, col: Column, n: Column) -> Column:
    return F.pmod((col + F.lit(0.5) + row_shift(row)) / n * 360, F.lit(360.0)) - 180


def cell_lon(cell: Column | str, res: int = 4) -> Column:
    row = cell_row(cell)
    return column_longitude(row, cell_col(cell), row_cells(row_latitude(row, res), res))


def centroid_bin(degrees: Column | str, width: float = 10) -> Column:
    return floor_bin(degrees, width)


def squared(x: Column) -> Column:
    return x * x


def sphere_arc_km(h: Column, _px: Column | None = None, _qy: Column | None = None) -> Column:
    """Great-circle distance on the mean sphere from the haversine ``h`` = sin^2(arc / 2)."""
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(at_most(h, 1.0)))


def ellipsoid_arc_km(h: Column, px: Column, qy: Column) -> Column:
    """Lambert's correction for WGS 84, metres off over thousands of kilometres.

    ``h`` is the haversine of the reduced latitudes; ``px`` and ``qy`` depend on the two
    latitudes alone (see ``latitude_terms``).
    """
    h = at_most(h, 1.0)
    arc = 2 * F.asin(F.sqrt(h))
    sine = 2 * F.sqrt(h * (1 - h))
    x = (arc - sine) * px / F.nullif(1 - h, F.lit(0.0))
    y = (arc + sine) * qy / F.nullif(h, F.lit(0.0))
    return F.when(h == 0, F.lit(0.0)).otherwise(EQUATOR_KM * (arc - FLATTENING / 2 * (x + y)))


def reduced_latitude(lat: Column) -> Column:
    """Latitude on the auxiliary sphere of the ellipsoid, in radians."""
    return F.atan(F.tan(lat * RAD) * (1 - FLATTENING))


def latitude_terms(b1: Column, b2: Column) -> tuple[Column, Column]:
    p, q = (b1 + b2) / 2, (b2 - b1) / 2
    return squared(F.sin(p) * F.cos(q)), squared(F.cos(p) * F.sin(q))


#: method -> (latitude in radians, distance from haversine and latitude terms)
DISTANCES = {
    "ellipsoid": (reduced_latitude, ellipsoid_arc_km),
    "sphere": (lambda lat: lat * RAD, sphere_arc_km),
}


def heading(north: Column | str, east: Column | str) -> Column:
    """atan2(north, east): 0 points east, and a null move has heading 0."""
    return F.atan2(as_col(north), as_col(east))


def movement_heading(lat1, lon1, lat2, lon2, wrap: bool = False) -> Column:
    """Heading of a move on plain degrees; ``wrap`` takes the short way over 180 degrees."""
    dlon = as_col(lon2) - as_col(lon1)
    if wrap:
        dlon = F.pmod(dlon + 180, F.lit(360.0)) - 180
    return heading(as_col(lat2) - as_col(lat1), dlon)
