"""Joins. Sides that grow with the data carry no broadcast hint: Catalyst and AQE decide on
measured sizes. Only literal tables are broadcast by hint. AQE splits a hot key between two plain
sides, but not beside an aggregate or in a full outer join: totals of a growing table are therefore
written before they are joined back (``join_totals``), and ``outer_fill`` is a left and an anti join."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideway.functions import grid
from tideway.operators.columns import computed
from tideway.session import materialise


def join_on(df: DataFrame, other: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on named keys. No forced repartition: EnsureRequirements adds what is missing
    and reuses what is there."""
    return df.join(other, list(on), how)


def join_totals(df: DataFrame, totals: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join rows to an aggregate of their own keys; null keys meet each other.

    The aggregate is written first, so that the join sees a plain, sized side and a hot key of ``df`` is split.
    """
    side = materialise(totals, "totals")
    side = side.withColumnsRenamed({k: f"__on_{k}" for k in on})
    match = [F.col(k).eqNullSafe(F.col(f"__on_{k}")) for k in on]
    out = df.join(side, match, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"__on_{k}" for k in on])


def join_floored(
    df: DataFrame, other: DataFrame, on: Sequence[str], epoch: str, seconds: int, other_epoch: str
) -> DataFrame:
    """Equi-join where ``other`` is keyed by the epoch floored to ``seconds``."""
    from tideway.functions.scalar import floor_to

    key = "__floored"
    right = other.withColumnRenamed(other_epoch, key)
    return df.withColumn(key, floor_to(epoch, seconds)).join(right, [*on, key]).drop(key)


def join_context(choices: DataFrame, facts: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """Star join of choices to environment facts that share one key list.

    All joins use the same keys, so the choices are exchanged once and stay in place.
    """
    out = choices
    for fact in facts:
        out = out.join(fact, list(on))
    return out


def join_constant(df: DataFrame, other: DataFrame, on: Sequence[str], **constants) -> DataFrame:
    """Equi-join with constant predicates on ``other``, applied before the join so that they
    reach its scan."""
    for name, value in constants.items():
        other = other.filter(F.col(name) == F.lit(value))
    return df.join(other.drop(*constants), list(on))


def natural_join(df: DataFrame, other: DataFrame, how: str = "inner") -> DataFrame:
    """Join on every column name both sides share."""
    shared = [c for c in df.columns if c in other.columns]
    if not shared:
        raise ValueError("no shared columns: refusing a cross join")
    return df.join(other, shared, how)


def outer_fill(df: DataFrame, other: DataFrame, on: Sequence[str], fill: Mapping[str, object]) -> DataFrame:
    """Full outer join, then defaults for missing values.

    Written as a left join and the rows only ``other`` has, so that a hot key is split on either side.
    """
    left = df.join(other, list(on), "left")
    rest = other.join(df.select(*on), list(on), "left_anti")
    return left.unionByName(rest, allowMissingColumns=True).fillna(dict(fill))


def keep_keys(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key qualifies; null qualifies if listed."""
    return join_totals(df, keys.select(*on), on, "left_semi")


def drop_keys(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is not listed."""
    return df.join(keys.select(*on), list(on), "left_anti")


def paired(
    left: DataFrame, right: DataFrame, on: Sequence[str], values: Sequence[str], suffixes: tuple[str, str]
) -> DataFrame:
    """Inner join of two results on their keys, the shared value columns told apart by suffix."""
    a = left.withColumnsRenamed({v: f"{v}{suffixes[0]}" for v in values})
    b = right.select(*on, *[F.col(v).alias(f"{v}{suffixes[1]}") for v in values])
    return a.join(b, list(on))


def per_distinct(
    df: DataFrame, keys: Sequence[str], fn: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Run ``fn`` on the distinct keys only and join its columns back.

    Worth it when the expression is costly and the keys are few. The distinct side is written;
    when it is small it is broadcast, otherwise it is joined by its keys. Null is a key like any other.
    """
    return join_totals(df, fn(df.select(*keys).distinct()), keys)


def scalars(params: DataFrame) -> dict[str, Column]:
    """Columns of a one-row table as fields of one scalar subquery.

    The subquery is the same wherever a field is read, so Spark runs it once; attaching
    parameters costs neither a cross join nor a collect.
    """
    row = params.select(F.struct(*params.columns).alias("row")).scalar()
    return {c: row[c] for c in params.columns}


def attach_row(df: DataFrame, params: DataFrame) -> DataFrame:
    """Repeat the columns of a one-row table on every row."""
    return df.withColumns(scalars(params))


def explode_values(df: DataFrame, values: Sequence, name: str) -> DataFrame:
    """One row per literal value: what a cross join with a literal list gives, without a join."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def cell_center(df: DataFrame, cell: str, lat: str = "lat", lon: str = "lon", res: int = 4) -> DataFrame:
    return df.withColumns({lat: grid.cell_lat(cell, res), lon: grid.cell_lon(cell, res)})


def to_cell(df: DataFrame, lat: str, lon: str, res: int = 4, cell: str = "cell") -> DataFrame:
    """Cell id, resolution, and the 10 degree bins of the cell centre."""
    df = df.withColumn(cell, grid.cell_of(lat, lon, res))
    return df.withColumns(
        {
            "cell_resolution": F.lit(res),
            "cell_lat_bin": grid.centroid_bin(grid.cell_lat(cell, res)),
            "cell_lon_bin": grid.centroid_bin(grid.cell_lon(cell, res)),
        }
    )


def distance_km(
    df: DataFrame, lat1: str, lon1: str, lat2: str, lon2: str, name: str = "distance",
    method: str = "ellipsoid",
) -> DataFrame:
    """Distance of two points per row; ``method`` is "ellipsoid" (WGS 84) or "sphere"."""
    radians, arc = grid.DISTANCES[method]
    d = computed(df, {"__b1": radians(F.col(lat1)), "__b2": radians(F.col(lat2))})
    b1, b2 = F.col("__b1"), F.col("__b2")
    px, qy = grid.latitude_terms(b1, b2)
    dlon = (F.col(lon2) - F.col(lon1)) * (grid.RAD / 2)
    h = grid.squared(F.sin((b2 - b1) / 2)) + F.cos(b1) * F.cos(b2) * grid.squared(F.sin(dlon))
    d = computed(d, {"__h": h, "__px": px, "__qy": qy})
    out = d.withColumn(name, arc(F.col("__h"), F.col("__px"), F.col("__qy")))
    return out.drop("__b1", "__b2", "__h", "__px", "__qy")


def neighbors(
    df: DataFrame, cell: str, max_km: float, res: int = 4, neighbor: str = "neighbor",
    distance: str = "distance", method: str = "ellipsoid",
) -> DataFrame:
    """One row per cell whose centre lies within ``max_km`` of ``cell``'s centre, itself included.

    A range join turned into generation: for each row of the grid that can be reached, the
    reachable column span follows from the haversine identity, so almost only true neighbours
    are produced and nothing is joined or shuffled. The fan-out is bounded by the area of the
    disc. Latitude terms are computed once per row of the grid; a candidate costs one sine and
    one arcsine. Columns wrap at 180 degrees.
    """
    radians, arc = grid.DISTANCES[method]
    reach = max_km * 1.006 + 1e-6  # the ellipsoid may shorten a spherical distance this much
    rows = math.ceil(reach / (grid.row_height_deg(res) * grid.RAD * grid.EARTH_KM))
    limit = math.sin(min(reach / (2 * grid.EARTH_KM), math.pi / 2)) ** 2
    c = F.col

    d = df.withColumn("__r0", grid.cell_row(cell))
    d = computed(d, {"__f0": grid.row_latitude(c("__r0"), res), "__l0": grid.cell_lon(cell, res)})
    d = computed(d, {"__c0": F.cos(c("__f0") * grid.RAD), "__b0": radians(c("__f0"))})

    # rows of the grid
    d = d.withColumn("__dr", F.explode(F.sequence(F.lit(-rows), F.lit(rows))))
    d = computed(d, {"__r": c("__r0") + c("__dr")})
    d = d.filter((c("__r") >= 0) & (c("__r") < grid.row_count(res)))
    d = computed(d, {"__f": grid.row_latitude(c("__r"), res)})
    d = computed(
        d,
        {
            "__cos": F.cos(c("__f") * grid.RAD), "__b": radians(c("__f")),
            "__up": grid.squared(F.sin((c("__f") - c("__f0")) * (grid.RAD / 2))),
        },
    )
    # sin^2(dlon / 2) <= (sin^2(reach / 2R) - sin^2(dlat / 2)) / (cos lat0 cos lat)
    room = (F.lit(limit) - c("__up")) / F.greatest(c("__cos") * c("__c0"), F.lit(1e-12))
    d = computed(d, {"__room": room, "__n": grid.row_cells(c("__f"), res)}).filter(c("__room") >= 0)
    px, qy = grid.latitude_terms(c("__b0"), c("__b"))
    d = computed(
        d,
        {
            "__half": F.asin(F.sqrt(F.least(c("__room"), F.lit(1.0)))) / math.pi * c("__n"),
            # place of the origin in this row; exact in its own, so that its distance is 0
            "__at": F.when(c("__dr") == 0, grid.cell_col(cell).cast("double")).otherwise(
                (c("__l0") + 180) / 360 * c("__n") - 0.5 - grid.row_shift(c("__r"))
            ),
            "__a": grid.squared(F.sin((c("__b") - c("__b0")) / 2)),
            "__k": F.cos(c("__b0")) * F.cos(c("__b")), "__px": px, "__qy": qy,
        },
    )
    # columns in the row
    whole = c("__half") * 2 + 1 >= c("__n")
    lo = F.when(whole, F.lit(0)).otherwise(F.ceil(c("__at") - c("__half") - 1e-9))
    hi = F.when(whole, c("__n").cast("long") - 1).otherwise(F.floor(c("__at") + c("__half") + 1e-9))
    d = computed(d, {"__lo": lo, "__hi": hi}).filter(c("__lo") <= c("__hi"))
    d = d.withColumn("__j", F.explode(F.sequence(c("__lo"), c("__hi"))))
    # the centre's longitude, unwrapped: only its distance from the origin matters
    dlon = (c("__j") - c("__at")) / c("__n") * math.pi
    d = computed(d, {"__h": c("__a") + c("__k") * grid.squared(F.sin(dlon))})
    d = computed(d, {distance: arc(c("__h"), c("__px"), c("__qy"))}).filter(c(distance) <= max_km)
    column = F.pmod(c("__j"), c("__n").cast("long"))
    return d.select(*df.columns, grid.pack(res, c("__r"), column).alias(neighbor), distance)


def neighbors_from_edges(
    df: DataFrame, edges: DataFrame, cell: str, max_km: float, neighbor: str = "neighbor",
    distance: str = "distance",
) -> DataFrame:
    """The same as an equi-join, for grids with ids of their own.

    ``edges`` has (cell, neighbor, distance) rows and must list each cell as its own neighbour.
    """
    near = edges.filter(F.col(distance) <= max_km).select(cell, neighbor, distance)
    return df.join(near, cell)
