"""Grid, calendar, environment, transition and propagation queries."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from tideway.functions import calendar, grid, quadtree
from tideway.operators import environment, evaluation, joins, kept_sums, norms, propagation, seasons, spatial
from tideway.operators.aggregates import bucket_first
from tideway.operators.choices import expand_neighbors
from tideway.operators.columns import in_box
from tideway.operators.cube import state_space
from tideway.operators.sampling import depth_class
from tideway.operators.scoring import LinearModel
from tideway.plans import depth as depth_plan
from tideway.plans import movement as movement_plan
from tideway.plans import transition as transition_plan
from tideway.session import materialise, scratch_path
from workload.choice_queries import sql_edge
from workload.derive import (
    BOX_CELLS, CELL_FACTS, RES, START, TELEMETRY, TRACKS, VISITED, cell_facts, sql_cell, sql_km, sql_lat,
    sql_lon, telemetry, tracks, visited, with_sql,
)
from workload.registry import Tables, num, q6, query, r6

RAD = math.pi / 180
TAU = 2 * math.pi


@query("d01_to_cell", with_sql(TRACKS) + f"""
select tag_key, strftime(date, '%Y-%m-%d') as date, cell, 4 as cell_resolution,
  floor({sql_lat('cell')} / 10) * 10 as cell_lat_bin, floor({sql_lon('cell')} / 10) * 10 as cell_lon_bin
from (select *, {sql_cell('latitude', 'longitude')} as cell from tracks)""")
def d01(t: Tables):
    out = joins.to_cell(tracks(t), "latitude", "longitude", RES)
    return out.select(
        "tag_key", F.date_format("date", "yyyy-MM-dd").alias("date"), "cell", "cell_resolution", "cell_lat_bin", "cell_lon_bin"
    )


@query("d02_cell_center", with_sql(TRACKS, VISITED) + f"""
select cell, {q6(sql_lat('cell'))} as lat, {q6(sql_lon('cell'))} as lon from visited""")
def d02(t):
    out = joins.cell_center(visited(t), "cell", res=RES)
    return out.select("cell", r6("lat").alias("lat"), r6("lon").alias("lon"))


NEAR = f"""centres as (select cell as origin, {sql_lat('cell')} as la, {sql_lon('cell')} as lo from visited),
near as (select origin, cell as neighbor, {sql_km('la', 'lo', 'lat', 'lon')} as distance
  from centres, box_cells where abs(lat - la) < 2 and abs(lon - lo) < 6)"""


@query("j15_neighbor_join", with_sql(TRACKS, VISITED, BOX_CELLS, NEAR) + f"""
select origin as cell, neighbor, {q6('distance')} as distance from near where distance <= 100""")
def j15(t):
    out = joins.neighbors(visited(t), "cell", 100, RES, method="sphere")
    return out.withColumn("distance", r6("distance"))


@query("d03_neighbors_from_edges", with_sql(TRACKS, VISITED, BOX_CELLS, NEAR) + f"""
select origin as cell, neighbor, {q6('distance')} as distance from near where distance <= 50""")
def d03(t):
    cells = visited(t)
    edges = joins.neighbors(cells, "cell", 100, RES, method="sphere")
    return joins.neighbors_from_edges(cells, edges, "cell", 50).withColumn("distance", r6("distance"))


FOREIGN = f"""grids as (select distinct 'g' || cell as id, {sql_lat('cell')} as la, {sql_lon('cell')} as lo from visited)"""


@query("j15_foreign_neighbors", with_sql(TRACKS, VISITED, FOREIGN) + f"""
select a.id as cell, b.id as neighbor, {q6(sql_km('a.la', 'a.lo', 'b.la', 'b.lo'))} as distance from grids a, grids b
where {sql_km('a.la', 'a.lo', 'b.la', 'b.lo')} <= 400""")
def j15_foreign(t):
    cells = joins.cell_center(visited(t), "cell", res=RES).select(F.concat(F.lit("g"), "cell").alias("cell"), "lat", "lon").distinct()
    edges = spatial.edges_within(cells, 400, method="sphere")
    return joins.neighbors_from_edges(cells.select("cell"), edges, "cell", 400).withColumn("distance", r6("distance"))


LEVELS = [2, 5, 8, 11]


def sql_quad(lat: str, lon: str, level: str) -> str:
    """Code of a point at a level, bit by bit."""
    row = f"least(floor((sin({lat} * 0.017453292519943295e0) + 1) / 2 * (1 << {level})), (1 << {level}) - 1)::bigint"
    col = f"least(floor(((({lon} + 180) % 360 + 360) % 360) / 360 * (1 << {level})), (1 << {level}) - 1)::bigint"
    return (f"(1::bigint << (2 * {level})) + list_sum(list_transform(range(0, {level}), lambda k: (((({row}) >> k::int) & 1) << (2 * k + 1)::int) + "
            f"(((({col}) >> k::int) & 1) << (2 * k)::int)))::bigint")


@query("d43_mean_by_levels", with_sql(TRACKS) + f""", levels as (select unnest({LEVELS}) as level),
coded as (select level::int as level, {sql_quad('latitude', 'longitude', 'level')} as cell, day(date) as v from tracks, levels)
select level, cell, count(*) as n, {q6('avg(v)')} as mean from coded group by 1, 2""")
def d43_levels(t):
    rows = tracks(t).withColumn("day", F.dayofmonth("date"))
    out = quadtree.rolled_up(rows, "latitude", "longitude", "day", LEVELS)
    return out.withColumn("mean", r6("mean"))


def sql_lambert(alias_lat1, alias_lon1, alias_lat2, alias_lon2) -> tuple[str, str]:
    """(inner columns, distance over them) of Lambert's formula."""
    f, r = num(grid.FLATTENING), num(RAD)
    inner = (f"atan(tan({alias_lat1} * {r}) * (1 - {f})) as b1, atan(tan({alias_lat2} * {r}) * (1 - {f})) as b2, "
             f"({alias_lon2} - {alias_lon1}) * {r} as dl")
    half = "asin(sqrt(sin((b2 - b1) / 2) ** 2 + cos(b1) * cos(b2) * sin(dl / 2) ** 2))"
    x = f"(2 * {half} - sin(2 * {half})) * (sin((b1 + b2) / 2) * cos((b2 - b1) / 2)) ** 2 / cos({half}) ** 2"
    y = f"(2 * {half} + sin(2 * {half})) * (cos((b1 + b2) / 2) * sin((b2 - b1) / 2)) ** 2 / sin({half}) ** 2"
    return inner, f"case when {half} = 0 then 0e0 else {num(grid.EQUATOR_KM)} * (2 * {half} - {f} / 2 * ({x} + {y})) end"


LAMBERT = sql_lambert("latitude", "longitude", "57.5e0", "-150e0")


@query("d04_distance", with_sql(TRACKS) + f"""
select tag_key, strftime(date, '%Y-%m-%d') as date, {q6(LAMBERT[1])} as ellipsoid,
  {q6(sql_km('latitude', 'longitude', '57.5e0', '(-150e0)'))} as sphere
from (select *, {LAMBERT[0]} from tracks)""")
def d04(t):
    rows = tracks(t).withColumns({"la": F.lit(57.5), "lo": F.lit(-150.0)})
    out = joins.distance_km(rows, "latitude", "longitude", "la", "lo", "ellipsoid")
    out = joins.distance_km(out, "latitude", "longitude", "la", "lo", "sphere", "sphere")
    return out.select(
        "tag_key", F.date_format("date", "yyyy-MM-dd").alias("date"), r6("ellipsoid").alias("ellipsoid"), r6("sphere").alias("sphere")
    )


@query("d05_headings", f"""
select event_id, {q6('atan2(value / 10 - user_id % 7, event_id % 11 - 5)')} as movement, {q6('atan2(value - 40, user_id % 9 - 4)')} as water
from events""")
def d05(t):
    move = grid.movement_heading((F.col("user_id") % 7).cast("double"), F.lit(5.0), F.col("value") / 10, F.col("event_id") % 11)
    water = grid.heading(F.col("value") - 40, F.col("user_id") % 9 - 4)
    return t.events.select("event_id", r6(move).alias("movement"), r6(water).alias("water"))


@query("d06_stay_put", with_sql(TRACKS, VISITED, BOX_CELLS, NEAR) + """
select origin as cell, neighbor, case when distance = 0 then 1e0 else 0e0 end as stay_put from near where distance <= 100""")
def d06(t):
    out = joins.neighbors(visited(t), "cell", 100, RES, method="sphere")
    return out.select("cell", "neighbor", (F.col("distance") == 0).cast("double").alias("stay_put"))


@query("d07_month_circle", f"""
select o_orderkey, {q6(f'sin((month(o_orderdate) - 1) / 11e0 * {num(TAU)})')} as s, {q6(f'cos((month(o_orderdate) - 1) / 11e0 * {num(TAU)})')} as c,
  {q6(f'(month(o_orderdate) - 1) / 12e0 * {num(TAU)}')} as even from orders""")
def d07(t):
    m = calendar.month_circle("o_orderdate")
    return t.orders.select(
        "o_orderkey", r6(F.sin(m)).alias("s"), r6(F.cos(m)).alias("c"), r6(calendar.month_circle("o_orderdate", 12)).alias("even")
    )


@query("d08_orbit_phase", f"""
select o_orderkey, {q6(f'dayofyear(o_orderdate) / dayofyear(make_date(year(o_orderdate), 12, 31)) * {num(TAU)}')} as orbit from orders""")
def d08(t):
    return t.orders.select("o_orderkey", r6(calendar.orbit_phase("o_orderdate")).alias("orbit"))


@query("d09_sun_phase", f"""
with a as (select event_id, cast(event_id * 7919 % 86400 as double) as t, cast(event_id * 104729 % 86400 as double) as up,
  cast(event_id * 15485863 % 86400 as double) as down from events),
b as (select event_id, (t - up + 86400) % 86400 as since_rise, (down - up + 86400) % 86400 as light from a)
select event_id, {q6('pi() * if(since_rise < light, since_rise / light, 1 + (since_rise - light) / (86400 - light))')} as phase from b""")
def d09(t):
    e = F.col("event_id")
    rows = t.events.select(
        "event_id", (e * 7919 % 86400).cast("double").alias("t"), (e * 104729 % 86400).cast("double").alias("up"),
        (e * 15485863 % 86400).cast("double").alias("down"),
    )
    return rows.select("event_id", r6(calendar.sun_phase("t", "up", "down")).alias("phase"))


def sql_sun(lat: str, lon: str, day: str) -> tuple[list[str], str, str]:
    """CTE column lists and the two results of the sunrise equation."""
    r = num(RAD)
    c = calendar
    steps = [
        f"date_diff('day', date '1970-01-01', {day}) - {num(c.J2000_UNIX_DAY)} + 0.5e0 - {lon} / 360e0 as noon",
        f"({num(c.MEAN_ANOMALY[0])} + {num(c.MEAN_ANOMALY[1])} * noon) % 360e0 * {r} as m",
        (f"(m / {r} + {num(c.EQUATION_OF_CENTRE[0])} * sin(m) + {num(c.EQUATION_OF_CENTRE[1])} * sin(2 * m) + "
         f"{num(c.EQUATION_OF_CENTRE[2])} * sin(3 * m) + 180 + {num(c.PERIHELION)}) % 360e0 * {r} as ecl"),
        (f"noon + 0.0053e0 * sin(m) - 0.0069e0 * sin(2 * ecl) as transit, sin(ecl) * {num(math.sin(c.OBLIQUITY * RAD))} as sd"),
        (f"({num(math.sin(c.HORIZON * RAD))} - sin({lat} * {r}) * sd) / (cos({lat} * {r}) * sqrt(1 - sd * sd)) as ch"),
        f"case when abs(ch) <= 1 then acos(least(greatest(ch, -1e0), 1e0)) / {num(TAU)} end as half",
    ]
    rise = "(((transit - half + 0.5e0) * 86400) % 86400e0)"
    fall = "(((transit + half + 0.5e0) * 86400) % 86400e0)"
    return steps, rise, fall


def nested(source: str, steps: list[str]) -> str:
    for step in steps:
        source = f"(select *, {step} from {source})"
    return source


SUN = sql_sun("lat", "longitude", "date")


@query("d10_sun_times", with_sql(TRACKS) + f"""
select tag_key, strftime(date, '%Y-%m-%d') as date, coalesce({q6(SUN[1])}, -1) as sunrise, coalesce({q6(SUN[2])}, -1) as sunset
from {nested("(select *, latitude + (case when tag_key like '1%' then 25e0 else 0e0 end) as lat from tracks)", SUN[0])}""")
def d10(t):
    rows = tracks(t).withColumn("lat", F.col("latitude") + F.when(F.col("tag_key").startswith("1"), 25.0).otherwise(0.0))
    rows = seasons.sun_times(rows, "lat", "longitude", "date")
    return rows.select(
        "tag_key", F.date_format("date", "yyyy-MM-dd").alias("date"), F.coalesce(r6("sunrise"), F.lit(-1.0)).alias("sunrise"),
        F.coalesce(r6("sunset"), F.lit(-1.0)).alias("sunset"),
    )


def sql_new_moon(k: str) -> str:
    c, r = calendar, num(RAD)
    t = f"({k} / {num(c.LUNATIONS_PER_CENTURY)})"
    args = (
        f"(({num(c.SUN_ANOMALY[0])} + {num(c.SUN_ANOMALY[1])} * {k}) * {r})",
        f"(({num(c.MOON_ANOMALY[0])} + {num(c.MOON_ANOMALY[1])} * {k} + 0.0107582e0 * {t} * {t}) * {r})",
        f"(({num(c.MOON_LATITUDE_ARGUMENT[0])} + {num(c.MOON_LATITUDE_ARGUMENT[1])} * {k} - 0.0016118e0 * {t} * {t}) * {r})",
    )
    out = f"{num(c.NEW_MOON_UNIX_DAY - c.TT_MINUS_UT_DAYS)} + {k} * {num(c.SYNODIC_DAYS)} + 0.00015437e0 * {t} * {t}"
    for amplitude, *multiples in c.NEW_MOON_TERMS:
        angle = " + ".join(f"{m} * {a}" for m, a in zip(multiples, args) if m)
        ecc = f" * (1 - 0.002516e0 * {t})" * abs(multiples[0])
        out += f" + {num(amplitude)} * sin({angle}){ecc}"
    return f"({out})"


@query("d11_moon_phase", f"""
with days as (select distinct cast(o_orderdate as date) as d from orders),
base as (select d, date_diff('day', date '1970-01-01', d) * 1e0 as t from days),
moons as (select d, t, floor((t - {num(calendar.NEW_MOON_UNIX_DAY)}) / {num(calendar.SYNODIC_DAYS)}) + i as k from base, (select unnest(range(-2, 4)) as i)),
dated as (select d, t, {sql_new_moon('k')} as new_moon from moons),
phase as (select d, max(case when new_moon <= t then new_moon end) as prev, min(case when new_moon > t then new_moon end) as next, max(t) as t from dated group by 1)
select o_orderkey, {q6(f'(t - prev) / (next - prev) * {num(TAU)}')} as moon from orders join phase on d = cast(o_orderdate as date)""")
def d11(t):
    rows = t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    out = joins.per_distinct(rows, ["day"], lambda d: seasons.moon_phase(d, "day", "moon"))
    return out.select("o_orderkey", r6("moon").alias("moon"))


@query("d12_day_period", f"""
with a as (select event_id, cast(hour(ts) as double) as h, cast(event_id * 7 % 24 as double) as up, cast(event_id * 11 % 23 as double) + 0.5 as down from events),
b as (select event_id, (h - up + 24) % 24 as since_rise, (down - up + 24) % 24 as light from a)
select event_id, since_rise < light as daytime, {q6('light')} as length,
  {q6('if(since_rise < light, since_rise / light, (since_rise - light) / (24 - light))')} as progress from b""")
def d12(t):
    e = F.col("event_id")
    rows = t.events.select(
        "event_id", F.hour("ts").alias("h"), (e * 7 % 24).cast("double").alias("up"), (e * 11 % 23 + 0.5).alias("down")
    )
    daytime, length, progress = calendar.day_period("h", "up", "down")
    return rows.select("event_id", daytime.alias("daytime"), r6(length).alias("length"), r6(progress).alias("progress"))


TRACK_DECISIONS = f"""located as (select *, {sql_cell('latitude', 'longitude')} as origin_cell from tracks),
track_decisions as (select tag_key, date, origin_cell, row_number() over w as _decision, lead(origin_cell) over w as next_cell
  from located window w as (partition by tag_key order by date))"""


@query("d16_expand_neighbors", with_sql(TRACKS, VISITED, BOX_CELLS, NEAR, TRACK_DECISIONS) + f"""
select tag_key, _decision, neighbor as cell, row_number() over (partition by tag_key, _decision order by neighbor) as _choice
from track_decisions join near on origin = origin_cell where distance <= 50""")
def d16(t):
    rows = movement_plan.movement_decisions(tracks(t), res=RES)
    out = expand_neighbors(rows, "origin_cell", 50, RES, method="sphere")
    return out.select("tag_key", F.col("_decision").cast("long").alias("_decision"), "cell", F.col("_choice").cast("long").alias("_choice"))


@query("d_movement_choices", with_sql(TRACKS, VISITED, BOX_CELLS, NEAR, TRACK_DECISIONS, CELL_FACTS) + f"""
, numbered as (select tag_key, _decision, d.date, origin_cell, next_cell, neighbor as cell, distance,
    row_number() over (partition by tag_key, _decision order by neighbor) as _choice
  from track_decisions d join near on origin = origin_cell where distance <= 100)
select tag_key, _decision, _choice, n.cell, {q6('distance')} as distance, {q6('salinity')} as salinity,
  {q6('mixed_layer_thickness')} as mixed_layer_thickness,
  {q6(f"atan2({sql_lat('n.cell')} - {sql_lat('origin_cell')}, {sql_lon('n.cell')} - {sql_lon('origin_cell')})")} as movement_heading,
  coalesce(cast(next_cell = n.cell as varchar), 'unknown') as _selected
from numbered n join cell_facts f on f.cell = n.cell and f.date = n.date""")
def movement(t):
    rows = movement_plan.movement_decisions(tracks(t), res=RES)
    out = movement_plan.movement_choices(rows, [cell_facts(t)], 100, res=RES, method="sphere")
    return out.select(
        "tag_key", F.col("_decision").cast("long").alias("_decision"), F.col("_choice").cast("long").alias("_choice"), "cell",
        *[r6(c).alias(c) for c in ("distance", "salinity", "mixed_layer_thickness", "movement_heading")],
        F.coalesce(F.col("_selected").cast("string"), F.lit("unknown")).alias("_selected"),
    )


WATER_FACTS = """water_facts as (select *, cell % 13 / 6.0e0 - 1 as velocity_north, cell % 17 / 8.0e0 - 1 as velocity_east from cell_facts)"""


@query("d_movement_water", with_sql(TRACKS, VISITED, BOX_CELLS, NEAR, TRACK_DECISIONS, CELL_FACTS, WATER_FACTS) + f"""
select tag_key, _decision, neighbor as cell, {q6('atan2(velocity_north, velocity_east)')} as water_heading,
  {q6(f"atan2({sql_lat('neighbor')} - {sql_lat('origin_cell')}, {sql_lon('neighbor')} - {sql_lon('origin_cell')})")} as movement_heading
from track_decisions d join near on origin = origin_cell join water_facts f on f.cell = neighbor and f.date = d.date
where distance <= 100""")
def movement_water(t):
    facts = cell_facts(t).withColumns(
        {"velocity_north": F.col("cell") % 13 / 6.0 - 1, "velocity_east": F.col("cell") % 17 / 8.0 - 1}
    )
    rows = movement_plan.movement_decisions(tracks(t), res=RES)
    water = ("velocity_north", "velocity_east")
    out = movement_plan.movement_choices(rows, [facts], 100, res=RES, method="sphere", water=water)
    return out.select(
        "tag_key", F.col("_decision").cast("long").alias("_decision"), "cell",
        *[r6(c).alias(c) for c in ("water_heading", "movement_heading")],
    )


@query("d49_displacement", with_sql(TRACKS, VISITED, BOX_CELLS, NEAR, TRACK_DECISIONS) + f"""
select tag_key, _decision, {q6(sql_lon('origin_cell'))} as x, {q6(sql_lat('origin_cell'))} as y,
  {q6(f"{sql_lon('next_cell')} - {sql_lon('origin_cell')}")} as u, {q6(f"{sql_lat('next_cell')} - {sql_lat('origin_cell')}")} as v
from track_decisions join near on origin = origin_cell and neighbor = next_cell where distance <= 100""")
def d49(t):
    rows = movement_plan.movement_decisions(tracks(t), res=RES)
    out = expand_neighbors(rows, "origin_cell", 100, RES, method="sphere")
    out = out.withColumn("_selected", F.col("next_cell") == F.col("cell"))
    out = evaluation.displacement(out, "origin_cell", "next_cell", RES)
    return out.select(
        "tag_key", F.col("_decision").cast("long").alias("_decision"), *[r6(c).alias(c) for c in ("x", "y", "u", "v")]
    )


SPINE = (1704067200, 1704067200 + 30 * 86400)
SUN_CELL = sql_sun("la", "lo", "date")


@query("d39_state_space", with_sql(TRACKS, VISITED) + f"""
, boxed as (select * from (select cell, {sql_lat('cell')} as la, {sql_lon('cell')} as lo from visited) where lo > -170 and lo < -126 and la > 52 and la < 65),
spine as (select *, cast(make_timestamp(e * 1000000) as date) as date from boxed, (select unnest(generate_series({SPINE[0]}, {SPINE[1]}, 3600)) as e)),
sunned as (select cell, e, {SUN_CELL[1]} as up, {SUN_CELL[2]} as down, e % 86400 as t from {nested('spine', SUN_CELL[0])}),
phased as (select cell, e, ((t - up) % 86400 + 86400) % 86400 as since, ((down - up) % 86400 + 86400) % 86400 as len,
  ((t - down) % 86400 + 86400) % 86400 as dark from sunned)
select cell, count(*) as n, min(e) as first, max(e) as last,
  {q6('avg(case when since < len then since / len * pi() else pi() + dark / (86400 - len) * pi() end)')} as sun,
  {q6(f'avg(cos(dayofyear(make_timestamp(e * 1000000)) / 366e0 * {num(TAU)}))')} as orbit from phased group by 1""")
def d39(t):
    cells = materialise(visited(t), "cells")
    boxed = in_box(joins.cell_center(cells, "cell", res=RES), "lat", "lon", (52, 65), (-170, -126))
    rows = state_space(boxed, *SPINE)
    return rows.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("epoch").alias("first"), F.max("epoch").alias("last"),
        r6(F.avg("sun_radians")).alias("sun"), r6(F.avg("cos_orbit")).alias("orbit"),
    )


MOVE_MODEL = LinearModel({"sin_mh": 0.4, "cos_mh": -0.3, "sin_time": 0.1, "n_salinity": 0.5, "n_mixed_layer_thickness": 0.8, "stay_put": 1.2})
MOVE_SPEC = {"salinity": norms.ZScore(), "mixed_layer_thickness": norms.LogRatio(tolerance=0.01)}

TRANSITIONS = f"""moves as (
  select f.cell, n.neighbor as origin_cell, f.date, n.distance, f.salinity, f.mixed_layer_thickness,
    {sql_lat('f.cell')} - {sql_lat('n.neighbor')} as dlat, {sql_lon('f.cell')} - {sql_lon('n.neighbor')} as dlon
  from cell_facts f join near n on n.origin = f.cell
  where n.distance <= 50 and n.neighbor in (select cell from cell_facts)),
stats as (select avg(salinity) as m, stddev(salinity) as s, ln(max(mixed_layer_thickness) + 0.01e0) as lm from cell_facts),
phi as (select *, 0.4e0 * sin(atan2(dlat, dlon)) - 0.3e0 * cos(atan2(dlat, dlon)) + 0.1e0 * sin((month(date) - 1) / 11e0 * {num(TAU)})
  + 0.5e0 * (salinity - m) / s + 0.8e0 * ln(mixed_layer_thickness + 0.01e0) / lm + case when distance = 0 then 1.2e0 else 0e0 end as phi from moves, stats),
transitions as (select origin_cell, cell, date, exp(phi) / sum(exp(phi)) over (partition by origin_cell, date) as probability from phi)"""

WORLD = (TRACKS, VISITED, BOX_CELLS, NEAR, CELL_FACTS, TRANSITIONS)


@query("d40_transition_table", with_sql(*WORLD) + f"""
select origin_cell, cell, strftime(date, '%Y-%m-%d') as date, {q6('probability')} as probability from transitions""")
def d40(t):
    facts = materialise(cell_facts(t), "cell-facts")
    params = norms.fit_norm(facts, MOVE_SPEC)
    out = propagation.transition_table(facts, MOVE_MODEL, 50, MOVE_SPEC, params, res=RES, method="sphere")
    return out.select("origin_cell", "cell", F.date_format("date", "yyyy-MM-dd").alias("date"), r6("probability").alias("probability"))


STEPS = 4


def sql_steps() -> str:
    parts = [f"m0 as (select cell, date '{START}' as date, 10e0 as q from (select distinct cell from cell_facts))"]
    for i in range(STEPS):
        parts.append(
            f"m{i + 1} as (select t.cell, m.date + 1 as date, sum(q * probability) as q from m{i} m join transitions t "
            f"on t.origin_cell = m.cell and t.date = m.date group by 1, 2)"
        )
    union = " union all ".join(f"select {i} as step, cell, cast(date as date) as date, q from m{i}" for i in range(STEPS + 1))
    return ", " + ",\n".join(parts) + f", history as ({union})"


@query("d41_propagate", with_sql(*WORLD) + sql_steps() + f"""
select step, cell, strftime(date, '%Y-%m-%d') as date, {q6('q')} as _quanta from history""")
def d41(t):
    facts = materialise(cell_facts(t), "cell-facts")
    params = norms.fit_norm(facts, MOVE_SPEC)
    out = transition_plan.diffuse_and_propagate(
        facts, facts, START, STEPS, MOVE_MODEL, 50, MOVE_SPEC, params, method="sphere"
    )
    return out.select("step", "cell", F.date_format("date", "yyyy-MM-dd").alias("date"), r6("_quanta").alias("_quanta"))


@query("d41_propagate_bucketed", with_sql(*WORLD) + sql_steps() + f"""
select step, cell, strftime(date, '%Y-%m-%d') as date, {q6('q')} as _quanta from history""")
def d41_bucketed(t):
    facts = materialise(cell_facts(t), "cell-facts")
    params = norms.fit_norm(facts, MOVE_SPEC)
    out = transition_plan.diffuse_and_propagate(
        facts, facts, START, STEPS, MOVE_MODEL, 50, MOVE_SPEC, params, method="sphere", bucketed=f"transitions_{uuid.uuid4().hex[:12]}"
    )
    return out.select("step", "cell", F.date_format("date", "yyyy-MM-dd").alias("date"), r6("_quanta").alias("_quanta"))


@query("d41_mass_balance", f"""
with days as (select event_type, cast(ts as date) as date, count(*) * 1e0 as q from events group by 1, 2),
m as (select day(date) as step, sum(q) as mass from days group by 1)
select m.step, {q6('m.mass')} as mass, {q6('coalesce(b.mass - m.mass, 0)')} as lost from m left join m b on b.step = m.step - 1""")
def d41_balance(t):
    rows = t.events.groupBy("event_type", F.to_date("ts").alias("date")).agg(F.count(F.lit(1)).cast("double").alias("_quanta"))
    history = rows.select(F.dayofmonth("date").cast("long").alias("step"), "_quanta")
    out = propagation.mass_balance(history)
    return out.select("step", r6("mass").alias("mass"), r6("lost").alias("lost"))


@query("a17_kept_sums", f"""
with e as (select cast(ts as date) as date, event_type, user_id % 5 as cell, value from events)
select event_type, count(value) as value_n, {q6('avg(value)')} as value_mean, {q6('stddev_samp(value)')} as value_std,
  {q6('min(value)')} as value_min, {q6('max(value)')} as value_max from e group by 1""")
def a17_kept(t):
    rows = t.events.select(F.to_date("ts").alias("date"), "event_type", (F.col("user_id") % 5).alias("cell"), "value")
    path, third = scratch_path(t.spark, "kept-sums"), F.pmod(F.dayofmonth("date"), F.lit(3))
    for days in (0, 1, 2, 1):  # three appends, one of them repeated
        kept_sums.keep_days(rows.filter(third == days), path, ["event_type", "cell"], "date", ["value"])
    merged = kept_sums.kept_sums(t.spark, path, ["event_type"], ["value"])
    out = kept_sums.means_of(merged, ["event_type"], ["value"])
    return out.select("event_type", "value_n", *[r6(c).alias(c) for c in ("value_mean", "value_std", "value_min", "value_max")])


def ocean_points(t: Tables):
    """Line items as model levels on a 2 degree grid, some outside the boxes, some values missing."""
    return t.lineitem.select(
        (29 + F.col("l_suppkey") % 24 * 2.0).alias("latitude"), (-180 + F.col("l_partkey") % 180 * 2.0).alias("longitude"),
        (F.col("l_extendedprice") / 180).alias("depth"), F.to_date("l_shipdate").alias("time"),
        F.when(F.col("l_linenumber") < 7, F.col("l_quantity")).alias("so"), F.col("l_discount").alias("thetao"),
    )


@query("d42_grid_environment", f"""
with pts as (select 29 + l_suppkey % 24 * 2e0 as latitude, -180 + l_partkey % 180 * 2e0 as longitude, l_extendedprice / 180 as depth,
    cast(l_shipdate as date) as time, case when l_linenumber < 7 then l_quantity end as so, l_discount as thetao from lineitem),
inside as (select *, {sql_edge('depth')} as depth_bin from pts where latitude between 30 and 75
    and (longitude between -180 and -100 or longitude between 130 and 180) and depth > 0 and depth <= 500),
points as (select latitude, longitude, time, depth_bin, avg(so) as so, avg(thetao) as thetao from inside group by 1, 2, 3, 4),
cells as (select *, {sql_cell('latitude', 'longitude')} as cell from points where so is not null and thetao is not null)
select cell, depth_bin, strftime(time, '%Y-%m-%d') as date, 'chinook_study' as region, 4 as cell_resolution,
  {q6('avg(so)')} as salinity, {q6('avg(thetao)')} as temperature from cells group by cell, depth_bin, time""")
def d42(t):
    names = {k: environment.PHYSICS_NAMES[k] for k in ("so", "thetao")}
    out = environment.grid_environment(ocean_points(t), "chinook_study", names, res=RES)
    return out.select(
        "cell", "depth_bin", "date", "region", "cell_resolution", r6("salinity").alias("salinity"), r6("temperature").alias("temperature")
    )


@query("d43_mean_by_cell", f"""
with pts as (select distinct 50 + l_suppkey % 100 / 8e0 as lat, -170 + l_partkey % 400 / 10e0 as lon, l_quantity as elevation from lineitem),
cells as (select *, {sql_cell('lat', 'lon')} as cell from pts)
select cell, 4 as cell_resolution, floor({sql_lon('cell')} / 10) * 10 as cell_lon_bin, floor({sql_lat('cell')} / 10) * 10 as cell_lat_bin,
  {q6('avg(elevation)')} as elevation from cells group by cell""")
def d43(t):
    points = t.lineitem.select(
        (50 + F.col("l_suppkey") % 100 / 8.0).alias("lat"), (-170 + F.col("l_partkey") % 400 / 10.0).alias("lon"),
        F.col("l_quantity").alias("elevation"),
    )
    return environment.mean_by_cell(points, "elevation", res=RES).withColumn("elevation", r6("elevation"))


@query("d44_attach_home", f"""
with r as (select c_custkey as tag_key, case c_mktsegment when 'BUILDING' then 'WA/OR' when 'MACHINERY' then 'SEAK' else 'other' end as region from customer),
locs as (select * from (values ('WA/OR', 46e0, -125e0), ('SEAK', 53e0, -130e0), ('BC', 57e0, -136e0)) v(region, home_lat, home_lon))
select coalesce(tag_key, -1) as tag_key, coalesce(r.region, l.region) as region, coalesce(home_lat, 360) as home_lat, coalesce(home_lon, 360) as home_lon,
  {q6('coalesce(home_lat, 360) / 90')} as normed_home_lat, {q6('coalesce(home_lon, 360) / 180')} as normed_home_lon
from r full join locs l on l.region = r.region""")
def d44(t):
    region = F.when(F.col("c_mktsegment") == "BUILDING", "WA/OR").when(F.col("c_mktsegment") == "MACHINERY", "SEAK").otherwise("other")
    out = environment.attach_home(t.customer.select(F.col("c_custkey").alias("tag_key"), region.alias("region")))
    return out.select(
        F.coalesce("tag_key", F.lit(-1).cast("long")).alias("tag_key"), "region", "home_lat", "home_lon",
        r6("normed_home_lat").alias("normed_home_lat"), r6("normed_home_lon").alias("normed_home_lon"),
    )


@query("d44_home_attributes", f"""
with r as (select c_custkey, case c_mktsegment when 'BUILDING' then 'WA/OR' when 'MACHINERY' then 'SEAK' when 'AUTOMOBILE' then 'BC' else 'other' end as region from customer),
placed as (select r.*, home_lat, home_lon from r left join
  (values ('WA/OR', 46e0, -125e0), ('SEAK', 53e0, -130e0), ('BC', 57e0, -136e0)) v(region, home_lat, home_lon) on v.region = r.region),
known as (select *, coalesce(home_lat, avg(home_lat) over ()) as lat, coalesce(home_lon, avg(home_lon) over ()) as lon from placed)
select c_custkey, if(home_lat is null, 1e0, 0e0) as region_unknown, {q6('lat')} as home_lat,
  {q6('(lat - min(lat) over ()) / (max(lat) over () - min(lat) over ())')} as normed_home_lat,
  {q6('(lon - min(lon) over ()) / (max(lon) over () - min(lon) over ())')} as normed_home_lon from known""")
def d44_attributes(t):
    segment = F.col("c_mktsegment")
    region = F.when(segment == "BUILDING", "WA/OR").when(segment == "MACHINERY", "SEAK").when(segment == "AUTOMOBILE", "BC").otherwise("other")
    out = environment.home_attributes(t.customer.select("c_custkey", region.alias("region")))
    return out.select("c_custkey", "region_unknown", *[r6(c).alias(c) for c in ("home_lat", "normed_home_lat", "normed_home_lon")])


def bin_facts(t: Tables):
    bins = F.explode(F.array(*[F.lit(c) for c in environment.DEPTH_CLASSES])).alias("depth_bin")
    rows = cell_facts(t).select("cell", "date", "salinity", bins)
    return rows.select(
        "cell", "date", "depth_bin", (F.col("salinity") + F.col("depth_bin") / 1000).alias("salinity")
    )


def bin_values(t: Tables):
    return bin_facts(t).select("cell", "date", "depth_bin", (F.col("cell") % 41 / 4.0 + F.col("depth_bin")).alias("nitrate"))


BIN_FACTS = f"""bin_facts as (select cell, date, b * 1e0 as depth_bin, salinity + b / 1000e0 as salinity, cell % 41 / 4e0 + b as nitrate
  from cell_facts, (values {', '.join(f'({int(c)})' for c in environment.DEPTH_CLASSES)}) v(b))"""


@query("d_depth_features", with_sql(TELEMETRY, TRACKS, VISITED, CELL_FACTS, BIN_FACTS) + f"""
, firsts as (select tag_key, epoch - epoch % 900 as _decision, depth from telemetry
  qualify row_number() over (partition by tag_key, epoch - epoch % 900 order by epoch, event_id) = 1),
decisions as (select f.*, {sql_edge('f.depth')} as picked, cast(f.tag_key as bigint) % 3 <> 0 as _train, k.date,
    {sql_cell('latitude', 'longitude')} as cell from firsts f join tracks k on k.tag_key = f.tag_key
    and k.date = cast(make_timestamp(_decision * 1000000) as date)),
elevation as (select cell, 100e0 - cell % 4000 as elevation from visited),
choices as (select d.tag_key, d._decision, d._train, b.depth_bin, b.salinity, b.nitrate, e.elevation, d.picked = b.depth_bin as _selected,
    max(d.picked = b.depth_bin) over (partition by d.tag_key, d._decision) as has
  from decisions d join elevation e on e.cell = d.cell join bin_facts b on b.cell = d.cell and b.date = d.date),
kept as (select *, count(*) over (partition by tag_key, _decision) as c from choices where has),
p as (select min(salinity) as lo, max(salinity) as hi, min(ln(nitrate + 0.001e0)) as nlo, max(ln(nitrate + 0.001e0)) as nhi,
    min(greatest(0, -elevation)) as elo, max(greatest(0, -elevation)) as ehi from kept where _train)
select tag_key, _decision, depth_bin, _selected, _train, {q6('(salinity - lo) / (hi - lo)')} as n_salinity,
  {q6('(ln(nitrate + 0.001e0) - nlo) / (nhi - nlo)')} as n_nitrate, {q6('(greatest(0, -elevation) - elo) / (ehi - elo)')} as n_elevation
from kept, p where c > 1""")
def depth_features(t):
    splits = telemetry(t).select("tag_key").distinct().withColumn("_train", F.col("tag_key").cast("long") % 3 != 0)
    decisions = depth_plan.depth_decisions(telemetry(t), tracks(t), splits, mode="edge", tie=["event_id"], res=RES)
    elevation = visited(t).withColumn("elevation", 100.0 - F.col("cell") % 4000)
    choices = depth_plan.depth_choices(decisions, elevation, [bin_facts(t), bin_values(t)])
    spec = {"salinity": norms.MinMax(), "nitrate": norms.LogMinMax(tolerance=0.001), "elevation": norms.WaterDepth()}
    out, _ = depth_plan.depth_features(choices, spec)
    return out.select(
        "tag_key", "_decision", "depth_bin", "_selected", "_train",
        *[r6(f"n_{c}").alias(f"n_{c}") for c in spec],
    )


@query("d_daily_depth_features", with_sql(TELEMETRY, TRACKS, VISITED) + f"""
, firsts as (select tag_key, epoch - epoch % 900 as epoch, depth from telemetry
  qualify row_number() over (partition by tag_key, epoch - epoch % 900 order by epoch, event_id) = 1),
days as (select tag_key, date, {sql_cell('latitude', 'longitude')} as cell, cast(tag_key as bigint) * 7 % 24 * 1e0 as up,
  (cast(tag_key as bigint) * 11 + day(date)) % 23 + 0.5e0 as down from tracks),
joined as (select f.tag_key, f.epoch, {sql_edge('f.depth')} as picked, 100e0 - cell % 4000 as elevation,
    month(date) * 1e0 as month, (floor(f.epoch % 86400 / 3600) - up + 24) % 24 as since_rise, (down - up + 24) % 24 as light
  from firsts f join days k on k.tag_key = f.tag_key and k.date = cast(make_timestamp(f.epoch * 1000000) as date)),
numbered as (select *, row_number() over (order by tag_key, epoch) as _decision, dense_rank() over (order by tag_key) as _individual,
    if(since_rise < light, since_rise / light, (since_rise - light) / (24 - light)) as progress from joined),
expanded as (select n.*, c * 1e0 as class, i from numbered n, (values {', '.join(f'({int(c)}, {i + 1})' for i, c in enumerate(environment.DEPTH_CLASSES))}) v(c, i))
select tag_key, epoch, _individual, _decision, (_decision - 1) * {len(environment.DEPTH_CLASSES)} + i as _choice, picked = class as _selected,
  _individual % 3 <> 0 as _train, if(since_rise < light, 1e0, 0e0) as daytime, {q6('(class - avg(class) over ()) / stddev(class) over ()')} as depth_class,
  {q6('(progress - avg(progress) over ()) / stddev(progress) over ()')} as period_progress,
  {q6('(elevation - avg(elevation) over ()) / stddev(elevation) over ()')} as elevation, {q6('avg(elevation) over ()')} as avg_elevation
from expanded""")
def daily_depth(t):
    tag = F.col("tag_key").cast("long")
    first = bucket_first(telemetry(t), ["tag_key"], "epoch", 900, "depth", ["event_id"])
    readings = depth_class(first, "depth", environment.DEPTH_CLASSES, mode="edge", name="selected_depth_class")
    days = tracks(t).select(
        "tag_key", (F.datediff("date", F.lit("1970-01-01").cast("date")).cast("long") * 86400).alias("day_epoch"),
        grid.cell_of("latitude", "longitude", RES).alias("cell"), (tag * 7 % 24).cast("double").alias("sunrise"),
        ((tag * 11 + F.dayofmonth("date")) % 23 + 0.5).cast("double").alias("sunset"),
    )
    elevation = visited(t).withColumn("elevation", 100.0 - F.col("cell") % 4000)
    out = depth_plan.daily_depth_features(readings, days, elevation)
    return out.select(
        "tag_key", "epoch", "_individual", "_decision", F.col("_choice").cast("long").alias("_choice"), "_selected", "_train",
        "daytime", *[r6(c).alias(c) for c in ("depth_class", "period_progress", "elevation", "avg_elevation")],
    )


@query("d_full_year_features", with_sql(TRACKS, VISITED, CELL_FACTS, BIN_FACTS) + f"""
, states as (select v.cell, d.date, cast(epoch(d.date) as bigint) as epoch, 100e0 - v.cell % 4000 as elevation,
    row_number() over (order by v.cell, d.date) as _decision from visited v, fact_days d),
p as (select min(salinity) as lo, max(salinity) as hi, min(ln(nitrate + 0.001e0)) as nlo, max(ln(nitrate + 0.001e0)) as nhi from bin_facts
  where cell % 3 <> 0)
select s._decision, s.cell, s.epoch, b.depth_bin, {q6('(b.salinity - lo) / (hi - lo)')} as n_salinity,
  {q6('(ln(b.nitrate + 0.001e0) - nlo) / (nhi - nlo)')} as n_nitrate
from states s join bin_facts b on b.cell = s.cell and b.date = s.date, p""")
def full_year(t):
    spec = {"salinity": norms.MinMax(), "nitrate": norms.LogMinMax(tolerance=0.001)}
    seen = bin_facts(t).join(bin_values(t), ["cell", "date", "depth_bin"])
    params = materialise(norms.fit_norm(seen.filter("cell % 3 <> 0"), spec), "stored-params")
    cells = visited(t).withColumns({"lat": grid.cell_lat("cell", RES), "lon": grid.cell_lon("cell", RES)})
    start = 1704067200  # 2024-01-01
    space = state_space(cells, start, start + 29 * 86400, step=86400)
    elevation = visited(t).withColumn("elevation", 100.0 - F.col("cell") % 4000)
    choices = depth_plan.inference_choices(space, elevation, [bin_facts(t), bin_values(t)])
    out = depth_plan.inference_features(choices, spec, params)
    return out.select("_decision", "cell", "epoch", "depth_bin", *[r6(f"n_{c}").alias(f"n_{c}") for c in spec])


@query("d_depth_phases")
def depth_phases(t):
    splits = telemetry(t).select("tag_key").distinct().withColumn("_train", F.col("tag_key").cast("long") % 3 != 0)
    decisions = depth_plan.depth_decisions(telemetry(t), tracks(t), splits, tie=["event_id"], res=RES)
    out = depth_plan.add_phases(decisions, RES)
    names = [f"{f}_{p}" for p in ("sun", "moon", "orbit") for f in ("cos", "sin")]
    return out.select("tag_key", "_decision", "depth_bin_selected", *[r6(n).alias(n) for n in names])
