"""Inputs of the operators, derived from the bundled tables, in Spark and in SQL."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideway.functions import grid
from workload.registry import Tables, num

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
RES = 4


def with_sql(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"


# --- telemetry and tracks ------------------------------------------------------------------

def epoch_seconds(ts: str) -> Column:
    """Whole seconds of a zone-free timestamp, whatever the session zone."""
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def telemetry(t: Tables) -> DataFrame:
    return t.events.select(
        F.col("user_id").cast("string").alias("tag_key"), epoch_seconds("ts").alias("epoch"),
        F.col("value").alias("depth"),
        F.when(F.col("event_type") != "error", F.col("event_id") % 300 / 10.0).alias("temperature"),
        "event_id",
    )


TELEMETRY = """telemetry as (
  select cast(user_id as varchar) as tag_key, cast(floor(epoch(ts)) as bigint) as epoch, value as depth,
    case when event_type <> 'error' then event_id % 300 / 10.0e0 end as temperature, event_id
  from events)"""


def tracks(t: Tables) -> DataFrame:
    day = F.dayofmonth("ts")
    return t.events.select(
        F.col("user_id").cast("string").alias("tag_key"), F.to_date("ts").alias("date"),
        (52 + (F.col("user_id") * 7 + day * 3) % 130 / 10.0).alias("latitude"),
        (-170 + (F.col("user_id") * 13 + day * 5) % 440 / 10.0).alias("longitude"),
    ).distinct()


TRACKS = """tracks as (
  select distinct cast(user_id as varchar) as tag_key, cast(ts as date) as date,
    52 + (user_id * 7 + day(ts) * 3) % 130 / 10.0e0 as latitude,
    -170 + (user_id * 13 + day(ts) * 5) % 440 / 10.0e0 as longitude
  from events)"""

# --- grid in SQL: written from the definition of the grid, not from the Spark expressions ---

H = grid.row_height_deg(RES)
ROWS = grid.row_count(RES)
CIRCLE = 2 * math.pi * grid.EARTH_KM / grid.spacing_km(RES)
RAD = math.pi / 180


def sql_rowlat(row: str) -> str:
    return f"least(-90e0 + ({row} + 0.5e0) * {num(H)}, 90e0)"


def sql_n(row: str) -> str:
    return f"greatest(round({num(CIRCLE)} * cos({sql_rowlat(row)} * {num(RAD)})), 1e0)"


def sql_col_lon(row: str, col: str) -> str:
    raw = f"(({col} + 0.5e0 + ({row} % 2) * 0.5e0) / {sql_n(row)} * 360 - 180)"
    return f"(case when {raw} >= 180 then {raw} - 360 else {raw} end)"


def sql_pack(row: str, col: str) -> str:
    return f"({RES << 50} + cast({row} as bigint) * {1 << 25} + cast({col} as bigint))"


def sql_row(cell: str) -> str:
    return f"(({cell} >> 25) & {(1 << 25) - 1})"


def sql_col(cell: str) -> str:
    return f"({cell} & {(1 << 25) - 1})"


def sql_lat(cell: str) -> str:
    return sql_rowlat(sql_row(cell))


def sql_lon(cell: str) -> str:
    return sql_col_lon(sql_row(cell), sql_col(cell))


def sql_cell(lat: str, lon: str) -> str:
    row = f"least(greatest(cast(floor(({lat} + 90) / {num(H)}) as bigint), 0), {ROWS - 1})"
    col = f"floor(({lon} + 180) / 360 * {sql_n(row)} - ({row} % 2) * 0.5e0)"
    return sql_pack(row, f"(({col} % {sql_n(row)}) + {sql_n(row)}) % {sql_n(row)}")


def sql_km(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Great-circle distance; takes plain column names."""
    r = num(RAD)
    h = (f"(sin(({lat2} - {lat1}) * {r} / 2) ** 2 + cos({lat1} * {r}) * cos({lat2} * {r})"
         f" * sin(({lon2} - {lon1}) * {r} / 2) ** 2)")
    return f"({num(2 * grid.EARTH_KM)} * asin(sqrt(least({h}, 1e0))))"


#: Every cell of a box around the tracks, found by listing rows and columns.
BOX_CELLS = f"""box_rows as (select unnest(generate_series(0, {ROWS - 1})) as r),
box_raw as (
  select r, unnest(generate_series(0, cast({sql_n('r')} as bigint) - 1)) as c from box_rows
  where {sql_rowlat('r')} between 50 and 67),
box_cells as (
  select {sql_pack('r', 'c')} as cell, {sql_rowlat('r')} as lat, {sql_col_lon('r', 'c')} as lon
  from box_raw where {sql_col_lon('r', 'c')} between -175 and -121)"""


def visited(t: Tables) -> DataFrame:
    return tracks(t).select(grid.cell_of("latitude", "longitude", RES).alias("cell")).distinct()


VISITED = f"visited as (select distinct {sql_cell('latitude', 'longitude')} as cell from tracks)"

START, END = "2024-01-01", "2024-01-30"


def cell_facts(t: Tables) -> DataFrame:
    """Environment per visited cell and date; cells in reach that nobody visited have none."""
    days = F.sequence(F.lit(START).cast("date"), F.lit(END).cast("date"))
    rows = visited(t).withColumn("date", F.explode(days))
    day = F.dayofmonth("date")
    return rows.select(
        "cell", "date",
        (10 + F.col("cell") % 97 / 2.0 + day).alias("mixed_layer_thickness"),
        (30 + (F.col("cell") % 1000 * 7 + day) % 100 / 50.0).alias("salinity"),
    )


CELL_FACTS = f"""fact_days as (
  select cast(unnest(generate_series(timestamp '{START}', timestamp '{END}', interval 1 day)) as date) as date),
cell_facts as (
  select cell, date, 10 + cell % 97 / 2.0e0 + day(date) as mixed_layer_thickness,
    30 + (cell % 1000 * 7 + day(date)) % 100 / 50.0e0 as salinity
  from visited, fact_days)"""

# --- categorical decisions -----------------------------------------------------------------

def order_decisions(t: Tables) -> DataFrame:
    """One decision per order: which priority did the customer choose that month?"""
    return t.orders.select(
        F.col("o_custkey").alias("_individual"), F.col("o_orderkey").alias("_decision"),
        F.col("o_orderpriority").alias("actual"), F.col("o_totalprice").alias("price"),
        F.to_date("o_orderdate").alias("date"),
        (F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("long").alias("month"),
        (F.col("o_custkey") % 3 != 0).alias("_train"),
    )


ORDER_DECISIONS = """order_decisions as (
  select o_custkey as _individual, o_orderkey as _decision, o_orderpriority as actual, o_totalprice as price,
    cast(o_orderdate as date) as date,
    cast(year(o_orderdate) * 100 + month(o_orderdate) as bigint) as month, o_custkey % 3 <> 0 as _train
  from orders)"""


def priority_facts(t: Tables) -> DataFrame:
    """Context per (month, priority)."""
    return (
        order_decisions(t).groupBy("month", F.col("actual").alias("priority"))
        .agg(F.avg("price").alias("avg_price"), F.max("price").alias("max_price"), F.count(F.lit(1)).alias("n"))
    )


PRIORITY_FACTS = """priority_facts as (
  select month, actual as priority, avg(price) as avg_price, max(price) as max_price, count(*) as n
  from order_decisions group by 1, 2)"""


def nation_facts(t: Tables) -> DataFrame:
    """What a nation's customers chose the month before; a class nobody chose has no row."""
    later = F.add_months(F.to_date("o_orderdate"), 1)
    rows = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    return rows.groupBy(
        F.col("c_nationkey").alias("nation"), (F.year(later) * 100 + F.month(later)).cast("long").alias("month"),
        F.col("o_orderpriority").alias("priority"),
    ).agg(F.count(F.lit(1)).alias("n"))


def nation_decisions(t: Tables) -> DataFrame:
    nations = t.customer.select(F.col("c_custkey").alias("_individual"), F.col("c_nationkey").alias("nation"))
    return order_decisions(t).join(nations, "_individual")


NATION_FACTS = """nation_facts as (
  select c_nationkey as nation, o_orderpriority as priority, count(*) as n,
    cast(year(cast(o_orderdate as date) + interval 1 month) * 100 + month(cast(o_orderdate as date) + interval 1 month) as bigint) as month
  from orders join customer on c_custkey = o_custkey group by all),
nation_decisions as (select d.*, c_nationkey as nation from order_decisions d join customer on c_custkey = _individual)"""


def scored_orders(t: Tables) -> DataFrame:
    """Five alternatives per order with a fixed linear score and its probability."""
    from tideway.operators.choices import expand_classes, mark_selected
    from tideway.operators.scoring import choice_probability

    rows = mark_selected(expand_classes(order_decisions(t), PRIORITIES, "priority"), "actual", "priority")
    return choice_probability(rows.withColumn("log_odds", score_expression()))


def score_expression() -> Column:
    return (F.col("_choice") * (F.col("_individual") % 7) - F.col("_decision") % 5 * 2) / 10.0 - F.col(
        "_choice"
    ) / 4.0


SCORED_ORDERS = """expanded as (
  select d.*, p.priority, p._choice, actual = p.priority as _selected,
    (_choice * (_individual % 7) - _decision % 5 * 2) / 10.0e0 - _choice / 4.0e0 as log_odds
  from order_decisions d,
    (values ('1-URGENT', 1), ('2-HIGH', 2), ('3-MEDIUM', 3), ('4-NOT SPECIFIED', 4), ('5-LOW', 5)) p(priority, _choice)),
scored as (
  select *, exp(log_odds) as odds, sum(exp(log_odds)) over (partition by _individual, _decision) as sum_odds,
    exp(log_odds) / sum(exp(log_odds)) over (partition by _individual, _decision) as probability
  from expanded)"""

SCORED = (ORDER_DECISIONS, SCORED_ORDERS)
