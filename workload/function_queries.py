"""Scalar functions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tideway.functions import hashing, normal, scalar
from tideway.operators.cube import hourly_spine
from workload.derive import TELEMETRY, telemetry, with_sql
from workload.registry import Tables, num, q6, query, r6


@query("f01_floor_epoch", with_sql(TELEMETRY) + """
select event_id, epoch - epoch % 300 as five, epoch - epoch % 900 as fifteen, epoch - epoch % 86400 as day from telemetry""")
def f01(t: Tables):
    return telemetry(t).select(
        "event_id", scalar.floor_to("epoch", 300).alias("five"), scalar.floor_to("epoch", 900).alias("fifteen"),
        scalar.floor_to("epoch", 86400).alias("day"),
    )


@query("f02_epoch_parts", with_sql(TELEMETRY) + """
select event_id, strftime(make_timestamp(epoch * 1000000), '%Y-%m-%d %H:%M:%S') as stamp,
  strftime(cast(make_timestamp(epoch * 1000000) as date), '%Y-%m-%d') as day, epoch % 86400 as second from telemetry""")
def f02(t):
    return telemetry(t).select(
        "event_id", F.date_format(scalar.epoch_timestamp("epoch"), "yyyy-MM-dd HH:mm:ss").alias("stamp"),
        scalar.iso_date(scalar.epoch_date("epoch")).alias("day"), scalar.epoch_second_of_day("epoch").alias("second"),
    )


@query("f03_date_parts", """
select o_orderkey, cast(hour(o_orderdate) as int) as h, cast(month(o_orderdate) as int) as m, cast(dayofyear(o_orderdate) as int) as d,
  cast(year(o_orderdate) as int) as y from orders""")
def f03(t):
    d = "o_orderdate"
    return t.orders.select("o_orderkey", F.hour(d).alias("h"), F.month(d).alias("m"), F.dayofyear(d).alias("d"), F.year(d).alias("y"))


@query("f04_iso_date", "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day from orders")
def f04(t):
    return t.orders.select("o_orderkey", scalar.iso_date("o_orderdate").alias("day"))


@query("f05_next_day", "select o_orderkey, strftime(cast(o_orderdate as date) + 1, '%Y-%m-%d') as next from orders")
def f05(t):
    return t.orders.select("o_orderkey", scalar.iso_date(F.date_add(F.to_date("o_orderdate"), 1)).alias("next"))


@query("f06_common_year", """
select o_orderkey, strftime(make_date(2020, month(o_orderdate), day(o_orderdate)), '%Y-%m-%d') as day from orders""")
def f06(t):
    return t.orders.select("o_orderkey", scalar.iso_date(scalar.common_year("o_orderdate")).alias("day"))


@query("f07_hourly_year", """
select s_suppkey, count(*) as n, min(e) as first, max(e) as last from supplier,
  (select unnest(generate_series(1640995200, 1672531200, 3600)) as e) group by 1""")
def f07(t):
    rows = hourly_spine(t.supplier.select("s_suppkey"), 1640995200, 1672531200, spread=["s_suppkey"])
    return rows.groupBy("s_suppkey").agg(
        F.count(F.lit(1)).alias("n"), F.min("epoch").alias("first"), F.max("epoch").alias("last")
    )


@query("f08_logs_and_powers", f"""
select event_id, {q6('ln(value + 0.01)')} as l, {q6('log10(value + 0.001)')} as l10, {q6('exp(-value / 100)')} as e,
  {q6('pow(value, 0.5)')} as p from events""")
def f08(t):
    v = F.col("value")
    return t.events.select(
        "event_id", r6(F.log(v + 0.01)).alias("l"), r6(F.log10(v + 0.001)).alias("l10"), r6(F.exp(-v / 100)).alias("e"),
        r6(F.pow(v, F.lit(0.5))).alias("p"),
    )


@query("f09_angles", f"""
select event_id, {q6('sin(value)')} as s, {q6('cos(value)')} as c, {q6('atan2(value - 50, value - 20)')} as a,
  {q6('pi() * value')} as p from events""")
def f09(t):
    v = F.col("value")
    return t.events.select(
        "event_id", r6(F.sin(v)).alias("s"), r6(F.cos(v)).alias("c"), r6(F.atan2(v - 50, v - 20)).alias("a"),
        r6(F.pi() * v).alias("p"),
    )


TAU = num(2 * math.pi)


@query("f10_wrap_angle", f"""
select event_id, {q6(f'(((50 - value) % {TAU}) + {TAU}) % {TAU}')} as a from events""")
def f10(t):
    return t.events.select("event_id", r6(scalar.wrap_angle(50 - F.col("value"))).alias("a"))


@query("f11_half_even", f"""
select l_orderkey, l_linenumber, l_partkey, round_even(l_quantity / 4 * 2, 0) / 2 as half,
  {q6(f'round_even(l_discount * 10 / {num(math.pi / 8)}, 0) * {num(math.pi / 8)}')} as angle from lineitem""")
def f11(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", scalar.half_even(F.col("l_quantity") / 4, 2).alias("half"),
        r6(scalar.half_even_step(F.col("l_discount") * 10, math.pi / 8)).alias("angle"),
    )


@query("f12_floor_bin", "select c_custkey, floor(c_acctbal / 10) * 10 as bin from customer")
def f12(t):
    return t.customer.select("c_custkey", scalar.floor_bin("c_acctbal").alias("bin"))


@query("f13_uniform_draw", f"""
select event_id, {q6("cast('0x' || substr(md5('7|' || event_id), 1, 13) as bigint) / 4503599627370496e0 * 0.5e0 - 0.25e0")} as u from events""")
def f13(t):
    u = hashing.uniform_between(-0.25, 0.25, 7, "event_id", portable=True)
    return t.events.select("event_id", r6(u).alias("u"))


@query("f14_cast_nan_negate", """
select event_id, cast(value as bigint) as whole, -value as minus, event_type = 'error' as missing from events""")
def f14(t):
    x = F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value"))
    return t.events.select(
        "event_id", F.bround("value").cast("long").alias("whole"), (-F.col("value")).alias("minus"), F.isnan(x).alias("missing")
    )


@query("f15_strings", """
select o_orderkey, o_orderpriority like '1%' as urgent, split_part(o_orderpriority, '-', 2) as word,
  concat_ws('/', o_orderstatus, replace(o_orderpriority, '-', '_')) as path from orders""")
def f15(t):
    p = F.col("o_orderpriority")
    return t.orders.select(
        "o_orderkey", p.startswith("1").alias("urgent"), F.split_part(p, F.lit("-"), F.lit(2)).alias("word"),
        F.concat_ws("/", "o_orderstatus", F.replace(p, F.lit("-"), F.lit("_"))).alias("path"),
    )


@query("f16_sha256", "select o_orderkey, sha256(o_orderpriority || cast(o_orderkey as varchar)) as digest from orders")
def f16(t):
    text = F.concat("o_orderpriority", F.col("o_orderkey").cast("string"))
    return t.orders.select("o_orderkey", F.sha2(text, 256).alias("digest"))


@query("f17_grids", f"""
select c_custkey, i, {q6('i * 0.05e0')} as step, {q6('pow(10e0, 2 + i * 0.1e0)')} as power from customer,
  (select unnest(generate_series(0, 20)) as i)""")
def f17(t):
    rows = t.customer.select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("i"))
    return rows.select(
        "c_custkey", F.col("i").cast("long").alias("i"), r6(F.col("i") * 0.05).alias("step"),
        r6(F.pow(F.lit(10.0), 2 + F.col("i") * 0.1)).alias("power"),
    )


def sql_poly(x: str, coefficients) -> str:
    out = num(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = f"({out} * {x} + {num(c)})"
    return out


def sql_cdf(z: str) -> str:
    """Normal CDF in SQL from the same published coefficients."""
    n = normal
    a = f"abs({z})"
    mid = f"0.5e0 + {z} * {sql_poly(f'({z} * {z})', n.CDF_MID_NUM)} / {sql_poly(f'({z} * {z})', n.CDF_MID_DEN)}"
    out = f"exp(-{a} * {a} / 2) * {sql_poly(a, n.CDF_OUT_NUM)} / {sql_poly(a, n.CDF_OUT_DEN)}"
    inv = f"(1e0 / ({a} * {a}))"
    tail = (f"exp(-{a} * {a} / 2) * ({num(n.INV_SQRT_2PI)} - {inv} * {sql_poly(inv, n.CDF_TAIL_NUM)}"
            f" / {sql_poly(inv, n.CDF_TAIL_DEN)}) / {a}")
    upper = f"(case when {a} < 5.656854249492381e0 then {out} else {tail} end)"
    return f"(case when {a} <= 0.67448975e0 then {mid} when {z} < 0 then {upper} else 1e0 - {upper} end)"


@query("f18_normal_cdf", f"""
select event_id, {q6(sql_cdf('z'))} as p, {q6(sql_cdf('z2') + ' - ' + sql_cdf('z'))} as band
from (select event_id, (value - 60) / 20 as z, (value - 40) / 20 as z2 from events)""")
def f18(t):
    rows = t.events.select("event_id", ((F.col("value") - 60) / 20).alias("z"), ((F.col("value") - 40) / 20).alias("z2"))
    rows = rows.withColumns({"pz": normal.normal_cdf(F.col("z")), "pz2": normal.normal_cdf(F.col("z2"))})
    return rows.select("event_id", r6("pz").alias("p"), r6(F.col("pz2") - F.col("pz")).alias("band"))


@query("f19_arrays", """
select p_partkey, item from (select p_partkey, p_size, unnest(['a', 'b', 'c', 'd']) as item from part)
where item <> chr(97 + cast(p_size % 4 as int))""")
def f19(t):
    own = F.char(F.lit(97) + (F.col("p_size") % 4).cast("long"))
    rest = F.array_except(F.array(*[F.lit(c) for c in "abcd"]), F.array(own))
    return t.part.select("p_partkey", F.explode(rest).alias("item"))
