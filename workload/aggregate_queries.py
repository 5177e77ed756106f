"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideway.operators import aggregates as agg
from tideway.operators.environment import DEPTH_EDGES
from workload.derive import TELEMETRY, telemetry, with_sql
from workload.registry import Tables, q2, q6, query, r2, r6


@query("a01_bucket_mean", with_sql(TELEMETRY) + f"""
select tag_key, epoch - epoch % 300 as epoch, {q6('avg(depth)')} as depth, {q6('avg(temperature)')} as temperature
from telemetry where depth is not null and temperature is not null group by 1, 2""")
def a01(t: Tables):
    out = agg.bucket_mean(telemetry(t), ["tag_key"], "epoch", 300, ["depth", "temperature"])
    return out.withColumns({c: r6(c) for c in ("depth", "temperature")})


@query("a02_agg_by_name", f"""
select l_returnflag, l_linestatus, {q6('avg(l_quantity)')} as quantity, max(l_discount) as top, count(l_tax) as n
from lineitem group by 1, 2""")
def a02(t):
    out = agg.agg_by_name(
        t.lineitem, ["l_returnflag", "l_linestatus"],
        [("l_quantity", "avg", "quantity"), ("l_discount", "max", "top"), ("l_tax", "count", "n")],
    )
    return out.withColumn("quantity", r6("quantity"))


@query("a03_group_count", "select o_custkey, o_orderpriority, count(*) as n from orders group by 1, 2")
def a03(t):
    return t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("a04_distinct_count", "select l_suppkey, count(distinct l_orderkey) as orders, count(distinct l_partkey) as parts from lineitem group by 1")
def a04(t):
    return t.lineitem.groupBy("l_suppkey").agg(
        F.count_distinct("l_orderkey").alias("orders"), F.count_distinct("l_partkey").alias("parts")
    )


@query("a05_global_extremes", f"""
select {q6('min(ln(value + 0.001))')} as log_min, {q6('max(ln(value + 0.001))')} as log_max, min(value) as low, max(value) as high from events""")
def a05(t):
    v = F.col("value")
    return t.events.agg(
        r6(F.min(F.log(v + 0.001))).alias("log_min"), r6(F.max(F.log(v + 0.001))).alias("log_max"),
        F.min(v).alias("low"), F.max(v).alias("high"),
    )


@query("a06_mean_and_std", f"select {q6('avg(value)')} as mean, {q6('stddev(value)')} as sd from events")
def a06(t):
    return t.events.agg(r6(F.avg("value")).alias("mean"), r6(F.stddev_samp("value")).alias("sd"))


@query("a07_collapse_state", f"select event_type, strftime(ts, '%Y-%m-%d') as date, {q2('sum(value)')} as q from events group by 1, 2")
def a07(t):
    return t.events.groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("date")).agg(r2(F.sum("value")).alias("q"))


@query("a08_rate", f"select l_linenumber, {q6('avg(cast(l_discount > 0.05 as double))')} as rate from lineitem group by 1")
def a08(t):
    out = agg.rate(t.lineitem.withColumn("hit", F.col("l_discount") > 0.05), ["l_linenumber"], "hit")
    return out.withColumn("rate", r6("rate"))


@query("a09_mean_and_count", f"select month(o_orderdate) as month, {q2('avg(o_totalprice)')} as mean, count(*) as count from orders group by 1")
def a09(t):
    return t.orders.groupBy(F.month("o_orderdate").cast("long").alias("month")).agg(
        r2(F.avg("o_totalprice")).alias("mean"), F.count(F.lit(1)).alias("count")
    )


@query("a10_median_by_group", f"select o_custkey, {q6('median(o_totalprice)')} as median from orders group by 1")
def a10(t):
    out = agg.quantile(t.orders, "o_totalprice", 0.5, ["o_custkey"], "median")
    return out.withColumn("median", r6("median"))


@query("a10_quantile", f"select {q6('quantile_cont(l_extendedprice, 0.95)')} as q95 from lineitem")
def a10_quantile(t):
    return agg.quantile(t.lineitem, "l_extendedprice", 0.95, name="q95").select(r6("q95").alias("q95"))


@query("a10_describe", f"""
select count(value) as count, {q6('avg(value)')} as mean, {q6('stddev(value)')} as std, min(value) as min, max(value) as max,
  {q6('quantile_cont(value, 0.25)')} as q25, {q6('quantile_cont(value, 0.5)')} as q50, {q6('quantile_cont(value, 0.75)')} as q75 from events""")
def a10_describe(t):
    out = agg.describe(t.events, "value")
    return out.withColumns({c: r6(c) for c in ("mean", "std", "q25", "q50", "q75")})


@query("a10_stored_sketches", """
select l_returnflag, count(*) as rows, true as median_near, true as q95_near, true as orders_near from lineitem group by 1""")
def a10_sketches(t):
    """Merged sketches of (flag, line, year) groups, held against exact ranks and counts of the rows."""
    from tideway.operators.sketches import merge_sketches, read_sketches, sketch_table
    from tideway.session import materialise

    parts = sketch_table(t.lineitem, ["l_returnflag", "l_linenumber", F.year("l_shipdate").alias("year")], ["l_extendedprice"], ["l_orderkey"])
    states = merge_sketches(materialise(parts, "sketches"), ["l_returnflag"])
    price = {"median": ("l_extendedprice", 0.5), "q95": ("l_extendedprice", 0.95)}
    told = materialise(read_sketches(states, price, {"orders": "l_orderkey"}), "sketched")
    ranks = t.lineitem.join(told, "l_returnflag").groupBy("l_returnflag").agg(
        *[F.avg((F.col("l_extendedprice") <= F.col(c)).cast("double")).alias(f"{c}_rank") for c in price],
        F.count_distinct("l_orderkey").alias("exact"),
    )
    return told.join(ranks, "l_returnflag").select(
        "l_returnflag", "rows", *[(F.abs(F.col(f"{c}_rank") - q) < 0.02).alias(f"{c}_near") for c, (_, q) in price.items()],
        (F.abs(F.col("orders") / F.col("exact") - 1) < 0.04).alias("orders_near"),
    )


RUN_LOG = """run_log as (
  select l_suppkey as run_id, cast(l_linenumber as bigint) as epoch, avg(l_discount) as val_loss, avg(l_tax) as train_loss
  from lineitem group by 1, 2)"""


def run_log(t: Tables):
    return t.lineitem.groupBy(
        F.col("l_suppkey").alias("run_id"), F.col("l_linenumber").cast("long").alias("epoch")
    ).agg(F.avg("l_discount").alias("val_loss"), F.avg("l_tax").alias("train_loss"))


@query("a11_arg_min_at_last_epoch", with_sql(RUN_LOG) + f"""
select run_id, {q6('val_loss')} as val_loss from run_log where epoch = (select max(epoch) from run_log)
order by floor(val_loss * 1e9), run_id limit 1""")
def a11(t):
    from tideway.operators.evaluation import best_run

    # equal means may differ in their last bit between engines, so compare nine decimals
    log = run_log(t).withColumn("key", F.floor(F.col("val_loss") * 1e9))
    best = best_run(log, loss="key").select("run_id")
    last = log.agg(F.max("epoch").alias("e")).scalar()
    return log.filter(F.col("epoch") == last).join(best, "run_id").select("run_id", r6("val_loss").alias("val_loss"))


@query("a12_macro_mean", f"""
select c_mktsegment, {q2('avg(m)')} as mean from (select c_mktsegment, c_custkey, avg(o_totalprice) as m from customer
  join orders on o_custkey = c_custkey group by 1, 2) group by 1""")
def a12(t):
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    out = agg.macro_mean(rows, ["c_custkey"], F.col("o_totalprice"), "mean", ["c_mktsegment"])
    return out.withColumn("mean", r2("mean"))


@query("a13_micro_loss", f"select {q6('avg(-ln(l_discount + 0.01))')} as loss from lineitem")
def a13(t):
    return t.lineitem.agg(r6(F.avg(-F.log(F.col("l_discount") + 0.01))).alias("loss"))


@query("a14_distinct", "select distinct user_id, event_type from events")
def a14(t):
    return t.events.select("user_id", "event_type").distinct()


@query("a15_first_row_per_key", """
select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by ts, event_id) as r from events)
where r = 1""")
def a15(t):
    rows = t.events.select("user_id", "event_type", "ts", "event_id", "value")
    return agg.first_row(rows, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("a16_having_on_detail", """
select l_orderkey, l_linenumber, l_partkey from lineitem
where (l_orderkey, l_linenumber) in (select (l_orderkey, l_linenumber) from lineitem group by l_orderkey, l_linenumber having count(*) > 1)""")
def a16(t):
    return agg.duplicates_only(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_linenumber"])


def _bin(x: str) -> str:
    inner = "".join(f" when {x} <= {hi} then {hi}e0" for hi in DEPTH_EDGES[1:])
    return f"case when {x} <= 0 then null{inner} end"


@query("a17_bin_mean", f"""
with binned as (select l_suppkey, l_partkey % 50 as point, {_bin('l_extendedprice / 200')} as depth_bin, l_quantity, l_discount from lineitem),
pts as (select l_suppkey, point, depth_bin, avg(l_quantity) as l_quantity, avg(l_discount) as l_discount from binned
  where depth_bin is not null group by 1, 2, 3)
select l_suppkey, depth_bin, {q6('avg(l_quantity)')} as l_quantity, {q6('avg(l_discount)')} as l_discount from pts group by 1, 2""".replace("0.0e0", "0e0").replace(".0e0", "e0"))
def a17(t):
    rows = t.lineitem.select(
        "l_suppkey", (F.col("l_partkey") % 50).alias("point"), (F.col("l_extendedprice") / 200).alias("depth"),
        "l_quantity", "l_discount",
    )
    out = agg.bin_mean(rows, "depth", DEPTH_EDGES, ["point"], ["l_suppkey"], ["l_quantity", "l_discount"])
    return out.withColumns({c: r6(c) for c in ("l_quantity", "l_discount")})


@query("a18_pivot", f"""
select l_linenumber, {q6("avg(case when l_returnflag = 'A' then l_quantity end)")} as a,
  {q6("avg(case when l_returnflag = 'N' then l_quantity end)")} as n, {q6("avg(case when l_returnflag = 'R' then l_quantity end)")} as r
from lineitem group by 1""")
def a18(t):
    out = agg.pivot_mean(t.lineitem, "l_linenumber", "l_returnflag", "l_quantity", ["A", "N", "R"])
    return out.select("l_linenumber", r6("A").alias("a"), r6("N").alias("n"), r6("R").alias("r"))


@query("a19_histogram", """
with b as (select min(value) as lo, max(value) as hi from events)
select least(cast(floor((value - lo) / ((hi - lo) / 40)) as bigint), 39) as bin, count(*) as n from events, b group by 1""")
def a19(t):
    return agg.histogram(t.events, "value", 40)


@query("a20_sorted_values", "select distinct p_size from part order by p_size")
def a20(t):
    return t.part.select("p_size").distinct().orderBy("p_size")


@query("a21_log_group_size", f"""
select round_even(l_discount * 50, 0) / 50 as d, round_even(l_tax * 50, 0) / 50 as x, count(*) as n, {q6('ln(count(*))')} as log_n
from lineitem group by 1, 2""")
def a21(t):
    from tideway.functions.scalar import half_even

    out = agg.rounded_counts(t.lineitem, {"d": half_even("l_discount", 50), "x": half_even("l_tax", 50)})
    return out.withColumn("log_n", r6("log_n"))


@query("a22_melt", with_sql(RUN_LOG) + f"""
select run_id, epoch, "case", {q6('loss')} as loss from (
  select run_id, epoch, 'train' as "case", train_loss as loss from run_log
  union all select run_id, epoch, 'val', val_loss from run_log)""")
def a22(t):
    out = agg.melt(run_log(t), ["run_id", "epoch"], {"train_loss": "train", "val_loss": "val"}, "case", "loss")
    return out.withColumn("loss", r6("loss"))


@query("a23_shares", f"""
select case when value = 0 then 'none' when value <= 50 then 'to 50' when value <= 100 then '50 to 100' else 'beyond' end as band,
  count(*) as n, {q6('count(*) / (select count(*) from events)')} as share from events group by 1""")
def a23(t):
    v = F.col("value")
    band = F.when(v == 0, "none").when(v <= 50, "to 50").when(v <= 100, "50 to 100").otherwise("beyond")
    out = agg.shares(t.events, [band.alias("band")])
    return out.withColumn("share", r6("share"))
