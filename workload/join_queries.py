"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideway.operators import aggregates, joins
from tideway.operators.choices import expand_classes, expand_by_context
from tideway.operators.propagation import step_mass
from tideway.operators.scoring import scored_back
from workload.derive import (
    EVENT_TYPES, ORDER_DECISIONS, PRIORITIES, PRIORITY_FACTS, TELEMETRY, TRACKS, SCORED,
    order_decisions, priority_facts, scored_orders, telemetry, tracks, with_sql,
)
from workload.registry import Tables, q2, q6, query, r2, r6


@query("j01_equi_join", f"""
select l_orderkey, l_linenumber, l_partkey, o_custkey, {q2('l_extendedprice')} as price from lineitem join orders on l_orderkey = o_orderkey""")
def j01(t: Tables):
    orders = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", r2("l_extendedprice").alias("price"))
    return joins.join_on(rows, orders, ["l_orderkey"])


@query("j02_floored_key", with_sql(TELEMETRY) + """
select t.event_id, t.tag_key, t.epoch, d.n from telemetry t
join (select tag_key, epoch - epoch % 86400 as day, count(*) as n from telemetry group by 1, 2) d
  on d.tag_key = t.tag_key and d.day = t.epoch - t.epoch % 86400""")
def j02(t):
    rows = telemetry(t).select("event_id", "tag_key", "epoch")
    day = (F.col("epoch") - F.col("epoch") % 86400).alias("day")
    daily = rows.groupBy("tag_key", day).agg(F.count(F.lit(1)).alias("n"))
    return joins.join_floored(rows, daily, ["tag_key"], "epoch", 86400, "day")


@query("j03_star_join", with_sql(ORDER_DECISIONS, PRIORITY_FACTS) + f"""
select d._decision, c.priority, {q6('f.avg_price')} as avg_price, g.lines
from order_decisions d, (values ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('4-NOT SPECIFIED'), ('5-LOW')) c(priority)
join priority_facts f on f.month = d.month and f.priority = c.priority
join (select cast(year(o_orderdate) * 100 + month(o_orderdate) as bigint) as month, o_orderpriority as priority, count(*) as lines
  from orders join lineitem on l_orderkey = o_orderkey group by 1, 2) g on g.month = d.month and g.priority = c.priority""")
def j03(t):
    choices = expand_classes(order_decisions(t).select("_decision", "month"), PRIORITIES, "priority")
    months = t.orders.select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("priority"),
        (F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("long").alias("month"),
    )
    lines = t.lineitem.join(months, "l_orderkey").groupBy("month", "priority").agg(F.count(F.lit(1)).alias("lines"))
    out = joins.join_context(choices, [priority_facts(t), lines], ["month", "priority"])
    return out.select("_decision", "priority", r6("avg_price").alias("avg_price"), "lines")


@query("j04_constant_predicates", """
select l_orderkey, l_linenumber, l_partkey, o_custkey from lineitem join orders on l_orderkey = o_orderkey
  and o_orderstatus = 'O' and o_orderpriority = '1-URGENT'""")
def j04(t):
    orders = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderstatus", "o_orderpriority")
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    return joins.join_constant(rows, orders, ["l_orderkey"], o_orderstatus="O", o_orderpriority="1-URGENT")


@query("j05_dimension_join", """
select c_custkey, n_name, r_name from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey""")
def j05(t):
    dim = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("c_nationkey"), "n_name", "r_name"
    )
    return joins.join_on(t.customer.select("c_custkey", "c_nationkey"), dim, ["c_nationkey"]).drop("c_nationkey")


@query("j07_unnest", """
select vec_id, label, i as place, cast(floor(embedding[i + 1] * 1000) as bigint) as component
from (select *, unnest(generate_series(0, len(embedding) - 1)) as i from embeddings)""")
def j07(t):
    rows = t.embeddings.select("vec_id", "label", F.posexplode("embedding").alias("place", "x"))
    return rows.select("vec_id", "label", F.col("place").cast("long").alias("place"), F.floor(F.col("x") * F.lit(1000).cast("float")).alias("component"))


@query("j08_left_join_of_aggregates", f"""
with a as (select c_custkey, avg(c_acctbal) as balance from customer group by 1),
b as (select o_custkey, avg(o_totalprice) as price from orders group by 1)
select a.c_custkey, {q6('a.balance')} as balance, {q6('coalesce(b.price, -1)')} as price, {q6('coalesce(b.price - a.balance, -1)')} as diff
from a left join b on a.c_custkey = b.o_custkey""")
def j08(t):
    a = t.customer.groupBy("c_custkey").agg(F.avg("c_acctbal").alias("balance"))
    b = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.avg("o_totalprice").alias("price"))
    out = joins.join_on(a, b, ["c_custkey"], "left")
    return out.select(
        "c_custkey", r6("balance").alias("balance"), r6(F.coalesce("price", F.lit(-1.0))).alias("price"),
        r6(F.coalesce(F.col("price") - F.col("balance"), F.lit(-1.0))).alias("diff"),
    )


@query("j09_outer_fill", """
select coalesce(a.k, b.k) as k, coalesce(a.total, 360) as total, coalesce(b.price, 360) as price
from (select o_custkey as k, max(o_totalprice) as total from orders group by 1) a
full join (select l_partkey as k, max(l_extendedprice) as price from lineitem group by 1) b on a.k = b.k""")
def j09(t):
    a = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("total"))
    b = t.lineitem.groupBy(F.col("l_partkey").alias("k")).agg(F.max("l_extendedprice").alias("price"))
    return joins.outer_fill(a, b, ["k"], {"total": 360.0, "price": 360.0})


@query("j10_natural_join", """
select s_suppkey, n_name from supplier join nation on n_nationkey = s_nationkey""")
def j10(t):
    nation = t.nation.select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return joins.natural_join(t.supplier.select("s_suppkey", "s_nationkey"), nation).drop("s_nationkey")


@query("j11_semi_join", """
select o_orderkey, o_custkey from orders where o_custkey in (select o_custkey from orders group by 1 having max(o_totalprice) > 480000)""")
def j11(t):
    rich = t.orders.groupBy("o_custkey").agg(F.max("o_totalprice").alias("m")).filter("m > 480000")
    return joins.keep_keys(t.orders.select("o_orderkey", "o_custkey"), rich, ["o_custkey"])


@query("j12_paired_models", f"""
select a._decision, a.day, {q6('a.ll')} as ll_old, {q6('b.ll')} as ll_new
from (select o_orderkey as _decision, dayofmonth(o_orderdate) as day, ln(o_totalprice) as ll from orders) a
join (select l_orderkey as _decision, ln(max(l_extendedprice)) / 2 as ll from lineitem group by 1) b on a._decision = b._decision""")
def j12(t):
    key = F.col("o_orderkey").alias("_decision")
    old = t.orders.select(key, F.dayofmonth("o_orderdate").cast("long").alias("day"), r6(F.log("o_totalprice")).alias("ll"))
    new = t.lineitem.groupBy(F.col("l_orderkey").alias("_decision")).agg(r6(F.log(F.max("l_extendedprice")) / 2).alias("ll"))
    return joins.paired(old, new, ["_decision"], ["ll"], ("_old", "_new"))


@query("j13_per_distinct", f"""
select o_orderkey, {q6('cos(month(o_orderdate) / 11e0)')} as c, {q6('sin(year(o_orderdate) * 1e0)')} as s from orders""")
def j13(t):
    rows = t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    out = joins.per_distinct(
        rows, ["day"],
        lambda d: d.withColumns({"c": r6(F.cos(F.month("day") / 11.0)), "s": r6(F.sin(F.year("day") * 1.0))}),
    )
    return out.drop("day")


@query("j14_attach_row", f"""
select p_partkey, {q6('m')} as mean, {q6('s')} as sd from part, (select avg(p_retailprice) as m, stddev(p_retailprice) as s from part)""")
def j14(t):
    stats = t.part.agg(r6(F.avg("p_retailprice")).alias("mean"), r6(F.stddev_samp("p_retailprice")).alias("sd"))
    return joins.attach_row(t.part.select("p_partkey"), stats)


@query("j16_scores_back", with_sql(*SCORED) + f"""
select _individual, _decision, _choice, price, {q6('probability')} as probability from scored""")
def j16(t):
    scores = scored_orders(t)
    rows = expand_classes(order_decisions(t), PRIORITIES, "priority").select("_individual", "_decision", "_choice", "price")
    return scored_back(rows, scores.withColumn("probability", r6("probability")))


@query("j17_state_by_transition", f"""
with m as (select event_type, cast(ts as date) as date, count(*) as q from events group by 1, 2),
tr as (select o.i as origin_cell, c.i as cell, dd.date, (c.i + o.i) / (5e0 * o.i + 10) as probability
  from (select unnest(range(5)) as i) o, (select unnest(range(5)) as i) c, (select distinct cast(ts as date) as date from events) dd),
st as (select case event_type when 'click' then 0 when 'error' then 1 when 'purchase' then 2 when 'signup' then 3 else 4 end as cell, date, q from m)
select tr.cell, strftime(st.date + 1, '%Y-%m-%d') as date, {q6('sum(q * probability)')} as _quanta
from st join tr on tr.origin_cell = st.cell and tr.date = st.date group by tr.cell, st.date""")
def j17(t):
    code = F.array_position(F.array(*[F.lit(e) for e in EVENT_TYPES]), F.col("event_type")) - 1
    rows = t.events.select(code.alias("cell"), F.to_date("ts").alias("date"))
    state = rows.groupBy("cell", "date").agg(F.count(F.lit(1)).cast("double").alias("_quanta"))
    days = rows.select("date").distinct()
    five = F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))
    table = days.withColumn("origin_cell", F.explode(five)).withColumn("cell", F.explode(five))
    table = table.withColumn("probability", (F.col("cell") + F.col("origin_cell")) / (5.0 * F.col("origin_cell") + 10))
    out = step_mass(state, table)
    return out.select("cell", F.date_format("date", "yyyy-MM-dd").alias("date"), r6("_quanta").alias("_quanta"))


@query("j18_anti_join", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 400000)")
def j18(t):
    return joins.drop_keys(t.customer.select("c_custkey"), t.orders.filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("j19_track_by_day", with_sql(TELEMETRY, TRACKS) + f"""
select event_id, {q6('latitude')} as latitude, {q6('longitude')} as longitude from telemetry t join tracks k
  on k.tag_key = t.tag_key and k.date = cast(make_timestamp(t.epoch * 1000000) as date)""")
def j19(t):
    from tideway.functions.scalar import epoch_date

    rows = telemetry(t).select("event_id", "tag_key", epoch_date("epoch").alias("date"))
    out = joins.join_on(rows, tracks(t), ["tag_key", "date"])
    return out.select("event_id", r6("latitude").alias("latitude"), r6("longitude").alias("longitude"))


@query("d15_expand_by_context", with_sql(ORDER_DECISIONS, PRIORITY_FACTS) + f"""
select d._decision, f.priority, list_position(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'], f.priority) as _choice,
  {q6('f.avg_price')} as avg_price from order_decisions d join priority_facts f on f.month = d.month""")
def d15_context(t):
    out = expand_by_context(order_decisions(t), priority_facts(t), ["month"], "priority", PRIORITIES)
    return out.select("_decision", "priority", "_choice", r6("avg_price").alias("avg_price"))
