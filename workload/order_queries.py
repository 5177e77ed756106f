"""Window functions, sorts, limits, samples and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideway.operators import aggregates, joins, ranking, sampling
from tideway.operators.choices import expand_classes, sequence_decisions
from tideway.streaming.runs import run_to_end
from tideway.streaming.states import stream_bucket_first, stream_next_state
from workload.derive import (
    ORDER_DECISIONS, PRIORITIES, SCORED, TELEMETRY, order_decisions, scored_orders, telemetry, with_sql,
)
from workload.registry import Tables, q2, q6, query, r2, r6


def timed_events(t: Tables):
    return telemetry(t).join(t.events.select("event_id", "event_type"), "event_id")


TIMED = """timed as (select t.*, e.event_type from telemetry t join events e on e.event_id = t.event_id)"""


@query("w01_row_number", with_sql(TELEMETRY) + """
select event_id, tag_key, row_number() over (partition by tag_key order by epoch, event_id) as _decision from telemetry""")
def w01(t: Tables):
    rows = telemetry(t).select("event_id", "tag_key", "epoch")
    out = ranking.rank_within(rows, ["tag_key"], ["epoch", "event_id"], "_decision")
    return out.select("event_id", "tag_key", F.col("_decision").cast("long").alias("_decision"))


@query("w02_lead", with_sql(TELEMETRY, TIMED) + """
select event_id, row_number() over w as _decision, coalesce(lead(event_type) over w, 'none') as next
from timed window w as (partition by tag_key order by epoch, event_id)""")
def w02(t):
    rows = timed_events(t).select("event_id", "tag_key", "epoch", "event_type")
    out = sequence_decisions(rows, "tag_key", "epoch", "event_type", tie=["event_id"], next_name="next")
    return out.select(
        "event_id", F.col("_decision").cast("long").alias("_decision"), F.coalesce("next", F.lit("none")).alias("next")
    )


#: Where the watermark of a stream of all events ends, with two hours of lateness.
STREAMED = """streamed as (select date_trunc('milliseconds', max(ts)) - interval 2 hour as passed from events)"""


def event_stream(t):
    """The events as a stream of the table's files."""
    stream = t.stream("events")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@query("w02_stream_next", f"""
with {STREAMED}, e as (select distinct user_id, ts, event_type from events where ts is not null),
n as (select *, lead(ts) over w as next_ts, lead(event_type) over w as next_type from e
  window w as (partition by user_id order by ts, event_type nulls first))
select user_id, epoch_us(ts) as at, event_type, case when next_ts <= ts + interval 6 hour then next_type end as next_type
from n, streamed where least(ts + interval 6 hour, coalesce(next_ts, ts + interval 6 hour)) <= passed""")
def w02_stream(t):
    out = run_to_end(stream_next_state(event_stream(t), ["user_id"], "ts", "event_type", "next_type", 6 * 3600, "2 hours"), "next")
    return out.select("user_id", F.unix_micros("ts").alias("at"), "event_type", "next_type")


@query("w05_stream_first", f"""
with {STREAMED}
select user_id, cast(epoch(ts) as bigint) - cast(epoch(ts) as bigint) % 900 as epoch, value from
  (select user_id, date_trunc('second', ts) as ts, value, row_number() over
    (partition by user_id, time_bucket(interval 15 minute, ts) order by ts, event_id) as r from events where ts is not null), streamed
where r = 1 and time_bucket(interval 15 minute, ts) + interval 15 minute <= passed""")
def w05_stream(t):
    out = run_to_end(stream_bucket_first(event_stream(t), ["user_id"], "ts", 900, "value", ["event_id"], "2 hours"), "first")
    return out.select("user_id", "epoch", "value")


@query("w03_global_ids", """
select o_orderkey, row_number() over (order by o_totalprice desc, o_orderkey) as _id from orders""")
def w03(t):
    rows = t.orders.select("o_orderkey", "o_totalprice")
    out = ranking.dense_ids(rows, [F.desc("o_totalprice"), F.asc("o_orderkey")])
    return out.select("o_orderkey", "_id")


@query("w04_choice_number", with_sql(ORDER_DECISIONS) + """
select _decision, p.priority, row_number() over (partition by _individual, _decision order by p.priority desc) as _choice
from order_decisions, (values ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('4-NOT SPECIFIED'), ('5-LOW')) p(priority)""")
def w04(t):
    rows = expand_classes(order_decisions(t), PRIORITIES, "priority").drop("_choice")
    out = ranking.choice_number(rows, ["_individual", "_decision"], [F.desc("priority")])
    return out.select("_decision", "priority", F.col("_choice").cast("long").alias("_choice"))


@query("w05_bucket_first", with_sql(TELEMETRY) + """
select tag_key, epoch - epoch % 900 as epoch, depth from telemetry
qualify row_number() over (partition by tag_key, epoch - epoch % 900 order by epoch, event_id) = 1""")
def w05(t):
    return aggregates.bucket_first(telemetry(t), ["tag_key"], "epoch", 900, "depth", ["event_id"]).select(
        "tag_key", "epoch", "depth"
    )


@query("w06_global_stats_on_rows", f"""
select event_id, {q6('avg(value) over ()')} as avg_value, {q6('stddev(value) over ()')} as std_value,
  {q6('(value - avg(value) over ()) / stddev(value) over ()')} as value from events""")
def w06(t):
    from tideway.operators.norms import standardise_in_place

    out = standardise_in_place(t.events.select("event_id", "value"), ["value"])
    return out.select("event_id", *[r6(c).alias(c) for c in ("avg_value", "std_value", "value")])


@query("w07_sum_over_decision", with_sql(*SCORED) + f"""
select _decision, _choice, {q6('sum_odds')} as sum_odds from scored""")
def w07(t):
    return scored_orders(t).select("_decision", "_choice", r6("sum_odds").alias("sum_odds"))


@query("w08_has_selected", """
select l_orderkey, l_linenumber, l_partkey, max(l_discount > 0.09) over (partition by l_orderkey) as has from lineitem""")
def w08(t):
    # an order holds a few lines, but nothing bounds them: aggregate and join back
    flags = t.lineitem.groupBy("l_orderkey").agg(F.max(F.col("l_discount") > 0.09).alias("has"))
    return joins.join_totals(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), flags, ["l_orderkey"])


@query("w09_reindex", """
select o_orderkey, dense_rank() over (order by o_custkey) - 1 as _individual from orders""")
def w09(t):
    out = ranking.reindex(t.orders.select("o_orderkey", "o_custkey"), "o_custkey")
    return out.select("o_orderkey", "_individual")


@query("w10_rolling_stay_rate", with_sql(TELEMETRY, TIMED) + f""",
moves as (select *, cast(coalesce(event_type = lag(event_type) over (partition by tag_key order by epoch, event_id), false) as double) as stay from timed)
select event_id, {q6('avg(stay) over (partition by tag_key order by epoch, event_id rows between 9 preceding and current row)')} as rolling
from moves""".replace("\n,", ","))
def w10(t):
    rows = timed_events(t).select("event_id", "tag_key", "epoch", "event_type")
    # the previous type is the next one of the reversed order
    rows = rows.withColumns({"back": -F.col("epoch"), "back_id": -F.col("event_id")})
    out = sequence_decisions(
        rows, "tag_key", "back", "event_type", tie=["back_id"], next_name="previous"
    )
    stay = F.coalesce(F.col("event_type") == F.col("previous"), F.lit(False)).cast("double")
    out = out.select("event_id", "tag_key", "epoch", stay.alias("stay"))
    out = ranking.rolling_mean(
        out, ["tag_key"], ["epoch", "event_id"], "stay", 10, block=64
    )
    return out.select("event_id", r6("rolling").alias("rolling"))


@query("o01_order_by", f"""
select o_custkey, {q2('sum(o_totalprice)')} as total from orders group by 1 order by 2 desc, 1""")
def o01(t):
    return t.orders.groupBy("o_custkey").agg(r2(F.sum("o_totalprice")).alias("total")).orderBy(F.desc("total"), "o_custkey")


@query("o02_top_one", "select l_orderkey, l_partkey, l_extendedprice from lineitem order by l_extendedprice desc, l_orderkey, l_partkey limit 1")
def o02(t):
    return t.lineitem.select("l_orderkey", "l_partkey", "l_extendedprice").orderBy(
        F.desc("l_extendedprice"), "l_orderkey", "l_partkey"
    ).limit(1)


@query("o03_row_sample", """
select event_id, user_id from events order by (event_id * 7919) % 1000003, event_id limit 2500""")
def o03(t):
    score = (F.col("event_id") * 7919) % 1000003
    return sampling.sample_rows(
        t.events.select("event_id", "user_id"), 2500, ["event_id"], score=score, slice_by=F.floor(score / 64)
    )


@query("o03_hashed_sample")
def o03_hashed(t):
    return sampling.sample_rows(t.events.select("event_id", "user_id"), 1000, ["event_id"], seed=11)


@query("o04_split_keys", """
with k as (select o_custkey, row_number() over (order by (o_custkey * 7919) % 1000003, o_custkey) as r, count(*) over () as n
  from (select distinct o_custkey from orders))
select o_custkey, r > cast(floor(0.35e0 * n) as bigint) as _train from k""")
def o04(t):
    score = (F.col("o_custkey") * 7919) % 1000003
    return sampling.split_keys(t.orders, "o_custkey", 0.35, score=score, slice_by=F.floor(score / 64))


@query("u01_union_by_name", """
select s_suppkey as k, s_acctbal as balance from supplier union all select c_custkey, c_acctbal from customer""")
def u01(t):
    a = t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("balance"))
    return a.unionByName(t.customer.select(F.col("c_acctbal").alias("balance"), F.col("c_custkey").alias("k")))


@query("u02_offset_ids", """
select s_suppkey + 91 as k from supplier union all select c_custkey from customer""")
def u02(t):
    a = ranking.offset_ids(t.supplier.select(F.col("s_suppkey").alias("k")), "k", 91)
    return a.unionByName(t.customer.select(F.col("c_custkey").alias("k")))


@query("u03_key_difference", """
select distinct l_partkey from lineitem where l_partkey not in (select l_partkey from lineitem where l_discount > 0.08)""")
def u03(t):
    high = t.lineitem.filter("l_discount > 0.08")
    return joins.drop_keys(t.lineitem.select("l_partkey"), high, ["l_partkey"]).distinct()
