"""From decisions to labelled, scaled, split, augmented and contrasted choices."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideway.operators import choices, norms, sampling
from tideway.operators.aggregates import bucket_first, bucket_mean
from tideway.operators.environment import DEPTH_CLASSES
from workload.derive import (
    NATION_FACTS, ORDER_DECISIONS, PRIORITIES, PRIORITY_FACTS, SCORED, TELEMETRY, nation_decisions, nation_facts,
    order_decisions, priority_facts,
    scored_orders, telemetry, with_sql,
)
from workload.function_queries import sql_cdf, sql_poly
from workload.registry import Tables, num, q6, query, r6

FIVE = "(values ('1-URGENT', 1), ('2-HIGH', 2), ('3-MEDIUM', 3), ('4-NOT SPECIFIED', 4), ('5-LOW', 5))"
EDGES = [int(c) for c in DEPTH_CLASSES]


def sql_edge(x: str) -> str:
    inner = "".join(f" when {x} <= {e} then {e}e0" for e in EDGES[:-1])
    return f"(case{inner} else {EDGES[-1]}e0 end)"


@query("d13_downsample", with_sql(TELEMETRY) + f"""
select m.tag_key, m.epoch, {q6('m.depth')} as mean, f.depth as first from
(select tag_key, epoch - epoch % 900 as epoch, avg(depth) as depth from telemetry where depth is not null group by 1, 2) m
join (select tag_key, epoch - epoch % 900 as epoch, depth from telemetry
  qualify row_number() over (partition by tag_key, epoch - epoch % 900 order by epoch, event_id) = 1) f
on f.tag_key = m.tag_key and f.epoch = m.epoch""")
def d13(t: Tables):
    mean = bucket_mean(telemetry(t), ["tag_key"], "epoch", 900, ["depth"]).withColumnRenamed("depth", "mean")
    first = bucket_first(telemetry(t), ["tag_key"], "epoch", 900, "depth", ["event_id"])
    return mean.join(first.withColumnRenamed("depth", "first"), ["tag_key", "epoch"]).withColumn("mean", r6("mean"))


def sql_ppf(p: str) -> str:
    from tideway.functions import normal as n

    q = f"({p} - 0.5e0)"
    rm = f"(0.180625e0 - {q} * {q})"
    mid = f"{q} * {sql_poly(rm, n.PPF_MID_NUM)} / {sql_poly(rm, n.PPF_MID_DEN)}"
    r = f"sqrt(-ln(least({p}, 1e0 - {p})))"
    ro, rt = f"({r} - 1.6e0)", f"({r} - 5e0)"
    out = f"{sql_poly(ro, n.PPF_OUT_NUM)} / {sql_poly(ro, n.PPF_OUT_DEN)}"
    tail = f"{sql_poly(rt, n.PPF_TAIL_NUM)} / {sql_poly(rt, n.PPF_TAIL_DEN)}"
    far = f"(case when {r} <= 5 then {out} else {tail} end)"
    return f"(case when abs({q}) <= 0.425e0 then {mid} when {q} < 0 then -{far} else {far} end)"


@query("d14_depth_class", f"""
with a as (select event_id, value as d, value * {num(0.08 / 1.96)} as sd, (event_id * 7919 + 13) % 1000003 / 1000003e0 as u from events),
b as (select *, (500 - d) / sd as z from a),
c as (select *, {sql_cdf('z')} as top from b),
e as (select *, least(greatest(u * top, 1e-300), {num(1 - 2.0**-53)}) as p from c),
f as (select event_id, d, least(d + sd * {sql_ppf('p')}, 500e0) as x from e)
select event_id, case when d = 0 then 25e0 else {sql_edge('x')} end as drawn, {sql_edge('d')} as edge from f""")
def d14(t):
    u = (F.col("event_id") * 7919 + 13) % 1000003 / 1000003.0
    rows = sampling.depth_class(t.events, "value", DEPTH_CLASSES, uniform=u, name="drawn")
    rows = sampling.depth_class(rows, "value", DEPTH_CLASSES, name="edge", mode="edge")
    return rows.select("event_id", "drawn", "edge")


@query("d14_class_probabilities", f"""
with a as (select event_id, value as d, value * {num(0.08 / 1.96)} as sd from events),
k as (select *, lag(c) over (order by c) as prev from (values {', '.join(f'({e}e0)' for e in EDGES)}) v(c)),
z as (select event_id, c, (c - d) / sd as z, coalesce((prev - d) / sd, -1e9) as y, (500 - d) / sd as t, prev from a, k)
select event_id, c as depth_class, {q6(f"({sql_cdf('z')} - case when prev is null then 0e0 else {sql_cdf('y')} end) / {sql_cdf('t')}")} as p from z""")
def d14_probabilities(t):
    out = sampling.class_probabilities(t.events.select("event_id", "value"), "value", DEPTH_CLASSES)
    return out.select("event_id", "depth_class", r6("p").alias("p"))


@query("d15_expand_classes", with_sql(ORDER_DECISIONS) + f"""
select _decision, priority, _choice from order_decisions, {FIVE} p(priority, _choice)""")
def d15(t):
    return choices.expand_classes(order_decisions(t), PRIORITIES, "priority").select("_decision", "priority", "_choice")


@query("d17_sequence_decisions", with_sql(ORDER_DECISIONS) + """
select _decision as o_orderkey, row_number() over w as _decision, coalesce(lead(actual) over w, 'last') as next_actual
from order_decisions window w as (partition by _individual order by date, _decision)""")
def d17(t):
    rows = order_decisions(t).withColumnRenamed("_decision", "o_orderkey").drop("month", "price")
    out = choices.sequence_decisions(rows, "_individual", "date", "actual", tie=["o_orderkey"])
    return out.select(
        "o_orderkey", F.col("_decision").cast("long").alias("_decision"),
        F.coalesce("next_actual", F.lit("last")).alias("next_actual"),
    )


@query("d18_require_selected", with_sql(ORDER_DECISIONS, NATION_FACTS) + """
select _individual, _decision, priority, _selected from (
  select d._individual, d._decision, f.priority, d.actual = f.priority as _selected,
    max(d.actual = f.priority) over (partition by d._individual, d._decision) as has
  from nation_decisions d join nation_facts f on f.nation = d.nation and f.month = d.month) where has""")
def d18(t):
    rows = choices.expand_by_context(nation_decisions(t), nation_facts(t), ["nation", "month"], "priority", PRIORITIES)
    out = choices.require_selected(choices.mark_selected(rows, "actual", "priority"))
    return out.select("_individual", "_decision", "priority", "_selected")


@query("d19_drop_trivial", with_sql(ORDER_DECISIONS, NATION_FACTS) + """
select _decision, priority from (
  select d._decision, f.priority, count(*) over (partition by d._individual, d._decision) as c
  from nation_decisions d join nation_facts f on f.nation = d.nation and f.month = d.month) where c > 1""")
def d19(t):
    rows = choices.expand_by_context(nation_decisions(t), nation_facts(t), ["nation", "month"], "priority", PRIORITIES)
    return choices.drop_trivial(rows).select("_decision", "priority")


@query("d20_restrict_moves", with_sql(*SCORED) + """
, moved as (select *, (_choice * 13 + _decision % 17) % 60 as distance from scored)
select _decision, _choice, _selected from moved where distance < 30 and (_individual, _decision) in
  (select (_individual, _decision) from moved where _selected and distance < 30)""")
def d20(t):
    rows = scored_orders(t).withColumn("distance", (F.col("_choice") * 13 + F.col("_decision") % 17) % 60)
    return choices.restrict_moves(rows, 30).select("_decision", "_choice", "_selected")


def _mix(tag, *cols):
    """Arithmetic stand-in for the hash, so that SQL can follow the draws."""
    out = F.lit(17 if tag == "decision" else 29).cast("long")
    for c in cols:
        out = (out * 7919 + c.cast("long") * 104729 + 13) % 1000003
    return out


def sql_mix(tag: str, *cols: str) -> str:
    out = "17" if tag == "decision" else "29"
    for c in cols:
        out = f"(({out} * 7919 + {c} * 104729 + 13) % 1000003)"
    return out


@query("d21_contrasts", with_sql(*SCORED) + f"""
, usable as (select _individual, _decision, sum(cast(not _selected as int)) as alt from scored group by 1, 2 having max(_selected)),
ranked as (select *, row_number() over (partition by _individual order by (_decision * 31) % 10007, _decision) as r,
  count(*) over (partition by _individual) as size from usable),
ids as (select distinct _individual, size from ranked),
draws as (select _individual, d as _draw, {sql_mix('decision', '_individual', 'd')} % size + 1 as r
  from ids, (select unnest(range(6)) as d)),
pairs as (select w._individual, w._draw, p as _pair, r._decision, {sql_mix('choice', 'w._individual', '_draw', 'p')} % alt + 1 as a
  from draws w join ranked r on r._individual = w._individual and r.r = w.r, (select unnest(range(3)) as p)),
others as (select *, row_number() over (partition by _individual, _decision order by _choice) as a from scored where not _selected)
select p._individual, p._decision, p._draw, p._pair, s._choice as selected_choice, o._choice as other_choice,
  {q6('s.probability')} as selected_probability, {q6('o.probability')} as other_probability
from pairs p join others o on o._individual = p._individual and o._decision = p._decision and o.a = p.a
join scored s on s._selected and s._individual = p._individual and s._decision = p._decision""")
def d21(t):
    rows = scored_orders(t).withColumn("probability", r6("probability"))
    order = (F.col("_decision") * 31) % 10007
    out = sampling.contrasts(
        rows, 6, 3, features=["probability"], pick=_mix, order=order
    )
    return out.select(
        "_individual", "_decision", F.col("_draw").cast("long").alias("_draw"), F.col("_pair").cast("long").alias("_pair"),
        "selected_choice", "other_choice", "selected_probability", "other_probability",
    )


@query("d21_contrast_decisions")
def d21_long(t):
    pairs = sampling.contrasts(scored_orders(t), 8, 4, features=["log_odds"], seed=3)
    long = sampling.contrast_decisions(pairs, ["log_odds"])
    return long.groupBy("_individual").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("_selected").cast("int")).alias("selected")
    )


@query("d22_pad_decisions", with_sql(*SCORED) + f"""
, slots as (select i, d._individual, d._decision from (select distinct _individual, _decision from scored) d, (select unnest(range(1, 7)) as i)),
numbered as (select *, row_number() over (partition by _individual, _decision order by _choice) as i from scored)
select s._decision, cast(s.i as bigint) as slot, coalesce(n._choice, -1) as choice, coalesce(n._selected, false) as selected,
  {q6('coalesce(n.log_odds, -1000)')} as x
from slots s left join numbered n on n._individual = s._individual and n._decision = s._decision and n.i = s.i""")
def d22(t):
    out = choices.pad_decisions(scored_orders(t), 6, ["log_odds"], {"log_odds": -1000})
    out = out.select("_decision", F.posexplode("choices").alias("slot", "c"))
    return out.select(
        "_decision", (F.col("slot") + 1).cast("long").alias("slot"), F.coalesce("c.choice", F.lit(-1)).alias("choice"),
        F.col("c.selected").alias("selected"), r6("c.log_odds").alias("x"),
    )


@query("d23_assign_shards", with_sql(ORDER_DECISIONS) + """
select _decision, _train, (_individual * 7919 + 5) % case when _train then 4 else 1 end as _shard from order_decisions""")
def d23(t):
    out = sampling.assign_shards(order_decisions(t), ["_individual"], 4, 1, pick=lambda k: k * 7919 + 5)
    return out.select("_decision", "_train", "_shard")


NORM_SPEC = {
    "price": norms.ZScore(), "a": norms.MinMax(), "b": norms.LogMinMax(tolerance=0.001),
    "c": norms.LogCentre(tolerance=0.001), "d": norms.LogRatio(tolerance=0.01), "e": norms.Scale(by=100.0),
    "f": norms.WaterDepth(), "g": norms.LogWaterDepth(),
}


def norm_inputs(t: Tables):
    price = F.col("price")
    return order_decisions(t).select(
        "_decision", "_train", "price", *[price.alias(c) for c in "abcde"],
        (F.lit(100000.0) - price).alias("f"), (F.lit(50000.0) - price).alias("g"),
    )


NORM_SQL = with_sql(ORDER_DECISIONS) + f"""
, x as (select _decision, _train, price, 100000e0 - price as f, 50000e0 - price as g from order_decisions),
p as (select avg(price) as m, stddev(price) as s, min(price) as lo, max(price) as hi, min(ln(price + 0.001)) as llo,
  max(ln(price + 0.001)) as lhi, avg(ln(price + 0.001)) as lm, min(greatest(0, -f)) as flo, max(greatest(0, -f)) as fhi,
  max(ln(greatest(-g, exp(1e0)))) as gmax from x where _train)
select _decision, {q6('(price - m) / s')} as n_price, {q6('(price - lo) / (hi - lo)')} as n_a,
  {q6('(ln(price + 0.001) - llo) / (lhi - llo)')} as n_b, {q6('ln(price + 0.001) - lm')} as n_c,
  {q6('ln(price + 0.01) / ln(hi + 0.01)')} as n_d, {q6('price / 100')} as n_e,
  {q6('(greatest(0, -f) - flo) / (fhi - flo)')} as n_f, {q6('ln(greatest(-g, exp(1e0))) / gmax')} as n_g from x, p"""


@query("d24_normalise", NORM_SQL)
def d24(t):
    rows = norm_inputs(t)
    params = norms.fit_norm(rows.filter("_train"), NORM_SPEC)
    out = norms.apply_norm(rows, NORM_SPEC, params)
    return out.select("_decision", *[r6(f"n_{c}").alias(f"n_{c}") for c in NORM_SPEC])


@query("d24_invert", with_sql(ORDER_DECISIONS) + f"""
select _decision, {q6('price')} as price, {q6('price')} as b, {q6('price')} as c, {q6('price')} as d from order_decisions""")
def d24_invert(t):
    spec = {k: NORM_SPEC[k] for k in ("price", "b", "c", "d")}
    rows = norm_inputs(t)
    params = norms.fit_norm(rows.filter("_train"), spec)
    scaled = norms.apply_norm(rows, spec, params).drop(*spec)
    return norms.invert_norm(scaled, spec, params).select("_decision", *[r6(c).alias(c) for c in spec])


@query("d25_augment", with_sql(ORDER_DECISIONS) + f"""
, copies as (select *, unnest(case when _train then range(0, 4) else [0] end) as k from order_decisions),
noise as (select *, ((_decision * 31 + k * 101) % 2001 - 1000) / 1000e0 as u from copies)
select _decision, k as _copy, _individual + k * 100000 as _individual,
  {q6('case when k = 0 then price else price * (1 + u * 0.1e0) end')} as price,
  {q6('case when k = 0 then shift else shift + u * 0.25e0 end')} as shift,
  {q6('case when k = 0 then floored else greatest(floored + u * 5, 0) end')} as floored,
  {q6(f'case when k = 0 then angle else (angle + u * {num(3.141592653589793 / 8)} + {num(2 * 3.141592653589793)}) % {num(2 * 3.141592653589793)} end')} as angle
from (select *, price / 1e5 as shift, _decision % 7 * 1e0 as floored, _decision % 6 * 1e0 as angle from noise)""")
def d25(t):
    rows = order_decisions(t).withColumns(
        {"shift": F.col("price") / 1e5, "floored": F.col("_decision") % 7 * 1.0, "angle": F.col("_decision") % 6 * 1.0}
    )

    def noise(name, half, copy):
        return ((F.col("_decision") * 31 + copy * 101) % 2001 - 1000) / 1000.0 * half

    jitter = {
        "price": ("multiply", 0.1), "shift": ("add", 0.25), "floored": ("add_floor_zero", 5.0),
        "angle": ("angle", 3.141592653589793 / 8),
    }
    out = sampling.augment(rows, 3, jitter, ["_decision"], 100000, noise=noise)
    return out.select(
        "_decision", F.col("_copy").cast("long").alias("_copy"), "_individual", *[r6(c).alias(c) for c in jitter]
    )


@query("d25_augment_hashed")
def d25_hashed(t):
    out = sampling.augment(
        order_decisions(t), 3, {"price": ("multiply", 0.1)}, ["_individual", "_decision"], 1000000, seed=5
    )
    return out.groupBy("_train", "_copy").agg(F.count(F.lit(1)).alias("n"), F.avg("price").alias("price"))


@query("d26_split_by_modulus", "select c_custkey, c_custkey % 3 <> 0 as _train from customer")
def d26(t):
    return sampling.split_by_modulus(t.customer.select("c_custkey"), "c_custkey")


@query("d26_split_hashed")
def d26_hashed(t):
    split = sampling.split_keys(t.orders, "o_custkey", 0.35, seed=1)
    return split.groupBy("_train").agg(F.count(F.lit(1)).alias("n"))
