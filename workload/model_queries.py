"""Scoring, evaluation, fitting, and the user-function surface."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tideway import transforms
from tideway.functions import grid
from tideway.operators import choice_fit, choices, evaluation, fitting, norms, sampling, scoring, table_functions, weighted
from tideway.plans import priority
from tideway.session import materialise
from workload.aggregate_queries import RUN_LOG, run_log
from workload.derive import (
    ORDER_DECISIONS, PRIORITIES, PRIORITY_FACTS, SCORED, TELEMETRY, order_decisions, priority_facts,
    scored_orders, telemetry, tracks, with_sql,
)
from workload.registry import Tables, num, q6, query, r6

SLICE_SPEC = {"avg_price": norms.ZScore(), "n": norms.MinMax()}
SLICE_MODEL = scoring.LinearModel({"n_avg_price": 0.3, "n_n": -0.7}, 0.1)

SLICE = (ORDER_DECISIONS, PRIORITY_FACTS, """labelled as (
  select d._individual, d._decision, d._train, f.priority, f.avg_price, f.n, d.actual = f.priority as _selected
  from order_decisions d join priority_facts f on f.month = d.month),
fitted as (select avg(avg_price) as m, stddev(avg_price) as s, min(n) as lo, max(n) as hi from priority_facts),
phis as (select *, 0.1e0 + 0.3e0 * (avg_price - m) / s - 0.7e0 * (n - lo) / (hi - lo) as phi from labelled, fitted),
sliced as (select *, exp(phi) / sum(exp(phi)) over (partition by _individual, _decision) as probability from phis)""")


def min_slice(t: Tables):
    facts = priority_facts(t)
    return priority.scored_choices(
        order_decisions(t), facts, ["month"], "actual", "priority", PRIORITIES, SLICE_SPEC,
        norms.fit_norm(facts, SLICE_SPEC), SLICE_MODEL,
    )


@query("min_slice_probabilities", with_sql(*SLICE) + f"""
select _decision, priority, _selected, {q6('probability')} as probability from sliced""")
def min_slice_probabilities(t):
    return min_slice(t).select("_decision", "priority", "_selected", r6("probability").alias("probability"))


@query("min_slice_split_score", with_sql(*SLICE) + f"""
, per as (select _train, _individual, avg(ln(probability)) as l, sum(probability) as p, count(*) as n from sliced where _selected group by 1, 2)
select _train, {q6('avg(l)')} as nlp, {q6('exp(avg(l))')} as geometric_p, {q6('sum(p) / sum(n)')} as correct_rate, cast(sum(n) as bigint) as n
from per group by 1""")
def min_slice_split_score(t):
    out = priority.split_score(min_slice(t))
    return out.select("_train", r6("nlp").alias("nlp"), r6("geometric_p").alias("geometric_p"), r6("correct_rate").alias("correct_rate"), "n")


@query("d27_linear_score", f"""
select l_orderkey, l_linenumber, l_partkey, {q6('0.5e0 + 2e0 * l_discount - 1.5e0 * l_tax + 0.01e0 * l_quantity')} as log_odds from lineitem""")
def d27(t):
    model = scoring.LinearModel({"l_discount": 2.0, "l_tax": -1.5, "l_quantity": 0.01}, 0.5)
    return scoring.score(t.lineitem, model).select("l_orderkey", "l_linenumber", "l_partkey", r6("log_odds").alias("log_odds"))


MLP_FEATURES = ["l_discount", "l_tax", "l_quantity"]
MLP_LAYERS = [
    ([[1.5, -2.0, 0.5, 3.0], [0.25, 1.0, -4.0, 2.0], [0.02, -0.01, 0.03, 0.0]], [0.1, 0.0, -0.2, -0.3]),
    ([[0.5, -1.0], [1.0, 0.25], [-0.5, 2.0], [1.5, 0.75]], [0.05, -0.1]),
    ([[1.25], [-0.8]], [0.3]),
]


def sql_mlp() -> str:
    source, names = "lineitem", MLP_FEATURES
    for i, (weights, bias) in enumerate(MLP_LAYERS):
        outs = []
        for j in range(len(bias)):
            body = " + ".join(f"{num(weights[k][j])} * {names[k]}" for k in range(len(names))) + f" + {num(bias[j])}"
            outs.append(f"{body if i == len(MLP_LAYERS) - 1 else f'greatest({body}, 0e0)'} as h{i}_{j}")
        source = f"(select *, {', '.join(outs)} from {source})"
        names = [f"h{i}_{j}" for j in range(len(bias))]
    return f"select l_orderkey, l_linenumber, l_partkey, {q6(names[0])} as log_odds from {source}"


@query("d27_network_score", sql_mlp())
def d27_network(t):
    out = scoring.score(t.lineitem, scoring.MlpModel(MLP_FEATURES, MLP_LAYERS))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", r6("log_odds").alias("log_odds"))


@query("d28_choice_probability", with_sql(*SCORED) + f"""
select _decision, _choice, {q6('odds')} as odds, {q6('sum_odds')} as sum_odds, {q6('probability')} as probability from scored""")
def d28(t):
    return scored_orders(t).select("_decision", "_choice", *[r6(c).alias(c) for c in ("odds", "sum_odds", "probability")])


@query("d28_wide_decisions", f"""
select event_id, {q6('exp(value / 40) / sum(exp(value / 40)) over (partition by user_id) * 1000')} as probability from events""")
def d28_wide(t):
    # all events of a user as one decision: a group of any size
    rows = t.events.select("event_id", "user_id", (F.col("value") / 40).alias("log_odds"))
    out = scoring.choice_probability(rows, ["user_id"], wide=True)
    return out.select("event_id", r6(F.col("probability") * 1000).alias("probability"))


@query("d29_renormalise", with_sql(*SCORED) + f"""
select _decision, _choice, {q6('odds / sum(odds) over (partition by _individual, _decision)')} as probability from scored where _choice <> 3""")
def d29(t):
    out = scoring.renormalise(scored_orders(t), F.col("_choice") != 3)
    return out.select("_decision", "_choice", r6("probability").alias("probability"))


@query("d30_null_model", with_sql(*SCORED) + f"""
select _decision, _choice, {q6('1e0 / count(*) over (partition by _individual, _decision)')} as probability from scored""")
def d30(t):
    out = scoring.null_model(scored_orders(t))
    return out.select("_decision", "_choice", r6("probability").alias("probability"))


@query("d31_decision_score", with_sql(*SCORED) + f"""
, per as (select _train, _individual, avg(ln(probability)) as l, sum(probability) as p, count(*) as n from scored where _selected group by 1, 2)
select _train, {q6('avg(l)')} as nlp, {q6('exp(avg(l))')} as geometric_p, {q6('sum(p) / sum(n)')} as correct_rate, cast(sum(n) as bigint) as n
from per group by 1""")
def d31(t):
    out = evaluation.nlp(scored_orders(t), by=["_train"])
    return out.select("_train", *[r6(c).alias(c) for c in ("nlp", "geometric_p", "correct_rate")], "n")


@query("d31_contrast_score", with_sql(*SCORED) + f"""
select {q6('avg(ln(probability))')} as nlp, {q6('exp(avg(ln(probability)))')} as geometric_p, {q6('avg(probability)')} as correct_rate, count(*) as n
from scored where _selected""")
def d31_contrast(t):
    out = evaluation.nlp(scored_orders(t), "contrast")
    return out.select(*[r6(c).alias(c) for c in ("nlp", "geometric_p", "correct_rate")], "n")


@query("d32_compare_models", with_sql(*SCORED) + f"""
select _train, _individual, {q6('avg(ln(probability) - ln(0.2e0))')} as difference, count(*) as n from scored where _selected group by 1, 2""")
def d32(t):
    new = scored_orders(t)
    out = evaluation.compare_models(
        new, scoring.null_model(new), ["_train", "_individual", "_decision"], ["_train", "_individual"]
    )
    return out.withColumn("difference", r6("difference"))


@query("d32_compare_chain", with_sql(*SCORED) + f"""
, third as (select *, odds / sum(odds) over (partition by _individual, _decision) as p3 from scored where _choice <> 2)
select s._individual, 'linear - null' as step, {q6('sum(ln(probability) - ln(0.2e0))')} as difference, count(*) as n from scored s where _selected group by 1
union all
select s._individual, 'short - linear', {q6('sum(ln(p3) - ln(s.probability))')}, count(*) from scored s
  join third h on h._decision = s._decision and h._selected where s._selected group by 1""")
def d32_chain(t):
    linear = scored_orders(t)
    models = [("null", scoring.null_model(linear)), ("linear", linear), ("short", scoring.renormalise(linear, F.col("_choice") != 2))]
    out = evaluation.compare_chain(models, ["_individual", "_decision"], ["_individual"], "sum")
    return out.select("_individual", "step", r6("difference").alias("difference"), "n")


@query("d33_calibration", with_sql(*SCORED) + f"""
select priority, {q6('avg(cast(_selected as double))')} as selected_rate, {q6('avg(probability)')} as probability, 0.2e0 as null_probability
from scored group by 1""")
def d33(t):
    rows = scoring.null_model(scored_orders(t), probability="null_probability")
    out = evaluation.calibration(rows, ["priority"], probabilities=["probability", "null_probability"])
    return out.select("priority", *[r6(c).alias(c) for c in ("selected_rate", "probability")], r6("null_probability").alias("null_probability"))


@query("d34_response_curve", with_sql(*SCORED) + f"""
select _train, priority, round_even(price / 1e5 * 20, 0) / 20 as bin, {q6('avg(cast(_selected as double))')} as fraction,
  {q6('avg(probability)')} as probability from scored group by 1, 2, 3""")
def d34(t):
    rows = scored_orders(t).withColumn("x", F.col("price") / 1e5)
    by = ["_train", "priority"]
    a = evaluation.selection_curve(rows, "x", 20, by)
    b = evaluation.probability_curve(rows, "x", 20, by)
    return a.join(b, [*by, "bin"]).select(*by, "bin", r6("fraction").alias("fraction"), r6("probability").alias("probability"))


@query("d35_monthly_score", with_sql(*SCORED) + f"""
select month(date) as month, {q6('avg(ln(probability))')} as mean, count(*) as count from scored where _selected and not _train group by 1""")
def d35(t):
    out = evaluation.monthly_score(scored_orders(t), "date")
    return out.select(F.col("month").cast("long").alias("month"), r6("mean").alias("mean"), "count")


@query("d36_min_decisions", with_sql(ORDER_DECISIONS) + """
select _individual, _decision from order_decisions where _individual in
  (select _individual from order_decisions group by 1 having count(distinct _decision) >= 10)""")
def d36(t):
    return choices.min_decisions(order_decisions(t), 10).select("_individual", "_decision")


CONFIG = """configs as (select s_suppkey as run_id, s_nationkey % 4 as num_layers, 8 * (1 + s_suppkey % 3) as layer_size,
  (s_suppkey % 5) / 10e0 as dropout from supplier)"""


@query("d45_run_table", with_sql(RUN_LOG, CONFIG) + f"""
select layer_size, dropout, {q6('median(val_loss)')} as median_loss, count(*) as n from configs c
join run_log l on l.run_id = c.run_id and l.epoch = 6 group by 1, 2""")
def d45(t):
    k = F.col("s_suppkey")
    configs = t.supplier.select(
        k.alias("run_id"),
        F.struct(
            (F.col("s_nationkey") % 4).alias("num_layers"), (8 * (1 + k % 3)).alias("layer_size"), (k % 5 / 10.0).alias("dropout"),
            F.array(F.lit("dense")).alias("layers"),
        ).alias("config"),
    )
    rows = materialise(evaluation.run_table(configs, run_log(t), 6, drop=["layers"]), "run-table")
    from tideway.operators.aggregates import quantile

    by = ["layer_size", "dropout"]
    medians = quantile(rows, "val_loss", 0.5, by, "median_loss")
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return medians.join(counts, by).select(*by, r6("median_loss").alias("median_loss"), "n")


def fit_rows(t):
    return scored_orders(t).withColumns({"x1": F.col("_choice") / 5.0, "x2": F.col("_individual") % 7 * F.col("_choice") / 35.0})


@query("d46_fit_contrast_logit")
def d46(t):
    pairs = sampling.contrasts(fit_rows(t), 20, 4, features=["x1", "x2"], seed=9)
    model = fitting.fit_contrast_logit(pairs, ["x1", "x2"])
    fitted = scoring.choice_probability(scoring.score(fit_rows(t), model))
    return evaluation.nlp(fitted, by=["_train"]).withColumns({k: F.lit(w) for k, w in model.weights.items()})


NEWTON = 6


def sql_newton() -> str:
    """Newton steps from zero for two features, unrolled; the last round gives gradient and likelihood at the solution."""
    parts = ["""rows as (select _individual as i, _decision as d, _selected as s, _choice / 5e0 as x1, _individual % 7 * _choice / 35e0 as x2 from scored
  where _selected is not null),
usable as (select i, d from rows group by 1, 2 having count(*) filter (s) = 1),
kept as materialized (select rows.* from rows join usable using (i, d)), w0 as (select 0e0 as w1, 0e0 as w2)"""]
    for n in range(NEWTON + 1):
        parts.append(f"""p{n} as (select i, d, s, x1, x2, exp(x1 * w1 + x2 * w2) as e, x1 * w1 + x2 * w2 as u from kept, w{n}),
m{n} as (select i, d, sum(x1 * e) / sum(e) as m1, sum(x2 * e) / sum(e) as m2, sum(x1 * x1 * e) / sum(e) as q11, sum(x1 * x2 * e) / sum(e) as q12,
  sum(x2 * x2 * e) / sum(e) as q22, max(x1) filter (s) as s1, max(x2) filter (s) as s2, max(u) filter (s) - ln(sum(e)) as ll from p{n} group by 1, 2),
h{n} as (select count(*) as n, sum(s1 - m1) as g1, sum(s2 - m2) as g2, sum(q11 - m1 * m1) as a, sum(q12 - m1 * m2) as b, sum(q22 - m2 * m2) as c, sum(ll) as ll from m{n})""")
        if n < NEWTON:
            parts.append(f"w{n + 1} as (select w1 + (c * g1 - b * g2) / (a * c - b * b) as w1, w2 + (a * g2 - b * g1) / (a * c - b * b) as w2 from w{n}, h{n})")
    return ", " + ",\n".join(parts)


@query("d46_fit_choice_logit", with_sql(*SCORED) + sql_newton() + f"""
select {q6('w1')} as w1, {q6('w2')} as w2, {q6('abs(g1)')} as g1, {q6('abs(g2)')} as g2, {q6('ll / n')} as nlp, n as decisions from w{NEWTON}, h{NEWTON}""")
def d46_choice(t):
    fit = choice_fit.fit_choice_logit(fit_rows(t), ["_individual", "_decision"], ["x1", "x2"])
    row = {"w1": fit.model.weights["x1"], "w2": fit.model.weights["x2"], "g1": abs(fit.gradient["x1"]), "g2": abs(fit.gradient["x2"]),
           "nlp": fit.log_likelihood / fit.decisions}
    one = t.spark.range(1).select(*[r6(F.lit(v)).alias(k) for k, v in row.items()], F.lit(fit.decisions).cast("long").alias("decisions"))
    return one


ROUNDS = 4


def sql_rounds() -> str:
    parts = ["u0 as (select priority, 1e0 as odds from (select distinct priority from scored))"]
    for i in range(ROUNDS):
        parts.append(f"""r{i} as (select s.priority, s._selected, u.odds,
  u.odds / sum(u.odds) over (partition by _individual, _decision) as p from kept s join u{i} u on u.priority = s.priority),
u{i + 1} as (select priority, avg(odds * (1 + case when _selected then 1 - p else -p end)) as odds from r{i} group by 1)""")
    return ", kept as (select * from scored ),\n" + ",\n".join(parts) + "\n"


@query("d47_fit_tabular_odds", with_sql(*SCORED) + sql_rounds() + f"""
select priority, {q6('odds')} as odds from u{ROUNDS}""")
def d47(t):
    rows = scored_orders(t)
    out = fitting.fit_tabular_odds(rows, "priority", ROUNDS, checkpoint_every=2)
    return out.withColumn("odds", r6("odds"))


@query("d48_relative_density", f"""
with g as (select n_regionkey as region, c_mktsegment as origin, count(*) as n, avg(c_acctbal) + 1000 as rho from customer
  join nation on n_nationkey = c_nationkey group by 1, 2)
select region, origin, {q6('n * rho / sum(n * rho) over (partition by region)')} as relative_density from g""")
def d48(t):
    rows = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    g = rows.groupBy(F.col("n_regionkey").alias("region"), F.col("c_mktsegment").alias("origin")).agg(
        F.count(F.lit(1)).alias("n"), (F.avg("c_acctbal") + 1000).alias("rho")
    )
    out = evaluation.relative_density(g, "region", "origin", "n", "rho")
    return out.select("region", "origin", r6("relative_density").alias("relative_density"))


@query("d48_density_weights", f"""
with a as (select event_type, count(*) as n from events group by 1), b as (select event_type, count(distinct user_id) as n from events group by 1)
select a.event_type, {q6('a.n / (select sum(n) from a)')} as rho, {q6('b.n / (select sum(n) from b)')} as p,
  {q6('(a.n / (select sum(n) from a)) / (b.n / (select sum(n) from b))')} as weight from a join b on a.event_type = b.event_type""")
def d48_weights(t):
    a = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    b = t.events.groupBy("event_type").agg(F.count_distinct("user_id").alias("n"))
    out = evaluation.density_weights(a, b, "event_type")
    return out.select("event_type", *[r6(c).alias(c) for c in ("rho", "p", "weight")])


def spend(t):
    """What every customer of a segment spent: weights of a draw."""
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy(F.col("c_mktsegment").alias("segment"), "o_custkey").agg(F.sum("o_totalprice").alias("spent"))


@query("o05_alias_shares", f"""
with s as (select c_mktsegment as segment, o_custkey, sum(o_totalprice) as spent from orders join customer on o_custkey = c_custkey group by 1, 2)
select segment, o_custkey, {q6('spent / sum(spent) over (partition by segment)')} as share from s""")
def o05_shares(t):
    """The chance that the alias tables give every customer: what it keeps and what others leave to it, over all levels."""
    levels = weighted.alias_levels(spend(t), "segment", "o_custkey", "spent", 64)
    share = None
    for level in reversed(levels):
        own = level.select("group", "slice", "item", (F.col("keep") / F.col("size")).alias("p"))
        left = level.select("group", "slice", F.col("other").alias("item"), ((1 - F.col("keep")) / F.col("size")).alias("p"))
        now = own.union(left).groupBy("group", "slice", "item").agg(F.sum("p").alias("p"))
        if share is not None:
            now = now.join(share, ["group", "slice"]).withColumn("p", F.col("p") * F.col("above"))
        share = now.select("group", F.col("item").alias("slice"), F.col("p").alias("above"))
    return share.select(F.col("group").alias("segment"), F.col("slice").alias("o_custkey"), r6("above").alias("share"))


@query("o05_weighted_draws")
def o05_draws(t):
    drawn = weighted.weighted_draws(spend(t), "segment", "o_custkey", "spent", 500, seed=3, slice_rows=64)
    return drawn.groupBy("segment", "o_custkey").agg(F.count(F.lit(1)).alias("draws"))


# --- user functions -------------------------------------------------------------------------

@query("x01_native_in_place_of_scalar_function", f"select event_id, {q6('sqrt(value) * 2')} as y from events")
def x01(t):
    return t.events.transform(transforms.named("add_column", lambda v: r6(F.sqrt(v) * 2), ["value"], "y")).select("event_id", "y")


@query("x02_struct_result", f"""
select event_id, {q6('value / 2')} as half, {q6('value * value')} as square from events""")
def x02(t):
    rows = t.events.withColumn("s", F.struct(r6(F.col("value") / 2).alias("half"), r6(F.col("value") * F.col("value")).alias("square")))
    return rows.select("event_id", "s.*")


@query("x03_array_result", """
select o_orderkey, unnest(generate_series(0, o_orderkey % 4)) as step from orders""")
def x03(t):
    return t.orders.select("o_orderkey", F.explode(F.sequence(F.lit(0).cast("long"), F.col("o_orderkey") % 4)).alias("step"))


@query("x03_table_function", """
with e as (select user_id, date_trunc('day', ts)::date as day, ts, event_id, value from events where value is not null and ts is not null),
s as (select *, coalesce(last_value(case when value >= 20 then 1 when value < 5 then 0 end ignore nulls)
  over (partition by user_id, day order by ts, event_id rows unbounded preceding), 0) as inside from e),
b as (select *, case when inside = 1 and coalesce(lag(inside) over (partition by user_id, day order by ts, event_id), 0) = 0
  then 1 else 0 end as begins from s),
n as (select *, sum(begins) over (partition by user_id, day order by ts, event_id rows unbounded preceding) as episode from b)
select user_id, day::varchar as day, epoch_us(min(ts)) as start, epoch_us(max(ts)) as "end", count(*) as n, max(value) as peak
from n where inside = 1 group by user_id, day, episode""")
def x03_episodes(t):
    rows = t.events.withColumn("day", F.to_date("ts"))
    out = table_functions.episodes(rows, ["user_id", "day"], "ts", "value", enter=20, leave=5, tie="event_id")
    micros = {c: F.unix_micros(F.col(c).cast("timestamp")) for c in ("start", "end")}
    return out.withColumns({"day": F.col("day").cast("string"), **micros})


@query("x04_vectorised_function", f"select event_id, {q6('sin(value) + cos(value)')} as y from events")
def x04(t):
    @F.pandas_udf("double")
    def wave(v: pd.Series) -> pd.Series:
        return np.sin(v) + np.cos(v)

    return t.events.select("event_id", r6(wave("value")).alias("y"))


def _squash(scale, batch):
    return np.tanh(batch["value"].to_numpy() * scale) + batch["user_id"].to_numpy() % 3


@query("x05_bound_model_batches", f"select event_id, {q6('tanh(value * 0.01e0) + user_id % 3')} as log_odds from events")
def x05(t):
    from functools import partial

    rows = t.events.select("event_id", "user_id", "value")
    out = scoring.score_with(rows, partial(_squash, 0.01), ["value", "user_id"])
    return out.select("event_id", r6("log_odds").alias("log_odds"))


@query("x06_bound_parameters", f"""
select c_custkey, {q6('c_acctbal * 1.25e0 - 10')} as y from customer""")
def x06(t):
    from functools import partial

    def affine(slope, offset, v):
        return r6(v * slope + offset)

    return t.customer.transform(
        transforms.named("add_column", partial(affine, 1.25, -10), ["c_acctbal"], "y")
    ).select("c_custkey", "y")


@query("x07_named_transforms", with_sql(TELEMETRY) + f"""
select tag_key, epoch - epoch % 900 as epoch, {q6('avg(depth)')} as depth, avg(depth) > 60 as deep from telemetry group by 1, 2""")
def x07(t):
    rows = telemetry(t).transform(transforms.named("bucket_mean", ["tag_key"], "epoch", 900, ["depth"]))
    rows = rows.transform(transforms.named("add_column", lambda d: d > 60, ["depth"], "deep"))
    return rows.withColumn("depth", r6("depth"))
