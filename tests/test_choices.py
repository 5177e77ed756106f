from __future__ import annotations

import math
import re

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import plan_of
from tideway.functions.scalar import as_col
from tideway.operators import choices, environment, evaluation, fitting, norms, sampling, scoring
from tideway.operators.propagation import mass_balance, propagate
from workload.choice_queries import NORM_SPEC, norm_inputs
from workload.derive import PRIORITIES, order_decisions, priority_facts, scored_orders
from workload.registry import Tables


@pytest.fixture(scope="module")
def tables(spark, sf):
    return Tables(spark, sf)


def test_one_join_expansion_equals_expand_then_join(tables):
    facts, rows = priority_facts(tables), order_decisions(tables)
    a = choices.expand_by_context(rows, facts, ["month"], "priority", PRIORITIES)
    b = choices.expand_classes(rows, PRIORITIES, "priority").join(facts, ["month", "priority"])
    cols = ["_decision", "priority", "_choice", "avg_price"]
    assert a.select(cols).exceptAll(b.select(cols)).isEmpty() and b.select(cols).exceptAll(a.select(cols)).isEmpty()


def test_probabilities_sum_to_one_and_one_is_selected(tables):
    rows = choices.require_selected(scored_orders(tables))
    per = rows.groupBy("_individual", "_decision").agg(
        F.sum("probability").alias("p"), F.sum(F.col("_selected").cast("int")).alias("s")
    )
    assert per.filter("abs(p - 1) > 1e-9 or s != 1").isEmpty()


def test_large_log_odds_do_not_overflow(spark):
    df = spark.createDataFrame([(1, 1, 5000.0), (1, 2, 5001.0), (2, 1, -5000.0), (2, 2, -5000.0)], "d int, c int, log_odds double")
    for wide in (False, True):
        out = scoring.choice_probability(df, ["d"], wide=wide)
        got = {(r["d"], r["c"]): r["probability"] for r in out.collect()}
        assert got[(1, 2)] == pytest.approx(1 / (1 + math.exp(-1)))
        assert got[(2, 1)] == pytest.approx(0.5)


def test_wide_decisions_give_the_window_result(tables):
    df = tables.events.select("event_id", "user_id", (F.col("value") - 100).alias("log_odds"))
    a = scoring.choice_probability(df, ["user_id"]).select("event_id", F.round("probability", 9))
    b = scoring.choice_probability(df, ["user_id"], wide=True).select("event_id", F.round("probability", 9))
    assert a.exceptAll(b).isEmpty()


def test_unknown_selection_is_kept_until_required(spark):
    df = spark.createDataFrame([(1, 1, None, "a"), (1, 2, "b", "a"), (1, 2, "b", "b")], "_individual int, _decision int, actual string, alt string")
    marked = choices.mark_selected(df, "actual", "alt")
    assert marked.filter("_selected is null").count() == 1
    assert {r["_decision"] for r in choices.require_selected(marked).collect()} == {2}


def test_restrict_and_trivial(spark):
    rows = [(1, 1, 10.0, True), (1, 1, 60.0, False), (1, 2, 60.0, True), (1, 2, 5.0, False), (1, 3, 50.0, True), (1, 3, 1.0, False)]
    df = spark.createDataFrame(rows, "_individual int, _decision int, distance double, _selected boolean")
    kept = choices.restrict_moves(df, 50)
    assert [(r["_decision"], r["distance"]) for r in kept.collect()] == [(1, 10.0)]
    assert choices.drop_trivial(kept).isEmpty()


def test_padding_fills_and_refuses_to_truncate(spark):
    df = spark.createDataFrame([(1, 1, 2, True, 0.5), (1, 1, 1, False, 0.25)], "_individual int, _decision int, _choice int, _selected boolean, x double")
    row = choices.pad_decisions(df, 3, ["x"], {"x": -9}).first()
    assert [(c["choice"], c["selected"], c["x"]) for c in row["choices"]] == [(1, False, 0.25), (2, True, 0.5), (None, False, -9.0)]
    with pytest.raises(PySparkException):
        choices.pad_decisions(df, 1, ["x"], {"x": -9}).collect()


def test_norms_invert(tables):
    rows = norm_inputs(tables)
    spec = {c: NORM_SPEC[c] for c in ("price", "a", "b", "c", "d", "e")}
    params = norms.fit_norm(rows.filter("_train"), spec)
    out = norms.invert_norm(norms.apply_norm(rows, spec, params), spec, params)
    joined = out.select("_decision", *[F.col(c).alias(f"x_{c}") for c in spec]).join(rows, "_decision")
    worst = joined.agg(*[F.max(F.abs(F.col(f"x_{c}") / F.col(c) - 1)) for c in spec]).first()
    assert max(worst) < 1e-9


def test_contrasts_are_balanced_and_repeatable(tables):
    rows = scored_orders(tables)
    a = sampling.contrasts(rows, 7, 3, features=["log_odds"], seed=2, parts=3)
    b = sampling.contrasts(rows.repartition(13), 7, 3, features=["log_odds"], seed=2)
    per = a.groupBy("_individual").count()
    assert per.filter("count != 21").isEmpty()
    assert per.count() == rows.select("_individual").distinct().count()
    cols = ["_individual", "_decision", "_draw", "_pair", "selected_choice", "other_choice"]
    assert a.select(cols).exceptAll(b.select(cols)).isEmpty()
    assert a.filter("selected_choice = other_choice").isEmpty()


def test_stay_rate_in_contrasts_matches_closed_form(spark):
    # a share p of decisions stays; each draw gives the same number of pairs, so p is kept
    n, p = 1000, 0.65
    df = spark.range(n).select(F.lit(1).alias("_individual"), F.col("id").alias("_decision"))
    df = df.withColumn("stay", F.col("_decision") < p * n).withColumn("_choice", F.explode(F.sequence(F.lit(1), F.lit(7))))
    df = df.withColumn("_selected", F.when(F.col("stay"), F.col("_choice") == 1).otherwise(F.col("_choice") == 3))
    pairs = sampling.contrasts(df, 4000, 7, seed=5)
    assert pairs.agg(F.avg((F.col("selected_choice") == 1).cast("double"))).first()[0] == pytest.approx(p, abs=0.03)


def test_split_is_exact_and_disjoint(tables):
    split = sampling.split_keys(tables.orders, "o_custkey", 0.35, seed=3)
    n = tables.orders.select("o_custkey").distinct().count()
    counts = {r["_train"]: r["count"] for r in split.groupBy("_train").count().collect()}
    assert counts == {False: math.floor(0.35 * n), True: n - math.floor(0.35 * n)}
    assert split.count() == split.select("o_custkey").distinct().count()
    again = sampling.split_keys(tables.orders.repartition(9), "o_custkey", 0.35, seed=3)
    assert split.exceptAll(again).isEmpty()


def test_sample_size_beyond_the_table(tables):
    assert sampling.sample_rows(tables.customer, 10**9, ["c_custkey"]).count() == tables.customer.count()
    assert sampling.sample_rows(tables.customer, 10, ["c_custkey"]).count() == 10


def test_augmentation_keeps_originals_and_test_rows(tables):
    rows = order_decisions(tables)
    out = sampling.augment(rows, 3, {"price": ("multiply", 0.1)}, ["_decision"], 10**6, seed=1)
    train = rows.filter("_train").count()
    assert out.count() == rows.count() + 3 * train
    assert out.filter("not _train and _copy > 0").isEmpty()
    originals = out.filter("_copy = 0").select(rows.columns)
    assert originals.exceptAll(rows).isEmpty()
    ratio = out.filter("_copy > 0").join(rows.select("_decision", F.col("price").alias("p0")), "_decision")
    low, high = ratio.agg(F.min(F.col("price") / F.col("p0")), F.max(F.col("price") / F.col("p0"))).first()
    assert 0.9 <= low < high <= 1.1


@pytest.mark.parametrize("depth", [10.0, 97.0, 480.0, 900.0, 5000.0])
def test_depth_draw_follows_the_class_probabilities(spark, depth):
    n = 20000
    df = spark.range(n).withColumn("depth", F.lit(depth))
    drawn = sampling.depth_class(df, "depth", environment.DEPTH_CLASSES, key=["id"], seed=1)
    counts = {r["depth_class"]: r["count"] / n for r in drawn.groupBy("depth_class").count().collect()}
    p = {r["depth_class"]: r["p"] for r in sampling.class_probabilities(df.limit(1), "depth", environment.DEPTH_CLASSES).collect()}
    assert sum(p.values()) == pytest.approx(1.0, abs=1e-9)
    for c, share in p.items():
        assert counts.get(c, 0.0) == pytest.approx(share, abs=0.015)


def test_zero_depth_takes_the_first_class(spark):
    df = spark.createDataFrame([(1, 0.0), (2, None)], "id int, depth double")
    out = sampling.depth_class(df, "depth", environment.DEPTH_CLASSES, key=["id"]).orderBy("id").collect()
    assert [r["depth_class"] for r in out] == [25.0, None]


def test_null_model_scores(spark):
    df = spark.range(50).select((F.col("id") % 5).alias("_individual"), F.col("id").alias("_decision"))
    ten = scoring.null_model(choices.expand_classes(df, environment.DEPTH_CLASSES, "c").withColumn("_selected", F.col("_choice") == 1))
    assert evaluation.nlp(ten).first()["nlp"] == pytest.approx(math.log(0.1))
    two = scoring.null_model(choices.expand_classes(df, [1, 2], "c").withColumn("_selected", F.col("_choice") == 1))
    out = evaluation.nlp(two, "contrast").first()
    assert out["nlp"] == pytest.approx(-math.log(2)) and out["geometric_p"] == pytest.approx(0.5)


def test_logit_recovers_weights(spark):
    rng = np.random.default_rng(0)
    true, rows = np.array([1.5, -0.75]), []
    for d in range(4000):
        x = rng.normal(size=(4, 2))
        p = np.exp(x @ true)
        picked = rng.choice(4, p=p / p.sum())
        rows += [(d % 40, d, c + 1, bool(c == picked), float(x[c, 0]), float(x[c, 1])) for c in range(4)]
    df = spark.createDataFrame(rows, "_individual int, _decision int, _choice int, _selected boolean, a double, b double")
    model = fitting.fit_contrast_logit(sampling.contrasts(df, 150, 3, features=["a", "b"], seed=1), ["a", "b"])
    assert [model.weights["a"], model.weights["b"]] == pytest.approx(true, abs=0.15)


def test_contrasts_gather_choices_once(spark):
    rows = [(i, d, c, None if c == 4 else c in (1, d), float(c * d)) for i in (1, 2, None) for d in (1, 2) for c in (1, 2, 3, 4, 5)]
    rows += [(3, 7, c, False, 0.0) for c in (1, 2)] + [(1, None, c, c == 1, 0.0) for c in (1, 2)]
    df = spark.createDataFrame(rows, "_individual int, _decision int, _choice int, _selected boolean, x double").repartition(4)
    pairs = sampling.contrasts(df, 30, 6, features=["x"], seed=4)
    assert not re.search(r"_choice#\d+L? ASC", plan_of(pairs))  # no window numbers the choices behind the written rows
    got = pairs.collect()
    chosen = {(i, d): [c for i2, d2, c, s, _ in rows if (i2, d2) == (i, d) and s] for i, d, *_ in rows}
    other = {(i, d): [c for i2, d2, c, s, _ in rows if (i2, d2) == (i, d) and s is False] for i, d, *_ in rows}
    assert {r._individual for r in got} == {1, 2} and all(r._decision is not None for r in got)
    for r in got:
        assert r.other_choice in other[r._individual, r._decision] and r.other_x == r.other_choice * r._decision
    for i, d in {(r._individual, r._decision) for r in got}:  # every selected choice of a drawn decision
        assert sorted({r.selected_choice for r in got if (r._individual, r._decision) == (i, d)}) == chosen[i, d]


def test_equal_contrasts_are_counted(spark):
    pairs = spark.createDataFrame([(1.0, 0.0)] * 6 + [(0.0, 1.0)] * 2 + [(2.0, 0.0)], "selected_a double, other_a double")
    got = sorted(tuple(r) for r in fitting.contrast_differences(pairs, ["a"], "n").collect())
    assert got == [(-2.0, 1.0, 0.0), (-1.0, 2.0, 1.0), (-1.0, 6.0, 0.0), (1.0, 2.0, 0.0), (1.0, 6.0, 1.0), (2.0, 1.0, 1.0)]
    w = fitting.fit_contrast_logit(pairs, ["a"]).weights["a"]
    slope = 6 / (1 + math.exp(w)) - 2 / (1 + math.exp(-w)) + 2 / (1 + math.exp(2 * w))
    assert slope == pytest.approx(0, abs=1e-5)


GAME = [(1, "pizza", False), (1, "sandwich", True), (2, "pizza", True), (3, "pizza", True), (3, "sandwich", False),
        (4, "pizza", True), (4, "sandwich", False), (5, "sandwich", True)]


def test_tabular_odds_follow_the_worked_game(spark):
    df = spark.createDataFrame(GAME, "_decision int, meal string, _selected boolean")
    one = {r["meal"]: r["odds"] for r in fitting.fit_tabular_odds(df, "meal", 1, ["_decision"]).collect()}
    assert one == pytest.approx({"pizza": 1.125, "sandwich": 0.875})
    patterns = fitting.choice_patterns(df, "meal", ["_decision"])
    fixed = spark.createDataFrame([("pizza", 2.0), ("sandwich", 1.0)], "__key string, odds double")
    same = {r["__key"]: r["odds"] for r in fitting.tabular_round(patterns, fixed).collect()}
    assert same == pytest.approx({"pizza": 2.0, "sandwich": 1.0})


def test_mass_is_conserved_or_reported(spark):
    steps = [(1, 1, 0.5), (1, 2, 0.5), (2, 1, 0.25), (2, 3, 0.75)]  # 3 has no way out
    table = spark.createDataFrame([(o, c, p) for o, c, p in steps], "origin_cell long, cell long, probability double")
    table = table.withColumn("date", F.explode(F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-01-05").cast("date"))))
    seed = spark.createDataFrame([(1, 8.0)], "cell long, _quanta double").withColumn("date", F.lit("2024-01-01").cast("date"))
    history = propagate(seed, table, 3)
    got = {(r["step"], r["cell"]): r["_quanta"] for r in history.collect()}
    assert got[(1, 1)] == got[(1, 2)] == 4.0 and got[(2, 3)] == 3.0
    balance = {r["step"]: (r["mass"], r["lost"]) for r in mass_balance(history).collect()}
    assert balance[2] == (8.0, 0.0) and balance[3] == (5.0, 3.0)
    assert str({r["date"] for r in history.filter("step = 3").collect()}) == "{datetime.date(2024, 1, 4)}"


def test_native_operators_start_no_python_worker(tables):
    plan = plan_of(scored_orders(tables))
    assert "Python" not in plan and "Pandas" not in plan
    assert plan.count("Exchange hashpartitioning") == 1  # both sums share the decision exchange


def test_environment_regions_and_missing_levels(spark):
    rows = [(40.0, -150.0, 10.0, 1.0, 2.0), (40.0, -150.0, 20.0, 3.0, 2.0), (40.0, -150.0, 0.0, 9.0, 9.0),
            (40.0, -150.0, 30.0, None, 1.0), (40.0, -90.0, 10.0, 5.0, 5.0), (40.0, 150.0, 10.0, 7.0, 7.0)]
    df = spark.createDataFrame(rows, "latitude double, longitude double, depth double, so double, thetao double")
    df = df.withColumn("time", F.lit("2024-01-01").cast("date"))
    out = environment.grid_environment(df, "chinook_study", {"so": "salinity", "thetao": "temperature"})
    assert sorted((r["depth_bin"], r["salinity"]) for r in out.collect()) == [(25.0, 2.0), (25.0, 7.0)]
