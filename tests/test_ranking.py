"""Ranks and running values with one key holding a third of all rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import plan_of
from tideway.operators import aggregates, ranking
from tideway.operators.choices import sequence_decisions


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        key = "hot" if i % 3 == 0 else f"k{rng.randrange(200)}"
        rows.append((key, rng.randrange(40000), i, rng.choice("abc")))
    return rows, spark.createDataFrame(rows, "k string, t long, i long, s string")


def expected_ranks(rows):
    out, groups = {}, {}
    for k, t, i, s in rows:
        groups.setdefault(k, []).append((t, i, s))
    for k, g in groups.items():
        g.sort()
        for n, (t, i, s) in enumerate(g):
            out[i] = (n + 1, g[n + 1][2] if n + 1 < len(g) else None)
    return out


@pytest.mark.parametrize("parts, deal", [(1, 3), (7, 11), (40, 2)])
def test_rank_and_next_match_a_plain_window(skewed, parts, deal):
    rows, df = skewed
    out = sequence_decisions(df.repartition(deal), "k", "t", "s", tie=["i"], parts=parts)
    got = {r["i"]: (r["_decision"], r["next_s"]) for r in out.collect()}
    assert got == expected_ranks(rows)
    ranked = ranking.rank_within(df, ["k"], ["t", "i"], "n", parts)
    assert {r["i"]: r["n"] for r in ranked.collect()} == {i: n for i, (n, _) in expected_ranks(rows).items()}


def test_hot_key_is_cut(skewed):
    _, df = skewed
    placed = ranking._placed(df, ["k", "t", "i"], 20, "hot")
    assert placed.groupBy(ranking.PART).count().agg(F.max("count")).first()[0] < 600
    assert placed.filter("k = 'hot'").select(ranking.PART).distinct().count() >= 5


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_dirty_orders_match_a_plain_window(spark, zone):
    """Outlier, NaN and null positions, null keys, equal times, and a clock change in another session zone."""
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = [("hot" if i % 2 else None if i % 14 == 0 else f"k{i % 5}", float(i // 3), 1730595600 + 600 * (i % 60), i) for i in range(900)]
        rows += [("hot", -1e300, 0, 900), ("hot", float("nan"), 0, 901), ("hot", None, 253402300000, 902), (None, None, 5, 903)]
        df = spark.createDataFrame(rows, "k string, x double, e long, i long").withColumn("ts", F.timestamp_seconds("e"))
        for order in (["x", "i"], ["ts", "i"], ["e", "x", "i"]):
            w = Window.partitionBy("k").orderBy(*order)
            want = {r.i: (r.n, r.nxt, r.total) for r in df.select("i", F.row_number().over(w).alias("n"), F.lead("x").over(w).alias("nxt"), F.sum("i").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("total")).collect()}
            seq = ranking.sequence_with_next(df, ["k"], order, "x", "n", "nxt", 9)
            tot = {r.i: r.total for r in ranking.running_total(df, ["k"], order, "i", "total", 9).collect()}
            got = {r.i: (r.n, r.nxt, tot[r.i]) for r in seq.collect()}
            assert {k: repr(v) for k, v in got.items()} == {k: repr(v) for k, v in want.items()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_running_total_and_rolling_mean(skewed):
    rows, df = skewed
    got = ranking.running_total(df, ["k"], ["t", "i"], "i", "total", 40)
    roll = ranking.rolling_mean(df, ["k"], ["t", "i"], "i", 10, "m", block=16, parts=9)
    totals = {r["i"]: r["total"] for r in got.collect()}
    means = {r["i"]: r["m"] for r in roll.collect()}
    groups = {}
    for k, t, i, s in rows:
        groups.setdefault(k, []).append((t, i))
    for g in groups.values():
        g.sort()
        ids = [i for _, i in g]
        for n, i in enumerate(ids):
            assert totals[i] == sum(ids[: n + 1])
            last = ids[max(0, n - 9): n + 1]
            assert means[i] == pytest.approx(sum(last) / len(last))
    assert len(means) == len(rows)


def test_dense_ids_are_consecutive_in_order(skewed):
    rows, df = skewed
    out = ranking.dense_ids(df.repartition(5), ["k", "t", "i"], "id", parts=7).collect()
    ordered = sorted(out, key=lambda r: (r["k"], r["t"], r["i"]))
    assert [r["id"] for r in ordered] == list(range(1, len(rows) + 1))


def test_no_window_over_one_partition_of_rows(skewed):
    _, df = skewed
    plan = plan_of(sequence_decisions(df, "k", "t", "s", tie=["i"]))
    for line in plan.splitlines():
        assert not ("Exchange SinglePartition" in line and "WindowExec" in line)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("p", [0.0, 0.25, 0.5, 0.95, 1.0])
def test_quantile_is_exact_with_a_coarse_sketch(spark, p):
    import numpy as np

    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=4000), np.full(2000, 0.25), rng.exponential(50, size=3000)])
    df = spark.createDataFrame([(float(v), i % 3) for i, v in enumerate(x)], "x double, g int")
    got = aggregates.quantile(df.repartition(6), "x", p, accuracy=100).first()[0]
    assert got == pytest.approx(np.quantile(x, p), rel=1e-12)
    by = {r["g"]: r["q"] for r in aggregates.quantile(df, "x", p, ["g"], "q", accuracy=50).collect()}
    for g in range(3):
        assert by[g] == pytest.approx(np.quantile(x[g::3], p), rel=1e-12)


def test_reindex_starts_at_zero(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("c",)], "k string")
    assert {(r["k"], r["_individual"]) for r in ranking.reindex(df, "k").collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_first_row_and_bucket_first_keep_nulls(spark):
    df = spark.createDataFrame([("a", 0, None), ("a", 1, 5.0), ("a", 901, 7.0)], "k string, e long, v double")
    out = aggregates.bucket_first(df, ["k"], "e", 900, "v").collect()
    assert {(r["e"], r["v"]) for r in out} == {(0, None), (900, 7.0)}


def test_many_quantiles_at_once_and_null_groups(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    for n in (30_000, 50_000):  # on both sides of what the default sketch takes whole
        x = rng.normal(size=n)
        df = spark.createDataFrame([(float(v), None if i % 3 == 0 else "a") for i, v in enumerate(x)], "x double, g string")
        ps = {"q1": 0.25, "q2": 0.5, "q3": 0.75}
        for rows in (10, 2_000_000):  # ranked by a range sort, and by a window
            got = aggregates.quantiles(df, "x", ps, window_rows=rows).first()
            assert [got[k] for k in ps] == pytest.approx(np.quantile(x, list(ps.values())), rel=1e-12)
            by = {r["g"]: r for r in aggregates.quantiles(df, "x", ps, ["g"], window_rows=rows).collect()}
            assert set(by) == {None, "a"}
            assert [by[None][k] for k in ps] == pytest.approx(np.quantile(x[::3], list(ps.values())), rel=1e-12)


def test_null_keys_stay(spark):
    from tideway.operators import evaluation, joins, scoring

    df = spark.createDataFrame([("a", 1, 1.0), (None, 2, 2.0)], "k string, i int, v double")
    assert joins.per_distinct(df, ["k"], lambda d: d.withColumn("x", F.coalesce("k", F.lit("none")))).count() == 2
    assert ranking.reindex(df, "k").count() == 2 and evaluation.relative_density(df, "k", "i", "i", "v").count() == 2
    rows = df.select(F.col("k").alias("_individual"), F.col("i").alias("_decision"), F.col("v").alias("log_odds"))
    assert scoring.choice_probability(rows, wide=True).count() == 2


def test_worst_misses_stay_in_the_score(spark):
    from tideway.operators import evaluation, scoring

    rows = [(1, 1, 1, -2000.0, True), (1, 1, 2, 0.0, False), (1, 2, 1, 0.0, True), (1, 2, 2, 0.0, False)]
    df = spark.createDataFrame(rows, "_individual int, _decision int, _choice int, log_odds double, _selected boolean")
    for wide in (False, True):
        out = evaluation.nlp(scoring.choice_probability(df, wide=wide), "contrast").first()
        assert out["n"] == 2 and out["nlp"] == pytest.approx((-2000 - 0.6931471805599453) / 2)
    given = df.withColumn("probability", F.when(F.col("log_odds") < 0, 0.0).otherwise(0.5))
    assert evaluation.nlp(given, "contrast").first()["nlp"] == float("-inf")
    kept = scoring.renormalise(df.withColumn("log_odds", F.lit(-800.0)), F.col("_choice") > 0)
    assert {r["probability"] for r in kept.collect()} == {0.5}


def test_network_with_one_feature(spark):
    from tideway.operators import scoring

    model = scoring.MlpModel(["x"], [([[2.0]], [1.0])])
    out = scoring.score(spark.createDataFrame([(1.5,), (0.0,)], "x double"), model).collect()
    assert sorted(r["log_odds"] for r in out) == [1.0, 4.0]


def test_nan_depth_has_no_class(spark):
    from tideway.operators import sampling

    df = spark.createDataFrame([(float("nan"), 1), (None, 2), (10.0, 3)], "d double, i int")
    for mode in ("draw", "edge"):
        got = {r["i"]: r["depth_class"] for r in sampling.depth_class(df, "d", [25.0, 50.0], ["i"], mode=mode).collect()}
        assert got[1] is None and got[2] is None and got[3] == 25.0


def test_propagate_returns_its_own_steps(spark, tmp_path):
    import datetime

    from tideway.operators.propagation import propagate

    day = datetime.date(2024, 1, 1)
    seed = spark.createDataFrame([(1, day, 1.0), (1, day + datetime.timedelta(1), 1.0)], "cell long, date date, _quanta double")
    moves = spark.createDataFrame([(1, 1, day + datetime.timedelta(i), 1.0) for i in range(6)], "origin_cell long, cell long, date date, probability double")
    path = str(tmp_path / "mass")
    assert {r["step"] for r in propagate(seed, moves, 3, path).collect()} == {0, 1, 2, 3}
    assert {r["step"] for r in propagate(seed, moves, 1, path).collect()} == {0, 1}


def test_hot_key_beside_its_totals_is_split(spark):
    from tideway.operators import joins

    keys = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        df = spark.range(200_000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v")).repartition(8)
        out = joins.join_totals(df, df.groupBy("k").agg(F.sum("v").alias("t")), ["k"])
        out.write.format("noop").mode("overwrite").save()
        out.collect()
        assert "skew=true" in plan_of(out)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
