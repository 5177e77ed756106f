"""Conditional logit, spatial hash join, hierarchical cells and the cached query against plain Python."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideway.functions import quadtree
from tideway.operators.choice_fit import fit_choice_logit
from tideway.operators.spatial import edges_within, within_km
from tideway.session import materialise
from tideway.sources.tables import cached_query


def slow_logit(decisions, k, steps=30):
    w = np.zeros(k)
    for _ in range(steps):
        g, h = np.zeros(k), np.zeros((k, k))
        for x, chosen in decisions:
            e = np.exp(x @ w - (x @ w).max())
            p = e / e.sum()
            g += x[chosen] - p @ x
            h += (x.T * p) @ x - np.outer(p @ x, p @ x)
        w += np.linalg.lstsq(h, g, rcond=1e-12)[0]
    return w


def test_fit_equals_numpy(spark):
    rng = np.random.default_rng(3)
    true, rows, decisions = np.array([0.9, -1.7, 0.3]), [], []
    for d in range(300):
        x = rng.normal(0, 2, (rng.integers(2, 9), 3))
        chosen = int((x @ true + rng.gumbel(size=len(x))).argmax())
        decisions.append((x, chosen))
        rows += [(d % 7, d, *map(float, v), i == chosen) for i, v in enumerate(x)]
    odd = [(1, 900, 1.0, 1.0, 1.0, False), (1, 901, 1.0, 1.0, 1.0, True), (1, 901, 2.0, 1.0, 1.0, True), (1, 902, None, 1.0, 1.0, True),
           (1, 902, 2.0, 1.0, 1.0, False), (1, 903, 1.0, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows + odd, "i long, d long, a double, b double, c double, _selected boolean").repartition(5)
    fit = fit_choice_logit(df, ["i", "d"], ["a", "b", "c"])
    assert fit.decisions == 300
    assert np.allclose(list(fit.model.weights.values()), slow_logit(decisions, 3), atol=1e-7)
    assert max(map(abs, fit.gradient.values())) < 1e-6
    large = fit_choice_logit(df.withColumn("a", F.col("a") * 1000), ["i", "d"], ["a", "b", "c"])
    assert math.isclose(large.model.weights["a"] * 1000, fit.model.weights["a"], rel_tol=1e-6)
    none = fit_choice_logit(df.limit(0), ["i", "d"], ["a"])
    assert none.model.weights == {"a": 0.0} and none.decisions == 0


def km(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(min(1, h)))


@pytest.mark.parametrize("reach, crowded", [(30.0, 10**6), (150.0, 7), (25_000.0, 50)])
def test_spatial_join_is_exact(spark, reach, crowded):
    rng = random.Random(8)
    places = [(90.0, 0.0), (-90.0, 77.0), (89.99, 170.0), (0.0, 180.0), (0.0, -180.0), (0.1, 179.99), (None, 1.0), (float("nan"), 1.0)]
    places += [(50 + rng.gauss(0, 0.4), 179.9 + rng.gauss(0, 0.7)) for _ in range(60)]  # over the antimeridian, one hot bucket
    places += [(math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180)) for _ in range(40)]
    one = [(f"a{i}", la, lo) for i, (la, lo) in enumerate(places)]
    two = [(i, la, lo - 360 if lo > 179.95 else lo) for i, (la, lo) in enumerate(places[::2])]
    a, b = spark.createDataFrame(one, "p string, la double, lo double"), spark.createDataFrame(two, "q long, lb double, ob double")
    got = {(r.p, r.q): r.distance for r in within_km(a, b, reach, ("la", "lo"), ("lb", "ob"), method="sphere", crowded=crowded).collect()}
    fit = [(x, y) for x in one for y in two if None not in x and None not in y and not math.isnan(x[1]) and not math.isnan(y[1])]
    want = {(x[0], y[0]): km(*x[1:], *y[1:]) for x, y in fit}
    edge = 1e-4  # rounding of arcs near half a turn
    assert {k for k, v in want.items() if v <= reach - edge} <= set(got) <= {k for k, v in want.items() if v <= reach + edge}
    assert all(abs(v - want[k]) < 0.5 for k, v in got.items())


def test_spatial_join_has_no_cross_join(spark):
    from tests.conftest import plan_of

    df = spark.createDataFrame([("x", 1.0, 2.0)], "cell string, lat double, lon double")
    out = edges_within(df, 10)
    assert [tuple(r)[:2] for r in out.collect()] == [("x", "x")]
    assert "Cartesian" not in plan_of(out) and "NestedLoop" not in plan_of(out)
    with pytest.raises(ValueError):
        within_km(df, df, 10, ("lat", "lon"), ("lat", "lon"))


def test_quadtree(spark):
    rng = random.Random(2)
    rows = [(math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180)) for _ in range(200)]
    rows += [(90.0, 180.0), (-90.0, -180.0), (90.0, 540.0), (0.0, 0.0), (None, 1.0), (float("nan"), 0.0)]
    df = spark.createDataFrame(rows, "lat double, lon double")
    deep = quadtree.quad_cell("lat", "lon", 12)
    lat, lon = quadtree.quad_center("deep", 12)
    first, last = quadtree.quad_children("up3", 3)
    out = df.withColumn("deep", deep).withColumn("up3", quadtree.quad_parent("deep", 3)).select(
        "lat", "lon", "deep", "up3", quadtree.quad_cell("lat", "lon", 9).alias("direct"), quadtree.quad_level("deep").alias("level"),
        quadtree.quad_cell(lat, lon, 12).alias("again"), first.alias("first"), last.alias("last"), quadtree.quad_parent("deep", 13).alias("above"),
    )
    for r in out.collect():
        if r.lat is None or math.isnan(r.lat):
            assert r.deep is None
            continue
        assert r.up3 == r.direct and r.level == 12 and r.again == r.deep and r.first <= r.deep <= r.last and r.above is None
        assert r.last - r.first == 4**3 - 1
    children = spark.range(1).select(F.explode(F.sequence(*quadtree.quad_children(F.lit(77), 2))).alias("c")).select(quadtree.quad_parent("c", 2).alias("p"))
    assert {r.p for r in children.collect()} == {77}


def test_cached_query_follows_its_inputs(spark, tmp_path):
    data, root = str(tmp_path / "data"), str(tmp_path / "cache")
    spark.range(5).write.parquet(data)

    def ask():
        spark.read.parquet(data).createOrReplaceTempView("cached_input")
        return sorted(r.id for r in cached_query(spark, "select id from cached_input where id > 1", root).collect())

    assert ask() == [2, 3, 4]
    stored = sorted(p.name for p in (tmp_path / "cache").iterdir())
    assert ask() == [2, 3, 4] and sorted(p.name for p in (tmp_path / "cache").iterdir()) == stored  # only the store was read
    spark.range(7, 9).write.mode("append").parquet(data)
    assert ask() == [2, 3, 4, 7, 8]
    spark.range(100).createOrReplaceTempView("cached_input")
    assert len(cached_query(spark, "select id from cached_input where id > 1", root).collect()) == 98


def test_bucketed_transitions_are_not_exchanged(spark):
    from tideway.operators.propagation import step_mass, store_bucketed

    rows = spark.range(400).selectExpr("id % 40 as origin_cell", "(id * 7) % 40 as cell", "date_add(date '2024-01-01', int(id % 3)) as date", "0.5d as probability")
    stored = store_bucketed(rows, "bucketed_transitions")
    state = materialise(spark.range(40).selectExpr("id as cell", "date '2024-01-01' as date", "1d as _quanta"), "state")
    stepped = step_mass(state.hint("merge"), stored)
    # Under the join: one exchange, on the state's side.
    left, right = stepped._jdf.queryExecution().executedPlan().toString().split("SortMergeJoin", 1)[1].split("FileScan")[:2]
    assert "Exchange" in left and "Exchange" not in right
    want = {}
    for r in rows.collect():
        if str(r.date) == "2024-01-01":
            want[r.cell] = want.get(r.cell, 0) + 0.5
    assert {r.cell: r._quanta for r in stepped.collect()} == want
    spark.sql("drop table bucketed_transitions")


def test_kept_sums_equal_a_rebuild(spark, tmp_path):
    from tideway.operators.kept_sums import keep_days, kept_sums, means_of

    rows = [(d, k, v) for d in ("2024-01-01", "2024-01-02", "2024-01-03", None) for k in ("a", None) for v in (1.0, 2.5, None, -3.0)]
    df = spark.createDataFrame(rows, "date string, k string, v double")
    one, all_days, path = df.filter("date = '2024-01-02'"), str(tmp_path / "all"), str(tmp_path / "kept")
    keep_days(df, all_days, ["k"], "date", ["v"])
    for d in ("2024-01-03", "2024-01-01", "2024-01-02", "2024-01-01"):
        keep_days(df.filter(F.col("date") == d), path, ["k"], "date", ["v"])

    def read(at, **more):
        return sorted(map(str, means_of(kept_sums(spark, at, ["k"], ["v"], **more), ["k"], ["v"]).collect()))

    assert read(path) == read(all_days)
    keep_days(one.withColumn("v", F.col("v") * 2), path, ["k"], "date", ["v"])  # a corrected day replaces itself only
    keep_days(df.limit(0), path, ["k"], "date", ["v"])  # nothing new changes nothing
    assert read(path, between=("2024-01-03", "2024-01-09")) == read(all_days, between=("2024-01-03", "2024-01-09"))
    got = {r.k: r for r in kept_sums(spark, path, ["k"], ["v"]).collect()}
    assert got["a"].v_n == 9 and math.isclose(got["a"].v_sum, 0.5 * 4) and got[None].v_least == -6.0


def test_alias_tables_keep_every_weight():
    from tideway.operators.weighted import alias_table

    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 300):
        w = rng.exponential(1, n) ** 4 + 1e-12
        keep, other = alias_table(w)
        mass = keep.copy()
        np.add.at(mass, other, 1 - keep)
        assert np.allclose(mass / n, w / w.sum())


def test_weighted_draws(spark):
    from tideway.operators.weighted import alias_levels, weighted_draws

    rows = [("few", k, w) for k, w in ((1, 5.0), (2, 1.0), (3, 0.0), (4, -1.0), (5, None), (6, float("nan")), (7, 4.0))]
    rows += [(None, 1, 1.0), ("none", 1, 0.0)] + [("many", k, float(k % 10)) for k in range(1000)]
    df = spark.createDataFrame(rows, "g string, k long, w double")
    assert len(alias_levels(df, "g", "k", "w", 20)) == 3  # 900 rows, 45 slices, 3 slices of slices, one
    draws = 20_000
    out = weighted_draws(df.repartition(3), "g", "k", "w", draws, seed=5, slice_rows=20)
    got = sorted(map(str, out.collect()))
    assert got == sorted(map(str, weighted_draws(df.repartition(7), "g", "k", "w", draws, seed=5, slice_rows=20).collect()))
    counts = {(r.g, r.k): r["n"] for r in out.groupBy("g", "k").agg(F.count("*").alias("n")).collect()}
    assert {g for g, _ in counts} == {"few", None, "many"} and counts[None, 1] == draws
    for g, total, some in (("few", 10.0, [(1, 5.0), (2, 1.0), (7, 4.0)]), ("many", 4500.0, [(k, float(k % 10)) for k in range(1000)])):
        assert sum(n for (h, _), n in counts.items() if h == g) == draws
        chi = sum((counts.get((g, k), 0) - draws * w / total) ** 2 / (draws * w / total) for k, w in some if w)
        free = sum(w > 0 for _, w in some) - 1
        assert chi < free + 5 * math.sqrt(2 * free) and all((g, k) not in counts for k, w in some if not w)
    assert weighted_draws(df.limit(0), "g", "k", "w", 5).count() == 0
