"""Table functions and grids of quantiles."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import plan_of
from tideway.operators import aggregates, cube
from tideway.operators.aggregates import quantiles
from tideway.operators.table_functions import episodes

READINGS = "who string, at long, depth double, id int"


def slow_episodes(rows, enter, leave):
    out = []
    for who in {r[0] for r in rows}:
        held = None
        for _, at, depth, _ in sorted((r for r in rows if r[0] == who and r[1] is not None), key=lambda r: (r[1], r[3])):
            if depth is None or math.isnan(depth):
                continue
            if held and depth < leave:
                out.append((who, *held))
                held = None
            elif held:
                held = (held[0], at, held[2] + 1, max(held[3], depth))
            elif depth >= enter:
                held = (at, at, 1, depth)
        if held:
            out.append((who, *held))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", [1, 6])
def test_episodes(spark, parts):
    draw = np.random.default_rng(7)
    rows = [(str(w), int(t), float(d), i) for i, (w, t, d) in enumerate(zip(draw.choice(["a", "b"], 400), draw.integers(0, 150, 400), draw.gamma(2, 9, 400)))]
    rows += [(None, 5, 30.0, 1), (None, 6, None, 2), (None, 7, math.nan, 3), (None, 8, 6.0, 4), (None, None, 1.0, 5), ("c", 1, 2.0, 1)]
    df = spark.createDataFrame(rows, READINGS).repartition(parts)
    got = episodes(df, ["who"], "at", "depth", 20, 5, tie="id")
    assert got.dtypes == [("who", "string"), ("start", "bigint"), ("end", "bigint"), ("n", "bigint"), ("peak", "double")]
    assert sorted(map(tuple, got.collect()), key=str) == slow_episodes(rows, 20, 5)


def test_episodes_of_nothing(spark):
    none = spark.createDataFrame([], READINGS)
    assert episodes(none, ["who"], "at", "depth", 20, 5).collect() == []
    # Most partitions of the exchange are empty, and one group has readings but no episode.
    quiet = spark.createDataFrame([("a", 1, 1.0, 0), ("b", 1, 25.0, 0)], READINGS)
    assert [tuple(r) for r in episodes(quiet, ["who"], "at", "depth", 20, 5).collect()] == [("b", 1, 1, 1, 25.0)]
    with pytest.raises(Exception, match="bounds"):
        episodes(quiet, ["who"], "at", "depth", 5, 20).collect()


def test_quantile_grid(spark):
    draw = np.random.default_rng(3)
    x, y = draw.normal(size=5000), draw.integers(0, 3, 5000)
    rows = [(float(a), int(b), None) for a, b in zip(x, y)] + [(None, None, None), (math.nan, 1, None)]
    df = spark.createDataFrame(rows, "x double, y int, z double").repartition(5)
    sizes = {"x": 9, "y": 5, "z": 2}
    grid = cube.quantile_grid(df, sizes)
    row = grid.collect()[0]
    assert np.allclose(row.x, np.quantile(x, np.linspace(0, 1, 9)), rtol=0, atol=1e-12)
    assert row.y == np.quantile([*y, 1], np.linspace(0, 1, 5)).tolist() and row.z == [None, None]
    out = cube.hypercube(spark, cube.grid_values(grid, sizes), [1, 2])
    points = {(r.x, r.y) for r in out.collect()}
    assert out.count() == 9 * 5 * 2 * 2 and points == {(a, b) for a in row.x for b in row.y}
    with pytest.raises(ValueError, match="two ends"):
        cube.quantile_grid(df, {"x": 1})


def test_sweeps_move_one_feature(spark):
    df = spark.createDataFrame([(1, 5.0, 2), (2, None, 3)], "id int, x double, y int")
    grid = spark.createDataFrame([([0.0, 1.0, 2.0], [7.0, 8.0])], "x array<double>, y array<double>")
    out = cube.feature_sweeps(df, grid, {"x": 3, "y": 2})
    want = [(i, v, float(y), "x", k) for i, _, y in [(1, 5.0, 2), (2, None, 3)] for k, v in enumerate([0.0, 1.0, 2.0])]
    want += [(i, x, v, "y", k) for i, x, _ in [(1, 5.0, 2), (2, None, 3)] for k, v in enumerate([7.0, 8.0])]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    assert "Exchange" not in plan_of(cube.feature_sweeps(spark.range(9).select(F.col("id").alias("x")), grid, {"x": 3}))


def test_means_of_sweeps_are_taken_from_groups(spark):
    draw = np.random.default_rng(5)
    rows = [(int(g) or None, None if v < -1 else float(v), int(k)) for g, v, k in zip(draw.integers(0, 3, 200), draw.normal(size=200), draw.integers(0, 9, 200))]
    df = spark.createDataFrame([*rows, (9, None, 4)], "g int, x double, y int").repartition(5)
    grid = spark.createDataFrame([([0.0, 1.0, None], [7.0, 8.0])], "x array<double>, y array<double>")
    sizes = {"x": 3, "y": 2}
    want = cube.feature_sweeps(df, grid, sizes).groupBy("g", "_feature", "_step").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"))
    got = cube.sweep_means(df, grid, sizes, ["g"]).select(want.columns)
    rounded = [[tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in d.collect()] for d in (got, want)]
    assert sorted(rounded[0], key=str) == sorted(rounded[1], key=str)


def test_brackets_are_searched_without_lambdas(spark, monkeypatch):
    plans, write = {}, aggregates.materialise
    monkeypatch.setattr(aggregates, "materialise", lambda df, label: plans.setdefault(label, plan_of(df)) and write(df, label))
    draw = np.random.default_rng(8)
    x = np.concatenate([draw.normal(size=60_000), draw.integers(0, 3, 30_000)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(6)
    row = cube.quantile_grid(df, {"x": 38}).first()
    assert np.allclose(row.x, np.quantile(x, np.linspace(0, 1, 38)), rtol=0, atol=1e-12)
    ps = {f"q{i}": i / 8 for i in range(9)}
    with_nan = df.union(spark.createDataFrame([(math.nan,)] * 50_000, "x double"))
    got = quantiles(with_nan, "x", ps, accuracy=200).first()
    want = np.quantile(np.concatenate([x, np.full(50_000, np.inf)]), list(ps.values()))
    assert all(np.isclose(g, w, rtol=0, atol=1e-12) for g, w in zip(got[:5], want[:5])) and math.isnan(got[-1])
    assert "lambdafunction" not in plans["quantile-counts"]
