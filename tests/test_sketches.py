"""Stored sketches against exact answers."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from tideway.operators.sketches import merge_sketches, read_sketches, sketch_table


def answers(states):
    return read_sketches(states, {"low": ("v", 0.1), "mid": ("v", 0.5), "high": ("v", 0.99)}, {"kinds": "u"})


def test_errors_are_within_bounds_in_any_merge_order(spark):
    df = spark.range(200_000).select(
        (F.col("id") % 7).alias("g"), (F.col("id") % 31).alias("day"), F.exp(F.randn(3)).alias("v"),
        (F.hash("id") % 40_000).alias("u"),
    )
    stored = sketch_table(df, ["g", "day"], ["v"], ["u"])
    assert stored.count() == 7 * 31
    steps = merge_sketches(merge_sketches(stored, ["g", (F.col("day") % 4).alias("q")]), ["g"])
    halves = merge_sketches(
        merge_sketches(stored.filter("day < 9"), ["g"]).unionByName(merge_sketches(stored.filter("day >= 9"), ["g"])), ["g"]
    )
    exact = df.toPandas()
    counts = {}
    for merged in (merge_sketches(stored, ["g"]), steps, halves):
        for r in answers(merged).collect():
            own = exact[exact.g == r.g]
            assert r.rows == len(own)
            for name, share in (("low", 0.1), ("mid", 0.5), ("high", 0.99)):
                assert abs(np.mean(own.v <= r[name]) - share) < 2 * 2.3 / 400**0.9
            assert abs(r.kinds / own.u.nunique() - 1) < 4 * 1.04 / math.sqrt(2**14)
            # Distinct counts do not depend on the order at all.
            assert counts.setdefault(r.g, r.kinds) == r.kinds
    whole = answers(merge_sketches(stored)).first()
    assert whole.rows == 200_000 and abs(whole.kinds / exact.u.nunique() - 1) < 4 * 1.04 / math.sqrt(2**14)


def test_nulls_and_empty_tables(spark):
    rows = [(None, 1.0, 1), (None, float("nan"), None), ("a", None, None), ("a", float("nan"), None)]
    df = spark.createDataFrame(rows, "g string, v double, u int")
    got = {r.g: r for r in answers(merge_sketches(sketch_table(df, ["g"], ["v"], ["u"]), ["g"])).collect()}
    assert (got[None].rows, got[None].mid, got[None].kinds) == (2, 1.0, 1)
    assert (got["a"].rows, got["a"].mid, got["a"].kinds) == (2, None, None)
    assert merge_sketches(sketch_table(df.filter("false"), ["g"], ["v"], ["u"]), ["g"]).count() == 0
