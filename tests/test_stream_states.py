"""Keyed state on streams of files against the batch operators."""

from __future__ import annotations

import datetime as dt
import os
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tideway.operators.aggregates import bucket_first
from tideway.operators.ranking import sequence_with_next
from tideway.streaming.states import final_states, stream_bucket_first, stream_join_days, stream_next_state

START = dt.datetime(2024, 3, 1)
SCHEMA = "track string, at timestamp, cell long, n int"


def feed(spark, folder, batches, schema=SCHEMA):
    """A stream of one file a trigger, in this order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        for name in os.listdir(folder):
            path = os.path.join(folder, name)
            if name.endswith(".parquet") and os.path.getmtime(path) > 2_000_000:
                os.utime(path, (1_000_000 + i, 1_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def drain(stream, folder):
    out, spark = f"{folder}/out", stream.sparkSession
    query = stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(out, "parquet", "append")
    assert query.awaitTermination(240)
    return spark.read.schema(stream.schema).parquet(out)


def rows_of(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture(scope="module")
def batches():
    """Readings of three tracks (one null) over two hours, each batch up to nine minutes out of order, with repeated rows."""
    rng = random.Random(5)
    rows = []
    for track in ("a", "b", None):
        for n, second in enumerate(sorted(rng.sample(range(7200), 120))):
            rows.append((track, START + dt.timedelta(seconds=second), rng.choice([None, 9, 10, 11]), n))
    rows.sort(key=lambda r: r[1] + dt.timedelta(seconds=rng.randrange(540)))
    parts = [rows[i : i + 90] for i in range(0, len(rows), 90)]
    for i in range(1, len(parts)):
        parts[i] = parts[i] + parts[i - 1][-5:]
    # Later rows move the watermark past everything above; rows of long ago come after them and are dropped.
    end = START + dt.timedelta(days=2)
    return [*parts, [("z", end, 1, 0)], [("a", START, 12, 0), ("z", end + dt.timedelta(hours=1), 2, 1)]]


def test_first_of_bucket(spark, tmp_path, batches):
    got = drain(stream_bucket_first(feed(spark, str(tmp_path / "in"), batches), ["track"], "at", 900, "cell"), str(tmp_path))
    stored = spark.createDataFrame([r for b in batches[:-2] for r in b], SCHEMA).withColumn("epoch", F.unix_seconds("at"))
    want = bucket_first(stored, ["track"], "epoch", 900, "cell").select("track", "cell", "epoch")
    assert rows_of(got.filter("track is null or track <> 'z'")) == rows_of(want)


def test_next_state(spark, tmp_path, batches):
    got = drain(stream_next_state(feed(spark, str(tmp_path / "in"), batches), ["track"], "at", "cell", "next_cell", 86400), str(tmp_path))
    stored = spark.createDataFrame([r for b in batches[:-2] for r in b], SCHEMA).select("track", "at", "cell").distinct()
    want = sequence_with_next(stored, ["track"], ["at", "cell"], "cell", "rank", "next_cell").drop("rank")
    assert rows_of(got.filter("track is null or track <> 'z'")) == rows_of(want)


def test_gaps_end_tracks(spark, tmp_path):
    at = [START + dt.timedelta(minutes=m) for m in (0, 10, 10, 70, 200)]
    parts = [[("a", at[0], 1, 0), ("a", at[3], 4, 0)], [("a", at[2], 3, 0), ("a", at[1], 2, 0)], [("a", at[4], 5, 0)]]
    got = drain(stream_next_state(feed(spark, str(tmp_path / "in"), parts), ["track"], "at", "cell", "after", 1800, "2 hours"), str(tmp_path))
    assert [(r.cell, r.after) for r in got.orderBy("at", "cell").collect()] == [(1, 2), (2, 3), (3, None)]
    assert final_states([(0, "x"), (5, "y")], 4, 100) == ([], [(0, "x"), (5, "y")], 5)
    assert final_states([(0, "x"), (5, "y")], 5, 5) == ([(0, "x", "y")], [(5, "y")], 10)
    assert final_states([(0, "x"), (50, "y")], 9, 5) == ([(0, "x", None)], [(50, "y")], 55)
    assert final_states([], 9, 5) == ([], [], None)


def test_many_tracks_share_calls(spark, tmp_path):
    """State is held by bucket: a trigger calls Python as often for five thousand tracks as for a few hundred."""
    n = 5000
    spark.range(n).selectExpr(
        "cast(null as string) as a", "if(id % 7 = 0, null, cast(id as double) - 5 + 9007199254740992) as b", "id % 3 = 0 as c", "id as n",
        "explode(array(0, 60, 7200)) as more",
    ).selectExpr("a", "b", "c", "n", f"timestamp'{START}' + make_interval(0, 0, 0, 0, 0, 0, more + n % 50) as at", "cast(n + more as int) as cell").coalesce(1).write.parquet(str(tmp_path / "in"))
    schema = "a string, b double, c boolean, n long, at timestamp, cell int"
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    found = stream_next_state(stream, ["a", "b", "c", "n"], "at", "cell", "after", 300, "1 minute")
    query = found.writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"), "parquet", "append")
    assert query.awaitTermination(240)
    calls = [p.stateOperators[0].numRowsUpdated for p in query.recentProgress]
    assert 0 < max(calls) <= 2048
    got = spark.read.schema(found.schema).parquet(str(tmp_path / "out"))
    stored = spark.read.schema(schema).parquet(str(tmp_path / "in"))
    # The watermark ends a minute before the last rows: the last row of each track is open.
    want = stored.filter(F.col("at") < START + dt.timedelta(hours=1)).withColumn("after", F.expr("if(cell = n, cell + 60, null)"))
    assert rows_of(got) == rows_of(want.select("a", "b", "c", "n", "at", "cell", "after"))


def test_keys_of_any_type(spark, tmp_path):
    moment = dt.datetime(2024, 10, 27, 0, 30, 0, 123456)
    schema = "d date, w timestamp, x binary, y decimal(20,3), z struct<p:long,q:timestamp>, f float, at timestamp, cell string"
    rows = [(moment.date(), moment, b"\xff\x00", Decimal("1.250"), (None, moment), f, START + dt.timedelta(minutes=m), "s") for m, f in ((0, 0.0), (1, -0.0), (2, 0.1))]
    rows += [(None, None, None, None, None, None, START, None)]
    end = [(None, None, None, None, None, 9.0, START + dt.timedelta(days=d), None) for d in (5, 6)]
    got = drain(stream_next_state(feed(spark, str(tmp_path / "in"), [rows, end[:1], end[1:]], schema), list("dwxyzf"), "at", "cell", "after", 900), str(tmp_path))
    kept = spark.createDataFrame(rows, schema).withColumn("f", F.expr("f + 0.0f"))
    want = kept.withColumn("after", F.expr(f"if(f = 0 and at = timestamp'{START}', 's', null)"))
    assert got.schema.simpleString() == want.schema.simpleString()
    assert rows_of(got.filter("f is null or f <> 9").withColumn("x", F.hex("x"))) == rows_of(want.withColumn("x", F.hex("x")))


@pytest.mark.parametrize("how", ["inner", "left_outer"])
def test_join_by_day(spark, tmp_path, how):
    def row(track, hour, n):
        return track, START + dt.timedelta(hours=hour), n

    left = [[row("a", 3, 0), row("b", 5, 1)], [row("a", 23, 2), row("a", 26, 3), row(None, 4, 4)], [row("z", 200, 5)], [row("z", 300, 6)]]
    right = [[row("a", 1, 10), row("a", 23.5, 11)], [row("a", 22.9, 12), row("c", 5, 13), row(None, 4, 14)], [row("z", 200, 15)], [row("z", 300, 16)]]
    a, b = "track string, seen timestamp, n int", "track string, read timestamp, value int"
    streams = feed(spark, str(tmp_path / "l"), left, a), feed(spark, str(tmp_path / "r"), right, b)
    got = drain(stream_join_days(*streams, ["track"], "seen", "read", how=how), str(tmp_path))
    x, y = (spark.createDataFrame([r for p in side for r in p], s) for side, s in ((left, a), (right, b)))
    x, y = x.withColumn("date", F.to_date("seen")), y.withColumn("date", F.to_date("read"))
    want = x.join(y, ["track", "date"], how).select("track", "seen", "n", "read", "value", "date")
    keep = "track is null or track <> 'z'"
    assert rows_of(got.filter(keep)) == rows_of(want.filter(keep)) and want.filter(keep).count() >= 3
