from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from tideway import transforms
from tideway.operators.aggregates import bucket_mean
from tideway.session import scratch_path, scratch_root
from tideway.sources import tables as src
from tideway.streaming.telemetry import stream_bucket_mean


def test_scratch_follows_the_session_setting(spark):
    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert scratch_root(spark) == spark.conf.get("spark.checkpoint.dir")


def test_cached_query_is_read_back(spark, sf):
    spark.read.parquet(f"{sf}/nation.parquet").createOrReplaceTempView("cached_nation")
    root = scratch_path(spark, "cache")
    text = "select count(*) as n from cached_nation"
    assert src.cached_query(spark, text, root).first()["n"] == 25
    spark.range(3).createOrReplaceTempView("cached_nation")
    assert src.cached_query(spark, text, root).first()["n"] == 25  # the text is the key


def test_partition_filter_reaches_the_scan(spark, sf):
    path = scratch_path(spark, "pruned")
    src.write_table(spark.read.parquet(f"{sf}/orders.parquet"), path, ["o_orderstatus"])
    df = src.read_table(spark, path).filter("o_orderstatus = 'F' and o_totalprice > 100").select("o_orderkey", "o_orderstatus")
    plan = plan_of(df)
    assert "PartitionFilters: [isnotnull(o_orderstatus" in plan and "GreaterThan(o_totalprice,100" in plan
    assert src.read_table(spark, path, "o_orderstatus=F/").columns[-1] == "o_orderstatus"
    with pytest.raises(ValueError):
        src.read_table(spark, path, "/o_orderstatus=F")


def test_csv_key_is_text(spark):
    path = scratch_path(spark, "csv")
    spark.createDataFrame([(1, 2.5)], "tag_key int, v double").write.option("header", "true").csv(path)
    row = src.read_csv_keyed(spark, path, "tag_key long, v double", "tag_key", "u1", parts=2).first()
    assert (row["tag_key"], row["upload_key"]) == ("1", "u1")


def test_stream_matches_batch(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").select(
        F.col("user_id"), F.col("ts").cast("timestamp").alias("ts"), "value"
    )
    path = scratch_path(spark, "stream-in")
    late = events.agg(F.max("ts")).first()[0]
    # one far later reading moves the watermark past every bucket
    flush = events.limit(1).select("user_id", F.lit(late).cast("timestamp").alias("ts") + F.expr("interval 2 days"), "value")
    events.unionByName(flush.toDF("user_id", "ts", "value")).coalesce(1).write.parquet(path)
    stream = spark.readStream.schema("user_id long, ts timestamp, value double").parquet(path)
    out = stream_bucket_mean(stream, ["user_id"], "ts", 900, ["value"], "5 minutes")
    query = (
        out.writeStream.format("memory").queryName("bucket_stream").outputMode("append")
        .option("checkpointLocation", scratch_path(spark, "stream-state")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    got = {(r["user_id"], r["epoch"]): r["value"] for r in spark.table("bucket_stream").collect()}
    batch = bucket_mean(events.withColumn("epoch", F.unix_seconds("ts")), ["user_id"], "epoch", 900, ["value"])
    want = {(r["user_id"], r["epoch"]): r["value"] for r in batch.collect()}
    assert set(got) == set(want)
    for k in want:
        assert got[k] == pytest.approx(want[k])


def test_transforms_are_listed_and_checked(spark):
    names = {m["name"]: m for m in transforms.manifest()}
    assert {"to_cell", "bucket_mean", "require_selected", "apply_norm", "neighbors"} <= set(names)
    assert [p["name"] for p in names["to_cell"]["parameters"]] == ["lat", "lon", "res", "cell"]
    with pytest.raises(TypeError):
        transforms.named("to_cell", "lat")
    with pytest.raises(KeyError):
        transforms.named("nothing_of_the_kind")
    df = spark.createDataFrame([(56.0, 45.0)], "lat double, lon double")
    assert "cell" in df.transform(transforms.named("to_cell", "lat", "lon")).columns


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 2
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_files_are_sized_apart_from_shuffles(spark, tmp_path):
    import glob

    from tideway.sources import tables

    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    df = spark.range(400_000).selectExpr("id", "sha2(cast(id as string), 256) as h").repartition(16)
    tables.write_table(df, str(tmp_path / "t"))
    assert len(glob.glob(str(tmp_path / "t" / "*.parquet"))) == 1 and spark.conf.get(key) == before


def test_gzip_is_spread(spark, tmp_path):
    import gzip

    from tideway.sources import tables

    path = tmp_path / "rows.csv.gz"
    with gzip.open(path, "wt") as f:
        f.write("k,v\n" + "".join(f"{i},{i}\n" for i in range(1000)))
    df = tables.read_csv_keyed(spark, str(path), "k int, v int", "k", "load-1")
    assert df.count() == 1000 and df.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
