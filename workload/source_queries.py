"""Sources and sinks: each query writes from a bundled table and reads its own output."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tideway.operators.columns import label_by_groups
from tideway.session import scratch_path
from tideway.sources import raster, tables
from workload.derive import telemetry
from workload.registry import Tables, q2, q6, query, r2, r6


def _stored_orders(t: Tables) -> str:
    path = scratch_path(t.spark, "orders")
    tables.write_table(t.orders, path, ["o_orderstatus"])
    return path


@query("s01_read_subtree", f"""
select o_orderstatus, o_orderpriority, count(*) as n, {q2('sum(o_totalprice)')} as total
from orders where o_orderstatus = 'F' group by 1, 2""")
def s01(t):
    df = tables.read_table(t.spark, _stored_orders(t), "o_orderstatus=F/")
    return df.groupBy("o_orderstatus", "o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), r2(F.sum("o_totalprice")).alias("total")
    )


@query("s02_read_nested", "select o_orderpriority, count(*) as n, max(o_orderkey) as top from orders group by 1")
def s02(t):
    df = tables.read_nested(t.spark, _stored_orders(t))
    return df.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("top"))


def _name(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4().hex}"


@query("s03_read_catalog_table", "select r_regionkey, r_name, count(*) as n from region join nation on n_regionkey = r_regionkey group by 1, 2")
def s03(t):
    name = _name("catalog_nation")
    tables.save_as_table(t.nation, name, scratch_path(t.spark, name))
    df = t.spark.table(name)
    return t.region.join(df, F.col("n_regionkey") == F.col("r_regionkey")).groupBy(
        "r_regionkey", "r_name"
    ).agg(F.count(F.lit(1)).alias("n"))


@query("s04_read_csv_keyed", """
select cast(c_custkey as varchar) as c_custkey, c_mktsegment, c_acctbal, 'batch-1' as upload_key from customer""")
def s04(t):
    path = scratch_path(t.spark, "customers-csv")
    t.customer.select("c_custkey", "c_mktsegment", "c_acctbal").write.option("header", "true").option(
        "compression", "gzip"
    ).csv(path)
    return tables.read_csv_keyed(
        t.spark, path, "c_custkey long, c_mktsegment string, c_acctbal double", "c_custkey", "batch-1", parts=8
    )


SEGMENTS = "select c_mktsegment, count(*) as n, max(c_acctbal) as top from customer group by c_mktsegment"


@query("s05_sql_text", SEGMENTS)
def s05(t):
    return tables.sql(t.spark, SEGMENTS, {"customer": t.customer})


@query("s06_cached_query", SEGMENTS)
def s06(t):
    tables.register_views({"customer": t.customer})
    root = scratch_path(t.spark, "query-cache")
    tables.cached_query(t.spark, SEGMENTS, root)  # first call runs and stores
    return tables.cached_query(t.spark, SEGMENTS, root)  # second call reads


@query("s07_inline_rows", """
select s.label, count(*) as n from customer c
join (values ('BUILDING', 'b'), ('MACHINERY', 'm'), ('FURNITURE', 'f')) s(c_mktsegment, label)
  on c.c_mktsegment = s.c_mktsegment group by 1""")
def s07(t):
    rows = tables.inline_rows(
        t.spark, [("BUILDING", "b"), ("MACHINERY", "m"), ("FURNITURE", "f")], "c_mktsegment string, label string"
    )
    return t.customer.join(F.broadcast(rows), "c_mktsegment").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("s08_write_partitions", f"""
select o_orderstatus, count(*) as n, {q2("sum(case when o_orderstatus = 'P' then 0 else o_totalprice end)")} as total
from orders group by 1""")
def s08(t):
    path = _stored_orders(t)
    # a second write of one partition must leave the others alone
    tables.write_table(
        t.orders.filter("o_orderstatus = 'P'").withColumn("o_totalprice", F.lit(0.0)), path, ["o_orderstatus"]
    )
    return tables.read_table(t.spark, path).groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), r2(F.sum("o_totalprice")).alias("total")
    )


@query("s09_create_table_as", "select l_returnflag, l_suppkey, count(*) as n from lineitem group by 1, 2")
def s09(t):
    tables.register_views({"lineitem_in": t.lineitem})
    name = _name("ctas_lineitem")
    tables.create_table_as(
        t.spark, name, "select l_suppkey, l_orderkey, l_returnflag from lineitem_in",
        scratch_path(t.spark, name), ["l_returnflag"],
    )
    return t.spark.table(name).groupBy("l_returnflag", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))


@query("s10_write_and_register", "select p_brand, count(*) as n, max(p_size) as largest from part group by 1")
def s10(t):
    name = _name("catalog_part")
    tables.save_as_table(t.part, name, scratch_path(t.spark, name), ["p_brand"])
    return t.spark.table(name).groupBy("p_brand").agg(
        F.count(F.lit(1)).alias("n"), F.max("p_size").alias("largest")
    )


@query("s11_register_partitions", "select o_orderstatus, count(*) as n from orders group by 1")
def s11(t):
    name, path = _name("found_orders"), _stored_orders(t)
    tables.register_partitions(
        t.spark, name, path, "o_orderkey long, o_custkey long, o_totalprice double, o_orderstatus string",
        ["o_orderstatus"],
    )
    return t.spark.table(name).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("s12_drop_table", "select false as still_there, count(*) as n from nation")
def s12(t):
    name = _name("dropped_nation")
    tables.save_as_table(t.nation, name, scratch_path(t.spark, name))
    n = t.spark.table(name)
    tables.drop_table(t.spark, name)
    return t.nation.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(t.spark.catalog.tableExists(name)).alias("still_there"), "n"
    )


@query("s13_explode_raster", f"""
with points as (
  select -90 + vec_id % 180 + 0.25e0 as lat, -180 + i * 5.5e0 as lon, embedding[i + 1] as value
  from (select *, unnest(generate_series(0, len(embedding) - 1)) as i from embeddings))
select floor(lat / 10) * 10 as lat_bin, floor(lon / 10) * 10 as lon_bin, count(*) as n,
  {q6('avg(cast(value as double))')} as mean
from points group by 1, 2""")
def s13(t):
    tiles = t.embeddings.select(
        F.array(-90 + F.col("vec_id") % 180 + 0.25).alias("lats"),
        F.transform("embedding", lambda _, i: -180 + i * 5.5).alias("lons"),
        F.array("embedding").alias("values"),
    )
    points = raster.explode_raster(tiles, "lats", "lons", "values")
    return points.groupBy("lat_bin", "lon_bin").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg(F.col("value").cast("double"))).alias("mean")
    )


@query("s14_csv_report", """
select c_custkey, case c_mktsegment when 'BUILDING' then 'trade' when 'HOUSEHOLD' then 'home' end as label from customer
where c_mktsegment in ('BUILDING', 'HOUSEHOLD')""")
def s14(t):
    groups = {"trade": ["BUILDING"], "home": ["HOUSEHOLD"]}
    rows = label_by_groups(t.customer, "c_mktsegment", groups, "label").filter("label is not null")
    path = scratch_path(t.spark, "report")
    tables.write_report(rows.select("c_custkey", "label"), path)
    return t.spark.read.schema("c_custkey long, label string").csv(path, header=True)


@query("s15_bounded_parts", "select count(*) as n, true as within_limit from events")
def s15(t):
    path = scratch_path(t.spark, "parts")
    tables.write_table(telemetry(t), path, max_rows_per_file=1000)
    files = t.spark.read.parquet(path).groupBy(F.col("_metadata.file_path")).agg(F.count(F.lit(1)).alias("c"))
    return files.agg(F.sum("c").alias("n"), (F.max("c") <= 1000).alias("within_limit"))
