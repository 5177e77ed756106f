"""Tables: partitioned files, catalog tables, keyed CSV loads, cached queries, reports."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, base: str, sub_path: str = "") -> DataFrame:
    """Read a partitioned folder, or a part of it, with all partition columns.

    A filter on partition columns prunes as well; ``sub_path`` saves listing the rest.
    """
    if sub_path.startswith("/"):
        raise ValueError("sub_path is relative to base")
    root = base.rstrip("/") + "/"
    return spark.read.option("basePath", root).parquet(root + sub_path)


def read_nested(spark: SparkSession, root: str) -> DataFrame:
    """All files below ``root`` at any depth; folder names are not read as partitions."""
    return spark.read.option("recursiveFileLookup", "true").parquet(root)


def read_csv_keyed(
    spark: SparkSession, path: str, schema: str, key: str, upload_key: str, parts: int | None = None
) -> DataFrame:
    """CSV (also gzipped) with a fixed schema, its key as string, stamped with the load's key.

    A gzip file arrives as one partition, so rows are spread over ``parts`` tasks, by default as many as the session shuffles.
    """
    df = spark.read.schema(schema).csv(path, header=True)
    df = df.withColumns({key: F.col(key).cast("string"), "upload_key": F.lit(upload_key)})
    return df.repartition(parts or int(spark.conf.get("spark.sql.shuffle.partitions")))


def register_views(views: dict[str, DataFrame]) -> None:
    for name, df in views.items():
        df.createOrReplaceTempView(name)


def sql(spark: SparkSession, text: str, views: dict[str, DataFrame] | None = None) -> DataFrame:
    """Run SQL text over the given frames, named as views."""
    register_views(views or {})
    return spark.sql(text)


def _finished(spark: SparkSession, marker: str) -> bool:
    try:
        return spark.read.schema("done boolean").parquet(marker).count() == 1
    except AnalysisException:
        return False


def inputs_digest(df: DataFrame) -> str:
    """Digest of paths, times and lengths of the files behind ``df``; their content is not read.

    Files are listed by Spark and folded into one row, so the driver holds their names only. A frame without files (inline rows)
    gives a constant.
    """
    files = df.inputFiles()
    if not files:
        return "none"
    seen = df.sparkSession.read.format("binaryFile").load(files).select(F.xxhash64("path", "modificationTime", "length").alias("h"))
    r = seen.agg(F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.sum(F.pmod("h", F.lit(1 << 40))).alias("s")).first()
    return f"{r.n}-{r.x}-{r.s}"


def cached_query(spark: SparkSession, text: str, cache_root: str) -> DataFrame:
    """Result of a query, stored under a key of the query and its inputs, and read back when present.

    The key is the SHA-256 of the text, the analysed plan (so a view that was defined anew counts) and the files the plan reads
    with their times and lengths. Changed inputs therefore give fresh rows; unchanged ones cost a listing. A marker written
    after the result tells a finished write from a broken one. Old results stay; their owner clears the folder.
    """
    df = spark.sql(text)
    key = f"{text}|{df.semanticHash()}|{inputs_digest(df)}"
    path = f"{cache_root.rstrip('/')}/{hashlib.sha256(key.encode('utf-8')).hexdigest()}"
    if not _finished(spark, f"{path}/done"):
        df.write.mode("overwrite").parquet(f"{path}/result")
        spark.range(1).select(F.lit(True).alias("done")).write.mode("overwrite").parquet(f"{path}/done")
    return spark.read.parquet(f"{path}/result")


#: Bytes wanted in a file; shuffle partitions are far smaller, as alternatives multiply their rows.
FILE_BYTES = "256m"
#: The same for tables in partition folders: a task sorts its rows by folder before it writes, so this bounds its memory.
SORTED_BYTES = "64m"


@contextmanager
def _file_sized(spark: SparkSession, partition_by: Sequence[str] = ()):
    """While a table is written, partitions are merged and split to the size of files."""
    sized = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": SORTED_BYTES if partition_by else FILE_BYTES,
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }
    before = {k: spark.conf.get(k) for k in sized}
    try:
        for k, v in sized.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _even_files(df: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    # Rebalance groups rows by partition value, splits values that are too large for one file
    # and merges small ones; a plain repartition would send a hot value to one task.
    return df.hint("rebalance", *[F.col(c) for c in partition_by]) if partition_by else df.hint("rebalance")


def write_table(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), max_rows_per_file: int = 0
) -> None:
    """Write Parquet by partition; only the partitions present in ``df`` are replaced."""
    writer = _even_files(df, partition_by).write.mode("overwrite")
    writer = writer.option("partitionOverwriteMode", "dynamic").option("compression", "snappy")
    if max_rows_per_file:
        writer = writer.option("maxRecordsPerFile", max_rows_per_file)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with _file_sized(df.sparkSession, partition_by):
        writer.parquet(path)


def save_as_table(
    df: DataFrame, name: str, path: str | None = None, partition_by: Sequence[str] = ()
) -> None:
    """Write and register in the catalog, at a location of one's own when ``path`` is given."""
    writer = _even_files(df, partition_by).write.mode("overwrite").format("parquet")
    writer = writer.option("compression", "snappy")
    if path:
        writer = writer.option("path", path)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with _file_sized(df.sparkSession, partition_by):
        writer.saveAsTable(name)


def create_table_as(
    spark: SparkSession, name: str, query: str, path: str | None = None, partition_by: Sequence[str] = ()
) -> None:
    """CREATE TABLE ... AS with format, compression, location and partitioning."""
    parts = f" PARTITIONED BY ({', '.join(partition_by)})" if partition_by else ""
    where = f" LOCATION '{path}'" if path else ""
    spark.sql(
        f"CREATE TABLE {name} USING parquet OPTIONS ('compression' = 'snappy'){parts}{where} AS {query}"
    )


def register_partitions(spark: SparkSession, name: str, path: str, schema: str, partition_by: Sequence[str]) -> None:
    """Put a table over files that already lie in partition folders, and find the folders."""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet "
        f"PARTITIONED BY ({', '.join(partition_by)}) LOCATION '{path}'"
    )
    spark.catalog.recoverPartitions(name)


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def inline_rows(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def write_report(df: DataFrame, path: str) -> None:
    """CSV with a header. The number of files follows the data; nothing is gathered."""
    df.write.mode("overwrite").option("header", "true").csv(path)
