"""Session settings and the shared scratch folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings every job benefits from; cluster sizing is left to spark-submit.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join side even when that costs one more exchange downstream.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Alternatives multiply rows after an exchange (10 classes, 20-odd cells), so shuffle
    # partitions are kept well below the usual size, and short inputs are not merged into one.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}

#: On a cluster a shuffle starts from this many partitions, which adaptive execution merges where they are small; without
#: it, a large shuffle never has enough of them.
CLUSTER_DEFAULTS = {"spark.sql.adaptive.coalescePartitions.initialPartitionNum": "4000"}


def build_session(app: str = "tideway", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or get) a session with the library defaults; ``conf`` overrides them.

    Without a master, or with one that is not local, the defaults for clusters are added.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    cluster = {} if (master or "").startswith("local") else CLUSTER_DEFAULTS
    for key, value in {**DEFAULTS, **cluster, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Shared folder of the cluster, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster a machine-local
    path would be lost with the machine, so a missing setting is an error there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="tideway-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str = "stage", **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder, with the writer's ``options``, and read it back.

    Unlike a cache this survives lost executors, fixes the outcome of non-deterministic
    steps, and leaves a columnar table that later steps can prune.
    """
    return materialise_at(df, label, **options)[0]


def materialise_at(df: DataFrame, label: str = "stage", **options: str) -> tuple[DataFrame, str]:
    """As ``materialise``, with the path of the table, for ``release``."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def release(df: DataFrame, path: str) -> None:
    """Give back the disk of a scratch table that no later step reads, by writing an empty one in its place."""
    df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").parquet(path)
