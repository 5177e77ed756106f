"""Running a stream to the end of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tideway.session import scratch_path


def run_to_end(stream: DataFrame, label: str = "stream") -> DataFrame:
    """The rows a stream gives for all input of this moment, written to the shared folder and read back."""
    spark = stream.sparkSession
    out = scratch_path(spark, label)
    query = (
        stream.writeStream.option("checkpointLocation", scratch_path(spark, f"{label}-state"))
        .trigger(availableNow=True).start(out, "parquet", "append")
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
