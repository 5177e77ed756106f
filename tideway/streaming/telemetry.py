"""Bucket means over a stream of readings; the batch operator with a watermark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bucket_mean(
    df: DataFrame, keys: Sequence[str], time: str, seconds: int, cols: Sequence[str],
    lateness: str = "10 minutes",
) -> DataFrame:
    """Means per key and time bucket, emitted once the watermark passes the bucket's end.

    State is one running sum per open bucket. Readings later than ``lateness`` are dropped, as
    a watermark does; the batch operator over the stored readings has no such limit.
    """
    kept = df.filter(" and ".join(f"`{c}` is not null" for c in cols))
    bucket = F.window(time, f"{seconds} seconds").alias("__w")
    out = kept.withWatermark(time, lateness).groupBy(*keys, bucket).agg(
        *[F.avg(c).alias(c) for c in cols]
    )
    return out.select(*keys, F.unix_timestamp(F.col("__w.start")).alias("epoch"), *cols)
