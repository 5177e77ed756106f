"""Keyed state over streams: first reading of a bucket, next state of a track, and tracks joined with readings by day.

Each gives the rows of its batch operator once the watermark has passed them; rows that come later than ``lateness`` are
dropped, as a watermark does, and so are rows without a time. State is kept in Spark's state store and survives lost
executors and restarts through the checkpoint of the query.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_bucket_first(
    df: DataFrame, keys: Sequence[str], time: str, seconds: int, col: str, tie: Sequence[str] = (), lateness: str = "10 minutes"
) -> DataFrame:
    """Earliest reading per key and time bucket, null readings included: ``bucket_first`` on a stream.

    State is one reading per open bucket, so neither hot keys nor repeated rows make it grow.
    """
    first = F.min_by(F.struct(F.col(col)), F.struct(time, *tie, *([] if tie else [col]))).alias("__f")
    kept = df.filter(F.col(time).isNotNull()).withWatermark(time, lateness)
    out = kept.groupBy(*keys, F.window(time, f"{seconds} seconds").alias("__w")).agg(first)
    return out.select(*keys, F.col("__f")[col].alias(col), F.unix_timestamp(F.col("__w.start")).alias("epoch"))


def _read(kind: T.DataType):
    """States travel as text; ties in time are ordered by their own type."""
    return int if isinstance(kind, T.IntegralType) else float if isinstance(kind, T.FractionalType) else str


#: How moments inside nested keys are written.
_JSON = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _key_text(col: Column, kind: T.DataType) -> Column:
    """A key as text that ``_key_value`` reads back: equal keys have equal texts, null stays null."""
    if isinstance(kind, (T.StructType, T.ArrayType)):
        return F.to_json(col, _JSON)
    if isinstance(kind, T.BinaryType):
        return F.base64(col)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(col).cast("string")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        col = col + F.lit(0.0)  # both zeros are one key
    return col.cast("string")


def _key_value(col: Column, kind: T.DataType) -> Column:
    """The key behind ``_key_text``."""
    if isinstance(kind, (T.StructType, T.ArrayType)):
        return F.from_json(col, kind, _JSON)
    if isinstance(kind, T.BinaryType):
        return F.unbase64(col)
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(col.cast("long"))
    return col.cast(kind)


def _packed_rows(rows: list[tuple], schema: pa.Schema) -> bytes:
    """Rows (key texts, time, state) as compressed Arrow."""
    sink = pa.BufferOutputStream()
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)]
    with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=schema))
    return sink.getvalue().to_pybytes()


def _unpacked_rows(data: bytes) -> Iterator[tuple]:
    """The rows behind ``_packed_rows``."""
    table = pa.ipc.open_stream(data).read_all()
    return zip(*[c.to_pylist() for c in table.columns])


def final_states(rows: list[tuple[int, str | None]], watermark: int, gap: int) -> tuple[list[tuple], list[tuple], int | None]:
    """(rows that are final with their next state, rows that stay, when the first of these is final), times in microseconds.

    ``rows`` are sorted and hold all rows up to the watermark. A row is final once the watermark has reached the row that
    follows it, or the gap after it.
    """
    done = []
    for at, (when, state) in enumerate(rows):
        after = rows[at + 1] if at + 1 < len(rows) else None
        due = when + gap if after is None else min(when + gap, after[0])
        if due > watermark:
            return done, rows[at:], due
        done.append((when, state, after[1] if after and after[0] <= when + gap else None))
    return done, [], None


def stream_next_state(
    df: DataFrame, keys: Sequence[str], time: str, state: str, next_name: str, gap_seconds: int, lateness: str = "10 minutes",
    buckets: int = 2048,
) -> DataFrame:
    """Keys, time, state and the state that follows within ``gap_seconds`` in the same track, else null: ``lead`` on a stream.

    Rows of a key are ordered by time, then state (nulls first). A row that repeats another's key, time and state is taken
    once while that row is held. A row leaves the state when its successor is certain or the gap is over, by a timer if
    nothing more arrives; a key holds the rows of the lateness, the gap and one more. A null key is a track of its own.
    Tracks are dealt to ``buckets`` by hash and a trigger calls Python once a bucket, not once a track. A bucket's rows of a
    trigger are in memory together; the number stays the same for the life of a checkpoint.
    """
    own = {c: df.schema[c] for c in keys}
    kind = df.schema[state].dataType
    read, gap = _read(kind), gap_seconds * 1_000_000
    names = [f"__k{at}" for at in range(len(keys))]
    texts = [T.StructField(n, T.StringType()) for n in names]
    out_type = T.StructType([*texts, *[T.StructField(n, t) for n, t in (("__t", T.LongType()), ("__s", T.StringType()), ("__n", T.StringType()))]])
    state_type = T.StructType([T.StructField("rows", T.BinaryType())])
    packing = pa.schema([*[(n, pa.string()) for n in names], ("__t", pa.int64()), ("__s", pa.string())])
    source = df.filter(F.col(time).isNotNull()).withWatermark(time, lateness)
    source = source.select(
        time, *[_key_text(F.col(f"`{c}`"), f.dataType).alias(n) for n, (c, f) in zip(names, own.items())],
        F.unix_micros(time).alias("__t"), F.col(state).cast("string").alias("__s"),
    ).withColumn("__bucket", F.pmod(F.xxhash64(*names), F.lit(buckets)).cast("int"))

    def order(row: tuple[int, str | None]) -> tuple:
        return row[0], row[1] is not None, None if row[1] is None else read(row[1])

    def plain(column: pd.Series) -> list:
        return column.astype(object).where(column.notna(), None).tolist()

    def step(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        tracks = defaultdict(set)
        for row in _unpacked_rows(held.get[0]) if held.exists else ():
            tracks[row[:-2]].add(row[-2:])
        for frame in frames:
            for row in zip(*[plain(frame[n]) for n in packing.names]):
                tracks[row[:-2]].add(row[-2:])
        watermark, done, rest, dues = held.getCurrentWatermarkMs() * 1000, [], [], []
        for track, rows in tracks.items():
            some, more, due = final_states(sorted(rows, key=order), watermark, gap)
            done += [(*track, *row) for row in some]
            rest += [(*track, *row) for row in more]
            dues += [due] if more else []
        if rest:
            held.update((_packed_rows(rest, packing),))
            held.setTimeoutTimestamp(-(-min(dues) // 1000))
        elif held.exists:
            held.remove()
        if done:
            yield pd.DataFrame(done, columns=out_type.names).astype({n: object for n in out_type.names if n != "__t"})

    found = source.groupBy("__bucket").applyInPandasWithState(step, out_type, state_type, "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(
        *[_key_value(F.col(n), f.dataType).alias(c) for n, (c, f) in zip(names, own.items())],
        F.timestamp_micros("__t").alias(time), F.col("__s").cast(kind).alias(state), F.col("__n").cast(kind).alias(next_name),
    )


def stream_join_days(
    tracks: DataFrame, readings: DataFrame, keys: Sequence[str], track_time: str, reading_time: str, lateness: str = "1 hour",
    how: str = "inner", day: str = "date",
) -> DataFrame:
    """Rows of both streams with the same keys on the same day (UTC), plus that ``day``.

    The day is part of the join key, so a day's rows leave the state when the watermark has passed its end on both sides.
    ``how`` may be ``left_outer``: days without readings follow then. Null keys meet nothing. The right side's keys are
    dropped; other columns must differ in name.
    """
    # Only the day keeps the watermark: a stream may have one event time.
    plain = {t: F.col(t).alias(t, metadata={}) for t in (track_time, reading_time)}
    left = tracks.filter(F.col(track_time).isNotNull()).withWatermark(track_time, lateness)
    right = readings.filter(F.col(reading_time).isNotNull()).withWatermark(reading_time, lateness)
    left = left.select(*[plain.get(c, c) for c in tracks.columns], F.window(track_time, "1 day").alias("__day"))
    right = right.select(
        *[F.col(k).alias(f"__{k}") for k in keys], *[plain.get(c, c) for c in readings.columns if c not in keys],
        F.window(reading_time, "1 day").alias("__right_day"),
    )
    on = F.col("__day") == F.col("__right_day")
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    out = left.join(right, on, how)
    return out.select(
        *tracks.columns, *[c for c in readings.columns if c not in keys], F.to_date(F.col("__day.start")).alias(day)
    )
