"""Token-id shards in training order.

Token ids of all documents run on, task by task, and are cut into sequences of one length. A keyed Feistel network over the
next power of four permutes the sequence numbers; numbers beyond the last sequence walk on along their cycle. The result is
the slot of a sequence in the training order. Range partitions of slots, with exact bounds as slots are dense, write
shards of fixed-stride records: record ``slot % per_shard`` of shard ``slot // per_shard``. A reader seeks to any slot and
goes on in order; a writer that starts again leaves finished shards alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideway.llm.common import shuffle_parts
from tideway.llm.tokens import default_vocabulary, encode
from tideway.session import materialise, scratch_path

ROUNDS = 6
#: Stored sequences hardly repeat whole, so they get no dictionary; their ids compress best in large pages.
STORED = {
    "compression": "zstd", "parquet.compression.codec.zstd.level": "9", "parquet.enable.dictionary": "false",
    "parquet.page.size": str(4 << 20),
}
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser of the half and a round key."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _round_keys(key: int) -> list[int]:
    return [(key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03 + 1) % 2**64 for r in range(ROUNDS)]


def permute(numbers: np.ndarray, total: int, key: int, back: bool = False) -> np.ndarray:
    """Slots of sequence numbers in [0, total): a bijection for every key; ``back`` inverts it."""
    half = np.uint64(max(1, (max(total - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = _round_keys(key)
    out = np.asarray(numbers, np.uint64).copy()
    open_at = np.arange(len(out))
    while len(open_at):
        left, right = out[open_at] >> half, out[open_at] & mask
        for k in reversed(keys) if back else keys:
            if back:
                left, right = right ^ (_mix(left, k) & mask), left
            else:
                left, right = right, left ^ (_mix(right, k) & mask)
        out[open_at] = (left << half) | right
        open_at = open_at[out[open_at] >= np.uint64(total)]
    return out.astype(np.int64)


@dataclass(frozen=True)
class Layout:
    """Where record ``slot`` is: a shard file of ``per_shard`` records of ``length`` ids."""

    path: str
    total: int
    length: int
    per_shard: int
    dtype: str

    @property
    def stride(self) -> int:
        return self.length * np.dtype(self.dtype).itemsize

    def shard_file(self, shard: int) -> str:
        return f"{self.path}/shard-{shard:08d}.bin"

    def records(self, shard: int) -> int:
        return max(0, min(self.per_shard, self.total - shard * self.per_shard))


def read_from(layout: Layout, slot: int = 0) -> Iterator[np.ndarray]:
    """Sequences from ``slot`` on, in training order."""
    while slot < layout.total:
        shard, at = divmod(slot, layout.per_shard)
        files, path = fs.FileSystem.from_uri(layout.shard_file(shard))
        with files.open_input_file(path) as f:
            f.seek(at * layout.stride)
            for _ in range(layout.records(shard) - at):
                yield np.frombuffer(f.read(layout.stride), layout.dtype)
                slot += 1


def _sequences(batches, length: int, end_id: int, vocabulary, dtype: str) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(first document, ids that count, ids) of each sequence of a task; the last is filled up with the end id."""
    run, size, first = np.full(length, end_id, dtype), 0, None
    end = np.array([end_id], "<u4")
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids, at = np.concatenate((encode(text.as_py() or "", vocabulary), end)), 0
            while at < len(ids):
                if not size:
                    first = key
                take = min(length - size, len(ids) - at)
                run[size : size + take] = ids[at : at + take]
                size, at = size + take, at + take
                if size == length:
                    yield first, length, run
                    run, size = np.full(length, end_id, dtype), 0
    if size:
        yield first, size, run


def training_order(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 1024, per_shard: int = 4096, key: int = 20240601,
    end_id: int = 0, vocabulary: tuple[str, str] | None = None, dtype: str = "<u2", path: str | None = None,
) -> tuple[DataFrame, Layout]:
    """Write the shards and return (manifest, layout); the manifest has one row per sequence.

    Manifest: slot, shard, record, first_doc (id of the document its first token is from), n_tokens (ids that are not
    filling) and ids_crc32 (of the record as uint32). The table is tokenised once, into stored sequences with their task and
    their number in it; slots follow from the stored counts, so nothing is read twice. A null text is an empty one (its end
    id alone); repeated rows are written each; the last sequence of a task is filled with the end id; an empty table writes
    nothing. Other columns are ignored. ``path`` defaults to a fresh folder in the shared one; with a path of an earlier run
    of the same table, complete shards are not written again. ``dtype`` must hold every id.
    """
    spark = df.sparkSession
    vocabulary = vocabulary or default_vocabulary()
    path = path or scratch_path(spark, "shards")
    source = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def send() -> pa.RecordBatch:
            nonlocal number
            docs, sizes, ids = zip(*held)
            out = pa.RecordBatch.from_pydict({
                "part": pa.array(np.full(len(held), part, np.int32)), "number": pa.array(np.arange(number, number + len(held))),
                "first_doc": pa.array(docs, pa.int64()), "n_tokens": pa.array(sizes, pa.int64()), "ids": pa.array(ids, pa.binary()),
            })
            number += len(held)
            held.clear()
            return out

        for doc, size, ids in _sequences(batches, length, end_id, vocabulary, dtype):
            held.append((doc, size, ids.tobytes()))
            if len(held) == 1024:
                yield send()
        if held:
            yield send()

    stored = materialise(
        source.mapInArrow(cut, "part int, number long, first_doc long, n_tokens long, ids binary"), "sequences", **STORED
    )
    # One row per task, and one number per task in the closure.
    counts = stored.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    total = sum(c["n"] for c in counts)
    firsts = np.zeros(counts[-1]["part"] + 1 if counts else 0, np.int64)
    firsts[[c["part"] for c in counts]] = np.cumsum([0, *[c["n"] for c in counts]])[:-1]
    layout = Layout(path, total, length, per_shard, dtype)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(6).compress
        for batch in batches:
            slots = permute(firsts[batch.column(0).to_numpy()] + batch.column(1).to_numpy(), total, key)
            packed = pa.array([pack(ids.as_buffer()) for ids in batch.column(4)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(slots), batch.column(2), batch.column(3), packed], names=["slot", "first_doc", "n_tokens", "ids"]
            )

    placed = stored.mapInArrow(place, "slot long, first_doc long, n_tokens long, ids binary")
    shards = -(-total // per_shard)
    parts = max(1, min(shuffle_parts(df, None), shards))
    # Whole shards to a partition, in order; slots are dense, so no sampling is needed for even ranges.
    bound = F.floor(F.floor(F.col("slot") / per_shard) * parts / max(1, shards)).cast("int")
    ranged = placed.repartitionById(parts, bound).sortWithinPartitions("slot")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = fs.FileSystem.from_uri(path)
        files.create_dir(folder, recursive=True)
        out, shard, target, temp = None, -1, "", ""
        unpack = zstandard.ZstdDecompressor().decompress

        def close() -> None:
            if out is not None:
                out.close()
                files.move(temp, target)  # a shard appears whole or not at all

        for batch in batches:
            crcs = []
            for slot, packed in zip(batch.column(0).to_pylist(), batch.column(3)):
                if slot // per_shard != shard:
                    close()
                    out, shard = None, slot // per_shard
                    target = fs.FileSystem.from_uri(layout.shard_file(shard))[1]
                    if files.get_file_info(target).size != layout.records(shard) * layout.stride:
                        temp = f"{target}.{TaskContext.get().taskAttemptId()}"
                        out = files.open_output_stream(temp)
                record = unpack(packed.as_buffer())
                crcs.append(zlib.crc32(np.frombuffer(record, dtype).astype("<u4").tobytes()))
                if out is not None:
                    out.write(record)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(crcs, pa.int64())],
                names=["slot", "first_doc", "n_tokens", "ids_crc32"],
            )
        close()

    written = ranged.mapInArrow(write, "slot long, first_doc long, n_tokens long, ids_crc32 long")
    manifest = materialise(written, "manifest").select(
        "slot", F.floor(F.col("slot") / per_shard).alias("shard"), (F.col("slot") % per_shard).alias("record"), "first_doc", "n_tokens",
        "ids_crc32",
    )
    return manifest, layout
