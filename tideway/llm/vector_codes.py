"""Codes of vectors by parts: one codebook a part, fitted by exact rounds of means over metric trees.

The trees are grown once, one a part for every few thousand vectors, and written with the vectors and the caller's columns.
A round reads them, adds what wholly owned balls cache and sends one sum an entry from every task; the last pass reads them
again for codes and errors. Only codebooks and first entries pass through the driver, both of a size that parameters fix.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tideway.llm.common import numbered
from tideway.llm.metric_trees import Tree, grow, nearest
from tideway.operators.joins import join_totals
from tideway.session import materialise

#: Vectors that share a tree, and the integer at which components saturate, so that errors fit a long.
CHUNK, MOST = 2048, 1 << 26


@dataclass
class Codebooks:
    """Integer entries by part, entry and position."""

    entries: np.ndarray

    def digest(self) -> str:
        """SHA-256 of all components in order, as decimal integers joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def integers(vectors: Sequence[Sequence[float]] | np.ndarray, parts: int) -> np.ndarray:
    """floor(1024 * x) by row, part and position; zeros fill up a last part that is too short."""
    rows = np.clip(np.floor(np.asarray(vectors, np.float64) * 1024), -MOST, MOST).astype(np.int64)
    wide = -(-rows.shape[1] // parts)
    return np.pad(rows, ((0, 0), (0, wide * parts - rows.shape[1]))).reshape(len(rows), parts, wide)


def _packed(values: np.ndarray, trees: list[Tree]) -> bytes:
    held = {f"{name}{n}": getattr(t, name) for n, t in enumerate(trees) for name in Tree.FIELDS}
    np.savez(out := io.BytesIO(), values=values.astype(np.int32), **held)
    return out.getvalue()


def _unpacked(blob: bytes) -> tuple[np.ndarray, list[Tree]]:
    with np.load(io.BytesIO(blob)) as held:
        values = held["values"]
        return values, [Tree(*[held[f"{name}{n}"] for name in Tree.FIELDS]) for n in range(values.shape[1])]


def plant(rows: DataFrame, parts: int, chunk: int = CHUNK) -> DataFrame:
    """One row for at most ``chunk`` vectors: the other columns as an Arrow stream, and vectors with their trees; written."""
    held = to_arrow_schema(T.StructType(rows.schema.fields[:-1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def grown(some: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.Table.from_batches(some).combine_chunks().to_batches()[0]
            vectors = whole.column(whole.num_columns - 1)
            values = integers(vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1), parts)
            blob = _packed(values, [grow(values[:, p]) for p in range(parts)])
            with pa.ipc.new_stream(sink := io.BytesIO(), held) as stream:
                stream.write_batch(pa.RecordBatch.from_arrays(whole.columns[:-1], schema=held))
            return pa.RecordBatch.from_arrays([pa.array([sink.getvalue()], pa.binary()), pa.array([blob], pa.binary())], names=["others", "trees"])

        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                piece = batch.slice(at, chunk)
                room = chunk - sum(b.num_rows for b in waiting)
                waiting.append(piece.slice(0, room))
                if sum(b.num_rows for b in waiting) == chunk:
                    yield grown(waiting)
                    waiting = [piece.slice(room)] if piece.num_rows > room else []
        if sum(b.num_rows for b in waiting):
            yield grown(waiting)

    return materialise(rows.mapInArrow(run, "others binary, trees binary"), "trees", compression="zstd")


def fit_round(planted: DataFrame, books: Codebooks) -> Codebooks:
    """Entries moved to the floored means of their parts; unused ones stay."""
    parts, k, wide = books.entries.shape
    names = [f"s{i}" for i in range(wide)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, k, wide), np.int64), np.zeros((parts, k), np.int64)
        for batch in batches:
            for blob in batch.column(0):
                values, trees = _unpacked(blob.as_py())
                for p, tree in enumerate(trees):
                    _, s, n = nearest(tree, values[:, p], books.entries[p])
                    sums[p] += s
                    counts[p] += n
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (p, e, counts[p, e], *sums[p, e].T)], names=["p", "e", "n", *names])

    told = planted.select("trees").mapInArrow(run, ", ".join(f"`{c}` long" for c in ["p", "e", "n", *names]))
    moved = books.entries.copy()
    for r in told.groupBy("p", "e").agg(*[F.sum(c).alias(c) for c in ["n", *names]]).collect():  # a row an entry
        moved[r.p, r.e] = np.array([r[c] for c in names], np.int64) // r.n
    return Codebooks(moved)


def assign(planted: DataFrame, books: Codebooks, schema: T.StructType) -> DataFrame:
    """The rows with their code, two hex digits a part, and their squared error over all parts."""
    held = to_arrow_schema(schema)
    digits = max(2, len(f"{max(books.entries.shape[1] - 1, 0):x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for others, blob in zip(batch.column(0), batch.column(1)):
                values, trees = _unpacked(blob.as_py())
                found = np.stack([nearest(t, values[:, p], books.entries[p])[0] for p, t in enumerate(trees)], axis=1)
                chosen = np.stack([books.entries[p][found[:, p]] for p in range(found.shape[1])], axis=1)
                error = ((values.astype(np.int64) - chosen) ** 2).sum(axis=(1, 2))
                code = ["".join(f"{e:0{digits}x}" for e in row) for row in found.tolist()]
                whole = pa.ipc.open_stream(others.as_py()).read_next_batch()
                yield pa.RecordBatch.from_arrays([*whole.columns, pa.array(code), pa.array(error)], names=[*held.names, "code", "error"])

    return planted.mapInArrow(run, T.StructType([*schema.fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]))


def compress(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = 4, entries: int = 256, rounds: int = 4,
    chunk: int = CHUNK, keep: Sequence[str] | None = None,
) -> tuple[DataFrame, Codebooks]:
    """(rows with ``code`` and ``error``, codebooks).

    Rows whose vector is null, empty, or holds null or non-finite components are dropped, and so are those whose length differs
    from that of the smallest id's. Components become floor(1024 * x) and saturate at 2^26. Codebooks start from the ``entries``
    smallest ids (null last, equal ids by vector), fewer where there are fewer rows; repeated rows count each. Ties go to the
    lower entry. Without usable rows the result is empty and the codebooks hold nothing. ``keep`` are the caller's columns that
    stay, by default all; columns called ``code`` or ``error`` give way.
    """
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    fit = F.coalesce(F.size(vector) > 0, F.lit(False)) & F.coalesce(
        F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False)
    )
    rows, back = numbered(df.filter(fit), keep, id=F.col(f"`{id_col}`"), vector=vector)
    first = rows.select("id", "vector").orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()
    dims = len(first[0].vector) if first else parts
    if any(len(r.vector) != dims for r in first):  # rows of other lengths took places among the first
        first = rows.filter(F.size("vector") == dims).select("id", "vector").orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()
    start = integers([r.vector for r in first] if first else np.zeros((0, dims)), parts)
    books = Codebooks(np.ascontiguousarray(start.transpose(1, 0, 2)))
    planted = plant(rows.filter(F.size("vector") == dims).drop("id"), parts, chunk)
    for _ in range(rounds if first else 0):
        books = fit_round(planted, books)
    schema = T.StructType([f for f in rows.schema.fields if f.name.startswith("c")])
    return assign(planted, books, schema).select(*back("code", "error"), "code", "error"), books


def with_group_error(coded: DataFrame, group_col: str, name: str) -> DataFrame:
    """``coded``, written, with the error summed over rows of an equal group, nulls together; sums saturate as longs."""
    coded = materialise(coded, "coded")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(2**63 - 1)).cast("long")
    return join_totals(coded, coded.groupBy(group_col).agg(total.alias(name)), [group_col])
