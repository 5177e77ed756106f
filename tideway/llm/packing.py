"""Sequence packing: shortest pack first over the length histogram.

Documents become token ids plus an end id and are cut every ``length`` ids; only the last piece of a document is shorter.
The histogram of those lengths (at most ``length`` counts, whatever the corpus) is packed: lengths are placed longest
first into the shortest pack that fits, by updating counts of packing patterns. Each short piece has a rank among the
pieces of its length, from its rank in its task and the counts of earlier tasks; the rank says which pattern, which pack of
that pattern and which place it gets. Token ids move once at most.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tideway.llm.common import shield
from tideway.llm.tokens import default_vocabulary, encode
from tideway.session import materialise


def shortest_pack_first(counts: dict[int, int], length: int) -> list[tuple[int, tuple[int, ...]]]:
    """(number of packs, lengths in a pack) for ``counts`` pieces per length; the sum in a pack is at most ``length``.

    Only the longest prefix of work ever depends on the number of lengths, never on the number of pieces.
    """
    open_packs: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    for size in sorted((s for s, n in counts.items() if n > 0), reverse=True):
        left = counts[size]
        while left:
            filled = min((f for f, packs in open_packs.items() if packs and f + size <= length), default=None)
            if filled is None:
                per = length // size
                for packs, inside in ((left // per, per), (1, left % per)):
                    if packs and inside:
                        open_packs.setdefault(size * inside, []).append((packs, (size,) * inside))
                left = 0
            else:
                packs, pattern = open_packs[filled].pop()
                used = min(packs, left)
                if packs > used:
                    open_packs[filled].append((packs - used, pattern))
                open_packs.setdefault(filled + size, []).append((used, (*pattern, size)))
                left -= used
    return sorted((p for packs in open_packs.values() for p in packs), key=lambda p: (p[1], p[0]), reverse=True)


PLACES = "pk_rem int, pk_slot_from long, pk_slot_to long, pk_copies int, pk_first_sequence long, pk_offsets array<int>"


def places(plan: list[tuple[int, tuple[int, ...]]]) -> list[tuple]:
    """Rows of ``PLACES``: ranks [slot_from, slot_to) of a length take ``pk_copies`` places in each pack of one pattern."""
    taken: Counter = Counter()
    rows, sequence = [], 0
    for packs, pattern in plan:
        at = dict.fromkeys(pattern, ())
        offset = 0
        for size in pattern:
            at[size] += (offset,)
            offset += size
        for size, offsets in at.items():
            rows.append((size, taken[size], taken[size] + packs * len(offsets), len(offsets), sequence, list(offsets)))
            taken[size] += packs * len(offsets)
        sequence += packs
    return rows


def tokenised(df: DataFrame, text_col: str, own: list[str], length: int, end_id: int, vocabulary: tuple[str, str]) -> DataFrame:
    """``own`` columns plus ids (uint32, little-endian), doc_tokens and the row's place in its task; written once."""
    added = [
        T.StructField("pk_ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType()), T.StructField("pk_part", T.IntegerType()),
        T.StructField("pk_rem", T.IntegerType()), T.StructField("pk_rank", T.LongType()), T.StructField("pk_full", T.LongType()),
    ]
    schema = T.StructType([df.schema[c] for c in own] + added)
    source = df.select(*[F.col(f"`{c}`") for c in own], F.col(f"`{text_col}`").cast("string").alias("pk_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, full = TaskContext.get().partitionId(), np.zeros(length, np.int64), 0
        end = np.array([end_id], "<u4")
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                ids, tokens, rems, ranks, fulls = [], [], [], [], []
                for x in rows.column(rows.num_columns - 1):
                    found = np.concatenate((encode(x.as_py() or "", vocabulary), end))
                    rem = len(found) % length
                    ids.append(found.tobytes())
                    tokens.append(len(found))
                    rems.append(rem)
                    ranks.append(seen[rem])
                    fulls.append(full)
                    seen[rem] += 1
                    full += len(found) // length
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns[:-1], pa.array(ids, pa.binary()), pa.array(tokens, pa.int64()),
                     pa.array([part] * len(ids), pa.int32()), pa.array(rems, pa.int32()), pa.array(ranks, pa.int64()),
                     pa.array(fulls, pa.int64())],
                    names=[*own, *[f.name for f in added]],
                )

    return materialise(source.mapInArrow(run, schema), "tokens", compression="zstd")


def pack(
    df: DataFrame,
    text_col: str = "text",
    keep: list[str] | None = None,
    length: int = 1024,
    end_id: int = 0,
    vocabulary: tuple[str, str] | None = None,
) -> DataFrame:
    """One row per piece: ``keep`` (all columns by default), start, length, ids, doc_tokens, sequence_id and offset.

    ``ids`` holds the piece's token ids as little-endian uint32; ``start`` counts the ids of its document before it. Every
    id, the end id included, lies in one piece; a sequence has at most ``length`` ids, without gaps from offset 0. A null
    text is an empty one (the end id alone). Repeated rows are packed one by one. Equal lengths are placed in stored
    order. An empty table gives no pieces. Columns named like an added one are replaced.
    """
    spark = df.sparkSession
    added = ("start", "length", "ids", "doc_tokens", "sequence_id", "offset")
    keep = df.columns if keep is None else keep
    df, back = shield(df, "pk_")
    own = [c if c in df.columns else f"own {c}" for c in keep if c.lower() not in added]
    stored = tokenised(df, text_col, own, length, end_id, vocabulary or default_vocabulary())

    counts = stored.groupBy("pk_part", "pk_rem").agg(
        F.count("*").alias("n"), F.sum(F.floor(F.col("doc_tokens") / length)).alias("full")
    )
    counts = materialise(counts, "lengths")
    # At most ``length`` rows.
    histogram = {r: n for r, n in counts.filter("pk_rem > 0").groupBy("pk_rem").agg(F.sum("n")).collect()}
    plan = shortest_pack_first(histogram, length)
    packs = sum(n for n, _ in plan)
    spots = spark.createDataFrame(places(plan), PLACES)

    earlier = Window.partitionBy("pk_rem").orderBy("pk_part").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("pk_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    fulls = counts.groupBy("pk_part").agg(F.sum("full").alias("n")).select(
        "pk_part", (F.coalesce(F.sum("n").over(before), F.lit(0)) + packs).alias("pk_full_from")
    )
    bases = counts.select("pk_part", "pk_rem", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("pk_rank_from"))
    bases = materialise(bases.join(fulls, "pk_part"), "bases")

    ranked = stored.join(bases.hint("shuffle_hash"), ["pk_part", "pk_rem"]).withColumn("pk_slot", F.col("pk_rank") + F.col("pk_rank_from"))
    # The plan is as large as the histogram, not the corpus.
    placed = ranked.join(
        F.broadcast(spots.withColumnRenamed("pk_rem", "pk_at_rem")),
        (F.col("pk_rem") == F.col("pk_at_rem")) & (F.col("pk_slot") >= F.col("pk_slot_from")) & (F.col("pk_slot") < F.col("pk_slot_to")),
        "left",
    )
    in_range = F.col("pk_slot") - F.col("pk_slot_from")
    whole = F.floor(F.col("doc_tokens") / length)
    piece = F.explode(
        F.transform(
            F.sequence(F.lit(0).cast("long"), F.floor((F.col("doc_tokens") - 1) / length)),
            lambda k: F.struct(
                (k * length).alias("start"),
                F.least(F.lit(length).cast("long"), F.col("doc_tokens") - k * length).alias("length"),
                F.when(k < whole, F.col("pk_full_from") + F.col("pk_full") + k)
                .otherwise(F.col("pk_first_sequence") + F.floor(in_range / F.col("pk_copies")))
                .alias("sequence_id"),
                F.when(k < whole, F.lit(0).cast("long"))
                .otherwise(F.get("pk_offsets", (in_range % F.col("pk_copies")).cast("int")).cast("long"))
                .alias("offset"),
            ),
        )
    )
    pieces = placed.select(*[F.col(f"`{c}`") for c in own], "pk_ids", "doc_tokens", piece.alias("pk_piece"))
    out = pieces.select(
        *[F.col(f"`{c}`") for c in own],
        F.col("pk_piece.start").alias("start"),
        F.col("pk_piece.length").alias("length"),
        F.expr("substring(pk_ids, cast(pk_piece.start * 4 + 1 as int), cast(pk_piece.length * 4 as int))").alias("ids"),
        "doc_tokens",
        F.col("pk_piece.sequence_id").alias("sequence_id"),
        F.col("pk_piece.offset").alias("offset"),
    )
    return back(out)
