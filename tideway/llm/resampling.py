"""Importance resampling towards a target text: hashed runs of words, gains of their buckets, and a drawn share.

A head of frequent words (and pairs) is broadcast with its CRC states (and buckets); its size is a parameter. Words outside
it take their CRC directly, so every bucket total is exact whatever the head holds. Texts are cut into words twice: to find
the head, and to note the bucket of every run; totals and weights then come from the noted buckets.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideway.llm.common import numbered, text_of
from tideway.operators.ranking import dense_ids
from tideway.session import materialise

#: Words and pairs of the head, and the distinct ones a task counts before it hands them on.
HEAD, HELD = 50_000, 400_000
#: Digits, lower-case letters and all beyond ASCII stay, capitals are lowered, the rest becomes a space.
_CUT = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class States(dict):
    """CRC of a word: known for the head, computed for the tail and not kept."""

    def __missing__(self, word: bytes) -> int:
        return crc32(word)


def words_in(text: bytes) -> list[bytes]:
    """Words of a text in UTF-8."""
    return text.translate(_CUT).split()


def run_buckets(words: list[bytes], longest: int, states: States, pairs: dict[bytes, int], buckets: int) -> np.ndarray:
    """Bucket of every run of 1 to ``longest`` consecutive words, shorter runs first."""
    ends = list(map(states.__getitem__, words))
    found = [np.array(ends, np.int64) % buckets]
    for n in range(2, min(longest, len(words)) + 1):
        # A run's state goes on from the state of the run without its last word.
        ends = [crc32(b" " + word, end) for word, end in zip(words[n - 1 :], ends)] if n > 2 or longest > 2 or not pairs else ends
        if n == 2 and pairs:
            known = [pairs.get(a + b" " + b, -1) for a, b in zip(words, words[1:])]
            if longest == 2:
                known = [k if k >= 0 else crc32(b" " + b, end) % buckets for k, b, end in zip(known, words[1:], ends)]
                found.append(np.array(known, np.int64))
                continue
        found.append(np.array(ends, np.int64) % buckets)
    return np.concatenate(found)


def _texts(df: DataFrame, text_col: str) -> DataFrame:
    return df.select(text_of(text_col).alias("text"))


def _frequent(texts: DataFrame, longest: int, head: int) -> tuple[list[bytes], list[bytes]]:
    """The most frequent words, and pairs if runs are that long: at most ``head`` of each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[Counter] = [Counter(), Counter()]

        def told() -> pa.RecordBatch:
            rows = [(pair, run, n) for pair, some in enumerate(seen) for run, n in some.items()]
            for some in seen:
                some.clear()
            return pa.RecordBatch.from_pylist([{"pair": p, "run": r, "n": n} for p, r, n in rows], schema=out)

        out = pa.schema([("pair", pa.int32()), ("run", pa.binary()), ("n", pa.int64())])
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                words = words_in(text)
                seen[0].update(words)
                if longest > 1:
                    seen[1].update(a + b" " + b for a, b in zip(words, words[1:]))
                if len(seen[0]) + len(seen[1]) > HELD:
                    yield told()
        yield told()

    counts = texts.mapInArrow(count, "pair int, run binary, n long").groupBy("pair", "run").agg(F.sum("n").alias("n"))
    # Whole levels of frequency, most frequent first, as long as they fit: no sort, and no more than the head is collected.
    counts = materialise(counts.withColumn("level", F.floor(F.log2("n") * 16)), "run-counts", compression="zstd")
    sizes = counts.groupBy("pair", "level").count().orderBy(F.desc("level")).collect()
    found: list[list[bytes]] = []
    for pair in (0, 1):
        bar, room = None, head
        for r in sizes:
            if r.pair == pair:
                room -= r["count"]
                if room < 0:
                    break
                bar = r.level
        some = counts.filter((F.col("pair") == pair) & (F.col("level") >= bar)).select("run") if bar is not None else None
        found.append([bytes(r.run) for r in some.collect()] if some is not None else [])
    return found[0], found[1]


def _noted(df: DataFrame, longest: int, buckets: int, known: tuple[list[bytes], list[bytes]]) -> DataFrame:
    """``df`` with number of words and buckets of all runs, as 32-bit numbers, in place of its last column, the text."""
    held = df.schema.fields[:-1]
    schema = T.StructType([*held, T.StructField("n_words", T.LongType()), T.StructField("runs", T.BinaryType())])
    sent = df.sparkSession.sparkContext.broadcast(known)  # at most ``head`` words and pairs

    def note(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states = States((w, crc32(w)) for w in sent.value[0])
        pairs = {p: crc32(p) % buckets for p in sent.value[1]}
        for batch in batches:
            sizes, runs = [], []
            for text in batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist():
                words = words_in(text)
                sizes.append(len(words))
                runs.append(run_buckets(words, longest, states, pairs, buckets).astype("<u4").tobytes())
            more = [pa.array(sizes, pa.int64()), pa.array(runs, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], names=schema.names)

    return df.mapInArrow(note, schema)


def bucket_totals(noted: DataFrame, buckets: int) -> np.ndarray:
    """Runs in every bucket over all rows; each task sends one sum a bucket."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for runs in batch.column(0).to_pylist():
                total += np.bincount(np.frombuffer(runs, "<u4"), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    rows = noted.select("runs").mapInArrow(add, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:  # one row a bucket
        out[r.bucket] = r.n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log ratio of add-one chances under target and source, floored."""
    n, total, wanted = float(len(source)), float(source.sum()), float(target.sum())
    return np.array(
        [math.floor(1000 * math.log((t + 1.0) * (total + n) / ((s + 1.0) * (wanted + n)))) for s, t in zip(source.tolist(), target.tolist())],
        np.int64,
    )


def resample(
    df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", longest: int = 1,
    buckets: int = 10_000, percent: int = 10, least: int = 20, seed: str = "2024", head: int = HEAD, keep: Sequence[str] | None = None,
) -> DataFrame:
    """Rows with ``n_features``, ``weight``, ``score`` and ``rank`` (of the drawn ones, else null).

    The weight is the floored mean of the gains of a text's runs of words; the score adds a draw that depends on the id alone
    (hashed; a null id hashes as the empty string). Of the texts with ``least`` words or more the ``percent`` highest scores
    are drawn, ties to the smaller id, null last, then in stored order. Null and empty texts have no runs, weight 0 and no
    rank. Repeated rows count each. An empty table gives an empty result, an empty target a uniform one.
    ``keep`` are the caller's columns that stay; by default all. Columns named like the new ones give way to them.
    """
    if longest < 1 or buckets < 1:
        raise ValueError("runs and buckets start at one")
    own, back = numbered(df, keep, id=F.col(f"`{id_col}`"), text=text_of(text_col))
    known = _frequent(_texts(df, text_col).union(_texts(target, target_col)), longest, head)
    noted = materialise(_noted(own, longest, buckets, known), "runs", compression="zstd")
    aimed = _noted(target.select(text_of(target_col).alias("text")), longest, buckets, known)
    gains = bucket_gains(bucket_totals(noted, buckets), bucket_totals(aimed, buckets))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, weights = [], []
            for runs in batch.column(batch.num_columns - 1).to_pylist():
                at = np.frombuffer(runs, "<u4")
                sizes.append(len(at))
                weights.append(int(gains[at].sum()) // len(at) if len(at) else 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64()), pa.array(weights, pa.int64())], names=schema.names)

    kept = noted.schema.fields[:-1]
    schema = T.StructType([*kept, T.StructField("n_features", T.LongType()), T.StructField("weight", T.LongType())])
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("long")
    drawn = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    weighed = noted.mapInArrow(weigh, schema).withColumns({"score": F.col("weight") + drawn, "row": F.monotonically_increasing_id()})
    weighed = materialise(weighed, "weighed")
    # Scores lie between fixed bounds (logs of ratios of longs, and of 32-bit hashes), so the counts a score are few.
    counts = weighed.filter(F.col("n_words") >= least).groupBy("score").count().orderBy(F.desc("score")).collect()
    wanted = percent * sum(r["count"] for r in counts) // 100
    bar, above = None, 0
    for r in counts:
        if above < wanted:
            bar, above = r["score"], above + r["count"]
    near = (F.col("n_words") >= least) & (F.col("score") >= bar) if bar is not None else F.lit(False)
    order = [F.desc("score"), F.col("id").asc_nulls_last(), F.col("row")]
    first = dense_ids(weighed.filter(near), order, "rank") if bar is not None else weighed.filter(near).withColumn("rank", F.lit(None).cast("long"))
    first = first.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")).cast("long"))
    out = first.unionByName(weighed.filter(~near).withColumn("rank", F.lit(None).cast("long")))
    return out.select(*back("n_features", "weight", "score", "rank"), "n_features", "weight", "score", "rank")
