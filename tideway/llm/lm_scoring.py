"""Language-model scoring on Spark: corpus counts, distributed training, scoring of whole texts.

Counts of words and of subword ids cover every training text. The attention weights start from one draw and are trained in
rounds: in each, every task trains on its own training texts of the round and the weights are averaged, first in groups,
then at the driver (weights have a fixed size). Texts are dealt to the rounds by hash, and the rounds together take every
training text once. Texts are scored where they are; only words outside the most frequent ones are
shuffled to meet their counts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideway.llm import lm
from tideway.llm.common import shield
from tideway.llm.tokens import default_vocabulary, fast_encoder
from tideway.session import materialise

#: The end of a text among words; no word holds a line feed.
END_WORD = "\n"
#: Most frequent words that every task knows; all others are joined.
HEAD = 1 << 17
#: Rounds of training, and of how many training texts a round takes one; as many rounds as shares take every text.
ROUNDS, SHARE = 3, 3
#: Bytes of ids that are cut into windows together.
CHUNK = 800_000
#: Distinct words a task holds before it sends their sums on.
WORDS_HELD = 400_000


def held_out(id_col: str, folds: int = 7, fold: int = 2) -> Column:
    """Texts that nothing is learned from: crc32 of the id as text, null as the empty text."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % folds == fold


def lower_words(text: str | None) -> list[bytes]:
    """Words in lower-case A-Z."""
    return (text or "").encode("utf-8", "replace").lower().split()


def subword_ids(text: str | None, vocabulary: tuple[str, str], end_id: int) -> np.ndarray:
    """Subword ids of the words, each after a space, then the end id; strings of added tokens are ordinary text."""
    joined = b"".join(b" " + w for w in lower_words(text)).decode("utf-8", "replace")
    return np.array([*fast_encoder(vocabulary).encode_ordinary(joined), end_id], "<u4")


def encoded(df: DataFrame, own: list[str], text_col: str, vocabulary: tuple[str, str], end_id: int) -> DataFrame:
    """``own`` columns, the text and its subword ids (uint32, little-endian), written once; nothing is encoded twice."""
    schema = T.StructType(
        [df.schema[c] for c in own] + [T.StructField("_lm_text", T.StringType()), T.StructField("_lm_ids", T.BinaryType())]
    )
    source = df.select(*[F.col(f"`{c}`") for c in own], F.col(f"`{text_col}`").cast("string").alias("_lm_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                ids = [subword_ids(x.as_py(), vocabulary, end_id).tobytes() for x in rows.column(rows.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(ids, pa.binary())], names=schema.names)

    return materialise(source.mapInArrow(run, schema), "encoded", compression="zstd")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """(rows, ids of each row), about CHUNK bytes of ids at a time; the ids are the last column."""
    for batch in batches:
        ids, size, first = [], 0, 0
        for at, data in enumerate(batch.column(batch.num_columns - 1)):
            raw = data.as_buffer()
            ids.append(np.frombuffer(raw, "<u4").astype(np.int64))
            size += raw.size
            if size >= CHUNK or at + 1 == batch.num_rows:
                yield batch.slice(first, at + 1 - first), ids
                ids, size, first = [], 0, at + 1


def corpus_counts(texts: DataFrame, shape: lm.Shape, end_id: int) -> tuple[DataFrame, np.ndarray]:
    """((word, c), counts (id, bucket of the id before)) over all texts, from one pass.

    Words are in lower-case A-Z, with one end per text; a task sends its sums on whenever they fill its dictionary. The
    second counts are as large as the vocabulary, whatever the corpus.
    """

    def sums(words: dict[bytes, int]) -> pa.RecordBatch:
        word = pa.array(list(words), pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([word, pa.nulls(len(words), pa.int64()), pa.array(list(words.values()), pa.int64())], names=["word", "cell", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, words, ends = np.zeros(shape.ids * shape.buckets, np.int32), Counter(), 0
        for rows, found in _chunks(batches):
            for text in rows.column(0):
                words.update(lower_words(text.as_py()))
            ids = np.concatenate(found)
            # Every text ends with the end id, which also stands before its first id.
            before = np.concatenate(([end_id], ids[:-1]))
            cell, n = np.unique(ids * shape.buckets + lm.bucket_of(before, shape), return_counts=True)
            seen[cell] += n.astype(np.int32)
            ends += len(found)
            if len(words) > WORDS_HELD:
                yield sums(words)
                words.clear()
        yield sums({**words, **({END_WORD.encode(): ends} if ends else {})})
        cell = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(cell), pa.string()), pa.array(cell, pa.int64()), pa.array(seen[cell], pa.int64())], names=["word", "cell", "n"]
        )

    stored = materialise(texts.mapInArrow(run, "word string, cell long, n long"), "counts")
    words = stored.filter("word is not null").groupBy("word").agg(F.sum("n").alias("c"))
    found = stored.filter("cell is not null").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    follow = np.zeros(shape.ids * shape.buckets, np.float32)
    follow[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return materialise(words, "words"), follow.reshape(shape.ids, shape.buckets)


def _flat(weights: dict[str, np.ndarray]) -> bytes:
    return b"".join(weights[k].astype("<f4").tobytes() for k in sorted(weights))


def _unflat(data: bytes, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    flat, out, at = np.frombuffer(data, "<f4"), {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).copy()
        at += like[k].size
    return out


def train_round(model: lm.Model, texts: DataFrame, nth: int, end_id: int, rate: float) -> None:
    """One round: every task trains from the same weights on its texts; the means, weighted by ids, become the weights."""
    sent = texts.sparkSession.sparkContext.broadcast(model.without_counts())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = sent.value
        weights = {k: v.copy() for k, v in mine.weights.items()}
        opt, n = lm.Adam(weights, rate), 0
        for _, ids in _chunks(batches):
            lm.train(mine, ids, end_id, opt, seed=nth)
            n += sum(map(len, ids))
        if n:
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([TaskContext.get().partitionId()], pa.int32()), "n": pa.array([float(n)]),
                "weights": pa.array([_flat(weights)], pa.binary()),
            })

    def mean(group: pa.Table) -> pa.Table:
        n = group.column("n").to_numpy()
        total = sum(w * np.frombuffer(x.as_py(), "<f4").astype(np.float64) for w, x in zip(n, group.column("weights")))
        return pa.table({"part": group.column("part")[:1], "n": [n.sum()], "weights": pa.array([(total / n.sum()).astype("<f4").tobytes()], pa.binary())})

    schema = "part int, n double, weights binary"
    trained = materialise(texts.mapInArrow(run, schema), "weights")
    # Means of at most 64 tasks at a time, until a few rows of a fixed size are left.
    left = trained.agg(F.max("part")).first()[0]
    while left is not None and left >= 64:
        trained = materialise(trained.withColumn("part", F.floor(F.col("part") / 64).cast("int")).groupBy("part").applyInArrow(mean, schema), "weights")
        left //= 64
    rows = trained.collect()
    if rows:
        total = sum(r["n"] for r in rows)
        flat = sum(r["n"] * np.frombuffer(r["weights"], "<f4").astype(np.float64) for r in rows) / total
        model.weights = _unflat(flat.astype("<f4").tobytes(), model.weights)


def fit(texts: DataFrame, key: Column, follow: np.ndarray, end_id: int, shape: lm.Shape, rounds: int = ROUNDS,
        share: int = SHARE, rate: float = 0.01) -> lm.Model:
    """The model of ``texts`` (_lm_ids) with its counts ``follow``; ``key`` deals texts to the rounds."""
    model = lm.start_model(follow, shape)
    deal = F.pmod(F.xxhash64(F.lit(11), key), F.lit(share))
    for nth in range(rounds):
        train_round(model, texts.filter(deal == nth).select("_lm_ids"), nth, end_id, rate / (1 + nth))
    return model


def score_texts(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, vocabulary=None,
    end_id: int = 50256, shape: lm.Shape = lm.Shape(), rounds: int = ROUNDS, share: int = SHARE,
) -> DataFrame:
    """``keep`` (all columns by default) plus held_out, n_tokens, n_known, train_tokens, base_score and score.

    Words (and one end per text) have the base score of add-one counts over the training texts; ``score`` is the log10
    probability the attention model gives the text's subword ids and its end. A null text is an empty one (its end
    alone). Repeated rows are counted and scored each; with nothing to learn from, all words are unknown and weights stay
    as drawn; an empty table gives an empty result. Columns named like an added one are replaced.
    """
    spark = df.sparkSession
    vocabulary = vocabulary or default_vocabulary()
    added = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    keep = df.columns if keep is None else keep
    df, back = shield(df, "_lm_")
    own = [c if c in df.columns else f"own {c}" for c in keep if c.lower() not in added]
    held = held_out(id_col)
    stored = encoded(df.withColumns({"_lm_held": held, "_lm_key": F.col(f"`{id_col}`")}), [*own, "_lm_held", "_lm_key"], text_col, vocabulary, end_id)
    training = stored.filter("not _lm_held")

    words, follow = corpus_counts(training.select("_lm_text", "_lm_ids"), shape, end_id)
    n, v = words.agg(F.sum("c"), F.count("*")).first()
    n = n or 0
    top = words.orderBy(F.desc("c"), "word").limit(HEAD).toArrow()  # a fixed number; the rest is joined below
    head = dict(zip((w.encode("utf-8", "replace") for w in top.column("word").to_pylist()), top.column("c").to_pylist()))
    model = fit(training, F.col("_lm_key"), follow, end_id, shape, rounds, share)
    known, learned = spark.sparkContext.broadcast(head), spark.sparkContext.broadcast(model)

    schema = T.StructType(
        [stored.schema[c] for c in [*own, "_lm_held"]]
        + [T.StructField("_lm_tokens", T.LongType()), T.StructField("_lm_known", T.LongType()), T.StructField("_lm_base", T.DoubleType()),
           T.StructField("_lm_score", T.DoubleType()), T.StructField("_lm_rest", T.ArrayType(T.StringType()))]
    )
    source = stored.drop("_lm_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, mine = known.value, learned.value
        end_count = counts.get(END_WORD.encode(), 0)
        for rows, ids in _chunks(batches):
            tokens, met, base, rest = [], [], [], []
            for text in rows.column(rows.num_columns - 2):
                found = lower_words(text.as_py())
                got = [counts.get(w, 0) for w in found]
                c = np.array([*got, end_count], np.float64)
                tokens.append(len(c))
                met.append(int((c > 0).sum()))
                base.append(float(np.log10(c + 1).sum()))
                rest.append([w.decode("utf-8", "replace") for w, x in zip(found, got) if not x])
            yield pa.RecordBatch.from_arrays(
                [*rows.columns[:-2], pa.array(tokens, pa.int64()), pa.array(met, pa.int64()), pa.array(base, pa.float64()),
                 pa.array(lm.score(mine, ids, end_id), pa.float64()), pa.array(rest, pa.list_(pa.string()))],
                names=schema.names,
            )

    scored = source.mapInArrow(run, schema).withColumn("_lm_row", F.monotonically_increasing_id())
    scored = materialise(scored, "scored")
    rest = scored.select("_lm_row", F.explode("_lm_rest").alias("word"))
    late = rest.join(words, "word").groupBy("_lm_row").agg(
        F.count("*").alias("_lm_more"), F.sum(F.log10(F.col("c") + 1)).alias("_lm_plus")
    )
    out = scored.drop("_lm_rest").join(late, "_lm_row", "left")
    each = math.log10(n + v + 1)
    out = out.select(
        *[F.col(f"`{c}`") for c in own],
        F.col("_lm_held").alias("held_out"),
        F.col("_lm_tokens").alias("n_tokens"),
        (F.col("_lm_known") + F.coalesce("_lm_more", F.lit(0))).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("_lm_base") + F.coalesce("_lm_plus", F.lit(0.0)) - F.col("_lm_tokens") * F.lit(each)).alias("base_score"),
        F.col("_lm_score").alias("score"),
    )
    return back(out)
