"""Exact Jaccard self-join of word shingles: size-banded tiles, bitmap signatures, sorted-array intersection.

Two sets of similarity t share one of their first (1 - t) n + 1 shingles in any order of all shingles. The order puts crowded
shingles last (by counts of hashed buckets, a sketch of fixed size), so texts meet where few others are. Of the texts that
share such a shingle only those of near sizes meet: bands are as wide as the similarity allows, so a tile holds a band and the
one above it. Bitmaps hold each set's parity a bit; differing bits bound the overlap from above, and what is left is decided
on the whole sorted arrays.

Most shared shingles are in a few texts, whose pairs are written out: no more than some a row, and narrow. Only crowded shingles
go through tiles. Dense groups would meet in all pairs, so there are three steps. First every text is compared with one text, and
what is alike becomes a class. Then, in rounds, every text is compared with the one text of another class that its tiles hold
nearest by signature, and classes that have a link become one: a round has at most one pair a text, however loose the group. Last,
all pairs that are left between different classes are compared. Joins are sort-merge joins at every size, so the plan that is
tested is the one that grows.
Sets are known by a digest of their content: equal sets are one, and every step can be run again after a lost executor.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideway.llm.common import numbered, text_of
from tideway.llm.components import connected_components
from tideway.llm.simhash import simhash_of
from tideway.operators.joins import join_totals
from tideway.session import materialise, materialise_at, release

#: Bits of the sketch that orders shingles; rows of a block of a tile; least and most bits of a signature.
SKETCH, BLOCK, BITS = 20, 1024, (128, 4096)
#: Most rounds that grow classes (a loose group halves its classes in each), and rows of a token whose pairs are written out: they
#: are bounded by its rows. Tokens with more are crowded and go through tiles.
ROUNDS, FEW = 12, 16
#: How often a pair counts as met that was proposed from outside.
PROPOSED = 1 << 20
#: Pairs that are left may be this part of all sets when the rounds end: the sets they move are at most half of all.
LEFT = 4
#: Tables that are no longer than some rows a set are written by so many tasks at most, and one more for so many sets.
LEAST_TASKS, SETS_A_TASK = 16, 1 << 13
#: Counters of a sketch that travel in one row.
_ROW = 4096
#: Bits a key of the filter that spares sets without a candidate a shuffle, and its largest size in bits (64 MB).
_PER_KEY, _MOST = 16, 1 << 29
_TIMES, _MIX = np.uint64(0x9E3779B97F4A7C15), (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class WordHashes(dict):
    """Hash of a word, remembered; forgets all when it has many."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word, 42)
        return out


def shingle_set(text: bytes, width: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; fewer words are one shingle, no words none."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for at in range(width):
        out = out * _TIMES + hashes[at : len(words) - width + 1 + at]
    for times in _MIX:
        out = (out ^ (out >> np.uint64(33))) * times
    return np.unique(out ^ (out >> np.uint64(33)))


def packed(found: np.ndarray) -> bytes:
    """A sorted set as steps, all first bytes before all second ones: the high bytes of large sets are zeros that compress."""
    return np.diff(found, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(raw) -> np.ndarray:
    """The set behind ``packed``."""
    steps = np.frombuffer(raw, np.uint8)
    return np.cumsum(np.ascontiguousarray(steps.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def signature_bits(n: int) -> int:
    """Bits of the signature of a set of ``n``: never fewer for a larger set."""
    return min(BITS[1], max(BITS[0], 1 << math.ceil(math.log2(1.5 * n)))) if n else BITS[0]


def signature(found: np.ndarray) -> bytes:
    """Parity of the set's elements in every bit."""
    bits = signature_bits(len(found))
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def fold(bits: np.ndarray, size: int) -> np.ndarray:
    """A signature as it would be with ``size`` bytes."""
    while len(bits) > size:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def needed(n: np.ndarray, m: np.ndarray, least: int) -> np.ndarray:
    """Smallest overlap of sets of ``n`` and ``m`` whose intersection is ``least`` hundredths of their union."""
    return -(-least * (n + m) // (100 + least))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def band(n, least: int):
    """Column of the size band: two sizes that can be similar enough are in one band or in adjacent ones."""
    if least == 100:
        return n.cast("int")
    return F.floor(F.log(n.cast("double")) / F.lit(math.log(100 / least)) + F.lit(1e-9)).cast("int")


def written(df: DataFrame, label: str, sets: int, **options: str) -> DataFrame:
    """``df`` written by tasks that grow in number with ``sets``: a short table is not a file a partition of the exchange before it."""
    return materialise(df.coalesce(LEAST_TASKS + sets // SETS_A_TASK), label, **options)


def with_sets(df: DataFrame, width: int, prints: bool = False) -> tuple[DataFrame, str]:
    """The columns before the last, the text, and the set's size, digest (null for none), signature and hashes; written, with path.

    With ``prints`` also ``fp``, the SimHash fingerprint of the set as a signed long.
    """
    import xxhash

    held = df.schema.fields[:-1]
    own = [("n", T.LongType()), ("key", T.BinaryType()), ("bits", T.BinaryType()), ("hashes", T.BinaryType())]
    schema = T.StructType([*held, *[T.StructField(*f) for f in own + [("fp", T.LongType())] * prints]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                rows, fps = [], []
                for text in batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist():
                    found = shingle_set(text, width, known)
                    rows.append((len(found), xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None, signature(found), packed(found)))
                    if prints:
                        fps.append(simhash_of(found))
                n, key, bits, hashes = zip(*rows)
                more = [pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(bits, pa.binary()), pa.array(hashes, pa.binary())]
                more += [pa.array(np.array(fps, np.uint64).view(np.int64))] * prints
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], names=schema.names)

    return materialise_at(df.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "sets", compression="zstd")


def crowding(stored: DataFrame, bits: int = SKETCH) -> np.ndarray:
    """How crowded a shingle's bucket is, in eighths of powers of two: one byte for each of 2^bits buckets."""
    rows = max(1, (1 << bits) // _ROW)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                # Sorted hashes have sorted buckets.
                at, n = np.unique((unpacked(raw.as_buffer()) >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
                total[at] += n
        parts = [p.tobytes() for p in np.split(total, rows)]
        yield pa.RecordBatch.from_arrays([pa.array(range(rows), pa.int32()), pa.array(parts, pa.binary())], names=["block", "counts"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(np.frombuffer(raw, np.int64) for batch in batches for raw in batch.column("counts").to_pylist())
        level = np.minimum(255, np.rint(8 * np.log2(1 + total))).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["block", "level"])

    told = stored.select("hashes").mapInArrow(count, "block int, counts binary").groupBy("block").applyInArrow(add, "block int, level binary")
    out = np.zeros((rows, (1 << bits) // rows), np.uint8)
    for r in told.collect():  # the sketch: 2^bits bytes
        out[r.block] = np.frombuffer(r.level, np.uint8)
    return out.ravel()


def prefixes(stored: DataFrame, least: int, bits: int = SKETCH) -> tuple[DataFrame, str]:
    """(token, key, n, pos) of the first shingles of every set, in the order of crowding; written, with path."""
    sent = stored.sparkSession.sparkContext.broadcast(crowding(stored, bits))
    first = written(stored.filter("n > 0").groupBy("key").agg(F.min("row").alias("row")).select("row"), "first-rows", stored.count())
    mask, place = bits_of(first, "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                # Copies seldom pass; those that do meet in the same pairs once more.
                batch = whole.slice(at, 512)
                batch = batch.filter(pa.array(among(mask.value, batch.column("place").to_numpy())))
                if not batch.num_rows:
                    continue
                tokens, keys, sizes, places = [], [], [], []
                for key, raw in zip(batch.column("key").to_pylist(), batch.column("hashes").to_pylist()):
                    found = unpacked(raw)
                    n = len(found)
                    level = sent.value[(found >> np.uint64(64 - bits)).astype(np.int64)]
                    first = np.argsort(level, kind="stable")[: n - (-(-least * n // 100)) + 1]  # equal levels by hash
                    tokens.append(found[first].view(np.int64))
                    sizes.append(n)
                    places.append(len(first))
                    keys.append(key)
                repeat = np.repeat(np.arange(len(keys)), places)
                ends = np.cumsum(places)
                pos = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - places, places)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(tokens)), pa.array(keys, pa.binary()).take(pa.array(repeat)), pa.array(np.array(sizes)[repeat]), pa.array(pos)],
                    names=["token", "key", "n", "pos"],
                )

    some = stored.filter("n > 0").select("key", "hashes", place("row").alias("place"))
    return materialise_at(some.mapInArrow(run, "token long, key binary, n long, pos long"), "prefixes", compression="zstd")


def bits_of(df: DataFrame, column: str):
    """(broadcast bits, function of a column that gives its place in them) of the longs of ``df``; the bits grow with them, up to a size."""
    bits = min(_MOST, max(1 << 16, 1 << math.ceil(math.log2(1 + _PER_KEY * df.count()))))

    def place(value):
        return F.pmod(F.xxhash64(value), F.lit(bits)).cast("int")

    words = df.select(place(F.col(column)).alias("place")).selectExpr("cast(place div 64 as int) as word", "shiftleft(1L, place % 64) as bit")
    at = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most _MOST / 64 numbers
    mask = np.zeros(bits // 64, np.int64)
    mask[at.column("word").to_numpy()] = at.column("bits").to_numpy()
    return df.sparkSession.sparkContext.broadcast(mask), place


def among(mask: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Whether the bits are set."""
    return (mask[where >> 6] >> (where & 63)) & 1 == 1


def filter_of(df: DataFrame, column: str):
    """Function of a column that is true wherever its value is among the longs of ``df``, and seldom elsewhere.

    It spares rows that a join would drop the shuffle before it. The bits grow with the values of ``df``, up to a fixed size;
    beyond that more rows pass and the join after it drops them.
    """
    sent, place = bits_of(df, column)

    @F.pandas_udf("boolean")
    def may(where: pd.Series) -> pd.Series:
        return pd.Series(among(sent.value, where.to_numpy()))

    return lambda value: may(place(value))


def meetings(index: DataFrame, least: int, sets: int) -> tuple[DataFrame, DataFrame]:
    """(pairs (a, b, times) of the tokens that few sets share, rows of the crowded tokens with their band); written.

    Pairs are those that sizes and places allow. A group of rows that comes together is one of few; no crowded token is in one task.
    """
    shared = written(index.groupBy("token").agg(F.count("*").alias("rows")).filter("rows > 1"), "shared", sets)
    few, many = shared.filter(F.col("rows") <= FEW).select("token"), shared.filter(F.col("rows") > FEW).select("token")
    rows = index.filter(filter_of(few, "token")(F.col("token"))).join(few.hint("merge"), "token")
    met = rows.groupBy("token").agg(F.collect_list(F.struct("key", "n", "pos")).alias("met"))
    met = met.select("met", F.explode("met").alias("x")).select("x", F.explode("met").alias("y")).filter("x.key < y.key")
    met = met.select(*[F.col(f"{side}.{c}").alias(c + end) for side, end in (("x", "_c"), ("y", "")) for c in ("key", "n", "pos")])
    pairs = met.filter(_close(least)).groupBy(F.col("key_c").alias("a"), F.col("key").alias("b")).agg(F.count("*").alias("times"))
    hits = index.filter(filter_of(many, "token")(F.col("token"))).join(many.hint("merge"), "token").withColumn("band", band(F.col("n"), least))
    return written(pairs, "few-pairs", sets), written(hits, "meetings", sets, compression="zstd")


def some_sets(stored: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, hashes), once a key, of the sets in ``keys``; written."""
    first = stored.filter("n > 0").select("key", "row").join(keys, "key").groupBy("key").agg(F.min("row").alias("row"))
    many = keys.count()
    first = written(first, "set-rows", many)
    rows = stored.select("row", "hashes").filter(filter_of(first, "row")(F.col("row")))
    return written(rows.join(first.hint("merge"), "row").select("key", "hashes"), "some-sets", many, compression="zstd")


def bounded(pairs: DataFrame, bits: DataFrame, least: int) -> DataFrame:
    """The ``pairs`` (a, b, times) of keys whose signatures (key, n, bits) leave enough overlap possible; written."""
    both = pairs.join(bits.select(F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a")).hint("merge"), "a")
    both = both.join(bits.select(F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b")).hint("merge"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            differ = np.zeros(len(n), np.int64)
            for i, (x, y) in enumerate(zip(batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist())):
                size = min(len(x), len(y))
                differ[i] = np.bitwise_count(fold(np.frombuffer(x, np.uint8), size) ^ fold(np.frombuffer(y, np.uint8), size)).sum()
            yield batch.select(["a", "b", "times"]).filter(pa.array((n + m - differ) // 2 >= needed(n, m, least)))

    some = both.select("a", "b", "times", "n_a", "n_b", "bits_a", "bits_b")
    return written(some.mapInArrow(run, "a binary, b binary, times long"), "bounded", bits.count())


def verified(pairs: DataFrame, stored: DataFrame, least: int) -> DataFrame:
    """The ``pairs`` (a, b) of keys that are similar enough, by their sorted arrays; written."""
    sets = some_sets(stored, pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct())
    many = sets.count() + pairs.count()
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("hashes").alias("one")).hint("merge"), "a")
    both = both.join(sets.select(F.col("key").alias("b"), F.col("hashes").alias("two")).hint("merge"), "b").select("a", "b", "one", "two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = []
            for x, y in zip(batch.column("one"), batch.column("two")):
                one, two = unpacked(x.as_buffer()), unpacked(y.as_buffer())
                common = overlap(one, two)
                alike.append(100 * common >= least * (len(one) + len(two) - common))
            yield batch.select(["a", "b"]).filter(pa.array(alike, pa.bool_()))

    return written(both.mapInArrow(run, "a binary, b binary"), "links", many)


def _close(least: int):
    """Columns test of two rows of a tile: sizes, and places of the token as if it were the first that both share."""
    n, m, i, j = F.col("n"), F.col("n_c"), F.col("pos"), F.col("pos_c")
    return F.least(n - i, m - j) >= F.ceil(F.lit(least) * (n + m) / F.lit(100 + least))


def first_pairs(hits: DataFrame, least: int, sets: int) -> DataFrame:
    """(a, b, times): each set with one other: of the smallest digests of its tokens and bands, the one it meets most often."""
    least_of = F.min(F.struct("key", "n", "pos"))
    centres = hits.groupBy("token", "band").agg(least_of.alias("c"), F.count("*").alias("rows")).filter("rows > 1")
    centres = centres.select("token", "band", F.col("c.key").alias("a"), F.col("c.n").alias("n_c"), F.col("c.pos").alias("pos_c"))
    centres = written(centres, "centres", sets)
    pairs = hits.join(centres.hint("merge"), ["token", "band"]).filter(F.col("key") > F.col("a")).filter(_close(least))
    met = pairs.groupBy("a", F.col("key").alias("b")).agg(F.count("*").alias("times"))
    return most_met(met)


def most_met(pairs: DataFrame) -> DataFrame:
    """Of the ``pairs`` (a, b, times) one for every b, the one that is met most often."""
    return pairs.groupBy("b").agg(F.max(F.struct("times", "a")).alias("one")).select("one.a", "b", "one.times")


def apart(pairs: DataFrame, classes: DataFrame, sets: int) -> DataFrame:
    """The ``pairs`` (a, b, times) of different classes; written."""
    of = lambda c: classes.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")).hint("merge")
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return written(both.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b", "times"), "apart", sets)


def mixed_hits(hits: DataFrame, classes: DataFrame, sets: int) -> DataFrame:
    """Rows of the tokens that sets of more than one class share, with their class as ``root``; written."""
    rows = hits.join(classes.withColumnsRenamed({"node": "key"}), "key", "left").withColumn("root", F.coalesce("root", "key"))
    rows = written(rows, "rooted", sets, compression="zstd")
    mixed = rows.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    mixed = written(mixed.filter(F.col("low") < F.col("high")).select("token"), "mixed", sets)
    return written(rows.join(mixed.hint("merge"), "token"), "mixed-hits", sets, compression="zstd")


def tiles(rows: DataFrame, bits: DataFrame, sets: int, block: int = BLOCK) -> DataFrame:
    """Rows of the tiles that hold more than one class, with class and signature, cut into pairs of blocks.

    A tile is a token, a band and the band above. Rows of its largest class need not meet each other, so their blocks meet only
    blocks of the other rows.
    """
    rows = rows.withColumn("own", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("tile", F.when(F.col("own"), F.col("band")).otherwise(F.col("band") - 1))
    per = rows.groupBy("token", "tile", "root").agg(F.count("*").alias("rows"), F.bool_or("own").alias("own"))
    per = per.groupBy("token", "tile").agg(
        F.max_by("root", F.struct("rows", "root")).alias("main"), F.max("rows").alias("in_main"), F.sum("rows").alias("rows"),
        F.count("*").alias("roots"), F.bool_or("own").alias("own_any"),
    )
    # Blocks of the other rows, then of the largest class; a tile that fits is one block.
    small = F.col("rows") <= block
    per = per.filter("roots > 1 and own_any").select(
        "token", "tile", "main",
        F.when(small, 1).otherwise(F.ceil((F.col("rows") - F.col("in_main")) / block)).cast("int").alias("others"),
        F.when(small, 0).otherwise(F.ceil(F.col("in_main") / block)).cast("int").alias("mains"),
    )
    cut = rows.join(written(per, "tiles", sets), ["token", "tile"])
    at_main = (F.col("mains") > 0) & (F.col("root") == F.col("main"))
    spread = F.xxhash64("key")
    place = F.when(at_main, F.col("others") + F.pmod(spread, F.greatest("mains", F.lit(1)))).otherwise(F.pmod(spread, F.greatest("others", F.lit(1)))).cast("int")
    cut = cut.withColumn("place", place)
    met = F.when(at_main, F.sequence(F.lit(0), F.col("others") - 1)).otherwise(F.sequence(F.lit(0), F.col("others") + F.col("mains") - 1))
    cut = cut.withColumn("other", F.explode(met)).withColumns({"low": F.least("place", "other"), "high": F.greatest("place", "other")})
    cut = cut.join(bits.select("key", "bits").hint("merge"), "key")
    return cut.select("token", "tile", "low", "high", "place", "own", "key", "n", "pos", "root", "bits")


def _candidates(rows: dict[str, np.ndarray], lo: int, hi: int, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(i, the rows j that it meets, greatest similarity of each) in the pair of blocks from ``lo`` to ``hi``.

    Rows are of different classes, and sizes, places and signatures allow a link. Every pair is met once.
    """
    at = np.arange(lo, hi)
    place, own, n = rows["place"][lo:hi], rows["own"][lo:hi], rows["n"][lo:hi]
    if rows["low"][lo] == rows["high"][lo]:
        left, right = at, at
    else:
        left, right = at[place == rows["low"][lo]], at[place == rows["high"][lo]]
    size = min(map(len, rows["bits"][lo:hi]), default=16)
    marks = np.stack([fold(np.frombuffer(b, np.uint8), size) for b in rows["bits"][lo:hi]]).view(np.uint64)
    for i in left:
        j = right[right > i] if left is right else right
        x, y = i - lo, j - lo
        j = j[(rows["root"][j] != rows["root"][i]) & (own[y] | own[x])]
        want = needed(n[x], rows["n"][j], least)
        j = j[np.minimum(n[x] - rows["pos"][i], rows["n"][j] - rows["pos"][j]) >= want]
        if not len(j):
            continue
        differ = np.bitwise_count(marks[x] ^ marks[j - lo]).sum(axis=1).astype(np.int64)
        both, most = n[x] + rows["n"][j], (n[x] + rows["n"][j] - differ) // 2
        may = most >= needed(n[x], rows["n"][j], least)
        if may.any():
            yield i, j[may], (most / np.maximum(1, both - most))[may]


def _per_tile(cut: DataFrame, compare, names: Sequence[str], more: Sequence[tuple[str, pa.DataType]]) -> DataFrame:
    """Rows (two keys called ``names``, numbers called as in ``more``) that ``compare`` gives for every pair of blocks of ``cut``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in (*batches, None):
            if batch is not None:
                some = pa.Table.from_batches([batch])
                rest = some if rest is None else pa.concat_tables([rest, some])
            if rest is None or not rest.num_rows:
                continue
            plain = ["token", "tile", "low", "high", "place", "own", "n", "pos"]
            rows = {c: rest.column(c).to_numpy() for c in plain} | {c: np.array([*rest.column(c).to_pylist(), None], object)[:-1] for c in ("key", "root", "bits")}
            change = np.zeros(rest.num_rows - 1, bool)
            for c in ("token", "tile", "low", "high"):
                change |= rows[c][1:] != rows[c][:-1]
            ends = [0, *(np.flatnonzero(change) + 1), *([rest.num_rows] if batch is None else [])]
            found = [x for x in (compare(rows, lo, hi) for lo, hi in zip(ends, ends[1:]) if hi - lo > 1) if len(x[0])]
            if found:
                one, two, *numbers = map(np.concatenate, zip(*found))
                keys = [pa.array(rows["key"][at].tolist(), pa.binary()) for at in (one, two)]
                yield pa.RecordBatch.from_arrays([*keys, *[pa.array(x, t) for x, (_, t) in zip(numbers, more)]], names=[*names, *[n for n, _ in more]])
            rest = rest.slice(ends[-1])

    sides = ["token", "tile", "low", "high"]
    dealt = cut.repartition(*sides).sortWithinPartitions(*sides)  # a tile holds at most two blocks
    kinds = {pa.float64(): "double", pa.int64(): "long"}
    return dealt.mapInArrow(run, ", ".join([f"{n} binary" for n in names] + [f"{n} {kinds[t]}" for n, t in more]))


def tile_pairs(cut: DataFrame, least: int, sets: int) -> DataFrame:
    """Pairs (a, b) of keys in one tile, of different classes, whose sizes, places and signatures allow a link; written."""

    def compare(rows: dict[str, np.ndarray], lo: int, hi: int):
        found = [np.stack([np.full(len(j), i), j]) for i, j, _ in _candidates(rows, lo, hi, least)]
        return np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)

    pairs = _per_tile(cut, compare, ["one", "two"], [])
    return written(pairs.select(F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b")).distinct(), "tile-pairs", sets)


def nearest(cut: DataFrame, least: int, sets: int) -> DataFrame:
    """(one, two, alike, pairs) for every key that meets another class: the key of another class that is nearest by signature, the
    greatest similarity with it, and the number of pairs that ``tile_pairs`` would make of it; written.
    """

    def compare(rows: dict[str, np.ndarray], lo: int, hi: int):
        best, who, pairs = np.zeros(hi - lo), np.full(hi - lo, -1), np.zeros(hi - lo, np.int64)
        for i, j, alike in _candidates(rows, lo, hi, least):
            x, y = i - lo, j - lo
            k = int(alike.argmax())
            if alike[k] > best[x]:
                best[x], who[x] = alike[k], j[k]
            closer = alike > best[y]
            best[y[closer]], who[y[closer]] = alike[closer], i
            pairs[x] += len(j)
        met = np.flatnonzero(who >= 0)
        return met + lo, who[met], best[met], pairs[met]

    rows = _per_tile(cut, compare, ["one", "two"], [("alike", pa.float64()), ("pairs", pa.int64())])
    one = F.max_by(F.struct("two", "alike"), F.struct("alike", "two"))
    told = rows.groupBy("one").agg(one.alias("best"), F.sum("pairs").alias("pairs"))
    return written(told.select("one", "best.two", "best.alike", "pairs"), "nearest", sets)


def joined_classes(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) of all nodes of ``classes`` and ``links``, connected by both."""
    return connected_components(links.unionByName(classes.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def grown_classes(
    hits: DataFrame, pairs: DataFrame, classes: DataFrame, marks: DataFrame, stored: DataFrame, least: int, block: int, rounds: int = ROUNDS
) -> tuple[DataFrame, DataFrame]:
    """(classes, pairs (a, b) that are left between them): classes that a link joins are one, round by round.

    Every text proposes its nearest text of another class, so a loose group of n texts costs n pairs a round and its classes fall to
    half or less. Rows of crowded tokens propose by ``nearest``, the ``pairs`` (a, b, times) of the others as they are met. The rounds
    end when few of the proposed pairs are links or when the pairs that are left are no more than the texts that have one, or than a
    share of all sets; these cost less than another round.
    """
    sets = marks.count()
    enough = sets // LEFT
    for nth in range(rounds + 1):
        hits, pairs = mixed_hits(hits.drop("root"), classes, sets), apart(pairs, classes, sets)
        cut = tiles(hits, marks, sets, block)
        told = nearest(cut, least, sets)
        asked = told.select(F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b")).union(most_met(pairs).select("a", "b"))
        asked = written(asked.distinct(), "asked", sets)
        left, texts = told.agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0], asked.count()
        if nth == rounds or left + pairs.count() <= max(texts, enough):
            break
        links = verified(asked, stored, least)
        made = links.count()
        if made:
            classes = joined_classes(classes, links)
        if 10 * made < texts:
            break
    pairs = pairs.select("a", "b")
    # Classes that the last round joined make pairs too many here, never too few.
    return classes, (written(pairs.union(tile_pairs(cut, least, sets)).distinct(), "left", sets) if left else pairs)


def similar_sets(
    stored: DataFrame, path: str, least: int, block: int = BLOCK, bits: int = SKETCH, proposed: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """((node, root) of the keys that links of similarity ``least`` / 100 connect, ``stored`` without sets).

    Keys without links are left out. The large tables at ``path`` and of the first shingles are given back on the way. Of the pairs
    (a, b) in ``proposed`` each b has one compared first; those that are links make classes before the tiles meet.
    """
    index, at = prefixes(stored, least, bits)
    sets = stored.count()
    few, hits = meetings(index, least, sets)
    release(index, at)
    narrow = materialise(stored.drop("hashes", "row"), "narrow")
    marks = narrow.filter("n > 0").groupBy("key").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
    marks = written(marks, "signatures", sets)
    pairs = few.unionByName(first_pairs(hits, least, sets))
    pairs = pairs if proposed is None else pairs.unionByName(proposed.select("a", "b", F.lit(PROPOSED).cast("long").alias("times")))
    pairs = bounded(pairs.groupBy("a", "b").agg(F.sum("times").alias("times")), marks, least)
    first = verified(written(most_met(pairs).select("a", "b"), "first-pairs", sets), stored, least)
    classes, left = grown_classes(hits, pairs, connected_components(first), marks, stored, least, block)
    more = verified(left, stored, least)
    release(stored, path)
    # Links between classes, and the classes themselves, connect the same keys as all links.
    return classes if more.isEmpty() else joined_classes(classes, more), narrow


def jaccard_components(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, least: int = 85, keep: Sequence[str] | None = None,
    block: int = BLOCK, bits: int = SKETCH,
) -> DataFrame:
    """Rows with ``n_shingles`` and ``component_id``: the smallest id that links lead to, a row's own included.

    Texts link when the intersection of their sets of ``width``-word shingles (A-Z in lower case) is ``least`` hundredths of the
    union or more. A text of fewer words is one shingle. Null texts and texts without words have no shingle, link with nothing
    and keep their own id. Repeated rows and equal sets are linked. Null ids count after all others: a component of null ids
    alone has a null id. An empty table gives an empty result. ``keep`` are the caller's columns that stay, by default all.
    """
    if not 0 < least <= 100 or width < 1:
        raise ValueError("similarity in hundredths above zero, width from one")
    rows, back = numbered(df, keep, id=F.col(f"`{id_col}`"), text=text_of(text_col))
    roots, narrow = similar_sets(*with_sets(rows, width), least, block, bits)
    roots, narrow = roots.withColumnRenamed("node", "key"), narrow.drop("bits")
    linked = narrow.filter("n > 0").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    linked = materialise(linked.drop("key"), "linked")
    linked = join_totals(linked, linked.groupBy("root").agg(F.min("id").alias("component_id")), ["root"]).drop("root")
    out = linked.unionByName(narrow.filter("n = 0").drop("key").withColumn("component_id", F.col("id")))
    return out.select(*back("n_shingles", "component_id"), F.col("n").alias("n_shingles"), "component_id")
