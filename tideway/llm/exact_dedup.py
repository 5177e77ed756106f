"""Exact duplicates by a content sort, in DataFrame operations only.

Rows are range-partitioned by sampled splitters over the start of the normalised text and its hash, sorted inside each
partition by the whole normalised text, and every row is compared in full with its neighbour. A run of equal neighbours
keeps its smallest id. Only a text that alone exceeds an even share of one partition is cut, by a salt from the id; what
its runs have in common (smallest id and size) comes from one aggregate with partial sums, of fewer texts than partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideway.llm.common import SPACES, shield, shuffle_parts, text_of, without
from tideway.session import materialise

START, HASH, SALT, NORM, FIRST = "_xd_start", "_xd_hash", "_xd_salt", "_xd_norm", "_xd_first"
#: Bytes a row costs besides its text, so that many copies of a short text count too.
ROW_BYTES = 64


def normalised(text_col: str) -> Column:
    """The text with every run of white space replaced by one space; null is the empty text."""
    return F.regexp_replace(text_of(text_col), SPACES, " ")


def _hot_hashes(keyed: DataFrame, text_col: str, n: int) -> DataFrame:
    """Hashes whose rows weigh more than 1/n of the table: fewer than n rows by construction."""
    weighed = keyed.select(HASH, (F.length(text_of(text_col)) + ROW_BYTES).alias("weight"))
    groups = weighed.groupBy(HASH).agg(F.count("*").alias("copies"), F.sum("weight").alias("weight"))
    groups = materialise(groups.filter("copies > 1"), "copy-groups")
    total = weighed.agg(F.sum("weight")).first()[0] or 0
    return groups.filter(F.col("weight") * n > total).select(HASH, F.lit(True).alias("_xd_hot"))


def exact_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None, carry: bool = True
) -> DataFrame:
    """``df`` plus keep_id, group_size, kept and text_sha256; one row per input row.

    Texts are equal when identical after white-space normalisation; a null text is the empty text. Of a group the row
    with the smallest id has ``kept``; null ids come last, and of rows that repeat an id exactly one is kept. An empty
    table gives an empty result. Columns of ``df`` named like an added one are replaced. ``carry=False`` returns the id
    and the added columns only.
    """
    added = ("keep_id", "group_size", "kept", "text_sha256")
    n = shuffle_parts(df, parts)
    df, back = shield(without(df, *added), "_xd_")
    own = list(df.columns) if carry else [id_col]
    if not carry:
        df = df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    keyed = df.withColumns({START: F.substring(normalised(text_col), 1, 32), HASH: F.xxhash64(normalised(text_col))})
    hot = materialise(_hot_hashes(keyed, text_col, n), "hot-texts")
    row_id = F.col(f"`{id_col}`")
    # Fewer than n hashes, so fewer rows than partitions but for collisions.
    cut = keyed.join(F.broadcast(hot), HASH).groupBy(normalised(text_col).alias(NORM)).agg(
        F.min(row_id).alias("_xd_keep"), F.count(F.lit(1)).alias("_xd_size")
    ).select(F.sha2(NORM, 256).alias("text_sha256"), "_xd_keep", "_xd_size")
    cut = materialise(cut, "cut-texts")
    salted = keyed.join(F.broadcast(hot), HASH, "left").withColumn(
        SALT, F.when(F.col("_xd_hot"), F.pmod(F.xxhash64(row_id), F.lit(n)).cast("int")).otherwise(-1)
    )
    # Window keys that contain the range keys need no further exchange.
    dealt = salted.repartitionByRange(n, START, HASH, SALT).withColumn(NORM, normalised(text_col))
    content = Window.partitionBy(START, HASH, SALT).orderBy(F.col(NORM), row_id.asc_nulls_last())
    run = Window.partitionBy(START, HASH, SALT, NORM)
    runs = dealt.withColumns(
        {
            FIRST: ~F.col(NORM).eqNullSafe(F.lag(NORM).over(content)),
            "keep_id": F.min(row_id).over(run),
            "group_size": F.count(F.lit(1)).over(run),
        }
    ).withColumn("text_sha256", F.sha2(NORM, 256))
    runs = runs.select(*[F.col(f"`{c}`") for c in own], "keep_id", "group_size", "text_sha256", FIRST)
    whole = runs.join(F.broadcast(cut), "text_sha256", "left")
    out = whole.select(
        *[F.col(f"`{c}`") for c in own],
        F.coalesce("_xd_keep", "keep_id").alias("keep_id"),
        F.coalesce("_xd_size", "group_size").alias("group_size"),
        (F.col(FIRST) & row_id.eqNullSafe(F.coalesce("_xd_keep", "keep_id"))).alias("kept"),
        "text_sha256",
    )
    return back(out)
