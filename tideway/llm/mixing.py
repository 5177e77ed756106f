"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source starts with the same, usually fractional, number of copies (target over size). Whole copies
are certain; the fractions are rounded so that words are kept: two documents exchange words, in one of two directions
drawn so that expectations hold, until the fraction of one becomes 0 or 1. A leaf task does this for some documents of one
source and is left with at most one fraction; those residuals meet in the next level of a tree until one per source
remains, which a draw decides. All draws are hashes, so reruns agree whatever the partitioning.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideway.llm.common import count_words, shield, text_of, without
from tideway.operators.ranking import dense_ids
from tideway.session import materialise

#: Documents in a leaf, and residuals combined by one task of the tree.
LEAF, FAN = 1000, 1000
NEAR = 1e-9


def pivot(p: np.ndarray, size: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Round fractions ``p`` in order, keeping sum(p * size); at most one stays strictly between 0 and 1."""
    p = p.astype(float).copy()
    held = -1
    for j in range(len(p)):
        if not NEAR < p[j] < 1 - NEAR:
            p[j] = round(p[j])
            continue
        if held < 0:
            held = j
            continue
        i, si, sj = held, size[held], size[j]
        up, down = min((1 - p[i]) * si, p[j] * sj), min(p[i] * si, (1 - p[j]) * sj)
        moved = up if draw[j] * (up + down) < down else -down
        p[i] += moved / si
        p[j] -= moved / sj
        for k in (i, j):
            if not NEAR < p[k] < 1 - NEAR:
                p[k] = round(p[k])
        held = i if 0 < p[i] < 1 else j if 0 < p[j] < 1 else -1
    return p


def settle(p: np.ndarray, size: np.ndarray, draw: float) -> np.ndarray:
    """Decide the one fraction left, then turn documents that fit into the words it is off, largest first."""
    p = p.copy()
    for i in np.flatnonzero((p > 0) & (p < 1)):
        up = draw < p[i]
        off = (float(up) - p[i]) * size[i]
        p[i] = float(up)
        for j in np.argsort(-size, kind="stable"):
            if j != i and 0 < size[j] <= abs(off) and p[j] == float(off > 0):
                p[j] = 1 - p[j]
                off -= np.sign(off) * size[j]
    return p


def _uniform(seed: int, *keys):
    """A draw in [0, 1) from hashed keys."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11).cast("double") * F.lit(2.0**-53)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """``sizes`` (source, source_size, n) plus target: the words each source gives to the mix.

    Sources in code-point order, null last, take ``weights`` in turn and share all words by weight; no target exceeds
    ``most`` times its source, and what is cut off is shared again by weight until none does. The level of sharing is
    found by a few aggregates of this small table.
    """
    ranked = dense_ids(sizes, [F.col("source").asc_nulls_last()], "_mx_rank", 0)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_mx_rank") % len(weights) + 1).cast("int"))
    ranked = materialise(ranked.withColumn("weight", weight).drop("_mx_rank"), "sources")
    ceiling = F.col("source_size") * F.lit(float(most))
    level, capped = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(level) > ceiling
        total, open_weight, spent, n = ranked.agg(
            F.sum("source_size"), F.sum(F.when(~over, F.col("weight"))), F.sum(F.when(over, ceiling)), F.count(F.when(over, 1))
        ).first()
        if n == capped or not open_weight:
            break
        capped = n
        level = ((total or 0) - (spent or 0.0)) / open_weight
    return ranked.withColumn("target", F.least(F.col("weight") * F.lit(level), ceiling)).drop("weight")


def _round_groups(df: DataFrame) -> DataFrame:
    """One level: rows (row, key, size, source, leaf, groups, p, u) with fractions rounded inside (source, leaf).

    ``groups`` is how many groups the source has at this level; in the only one nothing stays fractional.
    """
    schema = df.schema

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("size", "descending"), ("u", "ascending"), ("key", "ascending"), ("row", "ascending")])
        at = group.schema.get_field_index("p")
        size, u = group.column("size").to_numpy(), group.column("u").to_numpy()
        p = pivot(group.column("p").to_numpy(), size, u)
        if group.column("groups")[0].as_py() == 1:
            p = settle(p, size, u[-1])
        return group.set_column(at, "p", pa.array(p))

    return df.groupBy("source", "leaf").applyInArrow(run, schema)


def copies_of(rows: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """(row, copies) for ``rows`` (row, key, size, source): whole numbers whose words meet the targets of the sources."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rate = F.when(F.abs(rate - F.round(rate)) < NEAR, F.round(rate)).otherwise(rate)
    at = targets.select(F.col("source").alias("_mx_source"), "n", rate.alias("rate"))
    joined = rows.join(at, F.col("source").eqNullSafe(F.col("_mx_source"))).select(
        "row", "key", "size", "source", F.floor("rate").cast("int").alias("whole"), (F.col("rate") - F.floor("rate")).alias("p"),
        F.ceil(F.col("n") / LEAF).cast("long").alias("groups"),
    ).withColumn("leaf", F.pmod(F.xxhash64(F.lit(seed), "key", "size"), F.col("groups")))
    joined = materialise(joined, "fractions")
    groups = joined.agg(F.max("groups")).first()[0] or 1
    done, level = [], 1
    # A text without words weighs nothing: its fraction is drawn on its own.
    idle = joined.filter("size = 0 or p = 0").select("row", F.when(_uniform(seed, "key") < F.col("p"), 1).otherwise(0).alias("p"))
    done.append(idle)
    now = joined.filter("size > 0 and p > 0").drop("whole")
    while True:
        rounded = materialise(_round_groups(now.withColumn("u", _uniform(seed + level, "key"))), f"level-{level}")
        done.append(rounded.filter("p = 0 or p = 1").select("row", F.col("p").cast("int").alias("p")))
        if groups == 1:
            break
        groups, level = -(-groups // FAN), level + 1
        now = rounded.filter("p > 0 and p < 1").drop("u").withColumns(
            {"leaf": F.floor(F.col("leaf") / FAN), "groups": F.ceil(F.col("groups") / FAN)}
        )
    extra = done[0]
    for part in done[1:]:
        extra = extra.unionByName(part)
    return joined.select("row", "whole").join(extra, "row").select("row", (F.col("whole") + F.col("p")).alias("copies"))


def mix(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0, seed: int = 7, carry: bool = True,
) -> DataFrame:
    """``df`` plus size (words), source_size, target (both of its source) and copies; one row per input row.

    Copies are 0 to ``most`` (rounded up); size times copies, summed over a source, differs from its target by less than
    its largest document. A null text has size 0; null sources form one source, ranked last; rows that repeat are rounded one by
    one. An empty table gives an empty result. Columns named like an added one are replaced. ``carry=False`` returns the
    id and the added columns only.
    """
    df, back = shield(without(df, "size", "source_size", "target", "copies"), "_mx_")
    own = list(df.columns) if carry else [id_col]
    stored = df.select(
        *[F.col(f"`{c}`") for c in own],
        count_words(text_of(text_col)).alias("size"),
        F.col(f"`{source_col}`").alias("_mx_source"),
        F.col(f"`{id_col}`").alias("_mx_key"),
    )
    stored = materialise(stored.withColumn("_mx_row", F.monotonically_increasing_id()), "sized", compression="zstd")
    rows = stored.select(
        F.col("_mx_row").alias("row"), F.col("_mx_key").alias("key"), "size", F.col("_mx_source").alias("source")
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    targets = materialise(source_targets(sizes, weights, most), "targets")
    copies = materialise(copies_of(rows, targets, seed), "copies").withColumnRenamed("row", "_mx_row")
    at = targets.select(F.col("source").alias("_mx_at"), "source_size", "target")
    # The same plan at every size, the one that grows.
    out = stored.join(copies.hint("merge"), "_mx_row").join(at, F.col("_mx_source").eqNullSafe(F.col("_mx_at")))
    return back(out.select(*[F.col(f"`{c}`") for c in own], "size", "source_size", "target", "copies"))
