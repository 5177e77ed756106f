"""Ranks, running totals, neighbours in time, and dense ids without unbounded window groups.

A window partitioned by an individual puts all rows of that individual into one task. Here the rows are sorted by one
range exchange on (keys, full order), which cuts any key anywhere, and written once with their place in their partition.
Windows then run inside (partition, key), and what a key has gathered in earlier partitions is added from the edges: the
first and the last key of each partition, at most two rows per partition, the only side that is broadcast.

Null keys form a group of their own, as in a plain window. Rows that tie in the order keep the order they were written in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideway.session import materialise

PART, AT = "__part", "__at"
#: Rows wanted in a partition that is dealt by range.
ROWS_PER_PART = 2_000_000


def measured_parts(df: DataFrame, parts: int | None = None) -> int:
    """``parts``, or as many as the counted rows ask for, and the session's number at least."""
    if parts:
        return parts
    session = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(session, -(-df.count() // ROWS_PER_PART))


def hash_slice(hashed: Column, bits: int = 18) -> Column:
    """Slice number that never decreases with a signed 64-bit hash; 2**bits slices."""
    return F.shiftright(hashed, 64 - bits)


def _placed(df: DataFrame, order_by: Sequence, parts: int | None, label: str) -> DataFrame:
    """Rows sorted over partitions, with the partition and the place in it, written once.

    The input is stored first: counting it, sampling the range bounds and sorting it then read a table and not the plan
    behind it, which runs once. Bounds are sampled, so all uses of the sorted table must see one and the same run.
    """
    if not parts:
        df = materialise(df, f"{label}-input")
    rows = df.repartitionByRange(measured_parts(df, parts), *order_by).sortWithinPartitions(*order_by)
    rows = rows.withColumn("__mid", F.monotonically_increasing_id())
    at = F.col("__mid").bitwiseAND(F.lit((1 << 33) - 1))
    return materialise(rows.withColumns({PART: F.shiftright("__mid", 33), AT: at}).drop("__mid"), label)


def _with_edges(placed: DataFrame, keys: Sequence[str], gathered: dict[str, Column], carried: dict[str, Column]) -> DataFrame:
    """Attach ``carried`` to rows whose key reaches over the border of their partition.

    ``gathered`` are aggregates of a key inside one partition; ``carried`` are expressions over them in a window along the
    partitions of the key. Other rows get nulls.
    """
    over = Window.partitionBy(*[f"__k{i}" for i in range(len(keys))]) if keys else Window.partitionBy(F.lit(0))
    earlier = over.orderBy(PART)
    runs = placed.groupBy(PART, *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(
        F.min(AT).alias("__lo"), F.max(AT).alias("__hi"), *[c.alias(n) for n, c in gathered.items()]
    )
    ends = placed.groupBy(PART).agg(F.max(AT).alias("__end"))
    edges = runs.join(F.broadcast(ends), PART).filter("__lo = 0 or __hi = __end")
    edges = edges.select(
        F.col(PART).alias("__edge"), "__hi", *[f"__k{i}" for i in range(len(keys))],
        *[(c.over(earlier) if n.startswith("__next") else c.over(earlier.rowsBetween(Window.unboundedPreceding, -1))).alias(n)
          for n, c in carried.items()],
    )
    on = F.col(PART) == F.col("__edge")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return placed.join(F.broadcast(edges), on, "left")


def _inside(keys: Sequence[str]):
    return Window.partitionBy(PART, *keys).orderBy(AT)


def rank_within(
    df: DataFrame, keys: Sequence[str], order_by: Sequence, name: str = "_rank", parts: int | None = None
) -> DataFrame:
    """``row_number() over (partition by keys order by order_by)``."""
    placed = _placed(df, [*keys, *order_by], parts, "ranked")
    out = _with_edges(placed, keys, {"__n": F.count(F.lit(1))}, {"__before": F.sum("__n")})
    rank = F.row_number().over(_inside(keys)) + F.coalesce("__before", F.lit(0))
    return out.withColumn("__rank", rank).select(*[c for c in df.columns if c != name], F.col("__rank").alias(name))


def running_total(
    df: DataFrame, keys: Sequence[str], order_by: Sequence, value: str, name: str, parts: int | None = None
) -> DataFrame:
    """``sum(value) over (partition by keys order by order_by rows unbounded preceding)``."""
    placed = _placed(df, [*keys, *order_by], parts, "running")
    out = _with_edges(placed, keys, {"__n": F.sum(value)}, {"__before": F.sum("__n")})
    local = F.sum(value).over(_inside(keys).rowsBetween(Window.unboundedPreceding, 0))
    total = F.when(F.col("__before").isNull(), local).otherwise(F.coalesce(local, F.lit(0)) + F.col("__before"))
    return out.withColumn("__total", total).select(*[c for c in df.columns if c != name], F.col("__total").alias(name))


def sequence_with_next(
    df: DataFrame, keys: Sequence[str], order_by: Sequence, state: str, rank_name: str, next_name: str,
    parts: int | None = None,
) -> DataFrame:
    """Row number and the next row's ``state``, from one sorted table."""
    placed = _placed(df, [*keys, *order_by], parts, "sequence")
    first = F.min_by(F.struct(F.col(state).alias("s")), F.col(AT))
    out = _with_edges(
        placed, keys, {"__n": F.count(F.lit(1)), "__first": first},
        {"__before": F.sum("__n"), "__next": F.lead("__first")},
    )
    inside = _inside(keys)
    out = out.withColumns(
        {"__rank": F.row_number().over(inside) + F.coalesce("__before", F.lit(0)), "__lead": F.lead(state).over(inside)}
    )
    return out.select(
        *[c for c in df.columns if c not in (rank_name, next_name)],
        F.col("__rank").alias(rank_name),
        F.when(F.col(AT) == F.col("__hi"), F.col("__next")["s"]).otherwise(F.col("__lead")).alias(next_name),
    )


def rolling_mean(
    df: DataFrame, keys: Sequence[str], order_by: Sequence, value: str, width: int = 10,
    name: str = "rolling", block: int = 65536, parts: int | None = None,
) -> DataFrame:
    """Mean over the last ``width`` rows of each key.

    Rows are numbered, then cut into blocks; each block also receives the ``width - 1`` rows
    before it, so every window is complete and no key is ever in one piece.
    """
    if width > block:
        raise ValueError("width must not exceed block")
    ranked = rank_within(df, keys, order_by, "__r", parts)
    position = F.col("__r") - 1
    own = F.floor(position / block)
    spill = F.pmod(position, F.lit(block)) > block - width
    ranked = ranked.withColumns({"__own": own})
    copies = ranked.withColumn(
        "__block",
        F.explode(F.when(spill, F.array("__own", F.col("__own") + 1)).otherwise(F.array("__own"))),
    )
    w = Window.partitionBy(*keys, "__block").orderBy("__r").rowsBetween(-(width - 1), 0)
    out = copies.withColumn(name, F.avg(value).over(w))
    return out.filter(F.col("__block") == F.col("__own")).select(*df.columns, name)


def dense_ids(
    df: DataFrame, order_by: Sequence, name: str = "_id", start: int = 1, parts: int | None = None
) -> DataFrame:
    """Consecutive ids over the whole table in the given order, which must be total for ids to be the same in every run.

    One range exchange sorts the table; the number of rows in earlier partitions is added from a table with one row per
    partition - the only side that is broadcast, and its size is the partition count. Rows with equal order values share
    a partition, so an order of few values should end with a key.
    """
    placed = _placed(df, order_by, parts, "dense-ids")
    sizes = placed.groupBy(PART).agg((F.max(AT) + 1).alias("__n"))
    over = Window.partitionBy(F.lit(0)).orderBy(PART)
    offsets = sizes.select(PART, (F.sum("__n").over(over) - F.col("__n")).alias("__before"))
    out = placed.join(F.broadcast(offsets), PART)
    return out.withColumn("__id", F.col(AT) + F.col("__before") + F.lit(start)).select(
        *[c for c in df.columns if c != name], F.col("__id").alias(name)
    )


def reindex(df: DataFrame, key: str, name: str = "_individual", start: int = 0) -> DataFrame:
    """Replace or add a dense id per distinct key, numbered in key order; null is a key like any other.

    The ids are written before the join, so a hot key meets a plain sized side and is split.
    """
    ids = dense_ids(df.select(F.col(key).alias("__key")).distinct(), ["__key"], "__id", start)
    ids = materialise(ids, "key-ids")
    out = df.join(ids, F.col(key).eqNullSafe(F.col("__key")))
    return out.select(*[c for c in df.columns if c != name], F.col("__id").alias(name))


def offset_ids(df: DataFrame, name: str, by: int) -> DataFrame:
    """Shift ids so that two id ranges stay apart in a union."""
    return df.withColumn(name, F.col(name) + F.lit(by))


def choice_number(df: DataFrame, decision: Sequence[str], order_by: Sequence, name: str = "_choice") -> DataFrame:
    """Number the alternatives of each decision.

    A plain window: a decision holds one row per alternative, a count fixed by the class list
    or by the cells in a disc, never by the size of the data.
    """
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*decision).orderBy(*order_by)))
