"""From decisions to labelled alternatives."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideway.operators.joins import join_totals, neighbors
from tideway.operators.ranking import choice_number, sequence_with_next

DECISION = ("_individual", "_decision")


def sequence_decisions(
    df: DataFrame, individual: str, time: str, state: str, tie: Sequence[str] = (),
    next_name: str | None = None, parts: int | None = None,
) -> DataFrame:
    """Number an individual's fixes in time order and attach the state it moves to next.

    The last fix keeps a null next state. The fixes are sorted over ``parts`` partitions (by
    default as many as their number asks for), so one individual may hold any share of them.
    """
    return sequence_with_next(
        df, [individual], [time, *tie], state, "_decision", next_name or f"next_{state}", parts
    )


def expand_classes(
    df: DataFrame, classes: Sequence[float | str], name: str, choice: str = "_choice"
) -> DataFrame:
    """One row per alternative class; ``_choice`` is the place of the class in the list."""
    values = F.array(*[F.lit(c) for c in classes])
    out = df.select("*", F.posexplode(values).alias(choice, name))
    return out.withColumn(choice, F.col(choice) + 1)


def expand_neighbors(
    df: DataFrame, cell: str, max_km: float, res: int = 4, name: str = "cell",
    decision: Sequence[str] = DECISION, distance: str = "distance", method: str = "ellipsoid",
) -> DataFrame:
    """One row per reachable cell, numbered by cell id inside the decision."""
    out = neighbors(df, cell, max_km, res, name, distance, method)
    return choice_number(out, decision, [name])


def expand_by_context(
    decisions: DataFrame, facts: DataFrame, on: Sequence[str], name: str, classes: Sequence,
    choice: str = "_choice",
) -> DataFrame:
    """``expand_classes`` followed by an inner join on ``[*on, name]``, in one join.

    The facts already hold one row per class, so joining on the other keys multiplies the
    decisions by itself: the exchange moves one row per decision instead of one per
    alternative. ``_choice`` is still the place in the class list.
    """
    listed = facts.filter(F.col(name).isin(list(classes)))
    out = decisions.join(listed, list(on))
    return out.withColumn(
        choice, F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(name)).cast("int")
    )


def mark_selected(df: DataFrame, actual: str, alternative: str, name: str = "_selected") -> DataFrame:
    """True where the alternative is the one taken, null where the actual state is unknown."""
    return df.withColumn(name, F.col(actual) == F.col(alternative))


def require_selected(
    df: DataFrame, decision: Sequence[str] = DECISION, selected: str = "_selected"
) -> DataFrame:
    """Drop decisions whose selected alternative was lost on the way, or is unknown."""
    w = Window.partitionBy(*decision)
    return df.withColumn("__has", F.max(F.col(selected)).over(w)).filter("__has").drop("__has")


def drop_trivial(df: DataFrame, decision: Sequence[str] = DECISION) -> DataFrame:
    """Drop decisions with a single alternative."""
    w = Window.partitionBy(*decision)
    return df.withColumn("__n", F.count(F.lit(1)).over(w)).filter("__n > 1").drop("__n")


def restrict_moves(
    df: DataFrame, max_km: float, decision: Sequence[str] = DECISION, distance: str = "distance",
    selected: str = "_selected",
) -> DataFrame:
    """Keep decisions whose selected move is below ``max_km``, and only such alternatives."""
    near = df.filter(F.col(distance) < max_km)
    w = Window.partitionBy(*decision)
    return (
        near.withColumn("__ok", F.max(F.col(selected)).over(w)).filter("__ok").drop("__ok")
    )


def min_decisions(
    df: DataFrame, n: int, individual: str = "_individual", decision: str = "_decision"
) -> DataFrame:
    """Keep individuals with at least ``n`` distinct decisions."""
    enough = (
        df.groupBy(individual)
        .agg(F.count_distinct(decision).alias("__d"))
        .filter(F.col("__d") >= n)
        .select(individual)
    )
    return join_totals(df, enough, [individual], "left_semi")


def pad_decisions(
    df: DataFrame, max_choices: int, features: Sequence[str], missing: Mapping[str, float],
    decision: Sequence[str] = DECISION, choice: str = "_choice", selected: str = "_selected",
) -> DataFrame:
    """Fixed-width decisions: one row per decision with a feature array of ``max_choices``.

    Absent alternatives take the ``missing`` values and are not selected. A decision with more
    alternatives than fit is an error, not a truncation.
    """
    row = F.struct(
        F.col(choice).alias("choice"), F.coalesce(F.col(selected), F.lit(False)).alias("selected"),
        *[F.col(f).cast("double").alias(f) for f in features],
    )
    filler = F.struct(
        F.lit(None).cast(dict(df.dtypes)[choice]).alias("choice"), F.lit(False).alias("selected"),
        *[F.lit(float(missing[f])).alias(f) for f in features],
    )
    packed = df.groupBy(*decision).agg(F.sort_array(F.collect_list(row)).alias("choices"))
    room = F.lit(max_choices) - F.size("choices")
    checked = F.when(
        room < 0,
        F.raise_error(F.concat(F.lit("more alternatives than max_choices: "), F.size("choices"))),
    ).otherwise(room)
    return packed.withColumn(
        "choices", F.concat(F.col("choices"), F.array_repeat(filler, checked.cast("int")))
    )
