"""What the corpus operators share: words, column hygiene and fresh column names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Separators of words and the word itself, in the dialect of Java and RE2.
SPACES = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"


def text_of(name: str) -> Column:
    """The text column as a string, null as the empty text."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of words."""
    return F.array_remove(F.split(text, SPACES), "")


def count_words(text: Column) -> Column:
    """Number of words as a long."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def shuffle_parts(df: DataFrame, parts: int | None) -> int:
    """Partitions for an exchange that is dealt by hand: given, or the session's."""
    return int(parts or df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns that an operator is about to add, so that names never clash."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def shield(df: DataFrame, prefix: str):
    """(``df`` with columns that begin with an operator's own ``prefix`` renamed, a function that names them back).

    Operators name their working columns by a prefix; this keeps them apart from whatever the caller's table has.
    """
    away = {c: f"own {c}" for c in df.columns if c.lower().startswith(prefix)}
    return (df.withColumnsRenamed(away) if away else df), lambda out: out.withColumnsRenamed({v: k for k, v in away.items()}) if away else out


def set_aside(df: DataFrame, *names: str):
    """(``df`` with columns called like ``names`` renamed, a function that names them back)."""
    taken = {n.lower() for n in names}
    away = {c: f"aside {c}" for c in df.columns if c.lower() in taken}
    return (df.withColumnsRenamed(away) if away else df), lambda out: out.drop(*away).withColumnsRenamed({v: k for k, v in away.items()}) if away else out


def numbered(df: DataFrame, keep, **own: Column):
    """(columns of ``df`` named in ``keep`` as c0, c1, ... beside the ``own`` ones, function from them to select expressions).

    Whatever the caller's columns are called, they never meet a working column.
    """
    names = list(keep if keep is not None else df.columns)
    inside = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], *[c.alias(n) for n, c in own.items()])

    def back(*taken: str) -> list[Column]:
        """The caller's columns under their names, less those named like a new one."""
        new = {n.lower() for n in taken}
        return [F.col(f"c{i}").alias(c) for i, c in enumerate(names) if c.lower() not in new]

    return inside, back
