"""Query registry, table access and the rounding both engines share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Parquet tables of one scale folder as attributes; ``spark`` is the session."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self._folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._folder}/{name}.parquet")

    def stream(self, name: str) -> DataFrame:
        """The table's files as a stream; a pattern, as a path of a stream that is no pattern must be a folder."""
        schema = getattr(self, name).schema
        return self.spark.readStream.schema(schema).parquet(f"{self._folder}/{name}.parque[t]")


def query(name: str, sql: str | None = None):
    """Register a function of ``Tables``; ``sql`` is what must give the same rows."""

    def add(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def r6(x: Column | str) -> Column:
    """Six decimals by arithmetic that is the same in both engines; ties always go up."""
    c = F.col(x) if isinstance(x, str) else x
    return F.floor(c * F.lit(1e6) + F.lit(0.5001)) / F.lit(1e6)


def r2(x: Column | str) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    return F.floor(c * F.lit(1e2) + F.lit(0.5001)) / F.lit(1e2)


def q6(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5001e0) / 1e6"


def q2(x: str) -> str:
    return f"floor(({x}) * 1e2 + 0.5001e0) / 1e2"


def num(x: float) -> str:
    """A SQL literal that is read as a double, digit for digit."""
    text = repr(float(x))
    return text if "e" in text else text + "e0"
