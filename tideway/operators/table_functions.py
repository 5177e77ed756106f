"""Table functions: rows of a partition in, any number of rows out, with a schema that follows the table given.

The built-in operators cover arrays and ``explode``. What remains is a state that walks along the readings of a group and
tells of it now and then; Spark partitions and sorts the table, and the function sees one row at a time.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult
from pyspark.sql.types import DoubleType, LongType, Row, StructType

ORDER, VALUE = "__time", "__value"


class EpisodeRows:
    """One row per episode of a partition; see ``episodes``."""

    def __init__(self) -> None:
        self._keys: tuple = ()
        self._open: list | None = None

    @staticmethod
    def analyze(rows: AnalyzeArgument, enter: AnalyzeArgument, leave: AnalyzeArgument) -> AnalyzeResult:
        if enter.value is None or leave.value is None or leave.value > enter.value:
            raise ValueError("episodes need constant bounds, the one to leave at or below the one to enter")
        schema = StructType([f for f in rows.dataType.fields if f.name not in (ORDER, VALUE, "__tie")])
        time = next(f.dataType for f in rows.dataType.fields if f.name == ORDER)
        schema = schema.add("start", time).add("end", time).add("n", LongType()).add("peak", DoubleType())
        return AnalyzeResult(schema=schema)

    def eval(self, row: Row, enter: float, leave: float):
        value, time = row[VALUE], row[ORDER]
        if value is None or math.isnan(value):
            return
        if self._open is None:
            if value >= enter:
                self._keys = tuple(v for k, v in row.asDict().items() if k not in (ORDER, VALUE, "__tie"))
                self._open = [time, time, 1, value]
        elif value < leave:
            done, self._open = self._open, None
            yield (*self._keys, *done)
        else:
            start, _, n, peak = self._open
            self._open = [start, time, n + 1, max(peak, value)]

    def terminate(self):
        if self._open is not None:
            yield (*self._keys, *self._open)


def episodes(
    df: DataFrame, keys: Sequence[str], time: str, value: str, enter: float, leave: float, tie: str | None = None
) -> DataFrame:
    """Episodes with hysteresis: a group's readings from one at ``enter`` or above until one below ``leave``.

    Columns: the keys with their types, ``start`` and ``end`` (times of the first and last reading inside, in the type of
    ``time``), ``n`` and ``peak``. An episode that is open at the end of its group ends there. Null and NaN readings are
    passed over, rows without a time are left out, and null keys are a group like any other. ``tie`` orders equal times.
    A group passes through one task row by row in constant memory; a key of any length is kept short by a day among the
    ``keys``, which ends episodes at midnight. An empty table has no episodes.
    """
    rows = df.filter(F.col(time).isNotNull()).select(
        *keys, F.col(time).alias(ORDER), F.col(value).cast("double").alias(VALUE), (F.col(tie) if tie else F.lit(0)).alias("__tie")
    )
    table = rows.asTable().partitionBy(*keys).orderBy(ORDER, "__tie")
    return F.udtf(EpisodeRows)(table, F.lit(float(enter)), F.lit(float(leave)))
