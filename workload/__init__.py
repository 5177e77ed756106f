"""Registered queries on the bundled tables, each with its SQL counterpart where one exists."""

from workload import (  # noqa: F401  (importing registers)
    aggregate_queries, choice_queries, column_queries, function_queries, geo_queries,
    join_queries, model_queries, order_queries, source_queries,
)
from workload.registry import ORACLES, QUERIES  # noqa: F401
