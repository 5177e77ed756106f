"""Context and model to a stored transition table and the mass it carries."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from tideway.operators.norms import Norm
from tideway.operators.propagation import propagate, stationary_seed, store_bucketed, transition_table
from tideway.operators.scoring import LinearModel, MlpModel
from tideway.session import scratch_path
from tideway.sources.tables import read_table, write_table


def diffuse(
    context: DataFrame, model: LinearModel | MlpModel, max_km: float, spec: Mapping[str, Norm],
    params: DataFrame, path: str | None = None, method: str = "ellipsoid",
) -> DataFrame:
    """Write the transition table partitioned by date and return it from there."""
    spark = context.sparkSession
    target = path or scratch_path(spark, "transitions")
    write_table(transition_table(context, model, max_km, spec, params, method=method), target, ["date"])
    return read_table(spark, target)


def diffuse_and_propagate(
    context: DataFrame, seed_cells: DataFrame, start, steps: int, model: LinearModel | MlpModel,
    max_km: float, spec: Mapping[str, Norm], params: DataFrame, quanta: float = 10.0,
    method: str = "ellipsoid", bucketed: str | None = None, buckets: int | None = None,
) -> DataFrame:
    """Mass history from equal mass on the seed cells.

    ``bucketed`` names a catalog table to keep the transitions in, in buckets that no step exchanges; worth it for many steps.
    """
    if bucketed:
        made = transition_table(context, model, max_km, spec, params, method=method)
        transitions = store_bucketed(made, bucketed, buckets, scratch_path(context.sparkSession, bucketed))
    else:
        transitions = diffuse(context, model, max_km, spec, params, method=method)
    return propagate(stationary_seed(seed_cells, start, quanta), transitions, steps)
