"""Operators as named transforms: bind parameters now, apply with ``df.transform`` later."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame

from tideway.operators import (
    aggregates, choices, columns, environment, evaluation, joins, norms, ranking,
    sampling, scoring, seasons,
)

_REGISTRY: dict[str, Callable[..., DataFrame]] = {}

for _module in (
    aggregates, choices, columns, environment, evaluation, joins, norms, ranking, sampling,
    scoring, seasons,
):
    for _name, _fn in vars(_module).items():
        if not _name.startswith("_") and inspect.isfunction(_fn) and _fn.__module__ == _module.__name__:
            _first = next(iter(inspect.signature(_fn).parameters.values()), None)
            if _first is not None and _first.annotation == "DataFrame":
                _REGISTRY[_name] = _fn


def named(name: str, *args, **kwargs) -> Callable[[DataFrame], DataFrame]:
    """``df.transform(named("to_cell", "lat", "lon", res=4))``."""
    fn = _REGISTRY[name]
    inspect.signature(fn).bind(None, *args, **kwargs)  # complain where it is written

    @wraps(fn)
    def bound(df: DataFrame) -> DataFrame:
        return fn(df, *args, **kwargs)

    return bound


def register(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Add a transform of one's own under its function name."""
    _REGISTRY[fn.__name__] = fn
    return fn


def manifest() -> list[dict]:
    """Name, description and parameters of every transform."""
    out = []
    for name, fn in sorted(_REGISTRY.items()):
        parameters = list(inspect.signature(fn).parameters.values())[1:]
        out.append(
            {
                "name": name,
                "description": (inspect.getdoc(fn) or "").split("\n")[0],
                "parameters": [
                    {"name": p.name, "type": str(p.annotation), "required": p.default is p.empty}
                    for p in parameters
                ],
            }
        )
    return out
