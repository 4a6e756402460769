"""Named queries and their SQL twins, gathered from the modules that define them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with DuckDB SQL for the same rows where SQL can express it."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


for _module in ("tabular", "graph", "ranking", "texts", "episodes", "observations", "vectors", "loaders", "reports", "tokens", "sources_sinks", "folders"):
    importlib.import_module(f"ledgerloom.plans.{_module}")
