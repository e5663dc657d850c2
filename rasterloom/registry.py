"""Every query of the library and its DuckDB twin, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; sql is what DuckDB runs on the same tables, where SQL can say it."""

    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def load() -> None:
    """Import the modules that register queries."""
    from .plans import geometry, manifests, models, pixels, rasters, routes, sequences, sessions, snapping, storage  # noqa: F401


load()
