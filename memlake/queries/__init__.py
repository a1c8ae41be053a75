"""Queries by theme; each registers a DataFrame function and, where SQL can say it, a DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        REGISTRY[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add
