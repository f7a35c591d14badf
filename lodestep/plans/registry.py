"""Where queries and their oracles are registered by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the DuckDB SQL that gives the same rows."""

    def add(fn: Query) -> Query:
        QUERIES[name or fn.__name__] = (fn, sql)
        return fn

    return add
