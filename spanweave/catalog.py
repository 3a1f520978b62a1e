"""Registry of queries: name -> (spark builder, oracle SQL or None).

Builders take ``(spark, sf_dir)`` and return a DataFrame over the driver's
tables (or data Spark derives from them).  The SQL is the independent DuckDB
oracle for the same result, with identical column names and types.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from spanweave import queries  # noqa: F401
