"""Registered queries: each name has a Spark callable ``(spark, sf_dir) -> DataFrame``
and, where the result is expressible in SQL, a DuckDB oracle over the same
tables. Modules under ``motorisk.checks`` add their entries on import.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise KeyError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    from . import checks  # noqa: F401  (registers on import)
