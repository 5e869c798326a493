"""Registered queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its check, omitted where SQL cannot express it."""

    def keep(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            CHECKS[name] = sql
        return run

    return keep
