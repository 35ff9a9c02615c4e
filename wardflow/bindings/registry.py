"""Registry of named queries with their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wardflow.bindings.star import StarTables, with_tables

QUERIES: dict[str, Callable[[StarTables], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query over the star tables; ``sql`` is its twin."""

    def add(build: Callable[[StarTables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            CHECKS[name] = sql
        return build

    return add


def bound(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: QUERIES[name](StarTables(spark, folder))


def check_sql(name: str) -> str:
    return with_tables(CHECKS[name])
