"""Where the modules of this package register their queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import spread, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def reader(spark: SparkSession, sf_dir: str) -> Callable[[str], DataFrame]:
    return lambda name: table(spark, sf_dir, name)


def dealt(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table, dealt to all cores: for queries that do much for
    each row."""
    return spread(table(spark, sf_dir, name).select(*columns))
