"""Registered queries: a name, a Spark callable, and (where SQL can say it) the SQL to check it with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from questloom.operators.gate import run_sql
from questloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None) -> Callable[[Query], Query]:
    """Register a function under ``name``, with the SQL that must give the same rows."""

    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = function
        if check:
            CHECKS[name] = check
        return function

    return add


def views(spark: SparkSession, folder: str, *names: str) -> None:
    for name in names:
        table(spark, folder, name).createOrReplaceTempView(name)


def plain_sql(name: str, tables: str, sql: str, check: str | None = None) -> None:
    """Register SQL that goes through the gate as a user's would; ``check`` if dialects differ."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        views(spark, folder, *tables.split())
        return run_sql(spark, sql, max_rows=None)

    query(name, check or sql)(run)
