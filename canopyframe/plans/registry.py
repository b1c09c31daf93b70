"""Registry of named queries and, where SQL can say the same, their ANSI-SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``; ``sql`` is the checking query."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return wrap


class Tables:
    """Lazy access to the parquet tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def with_ctes(*ctes: str, body: str) -> str:
    """Compose a checking query from shared CTE texts."""
    return "WITH " + ",\n".join(ctes) + "\n" + body


def r6(expr: str) -> str:
    """SQL rounding to 6 decimals, without negative zero."""
    return f"(round(CAST({expr} AS DOUBLE), 6) + 0.0)"


def r4(expr: str) -> str:
    return f"(round(CAST({expr} AS DOUBLE), 4) + 0.0)"
