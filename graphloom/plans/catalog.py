"""Registry of queries: each a callable of (spark, sf_dir), with the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a function of (tables) -> DataFrame, tables(name) being the table of that name."""

    def register(fn):
        key = name or fn.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))

        run.__doc__, run.__name__ = fn.__doc__, key
        QUERIES[key] = run
        if sql:
            SQL[key] = sql
        return fn

    return register
