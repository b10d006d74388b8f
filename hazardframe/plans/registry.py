"""Queries by name, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *views: str):
    """Registers fn(spark, sf_dir); `views` are WITH clauses that go before `sql`; one that starts with RECURSIVE makes them so."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            recursive = "RECURSIVE " if any(v.startswith("RECURSIVE ") for v in views) else ""
            ORACLE_SQL[name] = (f"WITH {recursive}{', '.join(v.removeprefix('RECURSIVE ') for v in views)} " if views else "") + sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
