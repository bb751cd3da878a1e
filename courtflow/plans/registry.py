"""Registered queries: a Spark function and, where SQL can say it, its check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtflow.plans.tables import Tables, sql_with_inputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            CHECKS[name] = sql_with_inputs(sql)
        return fn

    return register


def shown(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    """Round computed doubles for display; the operators keep full precision."""
    return df.withColumns({c: F.round(F.col(c), places) for c in columns})
