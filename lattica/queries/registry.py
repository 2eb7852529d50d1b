"""The registry of queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.darray import DArray, Engine
from lattica.sources.files import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name, with its twin."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def values(spark: SparkSession, d: str, value: str | Column = "value", kind: str = "n") -> DArray:
    """events as a list: event_id numbers them from 0."""
    return Engine(spark).dense(table(spark, d, "events"), "event_id", value, kind=kind)


def users(spark: SparkSession, d: str) -> DArray:
    return values(spark, d, "user_id")


def vectors(spark: SparkSession, d: str) -> DArray:
    """embeddings as a rank-2 array."""
    return Engine(spark).matrix(table(spark, d, "embeddings"), "vec_id", "embedding", 64)


def rounded(x: DArray | DataFrame, digits: int = 4) -> DataFrame:
    df = x.df if isinstance(x, DArray) else x
    return df.withColumn("v", F.round("v", digits) + 0.0)
