"""Registered queries: a Spark callable and, where SQL can say it, an oracle text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name together with its oracle."""

    def register(fn: Query) -> Query:
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def positions_sql(source: str, key: str, seed: int = 42, columns: str = "*") -> str:
    """SQL of a seeded shuffle: ``pos`` and the row count ``n``."""
    return (
        f"SELECT {columns}, row_number() OVER (ORDER BY md5('{seed}:' || {key}::VARCHAR), {key}) - 1 AS pos, "
        f"count(*) OVER () AS n FROM {source}"
    )
