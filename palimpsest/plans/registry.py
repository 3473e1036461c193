"""Registered queries: a function over the tables and, where SQL can say the same, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.session import share_package

Query = Callable[["Tables"], DataFrame]
QUERIES: dict[str, tuple[Query, str | None]] = {}


class Tables:
    """The tables of a folder, by attribute; read when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = share_package(spark), folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, folder, f=f: f(Tables(spark, folder))) for name, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
