"""How a module of queries registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Queries:
    """Queries by name and, where SQL can express them, their SQL."""

    def __init__(self):
        self.QUERIES: dict[str, Query] = {}
        self.SQL: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def put(f: Query) -> Query:
            if name in self.QUERIES:
                raise ValueError(f"{name} is registered twice")
            self.QUERIES[name] = f
            if sql is not None:
                self.SQL[name] = sql
            return f

        return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
