"""All queries of the base library, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import rates, relational, samples, scans, statistics, texts, vectors

Query = Callable[[SparkSession, str], DataFrame]
MODULES: tuple = (vectors, rates, relational, statistics, samples, texts, scans)


def queries() -> dict[str, Query]:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gain in cosine of each relation."""
    return vectors.k05(spark, sf_dir)
