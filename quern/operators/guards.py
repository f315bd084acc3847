"""Checks on joins: duplicates, coverage, cardinality. A check runs a job of its own at once; its error names a few offenders."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class GuardError(ValueError):
    """A frame breaks what a join needs."""


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n_rows) of keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def require_unique(df: DataFrame, keys: Sequence[str], what: str = "table", show: int = 5) -> DataFrame:
    """``df``, or an error with the first offenders."""
    found = duplicates(df, keys).orderBy(F.desc("n_rows"), *keys).limit(show).collect()
    if found:
        raise GuardError(f"{what}: duplicate keys {[tuple(r) for r in found]}")
    return df


def unmatched(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``left`` that have no partner."""
    return left.join(right.select(*keys).distinct(), list(keys), "left_anti")


def require_covered(left: DataFrame, right: DataFrame, keys: Sequence[str], show: int = 5) -> DataFrame:
    found = unmatched(left, right, keys).select(*keys).limit(show).collect()
    if found:
        raise GuardError(f"no partner for {[tuple(r) for r in found]}")
    return left


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise GuardError(f"missing columns {missing}; there are {df.columns}")
    return df


def checked_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", validate: str = "many_to_one") -> DataFrame:
    """A join whose sides named ``one`` in ``validate`` must have unique keys."""
    a, _, b = validate.partition("_to_")
    if a == "one":
        require_unique(left, keys, "left")
    if b == "one":
        require_unique(right, keys, "right")
    return left.join(right, list(keys), how)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join in which null keys match each other, as data-frame merges do."""
    names = {k: f"_r_{k}" for k in keys}
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    # without keys the right side is one row, as an aggregate without keys is
    return left.join(right.withColumnsRenamed(names) if keys else F.broadcast(right), reduce(and_, same, F.lit(True)), how).drop(*names.values())
