"""Vectors as array<double>: products, norms, cosines and means, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def cosine(a: Column, b: Column, rule: str = "none") -> Column:
    """Cosine under one of the zero rules.

    none: NULL for a zero vector; add: 1e-12 added to the product of norms; clamp:
    that product at least 1e-8.
    """
    den = norm(a) * norm(b)
    den = {"none": F.when(den > 0, den), "add": den + 1e-12, "clamp": F.greatest(den, F.lit(1e-8))}[rule]
    return F.try_divide(dot(a, b), den)


def distance(a: Column, b: Column) -> Column:
    return norm(subtract(a, b))


def mean_square(a: Column) -> Column:
    return F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x), F.size(a))


def mean_vector(df: DataFrame, keys: list[str], vector: str, name: str = "mean") -> DataFrame:
    """The mean vector of each group, dimension by dimension, so that no task holds a group."""
    each = df.select(*keys, F.posexplode(vector).alias("_i", "_v")).groupBy(*keys, "_i").agg(F.avg("_v").alias("_v"))
    return each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_v"))), lambda x: x["_v"]).alias(name))
