"""Seeded samples and splits whose order is a digest of seed and id: the same on every engine and every partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.permute import pair_at

from .guards import require_unique
from .ordering import Ordered


def order_key(seed: str, *cols: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *[c.cast("string") for c in cols]))


def sub_seed(seed: int, relation: str) -> str:
    """A seed of its own for each relation."""
    return f"{seed}:{relation}"


def product_sample(a: DataFrame, b: DataFrame, n: int, seed: str, anchor: tuple[str, str] | None = None) -> DataFrame:
    """n distinct pairs of two one-column token pools in random order, the anchor pair first.

    ``position`` numbers them. The k-th pair is the image of k under a keyed permutation
    of the product's index space, so n pairs cost n, however large the product is, and
    no pair comes twice. An anchor outside the product still comes first. More pairs than
    there are is an error.
    """
    spark, (x, y) = a.sparkSession, (a.columns[0], b.columns[0])
    pools = [Ordered(d.where(F.col(c).isNotNull()).distinct(), [], [c]).places().select(c, F.col("before").alias(at)) for d, c, at in ((a, x, "_l"), (b, y, "_r"))]
    na, nb = (p.count() for p in pools)
    outside = anchor is not None and (pools[0].where(F.col(x) == anchor[0]).isEmpty() or pools[1].where(F.col(y) == anchor[1]).isEmpty())
    if n > na * nb + outside:
        raise ValueError(f"{n} pairs are wanted, the product has {na * nb}")
    if n <= 0 or not na * nb:
        pairs = spark.range(0).select(F.col("id").alias("_k"), F.lit(0).cast("long").alias("_l"), F.lit(0).cast("long").alias("_r"))
    else:
        pairs = spark.range(min(n, na * nb)).select(F.col("id").alias("_k"), F.inline(F.array(pair_at(F.col("id"), na, nb, seed)))).withColumnsRenamed({"l": "_l", "r": "_r"})
    rows = pairs.join(pools[0], "_l").join(pools[1], "_r").select(x, y, F.col("_k").alias("position"))
    if anchor is None or n <= 0:
        return rows
    is_anchor = (F.col(x) == anchor[0]) & (F.col(y) == anchor[1])
    at = rows.where(is_anchor).select("position").first()
    before = F.lit(1) if at is None else (F.col("position") < at["position"]).cast("long")
    first = spark.createDataFrame([(*anchor, 0)], rows.schema)
    return first.unionByName(rows.where(~is_anchor).withColumn("position", F.col("position") + before).where(F.col("position") < n))


def shuffled_prefix(df: DataFrame, keys: Sequence[str], id_col: str, n: int, seed: str) -> DataFrame:
    """The first n of each key in shuffled order; duplicate ids are an error."""
    require_unique(df, [*keys, id_col], "sample")
    return capped(df, keys, id_col, n, seed)


def capped(df: DataFrame, keys: Sequence[str], id_col: str, n: int, seed: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order_key(seed, F.col(id_col)), id_col)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def split_clamped(df: DataFrame, keys: Sequence[str], id_col: str, seed: str, frac: float = 0.75) -> DataFrame:
    """train for floor(frac n), at least 1 and at most n - 1 rows."""
    w = Window.partitionBy(*keys)
    n = F.count(F.lit(1)).over(w)
    cut = F.greatest(F.lit(1), F.least(n - 1, F.floor(n * F.lit(frac))))
    rn = F.row_number().over(w.orderBy(order_key(seed, F.col(id_col)), id_col))
    return df.withColumn("split", F.when(rn <= cut, "train").otherwise("test"))


def split_fallback(df: DataFrame, keys: Sequence[str], id_col: str, seed: str, frac: float = 0.25) -> DataFrame:
    """test for round-half-even(frac n), at least 1; groups of one row are left out."""
    w = Window.partitionBy(*keys)
    n = F.count(F.lit(1)).over(w)
    cut = F.greatest(F.lit(1), F.bround(n * F.lit(frac), 0).cast("int"))
    rn = F.row_number().over(w.orderBy(order_key(seed, F.col(id_col)), id_col))
    return df.withColumn("_n", n).withColumn("split", F.when(rn <= cut, "test").otherwise("train")).where("_n > 1").drop("_n")


def annotation_sample(df: DataFrame, id_col: str, n: int, seed: str, blanks: Sequence[str]) -> DataFrame:
    """n rows in shuffled order with empty columns to fill in."""
    top = df.withColumn("_k", order_key(seed, F.col(id_col))).orderBy("_k", id_col).limit(n)
    return top.drop("_k").select("*", *[F.lit("").alias(b) for b in blanks])
