"""Window-like operators: deterministic firsts, heads, numbering and leave-one-out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.files import kept

from .guards import null_safe_join


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int = 1) -> DataFrame:
    """The first n rows of each key in an explicit order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def dedup_first(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per key, the first by ``order``, by a combining aggregate rather than a sort of every group."""
    rest = [c for c in df.columns if c not in keys]
    row = F.min_by(F.struct(*rest), order).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def position(keys: Sequence[str], order: Sequence[Column | str]) -> Column:
    """0-based number within a key."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1


#: Parts, by a hash of the id, of which a category's least numbers are taken to bound its first rows.
PARTS = 1024


def pick_one_each(df: DataFrame, keys: Sequence[str], category: str, id_col: str, order: Sequence[str]) -> DataFrame:
    """(keys, category, id): the first row of each category, the smallest category first, that no category of the same keys before it takes.

    A row may stand in any number of categories. Each category proposes its first row, a
    row accepts the smallest category that proposes, and those turned away propose their
    next, until none is; a row may still go to a smaller category in a later round. As
    there are c categories, no category needs more than its first c rows, and only those
    are moved between tasks. Numbers that are NULL come last. A category whose rows are
    all taken has none.
    """
    keys = list(keys)
    rows, number = df.select(*keys, category, *order, id_col).where(F.col(category).isNotNull()), F.col(order[0])
    lows = kept(rows.groupBy(*keys, category, F.pmod(F.xxhash64(id_col), F.lit(PARTS)).alias("_part")).agg(F.min(order[0]).alias("_low")), "lows")
    c = lows.agg(F.countDistinct(category)).first()[0]
    # the c-th of the parts' least numbers: c rows at least are not above it, so the first c are among those; fewer parts give no bound
    at = F.row_number().over(Window.partitionBy(*keys, category).orderBy("_low"))
    bounds = kept(lows.where("_low IS NOT NULL").withColumn("_at", at).where(F.col("_at") == c).select(*keys, category, F.col("_low").alias("_most")), "bounds")
    near = null_safe_join(rows, bounds, [*keys, category], "left").where(F.col("_most").isNull() | (number <= F.col("_most")))
    by = Window.partitionBy(*keys, category).orderBy(*[F.asc_nulls_last(x) for x in dict.fromkeys([*order, id_col])])
    ranked = near.withColumn("_rank", F.dense_rank().over(by)).where(F.col("_rank") <= c)
    pools = kept(ranked.select(*keys, category, F.col(id_col).alias("_id"), (F.col("_rank") - 1).alias("_at")).distinct(), "pools")
    asks = kept(pools.groupBy(*keys, category).agg(F.min("_at").alias("_at")), "asks")
    while True:
        asked = null_safe_join(asks, pools, [*keys, category, "_at"])
        taken = asked.groupBy(*keys, "_id").agg(F.min(category).alias("_by"))
        answer = kept(null_safe_join(asked, taken, [*keys, "_id"]).withColumn("_refused", F.col(category) != F.col("_by")), "asked")
        if answer.where("_refused").isEmpty():
            return answer.select(*keys, category, F.col("_id").alias(id_col))
        asks = kept(answer.select(*keys, category, (F.col("_at") + F.col("_refused").cast("int")).alias("_at")), "asks")


def demean(x: str, keys: Sequence[str]) -> Column:
    return F.col(x) - F.avg(x).over(Window.partitionBy(*keys))


def order_by_list(x: Column, values: Sequence[str]) -> Column:
    """Sort key of a custom order, unknown values last."""
    out = F.lit(len(values))
    for i, v in reversed(list(enumerate(values))):
        out = F.when(x == v, i).otherwise(out)
    return out


def leave_one_out(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """``r_without``: Pearson's r of each key's other points, from windowed sums less the own terms."""
    from quern.functions.correlation import paired

    a, b = paired(F.col(x), F.col(y))
    w = Window.partitionBy(*keys)
    base = df.withColumn("_a", a).withColumn("_b", b)
    # centred first: sums of small deviations lose no digits
    c = base.withColumn("_a", F.col("_a") - F.avg("_a").over(w)).withColumn("_b", F.col("_b") - F.avg("_b").over(w))
    own = lambda e: F.sum(e).over(w) - F.coalesce(e, F.lit(0.0))
    p, q = F.col("_a"), F.col("_b")
    m = F.count(p).over(w) - p.isNotNull().cast("int")
    sx, sy, sxx, syy, sxy = own(p), own(q), own(p * p), own(q * q), own(p * q)
    vx, vy = sxx - F.try_divide(sx * sx, m), syy - F.try_divide(sy * sy, m)
    den = F.sqrt(F.greatest(F.lit(0.0), vx) * F.greatest(F.lit(0.0), vy))
    r = F.try_divide(sxy - F.try_divide(sx * sy, m), F.when(den > 1e-12, den))
    return c.withColumn("r_without", F.when(m >= 3, r)).drop("_a", "_b")
