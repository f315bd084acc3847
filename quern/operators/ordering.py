"""Ranks, positions and order statistics within groups of any size.

A window over a group sorts all its rows in one task. Here rows are first counted by
distinct value, so that ties are placed once; the counts are sorted into ranges over
(keys, value) and written with the number of their range. A row's place is then the
number of its group's rows in earlier ranges, from one small sum for each group and
range, and the number inside its own range, which is one task's share of the table
whatever the sizes of groups. An order statistic reads only the ranges that hold it.

Values that are NULL, NaN or infinite have no place. Groups may have NULL keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.correlation import from_moments, paired
from quern.functions.numeric import finite
from quern.operators.guards import null_safe_join
from quern.sources.files import kept


class Ordered:
    """Rows of groups in the order of some columns, counted by these columns' distinct values; a row counts as often as ``weight`` says."""

    def __init__(self, df: DataFrame, keys: Sequence[str], by: Sequence[str], weight: str | None = None):
        self.keys, self.by = list(keys), list(by)
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        counts = df.groupBy(*self.keys, *self.by).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_k"))
        self.counts = kept(counts.repartitionByRange(n, *self.keys, *self.by).withColumn("_range", F.spark_partition_id()), "ordered")

    def _ranges(self) -> DataFrame:
        """(keys, _range, _held, _earlier, _n): rows of a group in a range, in earlier ranges, and in all."""
        w = Window.partitionBy(*(self.keys or [F.lit(0)]))
        held = self.counts.groupBy(*self.keys, "_range").agg(F.sum("_k").alias("_held"))
        return held.withColumn("_earlier", F.sum("_held").over(w.orderBy("_range")) - F.col("_held")).withColumn("_n", F.sum("_held").over(w))

    def _inside(self, rows: DataFrame) -> DataFrame:
        """``_in``: rows of the group before this value in its range."""
        return rows.withColumn("_in", F.sum("_k").over(Window.partitionBy("_range", *self.keys).orderBy(*self.by)) - F.col("_k"))

    def places(self) -> DataFrame:
        """(keys, by, ties, before, total): how many rows have a value, how many of its group come before it, how many there are."""
        placed = null_safe_join(self._inside(self.counts), self._ranges(), ["_range", *self.keys])
        return placed.select(*self.keys, *self.by, F.col("_k").alias("ties"), (F.col("_earlier") + F.col("_in")).alias("before"), F.col("_n").alias("total"))

    def at(self, ranks: dict[str, Column]) -> DataFrame:
        """(keys, total, names): the first of ``by`` of the row of each rank, counted from 1; a rank is an expression of ``_n``, the rows of a group."""
        wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("_name"), r.cast("long").alias("_rank")) for name, r in ranks.items()])).alias("_w")
        ranges = self._ranges().select("*", wanted).select("*", "_w.*").drop("_w")
        ranges = ranges.where((F.col("_earlier") < F.col("_rank")) & (F.col("_rank") <= F.col("_earlier") + F.col("_held")))
        wanted_in = ranges.groupBy(*self.keys, "_range", "_n").agg(F.collect_list(F.struct("_name", (F.col("_rank") - F.col("_earlier")).alias("_at"))).alias("_wanted"))
        rows = self._inside(null_safe_join(self.counts, wanted_in, ["_range", *self.keys]))
        met = F.filter("_wanted", lambda x: (x["_at"] > F.col("_in")) & (x["_at"] <= F.col("_in") + F.col("_k")))
        hits = rows.withColumn("_met", F.transform(met, lambda x: x["_name"])).where(F.size("_met") > 0)
        value = F.col(self.by[0])
        return hits.groupBy(*self.keys).agg(F.max("_n").alias("total"), *[F.max(F.when(F.array_contains("_met", name), value)).alias(name) for name in ranks])


def quantiles(df: DataFrame, keys: Sequence[str], x: str, qs: dict[str, float]) -> DataFrame:
    """(keys, total, names): exact quantiles, by linear interpolation between the two nearest values."""
    rows = df.select(*keys, finite(F.col(x)).alias("_x")).where("_x IS NOT NULL")
    ranks = {}
    for i, q in enumerate(qs.values()):
        h = (F.col("_n") - 1) * F.lit(float(q))
        ranks |= {f"_lo{i}": F.floor(h) + 1, f"_hi{i}": F.ceil(h) + 1}
    got = Ordered(rows, keys, ["_x"]).at(ranks)

    def between(i: int, q: float) -> Column:
        h = (F.col("total") - 1) * F.lit(float(q))
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        return lo + (hi - lo) * (h - F.floor(h))

    return got.select(*keys, "total", *[between(i, q).alias(name) for i, (name, q) in enumerate(qs.items())])


def medians(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """(keys, total, lower, upper): the middle values of each group."""
    rows = df.select(*keys, finite(F.col(x)).alias("_x")).where("_x IS NOT NULL")
    return Ordered(rows, keys, ["_x"]).at({"lower": F.floor((F.col("_n") + 1) / 2), "upper": F.floor(F.col("_n") / 2) + 1})


def average_ranks(df: DataFrame, keys: Sequence[str], x: str, name: str = "rank") -> DataFrame:
    """``df`` with the rank of x among its group's rows, ties sharing their mean; NULL where x is no finite number."""
    rows = df.withColumn("_x", finite(F.col(x)))
    p = Ordered(rows.where("_x IS NOT NULL"), keys, ["_x"]).places()
    ranks = p.select(*keys, "_x", (F.col("before") + (F.col("ties") + 1) / 2).alias(name))
    return null_safe_join(rows, ranks, [*keys, "_x"], "left").drop("_x")


def equal_count_bins(df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int, name: str = "bin") -> DataFrame:
    """``df`` with the bin, 1 to k, of nearly equal counts by ``order``, the larger bins first.

    ``order`` should tell rows apart: rows that agree in it come into one bin, that of the first of them.
    """
    p = Ordered(df, keys, order).places()
    base, more = F.floor(F.col("total") / k), F.col("total") % k
    wide = more * (base + 1)
    placed = null_safe_join(df, p, [*keys, *order])
    at = F.col("before")
    number = F.when(at < wide, F.floor(at / (base + 1))).otherwise(more + F.floor(F.try_divide(at - wide, base)))
    return placed.withColumn(name, (number + 1).cast("int")).drop("ties", "before", "total")


def spearman(df: DataFrame, x: str, y: str, keys: Sequence[str], least: int = 2) -> DataFrame:
    """(keys, n, spearman): Pearson's r of average ranks over finite pairs.

    Pairs are counted by distinct values first; ranks are centred by their known mean,
    so one weighted sum over the counts gives r.
    """
    a, b = paired(F.col(x), F.col(y))
    keys = list(keys)
    pairs = df.select(*keys, a.alias("_x"), b.alias("_y")).where("_x IS NOT NULL").groupBy(*keys, "_x", "_y").agg(F.count(F.lit(1)).alias("_c"))
    pairs = kept(pairs, "pairs")
    for c in ("_x", "_y"):
        p = Ordered(pairs, keys, [c], weight="_c").places()
        pairs = null_safe_join(pairs, p.select(*keys, c, (F.col("before") + (F.col("ties") + 1) / 2 - (F.col("total") + 1) / 2).alias(f"{c}r")), [*keys, c])
    c, dx, dy = F.col("_c"), F.col("_xr"), F.col("_yr")
    n = F.sum(c)
    return pairs.groupBy(*keys).agg(n.alias("n"), from_moments(n, F.sum(c * dx * dy) / n, F.sum(c * dx * dx) / n, F.sum(c * dy * dy) / n, least).alias("spearman"))
