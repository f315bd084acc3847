"""Curves of a yes-or-no outcome over x, one for each group: logistic, spline-logistic and isotonic.

Logistic fits are Newton steps over any number of predictors; a step is one grouped sum
of gradient and cross products, so a group may have any number of rows, and one small
system a group is solved. Isotonic fits pool adjacent values inside ranges of x, then
across the ends of neighbouring ranges until none is out of order. Rows whose x is NULL,
NaN or infinite, or whose y is NULL, are left out. Groups may have NULL keys.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import vectors as V
from quern.functions.correlation import pearson
from quern.functions.numeric import clip, finite
from quern.sources.files import kept

from .guards import null_safe_join

#: Groups up to which a step's sums are solved on the driver and its weights broadcast; beyond, both are tables.
MOST_GROUPS = 4096
#: Newton steps that every fit settles in, or it is an error.
MOST_STEPS = 100


def _kinds(df: DataFrame, keys: Sequence[str]) -> list[str]:
    return [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys]


def _logit(features: Sequence[Column], w: Column) -> Column:
    eta = w[0]
    for i, f in enumerate(features):
        eta = eta + w[i + 1] * f
    return 1 / (1 + F.exp(-clip(eta, -500, 500)))


def newton(rows: DataFrame, keys: Sequence[str], features: Sequence[str], y: str, c: float = 1.0, tol: float = 1e-10) -> DataFrame:
    """(keys, w): intercept and weights of the features at the optimum of c times the log loss plus half the weights' square, the intercept left out.

    Newton steps from zero, shortened while far away, until no group moves by ``tol``.
    ``rows`` are read once a step. Every group must have both outcomes.
    """
    spark, keys, m = rows.sparkSession, list(keys), len(features) + 1
    upper = [(i, j) for i in range(m) for j in range(i, m)]
    columns = [F.lit(1.0), *[F.col(f) for f in features]]
    err, q = F.col("_p") - F.col(y), F.col("_p") * (1 - F.col("_p"))
    schema = ", ".join([*_kinds(rows, keys), "_w array<double>", "_moved double"])

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = pdf[keys].copy()
            w = np.stack(pdf["_w"].to_numpy()) if len(pdf) else np.zeros((0, m))
            g, h = c * np.array(pdf["_g"].tolist()).reshape(-1, m), np.zeros((len(pdf), m, m))
            for (i, j), v in zip(upper, np.array(pdf["_h"].tolist()).reshape(-1, len(upper)).T, strict=True):
                h[:, i, j] = h[:, j, i] = c * v
            rest = np.arange(1, m)
            g[:, 1:] += w[:, 1:]
            h[:, rest, rest] += 1
            h[:, 0, 0] += 1e-300
            step = np.linalg.solve(h, g[:, :, None])[:, :, 0]
            far = np.abs(step).max(1) if len(step) else np.zeros(0)
            out["_w"] = list(w - step / np.maximum(1, far)[:, None])
            out["_moved"] = far
            yield out

    groups = kept(rows.select(*keys).distinct(), "groups")
    small = groups.limit(MOST_GROUPS + 1).count() <= MOST_GROUPS
    weights = groups.select(*keys, F.array_repeat(F.lit(0.0), m).alias("_w"))
    for _ in range(MOST_STEPS):
        at = null_safe_join(rows, F.broadcast(weights) if small else weights, keys).withColumn("_p", _logit(columns[1:], F.col("_w")))
        sums = at.groupBy(*keys, "_w").agg(F.array(*[F.sum(err * f) for f in columns]).alias("_g"), F.array(*[F.sum(q * columns[i] * columns[j]) for i, j in upper]).alias("_h"))
        if small:
            pdf = next(solve(iter([sums.toPandas()])))
            weights = spark.createDataFrame([(*k, [float(x) for x in w]) for *k, w in pdf[[*keys, "_w"]].astype(object).where(pdf[[*keys, "_w"]].notna(), None).itertuples(index=False, name=None)], ", ".join([*_kinds(rows, keys), "_w array<double>"]))
            moved = pdf["_moved"].max() if len(pdf) else 0.0
        else:
            solved = kept(sums.mapInPandas(solve, schema), "step")
            weights, moved = solved.drop("_moved"), solved.agg(F.max("_moved")).first()[0] or 0.0
        if moved < tol:
            return weights.withColumnRenamed("_w", "w")
    raise ArithmeticError(f"a fit has not settled after {MOST_STEPS} steps; the last moved a weight by {moved}")


def _usable(df: DataFrame, keys: Sequence[str], x: str, y: str) -> tuple[DataFrame, DataFrame]:
    """Rows (keys, _x, _y), and (keys, n, n_pos, mu, sd, lo, hi, good) of their groups: good has both outcomes and a finite deviation."""
    rows = kept(df.select(*keys, finite(F.col(x)).alias("_x"), F.col(y).cast("double").alias("_y")).dropna(subset=["_x", "_y"]), "rows")
    m = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_y").cast("long").alias("n_pos"), F.avg("_x").alias("mu"), F.stddev_pop("_x").alias("sd"),
        F.min("_x").alias("lo"), F.max("_x").alias("hi"),
    )
    # a sum or a square of huge numbers may leave the range of doubles
    good = (finite(F.col("sd")) > 0) & finite(F.col("mu")).isNotNull() & finite(F.col("hi") - F.col("lo")).isNotNull() & (F.col("n_pos") > 0) & (F.col("n_pos") < F.col("n"))
    return rows, kept(m.withColumn("good", F.coalesce(good, F.lit(False))), "groups")


def logistic(df: DataFrame, keys: Sequence[str], x: str, y: str, c: float = 1.0, tol: float = 1e-10) -> DataFrame:
    """(keys, n, n_pos, mu, sd, w0, w1): per-group logistic fits on standardised x with an L2 penalty 1/C on the slope.

    Groups of one class, without variance, or whose deviation is no finite number have NULLs.
    """
    keys = list(keys)
    rows, groups = _usable(df, keys, x, y)
    good = null_safe_join(rows, groups.where("good").select(*keys, "mu", "sd"), keys).select(*keys, ((F.col("_x") - F.col("mu")) / F.col("sd")).alias("_z"), "_y")
    w = newton(good, keys, ["_z"], "_y", c, tol).select(*keys, F.col("w")[0].alias("w0"), F.col("w")[1].alias("w1"))
    return null_safe_join(groups.select(*keys, "n", "n_pos", "mu", "sd"), w, keys, "left")


def raw_slope(fits: DataFrame) -> DataFrame:
    """Intercept and slope on the scale of x."""
    return fits.withColumn("slope", F.try_divide("w1", "sd")).withColumn("intercept", F.col("w0") - F.try_divide(F.col("w1") * F.col("mu"), F.col("sd")))


def logistic_p(x: Column) -> Column:
    """The fitted probability at x, beside the columns of ``logistic``."""
    return 1 / (1 + F.exp(-clip(F.col("w0") + F.col("w1") * (x - F.col("mu")) / F.col("sd"), -500, 500)))


KNOTS = 5


def _spline_features(x: Column) -> Column:
    """Values at x of the cubic B-splines over evenly spaced knots, and as many beyond as it takes, beside the columns of ``spline_logistic``.

    All splines but the last, as their sum is 1; where there are fewer, 0. Outside of the knots x counts as the nearer end.
    """
    lo, hi, knots = F.col("lo"), F.col("hi"), F.col("knots")
    u = (F.least(F.greatest(x, lo), hi) - lo) / ((hi - lo) / (knots - 1))
    # arrays of one bind a value, so that it is computed once
    at = F.transform(F.array(u), lambda u: F.struct(u.alias("u"), F.least(F.greatest(F.floor(u).cast("int"), F.lit(0)), knots - 2).alias("j")))

    def pieces(at: Column) -> Column:
        four = F.transform(F.array(at["u"] - at["j"]), lambda t: F.array((1 - t) ** 3 / 6, (3 * t**3 - 6 * t**2 + 4) / 6, (-3 * t**3 + 3 * t**2 + 3 * t + 1) / 6, t**3 / 6))
        return F.concat(F.array_repeat(F.lit(0.0), at["j"]), F.element_at(four, 1), F.array_repeat(F.lit(0.0), F.lit(KNOTS)))

    splines = F.element_at(F.transform(at, pieces), 1)
    return F.transform(F.slice(splines, 1, KNOTS + 1), lambda v, i: F.when(i <= knots, v).otherwise(0.0))


def spline_logistic(df: DataFrame, keys: Sequence[str], x: str, y: str, c: float = 1.0) -> DataFrame:
    """(keys, n, n_pos, lo, hi, knots, w): logistic fits on cubic splines of x, five knots evenly between its ends, as many as x has values but three at least."""
    keys = list(keys)
    rows, groups = _usable(df, keys, x, y)
    distinct = rows.groupBy(*keys, "_x").agg(F.lit(1).alias("one")).groupBy(*keys).agg(F.least(F.lit(KNOTS), F.greatest(F.lit(3), F.count(F.lit(1)))).cast("int").alias("knots"))
    groups = null_safe_join(groups, distinct, keys)
    names = [f"_f{i}" for i in range(KNOTS + 1)]
    good = null_safe_join(rows, groups.where("good").select(*keys, "lo", "hi", "knots"), keys)
    good = good.select(*keys, "_y", _spline_features(F.col("_x")).alias("_f"))
    good = kept(good.select(*keys, "_y", *[F.col("_f")[i].alias(n) for i, n in enumerate(names)]), "features")
    return null_safe_join(groups.select(*keys, "n", "n_pos", "lo", "hi", "knots"), newton(good, keys, names, "_y", c), keys, "left")


def spline_p(x: Column) -> Column:
    """The fitted probability at x, beside the columns of ``spline_logistic``."""
    w = F.col("w")
    eta = w[0] + V.dot(_spline_features(x), F.slice(w, 2, KNOTS + 1))
    return F.when(w.isNotNull(), 1 / (1 + F.exp(-clip(eta, -500, 500))))


#: Levels up to which one task pools what is left.
POOLED_AT_ONCE = 100_000


def _pool(pdf: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """Levels (lo, hi, n, s) in which neighbours out of order are merged, group by group; a level keeps the range of its first part."""
    out = []
    for _, g in pdf.groupby(keys, dropna=False, sort=False) if keys else [(None, pdf)]:
        g = g.sort_values("lo")
        levels: list[list] = []
        first: list[int] = []
        for i, (hi, n, s) in enumerate(zip(g["hi"], g["n"], g["s"], strict=True)):
            levels.append([hi, n, s])
            first.append(i)
            # means are compared as products, counts are positive
            while len(levels) > 1 and levels[-2][2] * levels[-1][1] >= levels[-1][2] * levels[-2][1]:
                hi, n, s = levels.pop()
                first.pop()
                levels[-1] = [hi, levels[-1][1] + n, levels[-1][2] + s]
        kept_rows = g.iloc[first].copy()
        kept_rows["hi"], kept_rows["n"], kept_rows["s"] = ([x[i] for x in levels] for i in range(3))
        out.append(kept_rows)
    return pd.concat(out) if out else pdf


def isotonic(df: DataFrame, keys: Sequence[str], x: str, y: str, increasing: bool | None = True) -> DataFrame:
    """(keys, x, fitted, increasing): the monotone curve of least squares at every x of a group.

    ``increasing`` None takes the direction of the group's correlation, rising where it has none.
    """
    spark, keys = df.sparkSession, list(keys)
    rows = df.select(*keys, finite(F.col(x)).alias("_x"), F.col(y).cast("double").alias("_y")).dropna(subset=["_x", "_y"])
    if increasing is None:
        rows = kept(rows, "rows")
        rise = rows.groupBy(*keys).agg(F.coalesce(pearson(F.col("_x"), F.col("_y")) >= 0, F.lit(True)).alias("increasing"))
        rows = null_safe_join(rows, rise, keys)
    else:
        rows = rows.withColumn("increasing", F.lit(increasing))
    sign = F.when(F.col("increasing"), 1.0).otherwise(-1.0)
    sums = rows.groupBy(*keys, "increasing", "_x").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_y") * sign).alias("s"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    points = kept(sums.repartitionByRange(parts, *keys, "_x").withColumn("_range", F.spark_partition_id()), "points")
    schema = ", ".join([*_kinds(df, keys), "_range int, lo double, hi double, n long, s double"])

    def pooled(levels: DataFrame, task: Column) -> DataFrame:
        return kept(levels.withColumn("_task", task).groupBy("_task").applyInPandas(lambda pdf: _pool(pdf.drop(columns="_task"), keys), schema), "levels")

    levels = pooled(points.select(*keys, "_range", F.col("_x").alias("lo"), F.col("_x").alias("hi"), "n", "s"), F.col("_range"))
    over = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_range")
    mean = F.col("s") / F.col("n")
    for turn in range(4 * parts + 4):
        ends = levels.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("held"), F.min_by(mean, "lo").alias("first"), F.max_by(mean, "lo").alias("last"))
        ends = ends.withColumn("wrong", F.coalesce(F.lag("last").over(over) >= F.col("first"), F.lit(False))).groupBy("_range").agg(F.sum("held").alias("held"), F.max("wrong").alias("wrong")).orderBy("_range").collect()
        if not any(r["wrong"] for r in ends):
            break
        # neighbouring ranges in pairs, by turns from the first and from the second; all of them where little is left
        alone = sum(r["held"] for r in ends) <= POOLED_AT_ONCE
        task = {r["_range"]: 0 if alone else (i + turn) // 2 for i, r in enumerate(ends)}
        levels = pooled(levels, F.create_map(*[F.lit(v) for pair in task.items() for v in pair])[F.col("_range")])
    else:
        raise ArithmeticError("levels are still out of order")
    # every x takes the level that begins last before it: in its range, or else in an earlier one
    begun = null_safe_join(points, levels.select(*keys, F.col("lo").alias("_x"), mean.alias("_m")), [*keys, "_x"], "left")
    begun = begun.withColumn("_m", F.last("_m", True).over(Window.partitionBy("_range", *keys).orderBy("_x")))
    carried = begun.groupBy(*keys, "_range").agg(F.max_by("_m", "_x").alias("_c")).withColumn("_c", F.last("_c", True).over(over.rowsBetween(Window.unboundedPreceding, -1)))
    out = null_safe_join(begun, carried, [*keys, "_range"])
    return out.select(*keys, F.col("_x").alias("x"), (F.coalesce("_m", "_c") * sign).alias("fitted"), "increasing")
