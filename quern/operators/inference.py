"""Tests of correlations, regressions with group effects, thresholds and cross-validation.

What is enumerated needs one small group together and runs as a grouped pandas function;
everything else is grouped sums, or draws dealt over tasks, over groups of any size.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.correlation import kish, paired, pearson, weighted_pearson
from quern.functions.numeric import clip, finite, t_p, t_tail
from quern.functions.permute import mix, mix_numpy, permuted, permuted_numpy
from quern.sources.files import kept

from . import fits
from .guards import null_safe_join
from .ordering import Ordered, average_ranks

MOST_EXACT = 9


def _r(x: np.ndarray, y: np.ndarray) -> float:
    x, y = x - x.mean(), y - y.mean()
    d = math.sqrt(float(x @ x) * float(y @ y))
    return float(x @ y) / d if d > 1e-300 else float("nan")


def _kinds(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def _points(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    a, b = paired(F.col(x), F.col(y))
    return df.select(*keys, a.alias("_x"), b.alias("_y")).where("_x IS NOT NULL")


def permutation_exact(df: DataFrame, keys: list[str], x: str, y: str, tol: float = 1e-12) -> DataFrame:
    """(keys, n, r, p_two, p_one): over all orders of y; NULL p beyond MOST_EXACT points, which are never gathered, or without variance."""

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_x", "_y"])
        a, b = pdf["_x"].to_numpy(), pdf["_y"].to_numpy()
        r = _r(a, b) if len(a) > 1 else float("nan")
        two = one = None
        if 3 <= len(a) <= MOST_EXACT and not math.isnan(r):
            orders = np.array(list(itertools.permutations(range(len(b)))))
            c = a - a.mean()
            all_r = (b - b.mean())[orders] @ c / math.sqrt(float(c @ c) * float(((b - b.mean()) ** 2).sum()))
            two, one = float((np.abs(all_r) >= abs(r) - tol).mean()), float((all_r >= r - tol).mean())
        return pd.DataFrame([[*pdf[keys].iloc[0], len(a), None if math.isnan(r) else r, two, one]], columns=[*keys, "n", "r", "p_two", "p_one"])

    rows = _points(df, keys, x, y)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), pearson(F.col("_x"), F.col("_y")).alias("r"))
    small = rows.join(sizes.where(F.col("n") <= MOST_EXACT).select(*keys), keys, "left_semi")
    tested = small.groupBy(*keys).applyInPandas(test, f"{_kinds(df, keys)}, n long, r double, p_two double, p_one double")
    none = F.lit(None).cast("double")
    large = sizes.where(F.col("n") > MOST_EXACT).select(*keys, "n", "r", none.alias("p_two"), none.alias("p_one"))
    return tested.union(large)


#: Points of a group that a task holds to draw orders of them (two arrays of doubles); larger groups are permuted by joins.
HELD = 1 << 24
#: Draws times points of a task, and draws that a join permutes at once.
TASK, JOINED = 20_000_000, 64


def permutation_sampled(df: DataFrame, keys: list[str], x: str, y: str, draws: int = 10_000, seed: int = 0) -> DataFrame:
    """(keys, n, r, p): two-sided, from seeded random orders of y; the observed order counts once.

    The points of a group are numbered by (x, y). Draw d pairs the x of point i with the y
    of point ``permuted(i)``, a permutation keyed by seed and draw. A group's draws are
    dealt over tasks, each of which holds the group's points; a group of more than
    ``HELD`` points is never held: its draws are joins on the permuted number. Both give
    the same permutations, and hits are added up by group.
    """
    none = F.lit(None).cast("double")
    a, b = paired(F.col(x), F.col(y))
    points = df.select(*keys, a.alias("_x"), b.alias("_y")).where("_x IS NOT NULL")
    placed = Ordered(points, keys, ["_x", "_y"]).places()
    rows = kept(placed.select(*keys, "_x", "_y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ties") - 1)).alias("_of"), "before").select(*keys, "_x", "_y", (F.col("before") + F.col("_of")).alias("_i")), "points")
    moments = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), pearson(F.col("_x"), F.col("_y")).alias("r"), F.avg("_x").alias("_mx"), F.avg("_y").alias("_my"),
        F.sqrt(F.var_pop("_x") * F.var_pop("_y")).alias("_s"),
    )
    moments = kept(moments, "moments")
    tested = moments.where((F.col("n") >= 3) & F.col("r").isNotNull())
    # deviations, scaled so that their product's sum is r
    scaled = null_safe_join(rows, tested, keys).select(*keys, "n", "r", "_i", ((F.col("_x") - F.col("_mx")) / (F.col("_s") * F.col("n"))).alias("_a"), (F.col("_y") - F.col("_my")).alias("_b"))
    hits = _held_draws(scaled.where(F.col("n") <= HELD), keys, draws, seed)
    if not tested.where(F.col("n") > HELD).isEmpty():
        hits = hits.unionByName(_joined_draws(scaled.where(F.col("n") > HELD), keys, draws, seed))
    counted = hits.groupBy(*keys).agg(F.sum("hits").alias("hits"))
    return null_safe_join(moments.select(*keys, "n", "r"), counted, keys, "left").select(*keys, "n", "r", F.coalesce((F.col("hits") + 1) / (draws + 1), none).alias("p"))


def _held_draws(scaled: DataFrame, keys: list[str], draws: int, seed: int) -> DataFrame:
    """(keys, hits) of parts of the draws, each part a task that holds the group."""
    parts = F.least(F.lit(draws), F.ceil(F.col("n") * F.lit(draws) / TASK)).cast("int")
    dealt = scaled.select("*", parts.alias("_parts"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part"))

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(pdf["_i"].to_numpy())
        a, b = pdf["_a"].to_numpy()[order], pdf["_b"].to_numpy()[order]
        n, r, part, parts = len(a), pdf["r"].iloc[0], int(pdf["_part"].iloc[0]), int(pdf["_parts"].iloc[0])
        mine, hits, block = np.arange(part, draws, parts), 0, max(1, 1_000_000 // n)
        for lo in range(0, len(mine), block):
            at = permuted_numpy(n, str(seed), mix_numpy(mine[lo : lo + block]))
            hits += int((np.abs(b[at] @ a) >= abs(r) - 1e-12).sum())
        return pd.DataFrame([[*pdf[keys].iloc[0], hits]], columns=[*keys, "hits"])

    return dealt.groupBy(*keys, "_part").applyInPandas(test, ", ".join(filter(None, [_kinds(scaled, keys), "hits long"])))


def _joined_draws(scaled: DataFrame, keys: list[str], draws: int, seed: int) -> DataFrame:
    """(keys, hits) of ranges of draws, each range a join of points on their permuted numbers."""
    out = None
    for lo in range(0, draws, JOINED):
        drawn = scaled.select(*keys, "n", "r", "_i", "_a", F.explode(F.sequence(F.lit(lo), F.lit(min(lo + JOINED, draws) - 1))).alias("_draw"))
        drawn = drawn.withColumn("_i", permuted(F.col("_i"), F.col("n"), str(seed), mix(F.col("_draw").cast("long"))))
        sums = null_safe_join(drawn, scaled.select(*keys, "_i", "_b"), [*keys, "_i"]).groupBy(*keys, "_draw", "r").agg(F.sum(F.col("_a") * F.col("_b")).alias("_r"))
        hits = kept(sums.groupBy(*keys).agg(F.count_if(F.abs("_r") >= F.abs("r") - 1e-12).alias("hits")), "hits")
        out = hits if out is None else out.unionByName(hits)
    return out


def ols_hc3(df: DataFrame, y: str, group: str, specs: dict[str, list[str]]) -> DataFrame:
    """(spec, term, coef, se_hc3, t_hc3, p_hc3, n, r2, adj_r2, aic, bic): fixed effects of ``group`` plus each specification's predictors.

    Effects are taken out by demeaning within groups, of which there may be any number:
    slopes and residuals are those of a regression on group dummies, and so are leverages
    with 1 / n of the group added. One aggregate gives the cross products of all
    predictors, a second the weighted residuals of all specifications; only their small
    matrices are solved. A specification without predictors is one row without term. A
    group of one row fits itself and adds nothing to the errors.
    """
    names = sorted({p for ps in specs.values() for p in ps})
    rows = df.select(F.col(group).alias("_g"), finite(F.col(y)).alias("_y"), *[finite(F.col(n)).alias(n) for n in names]).dropna()
    wide = [*names, "_y"]
    means = rows.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"), *[F.avg(c).alias(f"_m{i}") for i, c in enumerate(wide)])
    base = rows.join(means, "_g").select("_n", F.col("_y").alias("_raw"), *[(F.col(c) - F.col(f"_m{i}")).alias(c) for i, c in enumerate(wide)])
    upper = [(i, j) for i in range(len(wide)) for j in range(i, len(wide))]
    sums = base.agg(
        F.count(F.lit(1)).alias("n"), F.sum(1 / F.col("_n")).alias("groups"), F.var_pop("_raw").alias("v"),
        *[F.sum(F.col(wide[i]) * F.col(wide[j])).alias(f"s{i}_{j}") for i, j in upper],
    ).first()
    schema = "spec string, term string, coef double, se_hc3 double, t_hc3 double, p_hc3 double, n long, r2 double, adj_r2 double, aic double, bic double"
    n = sums["n"]
    if not n:
        return df.sparkSession.createDataFrame([], schema)
    full = np.zeros((len(wide), len(wide)))
    for i, j in upper:
        full[i, j] = full[j, i] = sums[f"s{i}_{j}"]
    fits, wanted = {}, []
    for s, (spec, ps) in enumerate(specs.items()):
        at = [names.index(p) for p in ps]
        inv = np.linalg.pinv(full[np.ix_(at, at)]) if at else np.zeros((0, 0))
        beta = inv @ full[at, -1]
        fits[spec] = ps, inv, beta
        resid = F.col("_y") - sum((F.col(c) * float(b) for c, b in zip(ps, beta, strict=True)), F.lit(0.0))
        lever = sum((F.col(a) * F.col(b) * float(inv[i, j]) for i, a in enumerate(ps) for j, b in enumerate(ps)), 1 / F.col("_n"))
        w = F.when(F.col("_n") > 1, F.try_divide(resid, 1 - lever)) ** 2
        wanted += [F.sum(resid * resid).alias(f"ssr{s}"), *[F.sum(w * F.col(a) * F.col(b)).alias(f"m{s}_{i}_{j}") for i, a in enumerate(ps) for j, b in enumerate(ps) if j >= i]]
    got = base.agg(*wanted).first()
    out = []
    for s, (spec, (ps, inv, beta)) in enumerate(fits.items()):
        k, ssr, sst = len(ps) + round(sums["groups"]), got[f"ssr{s}"], sums["v"] * n
        r2 = 1 - ssr / sst if sst > 0 else None
        adj = 1 - (1 - r2) * (n - 1) / (n - k) if r2 is not None and n > k else None
        loglik = -n / 2 * (math.log(2 * math.pi) + math.log(ssr / n) + 1) if ssr > 0 else None
        aic, bic = (None, None) if loglik is None else (2 * k - 2 * loglik, k * math.log(n) - 2 * loglik)
        meat = np.array([[got[f"m{s}_{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(len(ps))] for i in range(len(ps))])
        se = np.sqrt(np.diag(inv @ meat @ inv)) if ps else []
        for c, b, e in zip(ps, beta, se, strict=True):
            t = float(b / e) if e > 0 else None
            out.append((spec, c, float(b), float(e), t, None if t is None else math.erfc(abs(t) / math.sqrt(2)), n, r2, adj, aic, bic))
        if not ps:
            out.append((spec, None, None, None, None, None, n, r2, adj, aic, bic))
    return df.sparkSession.createDataFrame(out, schema)


def threshold_grid(df: DataFrame, keys: list[str], x: str, y: str, weight: str, thresholds: Sequence[float], least: int = 3) -> DataFrame:
    """(threshold, keys, n, r, p, r_weighted, n_eff, p_weighted) of the points whose weight reaches each threshold.

    Every key is there at every threshold; r and p are NULL for under ``least`` points or
    without variance, the weighted p also where the effective number of points is 3 or less.
    """
    every = df.select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y"), finite(F.col(weight)).alias("_w"), F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    a, b = paired(F.when(F.col("_w") >= F.col("threshold"), F.col("_x")), F.col("_y"))
    w = F.when(a.isNotNull() & (F.col("_w") > 0), F.col("_w"))
    g = every.groupBy("threshold", *keys).agg(F.count(a).alias("n"), pearson(a, b, least).alias("r"), weighted_pearson(a, b, w, least).alias("r_weighted"), kish(w).alias("n_eff"))
    p = lambda r, n: t_p(F.col(r), F.col(n))
    return g.select("threshold", *keys, "n", "r", p("r", "n").alias("p"), "r_weighted", "n_eff", F.when(F.col("n_eff") > 3, p("r_weighted", "n_eff")).alias("p_weighted"))


def ranked_thresholds(grid: DataFrame) -> DataFrame:
    """(threshold, n_tests, mean_p): mean over all keys and both kinds of p, those that can't be computed as 1; the smallest first."""
    one = lambda c: F.coalesce(F.col(c), F.lit(1.0))
    return grid.groupBy("threshold").agg((2 * F.count(F.lit(1))).alias("n_tests"), F.avg((one("p") + one("p_weighted")) / 2).alias("mean_p")).orderBy("mean_p", "threshold")


def cross_validated(df: DataFrame, keys: list[str], x: str, y: str, id_col: str, folds: int = 5, curve: str = "logistic") -> DataFrame:
    """(keys, n, folds, logloss, brier, auc) of a ``logistic`` or ``spline`` curve: stratified folds in the order of the ids' digests, as many as the rarer class has rows at most."""
    fit, at = {"logistic": (fits.logistic, fits.logistic_p), "spline": (fits.spline_logistic, fits.spline_p)}[curve]
    rows = df.select(*keys, F.col(id_col).alias("_id"), finite(F.col(x)).alias("_x"), F.col(y).cast("int").alias("_y")).dropna(subset=["_x", "_y"])
    rows = rows.withColumn("_h", F.md5(F.col("_id").cast("string")))
    sizes = rows.groupBy(*keys).agg(F.count_if(F.col("_y") == 0).alias("_n0"), F.count_if(F.col("_y") == 1).alias("_n1"))
    k = F.least(F.lit(folds), F.least("_n0", "_n1")).cast("int")
    dealt = null_safe_join(rows, Ordered(rows, [*keys, "_y"], ["_h", "_id"]).places(), [*keys, "_y", "_h", "_id"])
    dealt = null_safe_join(dealt, sizes.select(*keys, k.alias("folds")).where("folds >= 2"), keys)
    dealt = kept(dealt.select(*keys, "_x", "_y", "folds", (F.col("before") % F.col("folds")).cast("int").alias("_fold")), "dealt")
    train = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("folds") - 1)).alias("_out")).where("_fold <> _out")
    fitted = fit(train, [*keys, "_out"], "_x", "_y").drop("n", "n_pos").withColumnRenamed("_out", "_fold")
    held = kept(null_safe_join(dealt, fitted, [*keys, "_fold"]).select(*keys, "_y", "folds", clip(at(F.col("_x")), 1e-6, 1 - 1e-6).alias("_p")), "held")
    y1 = F.col("_y") == 1
    loss = -F.avg(F.when(y1, F.log("_p")).otherwise(F.log(1 - F.col("_p"))))
    n1, n0 = F.count_if(y1), F.count_if(~y1)
    auc = F.try_divide(F.sum(F.when(y1, F.col("_rank"))) - n1 * (n1 + 1) / 2, (n1 * n0).cast("double"))
    return average_ranks(held, keys, "_p", "_rank").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("folds").alias("folds"), loss.alias("logloss"), F.avg((F.col("_y") - F.col("_p")) ** 2).alias("brier"), auc.alias("auc"))


def partial_p(r: float | None, n: int | None, controls: int = 1) -> float | None:
    """Two-sided p of a partial correlation with n - 2 - controls degrees of freedom."""
    if r is None or n is None or n - 2 - controls <= 0:
        return None
    df = n - 2 - controls
    return t_tail(r * math.sqrt(df / max(1e-12, 1 - r * r)), df)


def residual_of(x: Column, z: Column, w: Window) -> Column:
    """x less its regression on z over a window."""
    slope = F.try_divide(F.covar_pop(x, z).over(w), F.nullif(F.var_pop(z).over(w), F.lit(0.0)))
    return x - F.avg(x).over(w) - F.coalesce(slope, F.lit(0.0)) * (z - F.avg(z).over(w))
