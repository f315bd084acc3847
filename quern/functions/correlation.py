"""Correlations as closed-form aggregates: NULL for too few points or no variance.

Sums run over pairwise finite points only, combine map-side, and never raise.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from .numeric import finite


def paired(x: Column, y: Column) -> tuple[Column, Column]:
    """x and y, both NULL unless both are finite."""
    a, b = finite(x), finite(y)
    both = a.isNotNull() & b.isNotNull()
    return F.when(both, a), F.when(both, b)


def from_moments(n: Column, cxy: Column, vx: Column, vy: Column, least: int) -> Column:
    """r from covariance and variances; clamped, NULL where undefined."""
    den = F.sqrt(F.greatest(F.lit(0.0), vx)) * F.sqrt(F.greatest(F.lit(0.0), vy))
    r = F.try_divide(cxy, F.when(den > 1e-300, den))
    return F.when((n >= least) & r.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(-1.0), r)))


def _variance(a: Column, w: Window | None = None) -> Column:
    """Population variance, exactly 0 where all values agree."""
    over = (lambda e: e) if w is None else (lambda e: e.over(w))
    return F.when(over(F.min(a)) < over(F.max(a)), over(F.var_pop(a))).otherwise(0.0)


def pearson(x: Column, y: Column, least: int = 2) -> Column:
    """Aggregate: Pearson's r over finite pairs."""
    a, b = paired(x, y)
    return from_moments(F.count(a), F.covar_pop(a, b), _variance(a), _variance(b), least)


def pearson_over(x: Column, y: Column, w: Window, least: int = 2) -> Column:
    """Pearson's r over a window."""
    a, b = paired(x, y)
    return from_moments(F.count(a).over(w), F.covar_pop(a, b).over(w), _variance(a, w), _variance(b, w), least)


def weighted_pearson(x: Column, y: Column, weight: Column, least: int = 2) -> Column:
    """Aggregate: Pearson's r with weights; points with weight 0 or below don't count."""
    a, b = paired(x, y)
    w = finite(weight)
    ok = a.isNotNull() & (w > 0)
    a, b, w = F.when(ok, a), F.when(ok, b), F.when(ok, w)
    total = F.sum(w)
    mx, my = F.try_divide(F.sum(w * a), total), F.try_divide(F.sum(w * b), total)
    cov = F.try_divide(F.sum(w * a * b), total) - mx * my
    vx = F.when(F.min(a) < F.max(a), F.try_divide(F.sum(w * a * a), total) - mx * mx).otherwise(0.0)
    vy = F.when(F.min(b) < F.max(b), F.try_divide(F.sum(w * b * b), total) - my * my).otherwise(0.0)
    return from_moments(F.count(w), cov, vx, vy, least)


def kish(weight: Column) -> Column:
    """Aggregate: Kish's effective sample size."""
    return F.try_divide(F.sum(weight) * F.sum(weight), F.sum(weight * weight))


def partial(rxy: Column, rxz: Column, ryz: Column) -> Column:
    """First-order partial correlation from three pairwise ones."""
    den = F.sqrt(F.greatest(F.lit(0.0), (1 - rxz * rxz) * (1 - ryz * ryz)))
    return F.try_divide(rxy - rxz * ryz, F.when(den > 1e-12, den))
