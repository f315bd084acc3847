"""Numeric column expressions with one null rule: what can't be computed is NULL, never NaN or an error."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.96


def finite(x: Column) -> Column:
    """x, or NULL for NaN and infinities."""
    x = x.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def rounded(x: Column, places: int = 6) -> Column:
    """x rounded half up; what a small negative number is rounded to keeps its sign, as in SQL engines that round doubles themselves: -0.0."""
    out = F.round(x, places)
    return F.when((out == 0) & (x < 0), F.lit(-0.0)).otherwise(out)


def ratio(num: Column, den: Column, on_empty: float | None = None) -> Column:
    """num / den as double; ``on_empty`` where den is 0 or NULL."""
    out = F.try_divide(num.cast("double"), den.cast("double"))
    return out if on_empty is None else F.coalesce(out, F.lit(float(on_empty)))


def wilson(k: Column, n: Column, upper: bool, z: float = Z95, on_empty: float | None = None) -> Column:
    """A bound of the Wilson score interval, clamped to [0, 1]."""
    k, n = k.cast("double"), n.cast("double")
    p = F.try_divide(k, n)
    den = 1 + F.try_divide(F.lit(z * z), n)
    mid = p + F.try_divide(F.lit(z * z), 2 * n)
    # the root never sees a negative number that rounding made
    half = z * F.sqrt(F.greatest(F.lit(0.0), F.try_divide(p * (1 - p) + F.try_divide(F.lit(z * z), 4 * n), n)))
    out = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (mid + half if upper else mid - half) / den))
    out = F.when(n > 0, out)
    return out if on_empty is None else F.coalesce(out, F.lit(float(on_empty)))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.lit(float(hi)), F.greatest(F.lit(float(lo)), x)))


def fisher_bound(r: Column, n: Column, upper: bool, z: float = Z95) -> Column:
    """A bound of the Fisher-z interval of a correlation; NULL for n < 4 or |r| = 1."""
    sign = 1 if upper else -1
    inside = (n > 3) & (F.abs(r) < 1)
    se = F.try_divide(F.lit(1.0), F.sqrt(F.when(n > 3, (n - 3).cast("double"))))
    return F.when(inside, F.tanh(F.atanh(F.when(F.abs(r) < 1, r)) + sign * z * se))


def p_text(p: Column) -> Column:
    """A p-value for titles."""
    return F.when(p.isNull() | F.isnan(p), "p=nan").when(p == 0, "p<1e-300").when(p < 1e-4, F.format_string("p=%.2e", p)).otherwise(F.format_string("p=%.4f", p))


def ci_text(mid: Column, lo: Column, hi: Column) -> Column:
    return F.format_string("%.3f [%.3f,%.3f]", mid, lo, hi)


# --- scalar helpers for grouped pandas functions and the driver -------------


def _fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's rule."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / ((1 + num * d) or tiny)
            c = (1 + num / c) or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _fraction(a, b, x) / a
    return 1 - front * _fraction(b, a, 1 - x) / b


def t_tail(t: float, df: float, sides: int = 2) -> float:
    """Tail probability of Student's t: of |t| for two sides, of larger values for one."""
    both = incomplete_beta(df / 2, 0.5, df / (df + t * t))
    if sides == 2:
        return both
    return both / 2 if t >= 0 else 1 - both / 2


def correlation_p(r: float | None, n: float | None, sides: int = 2, lost: int = 2) -> float | None:
    """p of a correlation by its t statistic with n - lost degrees of freedom."""
    if r is None or n is None or math.isnan(r) or n - lost <= 0:
        return None
    df = n - lost
    if abs(r) >= 1:
        return 0.0 if sides == 2 or r > 0 else 1.0
    return t_tail(r * math.sqrt(df / (1 - r * r)), df, sides)


def _half_gamma_ratio(a: Column) -> Column:
    """Log of gamma(a + 1/2) over gamma(a): an asymptotic series at a + 32, and the recurrence down to a."""
    z = a + 32.0
    series = 0.5 * F.log(z) - 1 / (8 * z) + 1 / (192 * z**3) - 1 / (640 * z**5) + 17 / (14336 * z**7)
    return F.aggregate(F.sequence(F.lit(0), F.lit(31)), series, lambda s, k: s - F.log1p(0.5 / (a + k)))


def _lentz(a: Column, b: Column, x: Column) -> Column:
    """Continued fraction of the incomplete beta function by Lentz's rule, in as many steps as it takes to settle for a of this size."""
    tiny = 1e-300
    safe = lambda v: F.when(F.abs(v) < tiny, F.lit(tiny)).otherwise(v)

    def half(s: Column, num: Column) -> Column:
        once = F.array(F.struct((1 / safe(1 + num * s["d"])).alias("d"), safe(1 + num / s["c"]).alias("c"), s["h"].alias("h")))
        return F.element_at(F.transform(once, lambda n: F.struct(n["c"].alias("c"), n["d"].alias("d"), (n["h"] * n["c"] * n["d"]).alias("h"))), 1)

    def step(s: Column, m: Column) -> Column:
        m = m.cast("double")
        return half(half(s, m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))

    steps = F.least(F.lit(5000), 60 + F.ceil(5 * F.sqrt(F.greatest(a, b)))).cast("int")
    d = 1 / safe(1 - (a + b) * x / (a + 1))
    return F.aggregate(F.sequence(F.lit(1), steps), F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("h")), step, lambda s: s["h"])


def t_p(r: Column, n: Column, sides: int = 2, lost: int = 2) -> Column:
    """p of a correlation r by its t statistic with n - lost degrees of freedom; NULL for none.

    The tail of Student's t is an incomplete beta function, at 1 - r * r of half the
    degrees of freedom and 1/2. For one side it is the tail of larger correlations.
    """

    def both_sides(v: Column) -> Column:
        a, r2, half = v["a"], v["r"] * v["r"], F.lit(0.5)
        front = F.exp(_half_gamma_ratio(a) - 0.5 * math.log(math.pi) + a * F.log1p(-r2) + 0.5 * F.log(r2))
        low = front * _lentz(a, half, 1 - r2) / a
        high = 1 - front * _lentz(half, a, r2) / half
        p = F.when(r2 == 0, 1.0).when(r2 >= 1, 0.0).when(1 - r2 < (a + 1) / (a + 2.5), low).otherwise(high)
        return p if sides == 2 else F.when(v["r"] >= 0, p / 2).otherwise(1 - p / 2)

    df = n.cast("double") - lost
    r = finite(r)
    once = F.when(r.isNotNull() & (df > 0), F.array(F.struct(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)).alias("r"), (df / 2).alias("a"))))
    return F.element_at(F.transform(once, both_sides), 1)


def fisher_combined(log_sum: Column, k: Column) -> Column:
    """Fisher's combined p from the sum of ln p over k tests: the chi-square tail with 2k degrees of freedom is a finite sum."""
    half = -log_sum
    terms = F.aggregate(F.sequence(F.lit(1), k.cast("int")), F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("all")), lambda s, i: F.struct((s["term"] * half / i).alias("term"), (s["all"] + s["term"]).alias("all")))
    return F.when(k > 0, F.least(F.lit(1.0), F.exp(-half) * terms["all"]))
