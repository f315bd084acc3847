"""Curves against NumPy, at any number of ranges and groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import fits

from . import plain

SCHEMA = "g string, x double, y int"


def made(n, seed, slope):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=n), 2)
    return x, (rng.random(n) < 1 / (1 + np.exp(-slope * x + x**2 / 3))).astype(int)


GROUPS = {"up": made(400, 1, 1.5), "down": made(300, 2, -1.0), None: made(60, 3, 0.5), "three": (np.array([1.0, 2.0, 3.0] * 8), np.array([0, 0, 1] * 7 + [1, 0, 0]))}


@pytest.fixture(scope="module")
def rows(spark):
    data = [(g, float(a), int(b)) for g, (x, y) in GROUPS.items() for a, b in zip(x, y, strict=True)]
    data += [("class", 1.0, 1), ("class", 2.0, 1), ("flat", 1.0, 0), ("flat", 1.0, 1), ("huge", 1.7e308, 1), ("huge", -1.7e308, 0), ("up", float("nan"), 1), ("up", None, 0), ("up", 1.0, None)]
    return spark.createDataFrame(data, SCHEMA)


@pytest.mark.parametrize("most", [fits.MOST_GROUPS, 1])
def test_logistic(rows, monkeypatch, most):
    """Weights on the driver and weights in tables; a group that can't be fitted is NULL and never keeps the others from ending."""
    monkeypatch.setattr(fits, "MOST_GROUPS", most)
    got = {r.g: r for r in fits.logistic(rows, ["g"], "x", "y").collect()}
    assert set(got) == {*GROUPS, "class", "flat", "huge"}
    for g, (x, y) in GROUPS.items():
        w = plain.newton(((x - x.mean()) / x.std())[:, None], y)
        assert np.allclose([got[g].w0, got[g].w1], w, rtol=0, atol=1e-8) and got[g].n == len(x) and got[g].n_pos == y.sum()
    assert all(got[g].w0 is None for g in ("class", "flat", "huge"))


def test_spline(rows):
    f = fits.spline_logistic(rows, ["g"], "x", "y")
    assert {r.g: r.knots for r in f.collect()} == {**dict.fromkeys(GROUPS, 5), "three": 3, "class": 3, "flat": 3, "huge": 3}
    at = np.array([-9.0, -1.3, 0.0, 0.77, 1.0, 3.0, 50.0])
    told = f.select("*", F.explode(F.array(*map(F.lit, at.tolist()))).alias("at")).select("g", "at", fits.spline_p(F.col("at")).alias("p")).collect()
    p = {(r.g, r.at): r.p for r in told}
    for g, (x, y) in GROUPS.items():
        assert np.allclose([p[g, v] for v in at], plain.spline_curve(x, y, at), rtol=0, atol=1e-6)
    assert p["class", 0.0] is p["flat", 0.0] is p["huge", 0.0] is None


def test_steps_are_bounded(rows, monkeypatch):
    monkeypatch.setattr(fits, "MOST_STEPS", 2)
    with pytest.raises(ArithmeticError, match="2 steps"):
        fits.logistic(rows, ["g"], "x", "y")


def falls(n):
    """Outcomes that fall, so that one level covers all ranges; the end is so low that it draws rising levels back."""
    x = np.arange(n, dtype=float)
    y = np.where(x < n * 0.9, x / n, -50.0)
    return x, y


@pytest.mark.parametrize("once", [fits.POOLED_AT_ONCE, 0])
@pytest.mark.parametrize("rising", [True, False, None])
def test_isotonic(spark, monkeypatch, once, rising):
    """A hot group, falling and rising ones, levels over many ranges, whatever is pooled at once."""
    monkeypatch.setattr(fits, "POOLED_AT_ONCE", once)
    rng = np.random.default_rng(7)
    groups = {"hot": (rng.normal(size=3000), None), "tail": falls(400), None: (np.round(rng.normal(size=200), 1), None), "one": (np.array([4.0]), np.array([1.0]))}
    groups = {g: (x, (rng.random(len(x)) < 1 / (1 + np.exp(-x))).astype(float) if y is None else y) for g, (x, y) in groups.items()}
    df = spark.createDataFrame([(g, float(a), float(b)) for g, (x, y) in groups.items() for a, b in zip(x, y, strict=True)] + [("hot", float("nan"), 1.0)], "g string, x double, y double")
    got = fits.isotonic(df, ["g"], "x", "y", rising).collect()
    for g, (x, y) in groups.items():
        up = rising if rising is not None else len(x) < 2 or np.corrcoef(x, y)[0, 1] >= 0
        want = plain.pooled(x.tolist(), y.tolist(), up)
        have = {r.x: r.fitted for r in got if r.g == g}
        assert set(have) == set(want) and all(abs(have[v] - want[v]) < 1e-9 for v in want)
        assert {r.increasing for r in got if r.g == g} == {up}


def test_nothing_to_fit(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert fits.logistic(none, ["g"], "x", "y").count() == fits.spline_logistic(none, ["g"], "x", "y").count() == fits.isotonic(none, ["g"], "x", "y").count() == 0
