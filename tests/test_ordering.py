"""Ranks and order statistics of groups of any size against pandas and NumPy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quern.operators import ordering as O


@pytest.fixture(scope="module")
def rows(spark):
    """A hot group with nearly all rows, one of ties, one of a single row, and a NULL key."""
    rng = np.random.default_rng(5)
    data = [("hot", float(x), float(y)) for x, y in zip(rng.normal(size=4000), rng.integers(0, 50, 4000), strict=True)]
    data += [("ties", float(i % 3), float(i)) for i in range(30)] + [("one", 7.0, 1.0)] + [(None, float(i * i % 11), float(i)) for i in range(25)]
    pdf = pd.DataFrame(data, columns=["g", "x", "y"])
    pdf["id"] = range(len(pdf))
    bad = [("hot", float("nan"), 1.0, -1), ("hot", None, 1.0, -2), ("ties", float("inf"), 1.0, -3)]
    return pdf, spark.createDataFrame([*pdf[["g", "x", "y", "id"]].itertuples(index=False, name=None), *bad], "g string, x double, y double, id long")


def test_a_hot_group_lies_in_all_ranges(rows):
    ordered = O.Ordered(rows[1].where("g = 'hot' AND x IS NOT NULL AND NOT isnan(x)"), ["g"], ["x"])
    sizes = [r["n"] for r in ordered.counts.groupBy("_range").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * 4000 / 4
    # no window of the plan is over the group alone
    plan = ordered.places()._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_range" in line or "_held" in line for line in windows)


def test_average_ranks(rows):
    pdf, df = rows
    want = dict(zip(pdf.id, pdf.groupby("g", dropna=False).x.rank(), strict=True))
    got = {r.id: r.rk for r in O.average_ranks(df, ["g"], "x", "rk").collect()}
    assert got == {**want, -1: None, -2: None, -3: None}


def test_quantiles_and_medians(rows):
    pdf, df = rows
    groups = {k if isinstance(k, str) else None: g.x.to_numpy() for k, g in pdf.groupby("g", dropna=False)}
    for r in O.quantiles(df, ["g"], "x", {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.933, "e": 1.0}).collect():
        assert np.allclose([r.a, r.b, r.c, r.d, r.e], np.quantile(groups[r.g], [0, 0.1, 0.5, 0.933, 1]), rtol=0, atol=1e-12)
    got = {r.g: (r.lower, r.upper, r.total) for r in O.medians(df, ["g"], "x").collect()}
    assert got == {k: (sorted(v)[(len(v) - 1) // 2], sorted(v)[len(v) // 2], len(v)) for k, v in groups.items()}


@pytest.mark.parametrize("k", [1, 5, 7, 40])
def test_equal_count_bins(rows, k):
    pdf, _ = rows
    df = rows[1].where("id >= 0")
    got = {r.id: r.bin for r in O.equal_count_bins(df, ["g"], ["x", "id"], k).collect()}
    for _, g in pdf.groupby("g", dropna=False):
        parts = np.array_split(g.sort_values(["x", "id"]).id.to_numpy(), k)
        assert all(got[i] == b + 1 for b, part in enumerate(parts) for i in part)


def test_spearman(rows):
    pdf, df = rows
    got = {r.g: (r.n, r.spearman) for r in O.spearman(df, "x", "y", ["g"]).collect()}
    for k, g in pdf.groupby("g", dropna=False):
        n, s = got[k if isinstance(k, str) else None]
        assert n == len(g)
        assert s is None if n == 1 else abs(s - g.x.rank().corr(g.y.rank())) < 1e-12


def test_no_rows_and_no_keys(spark):
    none = spark.createDataFrame([], "g string, x double, y double")
    assert O.average_ranks(none, ["g"], "x").count() == O.medians(none, ["g"], "x").count() == O.spearman(none, "x", "y", ["g"]).count() == 0
    some = spark.createDataFrame([(x,) for x in (3.0, 1.0, 2.0, 2.0)], "x double")
    assert sorted((r.x, r["rank"]) for r in O.average_ranks(some, [], "x").collect()) == [(1.0, 1.0), (2.0, 2.5), (2.0, 2.5), (3.0, 4.0)]
    assert O.quantiles(some, [], "x", {"m": 0.5}).first().m == 2.0
