"""Keyed permutations, samples of products and sampled permutation tests."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quern.functions import permute as P
from quern.operators import inference, sampling

MASK = 2**31 - 1


def plain_mix(v):
    v ^= v >> 15
    v = v * 739982445 & MASK
    v ^= v >> 12
    v = v * 695872825 & MASK
    return v ^ v >> 15


def plain_pair(k, a, b, seed, tweak=0):
    x, y = [k // b, a], [k % b, b]
    for key in P.round_keys(seed):
        x, y = y, [(x[0] + plain_mix(y[0] + key + tweak & MASK)) % x[1], x[1]]
    return x[0], y[0]


def plain_permuted(n, seed, tweak):
    a = int(np.ceil(np.sqrt(n)))
    b, out = -(-n // a), []
    for i in range(n):
        while True:
            left, right = plain_pair(i, a, b, seed, tweak)
            i = left * b + right
            if i < n:
                break
        out.append(i)
    return out


@pytest.mark.parametrize(("a", "b"), [(1, 1), (1, 7), (3, 5), (16, 16), (40, 3)])
def test_pairs_are_all_of_the_product(spark, a, b):
    got = [tuple(r.p) for r in spark.range(a * b).coalesce(1).select(P.pair_at(F.col("id"), a, b, "s").alias("p")).collect()]
    assert got == [plain_pair(k, a, b, "s") for k in range(a * b)]
    assert sorted(got) == [(i, j) for i in range(a) for j in range(b)]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 50, 1000])
def test_permutations_agree(spark, n):
    tweaks = np.array([0, 1, 77, MASK - 1])
    got = P.permuted_numpy(n, "k", tweaks)
    assert all(sorted(row) == list(range(n)) for row in got.tolist())
    assert got.tolist() == [plain_permuted(n, "k", int(t)) for t in tweaks]
    rows = spark.range(n).coalesce(1).select(P.permuted(F.col("id"), n, "k", 77).alias("p")).collect()
    assert [r.p for r in rows] == got[2].tolist()


def test_small_permutations_are_even():
    """All orders of four come about equally often."""
    seen = pd.Series(map(tuple, P.permuted_numpy(4, "e", P.mix_numpy(np.arange(24_000))).tolist())).value_counts()
    assert len(seen) == 24 and seen.between(850, 1150).all()


def test_product_sample(spark):
    a, b = (spark.createDataFrame([(x,) for x in pool], "v string").withColumnRenamed("v", n) for pool, n in ((["x", "y", "z", "x", None], "a"), ("1234", "b")))
    every = sampling.product_sample(a, b, 12, "s").collect()
    assert sorted(r.position for r in every) == list(range(12)) and len({(r.a, r.b) for r in every}) == 12
    for n in (1, 5, 12):
        got = sorted((r.position, r.a, r.b) for r in sampling.product_sample(a, b, n, "s", ("y", "2")).collect())
        assert got[0] == (0, "y", "2") and [p for p, *_ in got] == list(range(n)) and len({x[1:] for x in got}) == n
    odd = sorted((r.position, r.a, r.b) for r in sampling.product_sample(a, b, 13, "s", ("no", "9")).collect())
    assert odd[0] == (0, "no", "9") and len(odd) == 13
    assert sampling.product_sample(a, b, 0, "s", ("y", "2")).count() == 0
    with pytest.raises(ValueError, match="13 pairs"):
        sampling.product_sample(a, b, 13, "s", ("y", "2"))


def test_product_sample_has_no_cross_join(spark):
    big = spark.range(30_000).select(F.col("id").cast("string").alias("a")), spark.range(30_000).select(F.col("id").cast("string").alias("b"))
    got = sampling.product_sample(*big, 400, "s")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert got.distinct().count() == 400


def numbers(n, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=n)
    return x, 0.3 * x + rng.normal(size=n)


@pytest.mark.parametrize("held", [1 << 24, 5])
def test_sampled_permutations_against_plain_ones(spark, monkeypatch, held):
    """The same draws one by one, whether tasks hold a group or join it."""
    monkeypatch.setattr(inference, "HELD", held)
    rows = [(g, float(p), float(q)) for g, n in (("a", 20), (None, 9)) for p, q in zip(*numbers(n, n), strict=True)]
    rows += [("a", float("nan"), 1.0), ("flat", 1.0, 2.0), ("flat", 1.0, 3.0), ("flat", 1.0, 4.0), ("two", 1.0, 1.0), ("two", 2.0, 5.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {r.g: r for r in inference.permutation_sampled(df, ["g"], "x", "y", draws=70, seed=4).collect()}
    for g in ("a", None):
        x, y = (np.array(c) for c in zip(*sorted((p, q) for k, p, q in rows if k == g and p == p), strict=True))
        r = np.corrcoef(x, y)[0, 1]
        every = [np.corrcoef(x, y[plain_permuted(len(x), "4", plain_mix(d))])[0, 1] for d in range(70)]
        assert abs(got[g].r - r) < 1e-12 and got[g].n == len(x)
        assert abs(got[g].p - (sum(abs(e) >= abs(r) - 1e-12 for e in every) + 1) / 71) < 1e-12
    assert got["flat"].r is None and got["flat"].p is None and got["two"].p is None


def test_sampled_permutations_near_numpys(spark):
    x, y = numbers(40, 9)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double").withColumn("g", F.lit(1))
    rng, r = np.random.default_rng(0), np.corrcoef(x, y)[0, 1]
    want = np.mean([abs(np.corrcoef(x, rng.permutation(y))[0, 1]) >= abs(r) for _ in range(20_000)])
    assert abs(inference.permutation_sampled(df, ["g"], "x", "y", 20_000).first().p - want) < 0.01
