"""Best matches against all pairs."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import fuzzy

NAMES = "Anna Berta Carla Dora Emil Fritz Gustav Hanna Ida Jonas Karl Lena Moritz Nora Otto Paula Quirin Rosa Simon Tilda Ulrich Vera Wanda Xaver Yvonne Zoe".split()
PLACES = "Aachen Berlin Chemnitz Dresden Erfurt Frankfurt Gotha Hamburg Ilmenau Jena Kassel Leipzig Mainz Neuss Oldenburg Passau Rostock Schwerin Trier Ulm Weimar".split()


def made(n, seed):
    rng = random.Random(seed)
    return [f"{rng.choice(NAMES)} {rng.choice(PLACES)}er {rng.choice(NAMES)}" for _ in range(n)]


@pytest.mark.parametrize("block", [fuzzy.BLOCK, 40])
def test_best_of_all_pairs(spark, monkeypatch, block):
    """A hot key, a NULL key, keys on one side only, repeated strings, empty ones and NULLs; whatever the blocks."""
    monkeypatch.setattr(fuzzy, "BLOCK", block)
    a = [("hot", s) for s in made(200, 1) + ["", "x"]] + [(None, s) for s in made(5, 2)] + [("left", "Anna"), ("hot", None), ("hot", made(200, 1)[0])]
    b = [("hot", s) for s in made(300, 3)] + [(None, "Zoe Ulmer Zoe"), (None, ""), ("right", "Anna"), ("hot", None)]
    x, y = spark.createDataFrame(a, "k string, a string"), spark.createDataFrame(b, "k string, b string")
    got = {(r.k, r.a): r for r in fuzzy.best_matches(x, y, ["k"], "a", "b").collect()}
    pools = {k: sorted({s for q, s in b if q == k and s is not None}) for k, _ in b}
    assert set(got) == {(k, s) for k, s in a if s is not None and k in pools}
    for (k, s), r in got.items():
        score, best = max((SequenceMatcher(None, s, c).ratio(), c) for c in pools[k])
        assert (r.best, r.n_candidates) == (best, len(pools[k])) and abs(r.score - score) < 1e-12
    if block > 40:
        assert sum(r.n_compared for r in got.values()) < 0.1 * sum(r.n_candidates for r in got.values())


def test_bounds(spark):
    words = [*made(12, 5), "", "aab", "baa", "é"]
    pairs = spark.createDataFrame([(p, q) for p in words for q in words], "a string, b string")
    for r in pairs.select("a", "b", T.similarity_bound(F.col("a"), F.col("b")).alias("bound"), T.similarity(F.col("a"), F.col("b")).alias("full"), T.similarity(F.col("a"), F.col("b"), 0.7).alias("some")).collect():
        assert r.bound >= r.full - 1e-12 and r.some == (r.full if r.bound >= 0.7 else None)
        assert abs(fuzzy.Index([r.b]).bounds(r.a)[0] - r.bound) < 1e-12


def test_few_are_compared_and_blocks_spread(spark):
    """Numbered names of the same letters, whose bounds by letters hardly differ; no name is left to one task."""
    rng = random.Random(4)
    pool = [f"Supplier#{i:09d}" for i in rng.sample(range(60_000), 600)]
    asked = [f"Customer#{i:09d}" for i in rng.sample(range(900_000), 40)]
    index = fuzzy.Index(pool)
    for a in asked:
        score, best = max((SequenceMatcher(None, a, c).ratio(), c) for c in pool)
        assert index.best(a)[:2] == (best, score)
    assert sum(index.best(a)[2] for a in asked) <= 10 * len(asked)
    x = spark.createDataFrame([(k, a) for k in range(40) for a in asked[:3]], "k int, a string")
    y = spark.createDataFrame([(k, b) for k in range(40) for b in pool[:3]], "k int, b string")
    found = fuzzy.best_matches(x, y, ["k"], "a", "b")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 120 and plan.count("REPARTITION_BY_NUM") >= 2
