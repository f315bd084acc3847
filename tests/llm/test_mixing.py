import math

import numpy as np

from quern.llm import mixing as M
from quern.llm.common import Scratch


def docs(spark, sizes, words=10):
    rows, i = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((i, " ".join(["w"] * (words + i % 3)), s))
            i += 1
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def totals(spark, n):
    return spark.createDataFrame([(k, v) for k, v in n.items()], "source string, n long")


def test_entropy_target_is_met(spark):
    n = {"a": 8000, "b": 1500, "c": 500}
    got = {r.source: r for r in M.weights(totals(spark, n), way=0.4, epochs=1e9).collect()}
    p = np.array([v / 10000 for v in n.values()])
    h = lambda w: -sum(x * math.log(x) for x in w)
    assert abs(h([got[k].weight for k in n]) - (0.6 * h(p) + 0.4 * math.log(3))) < 1e-6
    assert abs(sum(r.weight for r in got.values()) - 1) < 1e-9


def test_repetition_limit_holds(spark):
    n = {"a": 100_000, "b": 100}
    got = {r.source: r for r in M.weights(totals(spark, n), way=1.0, epochs=3.0).collect()}
    assert abs(got["b"].target / 100 - 3.0) < 0.02 and got["b"].full in (2, 3)


def test_copies_meet_the_budget(spark):
    d = docs(spark, {"a": 400, "b": 60, "c": 20})
    p = M.plan(d, Scratch(spark, "t"), way=1.0, epochs=50.0)
    w = {r.source: r for r in M.weights(d.groupBy("source").agg(M.F.sum(M.n_tokens(M.F.col("text"))).alias("n")), way=1.0, epochs=50.0).collect()}
    rows = M.copies(d, p).withColumn("tokens", M.n_tokens(M.F.col("text"))).collect()
    for s, plan in w.items():
        spent = sum(r.copies * r.tokens for r in rows if r.source == s)
        assert plan.target - 12 <= spent <= plan.target
        assert {r.copies for r in rows if r.source == s} <= {plan.full, plan.full + 1}


def test_pipeline_mix_keeps_every_document(spark):
    d = docs(spark, {"a": 300, "b": 30, None: 5, "": 5})
    got = [r.doc_id for r in M.realise(spark, d).collect()]
    assert set(got) == set(range(340)) and len(got) > 340
    assert max(got.count(i) for i in range(340)) <= math.ceil(M.PIPELINE_EPOCHS)
