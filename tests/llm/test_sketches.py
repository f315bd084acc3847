import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from quern.llm import sketches as K
from quern.llm.common import Scratch

from .helpers import edge_docs, edge_rows, sentence


def items(t):
    return {p.strip(" ") for p in re.findall(r"[^\n.!?]{1,160}[.!?]*|[.!?]+", t)}


def like(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, (r[1] or "").encode()))
    out = []
    for i, r in enumerate(order):
        t, n = r[1] or "", order[(i + 1) % len(order)][1] or ""
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        out.append((str(r[0]), len(t), hashlib.sha256(e.encode()).hexdigest(), round(like(items(t), items(e)), 9), round(like(items(t), items(n)), 9)))
    return sorted(out)


def got(spark, df):
    return sorted((str(r.doc_id), r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in K.compared(df, Scratch(spark, "t")).collect())


def test_edges_against_brute_force(spark):
    assert got(spark, edge_docs(spark)) == brute(edge_rows())


def test_sparse_and_negative_ids_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(K, "IN_BLOCK", 4)
    rng = np.random.default_rng(0)
    rows = [(int(i), "\n".join(sentence(int(k)) for k in rng.integers(0, 60, 5))) for i in rng.integers(-(2**60), 2**60, 70)] + [(i, sentence(i)) for i in range(30)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(spark, d) == brute(rows)


def test_two_levels_of_quantiles(spark, monkeypatch):
    monkeypatch.setattr(K, "IN_BLOCK", 2)
    monkeypatch.setattr(K, "QUANTILES", 8)
    rows = [(i, f"{sentence(i % 9)}.{i % 4}") for i in range(60)] + [(None, "none")]
    assert got(spark, spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_an_outlier_leaves_blocks_even(spark):
    d = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")).union(spark.sql("SELECT 1152921504606846976L, 't'"))
    sizes = [r["count"] for r in K.in_blocks(d).groupBy("block").count().collect()]
    assert sum(sizes) == 20_001 and max(sizes) < 1.5 * K.IN_BLOCK


def pairs_of(spark, rows):
    """Rows (uid, a, b) as a frame, and their pair."""
    df = spark.createDataFrame(rows, "uid long, a array<long>, b array<long>").withColumn("s", K.subtracted(K.sketch(F.col("a")), K.sketch(F.col("b"))))
    return df, F.array(K.pair(0, F.col("s"), F.col("a"), F.col("b")))


def test_peeling_recovers_both_sides(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for uid, (na, nb, both) in enumerate([(0, 0, 5), (1, 0, 0), (300, 250, 500), (40, 0, 0), (3, 3, 2000), (1, 1, 50)]):
        x = [int(v) for v in rng.integers(-(2**62), 2**62, na + nb + both)]
        a, b, c = x[:na], x[na : na + nb], x[na + nb :]
        rows.append((uid, a + c, b + c))
        want[uid] = (sorted(a), sorted(b))
    df, pairs = pairs_of(spark, rows)
    found = {r.uid: (r.only_a, r.only_b) for r in K.differences(df, pairs, Scratch(spark, "t")).collect()}
    assert {k: found.get(k, ([], [])) for k in want} == want


def test_small_differences_are_peeled_from_the_fingerprints(spark):
    df, _ = pairs_of(spark, [(1, list(range(500)), [*range(1, 500), -7])])
    empty = F.array().cast("array<bigint>")
    assert df.first().s["size"] == K.BASE
    r = K._attempt(df, F.array(K.pair(0, F.col("s"), empty, empty))).first()
    assert r.ok and (r.only_a, r.only_b) == ([0], [-7])


def test_a_wrong_estimate_is_retried(spark):
    """Digests chosen so that every cell's counts cancel: the estimate is 0, the first attempt fails, a larger one peels."""
    pool = spark.range(100_000).select("id", F.array(*[F.pmod(F.xxhash64("id", F.lit(10 + j)), F.lit(K.BASE)) for j in range(3)]).alias("at"))
    same = pool.groupBy("at").agg(F.slice(F.collect_list("id"), 1, 60).alias("ids")).orderBy("at").first().ids
    a, b = sorted(same[:30]), sorted(same[30:60])
    df, pairs = pairs_of(spark, [(1, a, b)])
    assert df.first().s["size"] == K.BASE and not K._attempt(df, pairs).first().ok
    r = K.differences(df, pairs, Scratch(spark, "t")).first()
    assert (r.only_a, r.only_b) == (a, b)


def test_counts_are_not_cut(spark):
    cells = K.sketch(F.sequence(F.lit(0), F.lit(299_999)))
    hexed = spark.range(1).select(K.fingerprint(cells).alias("f")).first().f
    counts = [int(hexed[i : i + 8], 16) for i in range(0, len(hexed), 32)]
    assert len(counts) == 3 * K.BASE and all(sum(counts[j * K.BASE : (j + 1) * K.BASE]) == 300_000 for j in range(3)) and max(counts) > 65_535


def test_equal_texts_equal_fingerprints(spark):
    rows = K.compared(edge_docs(spark), Scratch(spark, "t")).select("doc_id", "fingerprint").collect()
    f = {r.doc_id: r.fingerprint for r in rows}
    assert f[4] == f[5] == f[6] and f[4] != f[7] and f[1] == f[2]
