"""Operators and functions against plain Python and NumPy, with the edge cases of missing and degenerate values."""

import itertools
import json
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import answers as A
from quern.functions import correlation as C
from quern.functions import numeric as N
from quern.functions import text as T
from quern.functions import vectors as V
from quern.operators import fits, guards, inference, linearity, ranking, resolve, sampling
from quern.sources import files, readers, sinks


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


# --- numeric ----------------------------------------------------------------


@settings(max_examples=40, deadline=None)
@given(n=st.integers(1, 500), f=st.floats(0, 1))
def test_t_tail_against_integration(n, f):
    t = 4 * f
    x = np.linspace(0, t, 20001)
    c = math.exp(math.lgamma((n + 1) / 2) - math.lgamma(n / 2)) / math.sqrt(n * math.pi)
    y = c * (1 + x * x / n) ** (-(n + 1) / 2)
    area = float(((y[1:] + y[:-1]) / 2 * np.diff(x)).sum())
    assert abs(N.t_tail(t, n) - (1 - 2 * area)) < 1e-6


def test_wilson_and_ratios(spark):
    rows = spark.createDataFrame([(0, 0), (0, 10), (10, 10), (3, 10), (None, 5)], "k long, n long")
    got = rows.select("k", "n", N.wilson(F.col("k"), F.col("n"), False).alias("lo"), N.wilson(F.col("k"), F.col("n"), True).alias("hi"), N.ratio(F.col("k"), F.col("n")).alias("p"), N.ratio(F.col("k"), F.col("n"), 0).alias("p0")).collect()
    assert got[0].lo is None and got[0].p is None and got[0].p0 == 0
    for r in got[1:4]:
        assert 0 <= r.lo <= r.p <= r.hi <= 1
    assert abs(got[3].lo - 0.1078) < 1e-4 and abs(got[3].hi - 0.6032) < 1e-4


def test_nulls_pass_through_clip_and_correlation(spark):
    assert one(spark, N.clip(F.lit(None).cast("double"), 0, 1).alias("x")).x is None
    pts = spark.createDataFrame([(1.0, 1.0), (float("nan"), 2.0), (2.0, None), (3.0, float("inf")), (2.0, 5.0)], "x double, y double")
    r = pts.agg(C.pearson(F.col("x"), F.col("y")).alias("r"), C.pearson(F.col("x"), F.col("y"), 3).alias("r3"), C.pearson(F.lit(2.0), F.col("y")).alias("c"), C.weighted_pearson(F.col("x"), F.col("y"), F.lit(2.0)).alias("w")).first()
    assert r.r == 1.0 and r.r3 is None and r.c is None and abs(r.w - 1) < 1e-12
    assert pts.limit(0).agg(C.pearson(F.col("x"), F.col("y")).alias("r")).first().r is None


def test_equal_weights_are_no_weights(spark):
    rng = np.random.default_rng(0)
    d = spark.createDataFrame([(float(a), float(b)) for a, b in rng.normal(size=(50, 2))], "x double, y double")
    r = d.agg(C.pearson(F.col("x"), F.col("y")).alias("a"), C.weighted_pearson(F.col("x"), F.col("y"), F.lit(3.0)).alias("b"), C.kish(F.lit(3.0)).alias("n")).first()
    assert abs(r.a - r.b) < 1e-9 and r.n == 50


def test_fisher_combined_two_tests(spark):
    r = one(spark, N.fisher_combined(F.lit(math.log(0.04) + math.log(0.2)), F.lit(2)).alias("p"))
    x = 0.04 * 0.2
    assert abs(r.p - x * (1 - math.log(x))) < 1e-12


# --- tests and fits ---------------------------------------------------------


def points(spark, n=7, seed=0):
    rng = np.random.default_rng(seed)
    return rng.normal(size=n), rng.normal(size=n)


def test_exact_permutation(spark):
    x, y = points(spark)
    d = spark.createDataFrame([("g", float(a), float(b)) for a, b in zip(x, y)] + [("one", 1.0, 1.0)] + [("flat", 1.0, float(i)) for i in range(4)], "g string, x double, y double")
    got = {r.g: r for r in inference.permutation_exact(d, ["g"], "x", "y").collect()}
    r = np.corrcoef(x, y)[0, 1]
    every = [np.corrcoef(x, y[list(p)])[0, 1] for p in itertools.permutations(range(7))]
    assert abs(got["g"].r - r) < 1e-12
    assert abs(got["g"].p_two - np.mean(np.abs(every) >= abs(r) - 1e-12)) < 1e-12 and abs(got["g"].p_one - np.mean(np.array(every) >= r - 1e-12)) < 1e-12
    assert got["one"].p_two is None and got["flat"].p_two is None


def test_sampled_permutation_is_near_the_exact_one(spark):
    x, y = points(spark, seed=3)
    d = spark.createDataFrame([("g", float(a), float(b)) for a, b in zip(x, y)], "g string, x double, y double")
    exact = inference.permutation_exact(d, ["g"], "x", "y").first().p_two
    assert abs(inference.permutation_sampled(d, ["g"], "x", "y", 20000).first().p - exact) < 0.02


def test_ols_hc3(spark):
    rng = np.random.default_rng(1)
    n = 60
    g = np.array(["a", "b", "c"])[np.arange(n) % 3]
    x, z = rng.normal(size=(2, n))
    y = 1 + 2 * x + (g == "b") * 0.5 + rng.normal(size=n) * (1 + np.abs(x))
    d = spark.createDataFrame([(str(a), float(b), float(c), float(e)) for a, b, c, e in zip(g, x, z, y)], "g string, x double, z double, y double")
    got = {(r.spec, r.term): r for r in inference.ols_hc3(d, "y", "g", {"FE": [], "FE + x": ["x"]}).collect()}
    X = np.column_stack([np.ones(n), x, g == "b", g == "c"]).astype(float)
    inv = np.linalg.inv(X.T @ X)
    b = inv @ X.T @ y
    e, h = y - X @ b, np.einsum("ij,jk,ik->i", X, inv, X)
    se = np.sqrt(np.diag(inv @ (X.T * (e / (1 - h)) ** 2) @ X @ inv))
    r = got["FE + x", "x"]
    assert abs(r.coef - b[1]) < 1e-9 and abs(r.se_hc3 - se[1]) < 1e-9
    r2 = 1 - e @ e / ((y - y.mean()) ** 2).sum()
    assert abs(r.r2 - r2) < 1e-9 and abs(r.adj_r2 - (1 - (1 - r2) * (n - 1) / (n - 4))) < 1e-9
    llf = -n / 2 * (math.log(2 * math.pi) + math.log(e @ e / n) + 1)
    assert abs(r.aic - (8 - 2 * llf)) < 1e-6 and abs(r.bic - (4 * math.log(n) - 2 * llf)) < 1e-6


def test_logistic_is_at_the_optimum(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(3, 2, 200)
    y = (rng.random(200) < 1 / (1 + np.exp(-(x - 3)))).astype(int)
    d = spark.createDataFrame([("g", float(a), int(b)) for a, b in zip(x, y)] + [("pure", float(i), 1) for i in range(5)], "g string, x double, y int")
    f = {r.g: r for r in fits.logistic(d, ["g"], "x", "y").collect()}
    z = (x - x.mean()) / x.std()
    p = 1 / (1 + np.exp(-(f["g"].w0 + f["g"].w1 * z)))
    assert abs((p - y).sum()) < 1e-6 and abs(((p - y) * z).sum() + f["g"].w1) < 1e-6
    assert f["pure"].w1 is None and f["pure"].n == 5


def test_cross_validation(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=120)
    y = (rng.random(120) < 1 / (1 + np.exp(-3 * x))).astype(int)
    d = spark.createDataFrame([("g", i, float(a), int(b)) for i, (a, b) in enumerate(zip(x, y))], "g string, id long, x double, y int")
    r = inference.cross_validated(d, ["g"], "x", "y", "id").first()
    assert r.n == 120 and r.folds == 5 and r.auc > 0.8 and 0 < r.brier < 0.25 and r.logloss < 0.69


def test_leave_one_out(spark):
    x, y = points(spark, 9)
    d = spark.createDataFrame([("g", i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "g string, i long, x double, y double")
    for r in ranking.leave_one_out(d, ["g"], "x", "y").collect():
        m = np.arange(9) != r.i
        assert abs(r.r_without - np.corrcoef(x[m], y[m])[0, 1]) < 1e-9


# --- vectors ----------------------------------------------------------------


def test_cosine_rules(spark):
    z, a, b = (F.array(*map(F.lit, v)) for v in ([0.0, 0.0], [3.0, 4.0], [4.0, 3.0]))
    r = one(spark, V.cosine(a, b).alias("x"), V.cosine(z, a).alias("n"), V.cosine(z, a, "add").alias("s"), V.cosine(z, a, "clamp").alias("c"))
    assert abs(r.x - 0.96) < 1e-12 and r.n is None and r.s == 0 and r.c == 0


def test_ridge_and_retrieval(spark):
    rng = np.random.default_rng(0)
    s, w = rng.normal(size=(30, 4)), rng.normal(size=(4, 4))
    o = s @ w + 1
    rows = [("r", i, s[i].tolist(), o[i].tolist(), "train" if i < 22 else "test", f"g{i % 4}") for i in range(30)]
    t = spark.createDataFrame(rows, "relation_key string, id long, s array<double>, o array<double>, split string, gold string")
    x, y = s[:22], o[:22]
    xc, yc = x - x.mean(0), y - y.mean(0)
    primal = np.linalg.solve(xc.T @ xc + 1e-2 * np.eye(4), xc.T @ yc)
    for r in linearity.affine(t, ["relation_key"]).collect():
        assert np.allclose(r.inferred, (s[r.id] - x.mean(0)) @ primal + y.mean(0), atol=1e-6)
    d = np.array(linearity.directions(t, ["relation_key"]).first().direction)
    assert np.allclose(d, (o - s)[:22].mean(0))
    ranks = linearity.ranked(linearity.queries_of(t, ["relation_key"], "gold", "translated"), linearity.prototypes(t, ["relation_key"], "gold"), ["relation_key"], "gold", "euclidean")
    protos = {g: o[[i for i in range(22) if i % 4 == g]].mean(0) for g in range(4)}
    for r in linearity.gold_ranks(ranks, ["relation_key"]).collect():
        order = sorted(range(4), key=lambda g: np.linalg.norm(protos[g] - (s[r.id] + d)))
        assert r.rank == order.index(r.id % 4) + 1 and r.num_candidates == 4


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("block", [linearity.BLOCK, 3])
def test_retrieval_by_blocks(spark, monkeypatch, metric, block):
    """Ties by label, zero vectors last, gold labels that are no candidate, a hot relation and one without candidates; whatever the blocks."""
    monkeypatch.setattr(linearity, "BLOCK", block)
    rng = np.random.default_rng(6)
    vec = lambda: [float(x) for x in rng.integers(-1, 2, 3)]
    queries = [(r, i, f"g{i % 7}", vec()) for r, n in (("hot", 40), (None, 5), ("none", 2)) for i in range(n)]
    candidates = [(r, f"g{j}", vec()) for r, n in (("hot", 6), (None, 9)) for j in range(n)]
    q = spark.createDataFrame(queries, "relation_key string, id long, gold string, inferred array<double>")
    c = spark.createDataFrame(candidates, "relation_key string, gold string, proto array<double>")
    got = {(r.relation_key, r.id): r for r in linearity.ranked(q, c, ["relation_key"], "gold", metric, 4).collect()}

    def score(a, b):
        a, b = np.array(a), np.array(b)
        if metric == "euclidean":
            return -np.sqrt(((a - b) ** 2).sum())
        den = np.sqrt((a**2).sum()) * np.sqrt((b**2).sum())
        return (a @ b) / den if den > 0 else None

    assert set(got) == {(r, i) for r, i, *_ in queries if r != "none"}
    for (rel, i), r in got.items():
        inferred = next(v for a, b, _, v in queries if (a, b) == (rel, i))
        order = sorted(((s is None, -(s or 0), g, s) for a, g, p in candidates if a == rel for s in [score(inferred, p)]))
        labels = [g for _, _, g, _ in order]
        assert r.rank == (labels.index(f"g{i % 7}") + 1 if f"g{i % 7}" in labels else None) and r.num_candidates == len(labels)
        assert [t.label for t in r.top] == labels[:4] and [t.score for t in r.top] == [s if s is None else pytest.approx(s) for *_, s in order[:4]]


def test_retrieval_has_no_row_for_a_pair(spark):
    q = spark.createDataFrame([("r", i, "g1", [1.0, i / 9]) for i in range(50)], "relation_key string, id long, gold string, inferred array<double>")
    c = spark.createDataFrame([("r", f"g{j}", [j / 7, 1.0]) for j in range(50)], "relation_key string, gold string, proto array<double>")
    plan = linearity.ranked(q, c, ["relation_key"], "gold")._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "Window" not in plan


def test_gold_outside_candidates_counts_in_coverage_only(spark):
    ranks = spark.createDataFrame([("r", 1, 1), ("r", 2, None), ("r", 3, 4)], "relation_key string, id long, rank int")
    m = {r.relation_key: r for r in linearity.metrics(ranks, ["relation_key"]).collect()}
    assert m["r"].coverage == pytest.approx(2 / 3) and m["r"].hits1 == 0.5 and m[None].mrr == 0.625


# --- guards, resolving, ranking, sampling -----------------------------------


def test_guards(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    b = spark.createDataFrame([(1, "x"), (None, "n")], "k int, v string")
    with pytest.raises(guards.GuardError, match="duplicate"):
        guards.checked_join(b, a, ["k"])
    with pytest.raises(guards.GuardError, match="no partner"):
        guards.require_covered(a, b, ["k"])
    with pytest.raises(guards.GuardError, match="missing"):
        guards.require_columns(a, ["k", "z"])
    assert guards.checked_join(a, b, ["k"]).count() == 2
    assert guards.null_safe_join(a, b, ["k"]).count() == 3


def test_resolution_rules():
    cols = ["Model Key", "model_key", "answer.text", "answer"]
    assert resolve.exact(cols, ["x", "model_key"]) == "model_key"
    assert resolve.any_case(cols, ["MODEL KEY"]) == "Model Key"
    assert resolve.canonical(cols, ["modelkey"]) == "Model Key"
    assert resolve.scored(cols, ["answer"], (), ["text"]) == "answer.text" and resolve.scored(cols, ["answer"]) == "answer"
    assert resolve.scored(cols, ["zzz"]) is None
    with pytest.raises(KeyError):
        resolve.exact(cols, ["zzz"], required=True)


def test_first_rows_break_ties_by_order(spark):
    d = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (1, 3, "c"), (2, 1, "d")], "k int, v int, n string")
    assert {r.n for r in ranking.first_rows(d, ["k"], [F.desc("v"), "n"]).collect()} == {"a", "d"}
    assert {r.n for r in ranking.dedup_first(d, ["k"], "v").collect()} == {"c", "d"}


def test_splits_have_their_sizes(spark):
    d = spark.createDataFrame([(g, i) for g, n in ((0, 1), (1, 2), (2, 7), (3, 40)) for i in range(n)], "g int, id long")
    size = lambda df, s: {r.g: r.n for r in df.where(F.col("split") == s).groupBy("g").agg(F.count("*").alias("n")).collect()}
    assert size(sampling.split_clamped(d, ["g"], "id", "s"), "train") == {0: 1, 1: 1, 2: 5, 3: 30}
    assert size(sampling.split_fallback(d, ["g"], "id", "s"), "test") == {1: 1, 2: 2, 3: 10}


def test_product_sample_has_the_anchor_first(spark):
    a, b = spark.createDataFrame([("x",), ("y",), ("y",)], "a string"), spark.createDataFrame([("1",), ("2",)], "b string")
    rows = sampling.product_sample(a, b, 3, "s", ("y", "2")).orderBy("position").collect()
    assert (rows[0].a, rows[0].b) == ("y", "2") and len({(r.a, r.b) for r in rows}) == 3


# --- text and labels --------------------------------------------------------


def test_text_functions(spark):
    r = one(
        spark,
        T.normalize_text(F.lit("  “A”’s \n ﬁne—dash ")).alias("norm"), T.tokens(F.lit("Café-42, Ünder")).alias("tok"), T.simplify_for_match(F.lit("A, b'c!")).alias("simple"),
        T.contains_tokens(F.array(), F.array().cast("array<string>")).alias("never"), T.fnv1a_32(F.lit("hello")).alias("fnv"), T.fnv1a_32(F.lit("")).alias("fnv0"),
        T.similarity(F.lit("abcd"), F.lit("bcde")).alias("sim"), T.collision_key(F.lit("Éa-B ß")).alias("key"), T.title_case(F.lit("joHN o'neil")).alias("title"),
        T.json_field(F.lit('x ```json\n{"label": "REFUSAL"} ```'), "label").alias("json"), T.first_nonblank(F.lit(" "), F.lit(None), F.lit("v")).alias("first"),
        T.template_to_question(F.lit("Who? When?")).alias("q"), T.normal_model(F.lit("mistralai/Mistral-7B-Instruct")).alias("model"), T.normal_id(F.lit("7.0")).alias("id"),
    )
    assert r.norm == "\"A\"'s fine-dash" and r.tok == ["cafe", "42", "under"] and r.simple == "a b c" and r.never is False
    assert r.fnv == 0x4F9F2CAB and r.fnv0 == 2166136261 and r.sim == 0.75 and r.key == "eabss" and r.title == "John O'neil"
    assert r.json == "REFUSAL" and r.first == "v" and r.q == "Who?" and r.model == "mistral_7b_instruct" and r.id == "7"


@pytest.mark.parametrize("text,phrase,hit", [("a woman", "men", False), ("two women", "men", False), ("men!", "men", True), ("é men", "É", True), ("a.b", "a.b", True), ("axb", "a.b", False), (r"x \E y", r"\E", True), ("any", " ", False)])
def test_boundaries(spark, text, phrase, hit):
    assert one(spark, T.boundary_match(F.lit(text), F.lit(phrase)).alias("m")).m is hit


CASES = [
    # answer, prompt, gold, relation: first labeler, final labeler, refusal-first labeler
    ("Paris.", "What is the capital of France?", "Paris", "capital", "CORRECT", "CORRECT", "CORRECT"),
    ("I don't know.", "Q?", "Paris", "capital", "REFUSAL", "REFUSAL", "REFUSAL"),
    ("London", "Q?", "Paris", "capital", "HALLUCINATION", "HALLUCINATION", "WRONG"),
    ("", "Q?", "Paris", "capital", "REFUSAL", "REFUSAL", "REFUSAL"),
    ("...", "Q?", "Paris", "capital", "REFUSAL", "REFUSAL", "REFUSAL"),
    ("Sure, here is the answer: Paris", "Q?", "Paris", "capital", "CORRECT", "CORRECT", "CORRECT"),
    ("women", "Typical?", "men", "gender of x", "HALLUCINATION", "HALLUCINATION", "WRONG"),
    ("The men", "Typical?", "men", "gender of x", "CORRECT", "CORRECT", "CORRECT"),
    ("Both men and women", "Typical?", "men", "gender of x", "HALLUCINATION", "HALLUCINATION", "WRONG"),
    ("Their father is named.", "Q?", "John", "father", "HALLUCINATION", "REFUSAL", "WRONG"),
    ("It is not specified, perhaps Paris", "Q?", "Paris", "capital", "CORRECT", "CORRECT", "REFUSAL"),
    ("Zoë\nmore", "Q?", "Zoe", "name", "CORRECT", "HALLUCINATION", "WRONG"),
]


def test_labelers_differ_on_purpose(spark):
    d = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], "i int, answer string, prompt string, gold string, relation string, a string, b string, c string")
    clean = A.clean_answer(F.col("answer"), F.col("prompt"))
    got = d.select("i", "a", "b", "c", A.label_v1(F.col("answer"), F.col("prompt"), F.col("gold"), F.col("relation")).alias("x"), A.label_final(clean, F.col("gold"), F.col("relation")).alias("y"), A.label_rcw(F.col("answer"), F.col("gold")).alias("z")).orderBy("i").collect()
    assert [(r.x, r.y, r.z) for r in got] == [(r.a, r.b, r.c) for r in got]


def test_prompt_echo(spark):
    r = one(spark, T.strip_prompt_echo(F.lit("capital of France is Paris"), F.lit("The capital of France is")).alias("a"), T.strip_prompt_echo(F.lit("France is big"), F.lit("In France is")).alias("b"))
    assert r.a == "Paris" and r.b == "France is big"


# --- sources and sinks ------------------------------------------------------


def test_malformed_lines(spark):
    d = files.scratch_dir(spark, "t")
    spark.createDataFrame([('{"k": 1}',), ("{bad",), ("",), ('{"k": null}',)], "value string").write.text(d)
    good, bad = readers.split_bad(readers.json_lines(spark, d, "k int", strict=False))
    assert good.count() == 2 and bad.count() == 1
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.json_lines(spark, d, "k int").collect()


def test_relations_from_nested_documents(spark, tmp_path):
    import json

    for group, name in (("bias", "b_rel"), ("factual", "a_rel")):
        (tmp_path / group).mkdir()
        doc = {"name": name, "prompt_templates": ["{} is"], "prompt_templates_zs": ["What of {}?"] if group == "factual" else [], "properties": {"symmetric": False}, "samples": [{"subject": f"s{i}", "object": f"o{i}"} for i in range(3)]}
        (tmp_path / group / f"{name}.json").write_text(json.dumps(doc, indent=1))
    rows = readers.relations(spark, str(tmp_path)).orderBy("id").collect()
    assert [r.id for r in rows] == list(range(6))
    assert (rows[0].relation_group, rows[0].relation_key, rows[0].prompt) == ("bias", "b_rel", "s0 is") and rows[5].prompt == "What of s2?"


def test_resumed_and_replaced_tables(spark):
    d = files.scratch_dir(spark, "t")
    df = spark.range(20)
    assert sinks.append_missing(spark, df.where("id < 7"), d, ["id"]) == 7
    assert sinks.append_missing(spark, df, d, ["id"]) == 13 and sinks.append_missing(spark, df, d, ["id"]) == 0
    sinks.replace_table(spark, df.where("id > 17"), d)
    assert spark.read.parquet(d).count() == 2
    assert "| id |" in sinks.markdown(df) and "tabular" in sinks.latex(df)
    with pytest.raises(ValueError):
        sinks.markdown(df, most=5)


def test_zip_cleaner():
    import io
    import zipfile

    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("a.jsonl", '{"x": 1, "secret": 2}\n\n')
        z.writestr("README", "hi")
    out = zipfile.ZipFile(io.BytesIO(readers.clean_zip(raw.getvalue(), ["x"])))
    assert out.read("a.jsonl") == b'{"x": 1}\n' and out.read("README") == b"hi"


def test_picks_without_reuse_are_those_of_the_loop(spark):
    """Eight categories that want the same rows, in three groups of which one is hot and one has too few rows."""
    rng = np.random.default_rng(11)
    rows = [(g, c, int(i), int(rng.integers(0, 4))) for g, n, ids in (("hot", 400, 60), (None, 12, 6), ("few", 30, 3)) for c in "abcdefgh" for i in rng.permutation(ids)[: max(1, n // 8)]]
    got = {(r.g, r.c): r.i for r in ranking.pick_one_each(spark.createDataFrame(rows, "g string, c string, i long, o long"), ["g"], "c", "i", ["o"]).collect()}
    want = {}
    for g in ("hot", None, "few"):
        used = set()
        for c in "abcdefgh":
            pool = sorted((o, i) for k, d, i, o in rows if (k, d) == (g, c) and i not in used)
            if pool:
                want[g, c] = pool[0][1]
                used.add(pool[0][1])
    assert got == want and len([k for k in want if k[0] == "few"]) == 3


@pytest.mark.parametrize("sides", [1, 2])
def test_t_tails_as_expressions(spark, sides):
    """Against the scalar function, from under one degree of freedom to a million, and where nothing is defined."""
    rows = [(r, n) for r in (0.0, 1e-4, 1e-3, 0.05, 0.31, 0.5, 0.77, 0.95, 0.999999, 1.0) for n in (2.3, 3.0, 3.5, 4.0, 7.0, 21.0, 47.5, 400.0, 12_345.0)]
    rows += [(-r, n) for r, n in rows] + [(None, 5.0), (float("nan"), 5.0), (0.5, None), (0.5, 2.0), (0.5, 1.0)]
    got = spark.createDataFrame(rows, "r double, n double").select("r", "n", N.t_p(F.col("r"), F.col("n"), sides).alias("p")).collect()
    for x in got:
        want = N.correlation_p(x.r, x.n, sides)
        assert (x.p is None) if want is None else abs(x.p - want) < 1e-10, x
    # many degrees of freedom: the normal tail and its first correction
    t = 0.001 * (1_000_000 / (1 - 1e-6)) ** 0.5
    normal = 0.5 * math.erfc(t / 2**0.5) + (t**3 + t) / 4e6 * math.exp(-t * t / 2) / (2 * math.pi) ** 0.5
    big = spark.createDataFrame([(0.001, 1_000_002.0)], "r double, n double").select(N.t_p(F.col("r"), F.col("n"), sides).alias("p")).first().p
    assert abs(big - normal * sides) < 1e-11
    # tails far out agree in relation, too
    far = spark.createDataFrame([(0.9, 60.0), (0.5, 800.0), (0.99, 30.0)], "r double, n double").select("r", "n", N.t_p(F.col("r"), F.col("n")).alias("p")).collect()
    assert all(abs(x.p / N.correlation_p(x.r, x.n) - 1) < 1e-9 for x in far)


def test_strict_lines_name_file_and_line(spark, tmp_path):
    """In files that many tasks read in parts, with blank lines and lines beyond ASCII before the bad one."""
    lines = [json.dumps({"k": i, "v": "ü" * (i % 50)}) if i % 7 else "" for i in range(3000)]
    (tmp_path / "good.jsonl").write_text("\n".join(lines))
    (tmp_path / "worse.jsonl").write_text("\n".join([*lines[:2345], '{"k": 1', *lines[2345:], "nothing"]))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
        assert spark.read.text(str(tmp_path / "good.jsonl")).rdd.getNumPartitions() > 5
        assert readers.json_lines(spark, str(tmp_path / "good.jsonl"), "k int, v string").count() == sum(map(bool, lines))
        got = {r.line: r.value for r in readers.numbered_lines(spark, str(tmp_path / "good.jsonl")).collect()}
        assert got == dict(enumerate(lines, 1))
        with pytest.raises(readers.JsonLineError, match=r"worse\.jsonl:2346: .*k") as e:
            readers.json_lines(spark, str(tmp_path), "k int, v string")
        assert e.value.line == 2346 and e.value.file.endswith("/worse.jsonl")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_a_run_that_stops_loses_no_slice(spark, tmp_path):
    path, seen = f"file://{tmp_path}/out/table", []
    df = spark.range(200).select("id", (F.col("id") % 3).alias("m"))
    sinks.replace_table(spark, spark.createDataFrame([(-1, 0, 0)], "id long, m long, twice long"), path)

    def work(stop_at):
        def one(rows):
            if len(seen) == stop_at:
                raise RuntimeError("stopped")
            seen.append(sorted(r.id for r in rows.collect()))
            return rows.withColumn("twice", F.col("id") * 2)

        return one

    for stop_at in (3, 5):
        with pytest.raises(RuntimeError, match="stopped"):
            sinks.checkpointed(spark, df, path, "id", work(stop_at), 8)
        assert [r.id for r in spark.read.parquet(path).collect()] == [-1]
    with pytest.raises(ValueError, match="other columns or slices"):
        sinks.checkpointed(spark, df, path, "id", work(99), 9)
    sinks.checkpointed(spark, df, path, "id", work(99), 8)
    assert sorted(i for part in seen for i in part) == list(range(200)) and len(seen) == 8
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(i, i % 3, 2 * i) for i in range(200)]
    assert not files.exists(spark, path + ".slices")


def test_frequent_tokens_are_pooled_once(spark):
    """Spans that touch the same tokens, repeated keys and tokens without a vector; the dimensions of all spans never meet."""
    from quern.operators import spans as S

    rows = [(i, [1, 2] if i % 3 else [2, 9]) for i in range(900)] + [(0, [1]), (901, []), (902, None), (903, [9])]
    vectors = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 6.0]), (3, [0.0, 0.0])], "token int, v array<double>")
    out = S.pool_rows(spark.createDataFrame(rows, "id int, tokens array<int>"), ["id"], "tokens", vectors, [], "token", "v")
    got = {r.id: (r.n_tokens, r.pooled) for r in out.collect()}
    assert got == {i: (2, [2.0, 4.0]) if i % 3 or i == 0 else (1, [3.0, 6.0]) for i in range(900)}
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()


def test_picks_move_a_bounded_number_of_rows_and_take_missing_numbers_last(spark, monkeypatch):
    from pyspark.sql import functions as F

    from quern.operators import ordering

    written = []

    def counted(df, name, keep=ranking.kept):
        written.append((out := keep(df, name)).count())
        return out

    monkeypatch.setattr(ordering, "kept", counted)
    monkeypatch.setattr(ranking, "kept", counted)
    number = F.when(F.col("i") >= 3, F.col("i").cast("double"))
    rows = spark.range(20_000).withColumnRenamed("id", "i").select(F.lit("g").alias("g"), F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("c"), "i", number.alias("o"))
    got = {r.c: r.i for r in ranking.pick_one_each(rows, ["g"], "c", "i", ["o"]).collect()}
    assert got == {"a": 3, "b": 4, "c": 5} and max(written) <= 3 * 1024


def test_texts_travel_in_batches_of_bounded_bytes(spark):
    import pandas as pd
    from pyspark.sql import functions as F

    from quern.functions import text as T

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")

    @F.pandas_udf("long")
    def together(s: pd.Series) -> pd.Series:
        return pd.Series([len(s)] * len(s))

    rows = spark.range(0, 2000, 1, 1).select(F.repeat(F.lit("é ﬁ x"), 1000).alias("t"))
    got = rows.select(T.tokens(F.col("t"))[1].alias("w"), T.strip_accents(F.col("t")).alias("s"), together("t").alias("n"))
    r = got.agg(F.max("n").alias("n"), F.min("w").alias("w"), F.min(F.length("s")).alias("short")).first()
    assert r.n * 5000 < 2_500_000 and r.w == "fi" and r.short >= 5000


def test_short_answers_are_normal_and_a_task_has_three_python_steps(spark):
    """The parts of a normal text are normal, so a label doesn't wait for a fourth step."""
    import random

    from pyspark.sql import functions as F

    from quern.functions import answers as A
    from quern.functions import text as T

    r = random.Random(5)
    some = ["a", "Q", " ", " ", " ", "\n", "́", "̸", "ͅ", "é", "ﬁ", "Å", "İ", "Σ", "가", "ᆨ", "’", "“", "–", "`", "=", ":", ",", "-", "who", " is ", "Sure, the answer is: ", "½", "ᄀ", "ᅡ", "ﷺ", "𝔸"]
    rows = [("".join(r.choices(some, k=r.randint(0, 14))), "".join(r.choices(some, k=r.randint(0, 6)))) for _ in range(3000)]
    rows += [(p + a, p) for a, p in rows]
    d = spark.createDataFrame(rows, "a string, p string")
    short = d.select(T.short_answer(F.col("a"), F.col("p")).alias("s")).localCheckpoint()
    assert short.where(T.normalize_text(F.col("s")) != F.col("s")).isEmpty()
    low = T.strip_accents(F.lower(T.normalize_text(F.col("s"))))
    assert short.where(low != T.strip_accents(F.lower("s"))).isEmpty()
    label = d.select(A.label_v1(F.col("a"), F.col("p"), F.lit("Qué"), F.lit("father")).alias("label"))
    assert label._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 3
