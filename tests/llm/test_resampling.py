import numpy as np

from quern.llm import resampling as R

from .helpers import WORDS


def test_top_is_exact(spark):
    rng = np.random.default_rng(0)
    draws = np.concatenate([rng.normal(size=3000), np.zeros(500), [1e6, -1e6]])
    df = spark.createDataFrame([(int(i), f"{i % 7}", 0.0, float(x)) for i, x in enumerate(draws)], "doc_id long, tie string, log_weight double, draw double")
    for k in (0, 1, 17, 1500, 1600, len(draws) - 1, len(draws)):
        got = {r.doc_id for r in R.top(df, k).where("selected").collect()}
        want = {i for i, _ in sorted(enumerate(draws), key=lambda x: (-x[1], x[0]))[:k]}
        assert got == want, k


def test_weights_are_log_ratios_of_the_models(spark):
    texts = ["a b a", "c d", "a c", None, ""]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    raw = R.bucket_counts(d)
    assert raw.sum() == sum(max(0, 2 * len((t or "").split()) - 1) for t in texts)
    target = R.bucket_counts(d.where("doc_id = 0"))
    ratio = R.log_ratio(target, raw)
    got = {r.doc_id: r for r in R.weigh(spark, d, ratio).collect()}
    g = R.Grams()
    for i, t in enumerate(texts):
        assert abs(got[i].log_weight - sum(ratio[b] for b in g(t))) < 1e-9
        assert abs(got[i].draw - got[i].log_weight - R.gumbel(i)) < 1e-9
    assert got[0].log_weight > 0 > got[1].log_weight


def test_gumbel_numbers_have_the_distribution():
    x = np.array([R.gumbel(i) for i in range(20_000)])
    assert abs(x.mean() - 0.5772) < 0.03 and abs(x.var() - np.pi**2 / 6) < 0.08


def test_junk_goes_and_clean_stays(spark):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        words = rng.choice(WORDS, 40)
        rows.append((i, " ".join(w.upper() + "!!" if bad else w for w in words)))
        if i % 2 == 0:
            labels.append((i, 0 if bad else 1, 0))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.selected for r in R.resample(spark, d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    bad = [i for i in out if i % 5 == 0]
    assert sum(out[i] for i in bad) <= 2 and sum(out.values()) == 320
