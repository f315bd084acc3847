"""Counts, rates, agreement and dispersion of labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions.numeric import ratio, wilson
from quern.operators import agreement, ordering

from .inputs import LABELLED, POINTS, TRIPLES, labelled, points, triples
from .registry import Queries, read

Q = Queries()
QUERIES, SQL = Q.QUERIES, Q.SQL
LABELS = ("REFUSAL", "CORRECT", "HALLUCINATION")


def _n(label: str):
    return F.count_if(F.col("label") == label)


def _r(c, name: str, places: int = 6):
    return F.round(c, places).alias(name)


_W = """round(least(1.0, greatest(0.0, (k/n + 1.96*1.96/(2*n) {sign} 1.96*sqrt(greatest(0.0, ((k/n)*(1-k/n) + 1.96*1.96/(4*n))/n))) / (1 + 1.96*1.96/n))), 6)"""


def _wilson_sql(k: str, n: str, upper: bool) -> str:
    e = _W.format(sign="+" if upper else "-").replace("k/n", f"({k})::DOUBLE/({n})").replace("*n", f"*({n})").replace("/n", f"/({n})")
    return f"CASE WHEN ({n}) > 0 THEN {e} END"


@Q.add(
    "behavior_summary",
    f"""WITH {LABELLED} SELECT model_key, relation_key, count(*) AS n_total, count(*) FILTER (label='REFUSAL') AS n_refusal,
    count(*) FILTER (label='CORRECT') AS n_correct, count(*) FILTER (label='HALLUCINATION') AS n_hallucination,
    round(count(*) FILTER (label='HALLUCINATION') / count(*), 6) AS hall_rate,
    {_wilson_sql("count(*) FILTER (label='HALLUCINATION')", "count(*)", False)} AS hall_ci_low,
    {_wilson_sql("count(*) FILTER (label='HALLUCINATION')", "count(*)", True)} AS hall_ci_high
    FROM labelled GROUP BY ALL""",
)
def behavior_summary(spark, sf):
    """Labels, counts, rate and Wilson interval of each model and relation."""
    m = agreement.three_way_summary(labelled(spark, sf), ["model_key", "relation_key"])
    return m.select("model_key", "relation_key", "n_total", "n_refusal", "n_correct", "n_hallucination", *[_r(F.col(c), c) for c in ("hall_rate", "hall_ci_low", "hall_ci_high")])


@Q.add("e01_count_by_group", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def e01(spark, sf):
    return read(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@Q.add("e02_conditional_counts", "SELECT user_id, count(*) FILTER (event_type = 'click') AS n_click, count(*) FILTER (value > 50) AS n_high, count(*) AS n FROM events GROUP BY 1")
def e02(spark, sf):
    return read(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("n_click"), F.count_if(F.col("value") > 50).alias("n_high"), F.count("*").alias("n"))


@Q.add("e03_label_pivot", f"""WITH {LABELLED} SELECT relation_key, count(*) FILTER (label='REFUSAL') AS "REFUSAL", count(*) FILTER (label='CORRECT') AS "CORRECT", count(*) FILTER (label='HALLUCINATION') AS "HALLUCINATION", 0::BIGINT AS "UNKNOWN" FROM labelled GROUP BY 1""")
def e03(spark, sf):
    return labelled(spark, sf).groupBy("relation_key").pivot("label", [*LABELS, "UNKNOWN"]).count().fillna(0)


@Q.add(
    "e04_rates_three_denominators",
    f"""WITH {LABELLED}, c AS (SELECT model_key, relation_key, count(*) n, count(*) FILTER (label='REFUSAL') r, count(*) FILTER (label='CORRECT') c, count(*) FILTER (label='HALLUCINATION') h FROM labelled GROUP BY 1,2)
    SELECT model_key, relation_key, round(h/n,6) AS hall_rate_total, round(CASE WHEN h+c>0 THEN h/(h+c) END,6) AS hall_rate_answered, round(CASE WHEN h+r>0 THEN h/(h+r) END,6) AS hall_rate_unknown FROM c""",
)
def e04(spark, sf):
    h, c, r = _n("HALLUCINATION"), _n("CORRECT"), _n("REFUSAL")
    return labelled(spark, sf).groupBy("model_key", "relation_key").agg(_r(ratio(h, F.count("*")), "hall_rate_total"), _r(ratio(h, h + c), "hall_rate_answered"), _r(ratio(h, h + r), "hall_rate_unknown"))


@Q.add(
    "e05_binary_summary",
    f"""WITH {LABELLED}, b AS (SELECT model_key, CASE WHEN label='CORRECT' THEN 'REFUSAL' ELSE label END AS label FROM labelled)
    SELECT model_key, count(*) AS total, count(*) FILTER (label='REFUSAL') AS refusal, count(*) FILTER (label='HALLUCINATION') AS hallucination, count(*) FILTER (label NOT IN ('REFUSAL','HALLUCINATION')) AS other,
    round(count(*) FILTER (label='REFUSAL')/count(*),6) AS refusal_rate FROM b GROUP BY 1""",
)
def e05(spark, sf):
    """Two labels, a third one collapsed into refusals."""
    b = labelled(spark, sf).withColumn("label", F.when(F.col("label") == "CORRECT", "REFUSAL").otherwise(F.col("label")))
    return b.groupBy("model_key").agg(F.count("*").alias("total"), _n("REFUSAL").alias("refusal"), _n("HALLUCINATION").alias("hallucination"), F.count_if(~F.col("label").isin("REFUSAL", "HALLUCINATION")).alias("other"), _r(ratio(_n("REFUSAL"), F.count("*")), "refusal_rate"))


@Q.add("e06_three_way_summary", f"""WITH {LABELLED} SELECT model_key, relation_key, count(*) AS n_total, count(*) FILTER (label='REFUSAL') AS n_refusal, count(*) FILTER (label='CORRECT') AS n_correct, count(*) FILTER (label='HALLUCINATION') AS n_hallucination, count(*) FILTER (label NOT IN ('REFUSAL','CORRECT','HALLUCINATION')) AS n_other FROM labelled GROUP BY 1,2""")
def e06(spark, sf):
    return labelled(spark, sf).groupBy("model_key", "relation_key").agg(F.count("*").alias("n_total"), _n("REFUSAL").alias("n_refusal"), _n("CORRECT").alias("n_correct"), _n("HALLUCINATION").alias("n_hallucination"), F.count_if(~F.col("label").isin(*LABELS)).alias("n_other"))


@Q.add(
    "e07_flag_metrics",
    f"""SELECT l_linestatus AS task, count(*) AS n, sum((l_discount > 0.05)::INT)::BIGINT AS n_refusal, round(avg((l_discount > 0.05)::INT),6) AS refusal_rate, round(avg((l_tax > 0.04)::INT),6) AS hallucination_rate, round(1-avg((l_discount > 0.05)::INT),6) AS coverage,
    {_wilson_sql("sum((l_discount > 0.05)::INT)", "count(*)", False)} AS ci_low, {_wilson_sql("sum((l_discount > 0.05)::INT)", "count(*)", True)} AS ci_high FROM lineitem GROUP BY 1""",
)
def e07(spark, sf):
    """Metrics of 0/1 flags by task; an empty task would give 0."""
    f = read(spark, sf, "lineitem").select(F.col("l_linestatus").alias("task"), (F.col("l_discount") > 0.05).cast("int").alias("r"), (F.col("l_tax") > 0.04).cast("int").alias("h"))
    n, k = F.count("*"), F.sum("r")
    return f.groupBy("task").agg(n.alias("n"), k.alias("n_refusal"), _r(ratio(k, n, 0), "refusal_rate"), _r(ratio(F.sum("h"), n, 0), "hallucination_rate"), _r(1 - ratio(k, n, 0), "coverage"), _r(wilson(k, n, False), "ci_low"), _r(wilson(k, n, True), "ci_high"))


@Q.add("e08_wilson", f"""SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus='F') AS k, {_wilson_sql("count(*) FILTER (o_orderstatus='F')", "count(*)", False)} AS lo, {_wilson_sql("count(*) FILTER (o_orderstatus='F')", "count(*)", True)} AS hi FROM orders GROUP BY 1""")
def e08(spark, sf):
    k, n = F.count_if(F.col("o_orderstatus") == "F"), F.count("*")
    return read(spark, sf, "orders").groupBy("o_custkey").agg(n.alias("n"), k.alias("k"), _r(wilson(k, n, False), "lo"), _r(wilson(k, n, True), "hi"))


@Q.add("e09_conditional_mean", "SELECT l_suppkey, round(avg(l_extendedprice) FILTER (l_returnflag='R'),4) AS mean_returned, round(avg(l_extendedprice) FILTER (l_returnflag<>'R'),4) AS mean_other FROM lineitem GROUP BY 1")
def e09(spark, sf):
    back = F.col("l_returnflag") == "R"
    return read(spark, sf, "lineitem").groupBy("l_suppkey").agg(_r(F.avg(F.when(back, F.col("l_extendedprice"))), "mean_returned", 4), _r(F.avg(F.when(~back, F.col("l_extendedprice"))), "mean_other", 4))


@Q.add("e10_population_std", "SELECT l_suppkey, round(stddev_pop(l_quantity),6) AS sd FROM lineitem GROUP BY 1")
def e10(spark, sf):
    return read(spark, sf, "lineitem").groupBy("l_suppkey").agg(_r(F.stddev_pop("l_quantity"), "sd"))


@Q.add("e11_count_distinct", "SELECT l_suppkey, count(DISTINCT l_partkey) AS n_parts FROM lineitem GROUP BY 1")
def e11(spark, sf):
    return read(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("n_parts"))


@Q.add("e12_target_density", "SELECT o_orderpriority AS relation_key, count(*) AS n_triples, count(DISTINCT o_custkey) AS n_unique_targets, round(count(DISTINCT o_custkey)/count(*),6) AS target_density FROM orders WHERE trim(o_custkey::VARCHAR) <> '' GROUP BY 1")
def e12(spark, sf):
    """Distinct targets over triples; blank targets don't count."""
    t = read(spark, sf, "orders").select(F.col("o_orderpriority").alias("relation_key"), F.trim(F.col("o_custkey").cast("string")).alias("target")).where("target <> ''")
    return t.groupBy("relation_key").agg(F.count("*").alias("n_triples"), F.countDistinct("target").alias("n_unique_targets"), _r(ratio(F.countDistinct("target"), F.count("*")), "target_density"))


@Q.add("e13_concat_distinct", "SELECT n_regionkey, string_agg(DISTINCT n_name, ' | ' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def e13(spark, sf):
    return read(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_set("n_name")), " | ").alias("names"))


@Q.add("e14_first_by_order", "SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS first_priority FROM orders GROUP BY 1")
def e14(spark, sf):
    return read(spark, sf, "orders").groupBy("o_custkey").agg(F.min_by("o_orderpriority", "o_orderkey").alias("first_priority"))


@Q.add("e15_average_before_join", "WITH a AS (SELECT l_orderkey, avg(l_discount) d FROM lineitem GROUP BY 1) SELECT o_orderstatus, count(*) AS n, round(avg(d),6) AS mean_discount FROM orders JOIN a ON l_orderkey=o_orderkey GROUP BY 1")
def e15(spark, sf):
    a = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.avg("l_discount").alias("d"))
    return read(spark, sf, "orders").select("o_orderkey", "o_orderstatus").join(a, "o_orderkey").groupBy("o_orderstatus").agg(F.count("*").alias("n"), _r(F.avg("d"), "mean_discount"))


@Q.add(
    "e16_concentration_entropy",
    """WITH c AS (SELECT l_suppkey, l_linenumber AS v, count(*) AS k FROM lineitem GROUP BY ALL), t AS (SELECT l_suppkey, sum(k) n, max(k) m, count(*) u, sum(k*ln(k)) s FROM c GROUP BY 1)
    SELECT l_suppkey, n::BIGINT AS n, u AS n_unique, round(m/n,6) AS top1, round(CASE WHEN u<=1 THEN 0 ELSE (ln(n)-s/n)/ln(u) END,6) AS entropy FROM t""",
)
def e16(spark, sf):
    """Share of the commonest value, and entropy over its largest value; 0 for one value."""
    c = read(spark, sf, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.count("*").alias("k"))
    n, u = F.sum("k"), F.count("*")
    h = F.try_divide(F.log(n) - F.try_divide(F.sum(F.col("k") * F.log("k")), n), F.log(F.when(u > 1, u)))
    return c.groupBy("l_suppkey").agg(n.alias("n"), u.alias("n_unique"), _r(ratio(F.max("k"), n), "top1"), _r(F.when(u <= 1, 0.0).otherwise(h), "entropy"))


_PAIR = """pair AS (SELECT doc_id, model_key, label AS truth, CASE WHEN crc % 5 = 0 THEN 'REFUSAL' WHEN crc % 7 = 0 THEN 'CORRECT' ELSE label END AS guess FROM (SELECT *, doc_id * 31 + n_chars AS crc FROM labelled))"""


def _pair(spark, sf):
    crc = F.col("doc_id") * 31 + F.col("n_chars")
    return labelled(spark, sf).select("doc_id", "model_key", F.col("label").alias("truth"), F.when(crc % 5 == 0, "REFUSAL").when(crc % 7 == 0, "CORRECT").otherwise(F.col("label")).alias("guess"))


@Q.add(
    "e17_confusion_kappa",
    f"""WITH {LABELLED}, {_PAIR}, c AS (SELECT truth, guess, count(*) k FROM pair GROUP BY 1,2), n AS (SELECT sum(k) n, sum(k) FILTER (truth=guess) agree FROM c), r AS (SELECT truth l, sum(k) a FROM c GROUP BY 1), g AS (SELECT guess l, sum(k) b FROM c GROUP BY 1), e AS (SELECT coalesce(sum(a*b),0) ab FROM r JOIN g USING (l))
    SELECT n::BIGINT AS n, round(agree/n,6) AS accuracy, round((agree/n - ab/(n*n))/(1-ab/(n*n)),6) AS kappa FROM n, e""",
)
def e17(spark, sf):
    """Accuracy and Cohen's kappa, from the confusion counts."""
    return agreement.kappa(_pair(spark, sf), "truth", "guess").select("n", _r(F.col("accuracy"), "accuracy"), _r(F.col("kappa"), "kappa"))


@Q.add("e17_confusion_matrix", f"""WITH {LABELLED}, {_PAIR}, l AS (SELECT unnest(['REFUSAL','CORRECT','HALLUCINATION']) AS l) SELECT t.l AS truth, g.l AS guess, count(p.doc_id) AS n FROM l t CROSS JOIN l g LEFT JOIN pair p ON p.truth=t.l AND p.guess=g.l GROUP BY 1,2""")
def e17m(spark, sf):
    """Dense counts of truth by guess, zeros included."""
    dense = spark.range(1).select(F.explode(F.array(*map(F.lit, LABELS))).alias("truth")).select("truth", F.explode(F.array(*map(F.lit, LABELS))).alias("guess"))
    return F.broadcast(dense).join(_pair(spark, sf).groupBy("truth", "guess").agg(F.count("*").alias("n")), ["truth", "guess"], "left").fillna(0, "n")


def _prf(n: str) -> str:
    return f"""round(CASE WHEN tp+fp>0 THEN tp/(tp+fp) {n} END,6) AS precision, round(CASE WHEN tp+fn>0 THEN tp/(tp+fn) {n} END,6) AS recall, round(CASE WHEN 2*tp+fp+fn>0 THEN 2*tp/(2*tp+fp+fn) {n} END,6) AS f1"""


_COUNTS = "SELECT l AS label, count(*) FILTER (truth=l AND guess=l) tp, count(*) FILTER (truth<>l AND guess=l) fp, count(*) FILTER (truth=l AND guess<>l) fn FROM pair, (SELECT unnest(['REFUSAL','CORRECT','HALLUCINATION','OTHER']) AS l) GROUP BY 1"


def _prf_rows(df, keys=(), on_empty=None, labels=(*LABELS, "OTHER")):
    """Precision, recall and F1 of each label, absent ones included."""
    m = agreement.precision_recall(df, "truth", "guess", labels, keys, on_empty)
    return m.select(*keys, "label", *[_r(F.col(c), c) for c in ("precision", "recall", "f1")])


@Q.add("e18_precision_recall_null", f"WITH {LABELLED}, {_PAIR}, c AS ({_COUNTS}) SELECT label, {_prf('')} FROM c")
def e18(spark, sf):
    return _prf_rows(_pair(spark, sf))


@Q.add("e18_precision_recall_zero", f"WITH {LABELLED}, {_PAIR}, c AS ({_COUNTS}) SELECT label, {_prf('ELSE 0')} FROM c")
def e18z(spark, sf):
    return _prf_rows(_pair(spark, sf), on_empty=0)


@Q.add("e18_macro_f1", f"WITH {LABELLED}, {_PAIR}, c AS ({_COUNTS}) SELECT round(avg(f1),6) AS macro_f1 FROM (SELECT {_prf('ELSE 0')} FROM c WHERE label <> 'OTHER')")
def e18m(spark, sf):
    return _prf_rows(_pair(spark, sf), on_empty=0, labels=LABELS).agg(_r(F.avg("f1"), "macro_f1"))


@Q.add("e19_all_and_by_task", f"WITH {LABELLED}, {_PAIR} SELECT coalesce(model_key,'ALL') AS task, count(*) AS n, round(avg((truth=guess)::INT),6) AS accuracy FROM pair GROUP BY GROUPING SETS ((),(model_key))")
def e19(spark, sf):
    g = _pair(spark, sf).rollup("model_key").agg(F.count("*").alias("n"), _r(F.avg((F.col("truth") == F.col("guess")).cast("int")), "accuracy"), F.grouping("model_key").alias("g"))
    return g.select(F.when(F.col("g") == 1, "ALL").otherwise(F.col("model_key")).alias("task"), "n", "accuracy")


@Q.add("e20_grouping_sets", f"WITH {LABELLED} SELECT coalesce(model_key,'*') AS model_key, coalesce(relation_key,'*') AS relation_key, count(*) AS n, count(*) FILTER (label='CORRECT') AS n_correct FROM labelled GROUP BY GROUPING SETS ((),(model_key),(relation_key))")
def e20(spark, sf):
    keys = ("model_key", "relation_key")
    g = labelled(spark, sf).groupingSets([[], ["model_key"], ["relation_key"]], *keys).agg(F.count("*").alias("n"), F.count_if(F.col("label") == "CORRECT").alias("n_correct"))
    return g.select(*[F.coalesce(c, F.lit("*")).alias(c) for c in keys], "n", "n_correct")


@Q.add("e21_quantiles", "SELECT l_returnflag, round(quantile_cont(l_extendedprice::DOUBLE, 0.25),4) AS q25, round(quantile_cont(l_extendedprice::DOUBLE, 0.9),4) AS q90 FROM lineitem GROUP BY 1")
def e21(spark, sf):
    """Exact quantiles with linear interpolation."""
    q = ordering.quantiles(read(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", {"q25": 0.25, "q90": 0.9})
    return q.select("l_returnflag", _r(F.col("q25"), "q25", 4), _r(F.col("q90"), "q90", 4))


@Q.add(
    "e22_core_periphery",
    f"""WITH {TRIPLES}, v AS (SELECT id, relation_key, split, list_cosine_similarity(s, o) AS delta FROM triples), t AS (SELECT relation_key, quantile_cont(delta, 0.5) AS thr FROM v WHERE split='train' GROUP BY 1)
    SELECT relation_key, count(*) AS n_test, round(avg(delta),6) AS delta_test, round(avg(delta) FILTER (delta>=thr),6) AS delta_core, round(avg(delta) FILTER (delta<thr),6) AS delta_periphery,
    round(avg((delta>=thr)::INT),6) AS core_frac, round(avg(delta) FILTER (delta>=thr) - avg(delta) FILTER (delta<thr),6) AS gap, round(avg((delta>0)::INT) FILTER (delta>=thr),6) AS pos_share_core
    FROM v JOIN t USING (relation_key) WHERE split='test' GROUP BY 1""",
)
def e22(spark, sf):
    """Threshold from training rows, applied to test rows."""
    from quern.functions.vectors import cosine

    v = triples(spark, sf).select("relation_key", "split", cosine(F.col("s"), F.col("o")).alias("delta"))
    m = agreement.core_periphery(v, ["relation_key"], "delta")
    names = {"mean": "delta_test", "mean_core": "delta_core", "mean_periphery": "delta_periphery", "core_frac": "core_frac", "gap": "gap", "pos_share_core": "pos_share_core"}
    return m.select("relation_key", "n_test", *[_r(F.col(a), b) for a, b in names.items()])


@Q.add(
    "e23_pivot_with_row_mean",
    f"""WITH {LABELLED} SELECT relation_key, round(avg(n_chars) FILTER (model_key='en'),4) AS en, round(avg(n_chars) FILTER (model_key='de'),4) AS de, round(avg(n_chars) FILTER (model_key='fr'),4) AS fr, round(avg(n_chars) FILTER (model_key='es'),4) AS es,
    round(list_avg([x for x in [avg(n_chars) FILTER (model_key='en'), avg(n_chars) FILTER (model_key='de'), avg(n_chars) FILTER (model_key='fr'), avg(n_chars) FILTER (model_key='es')] if x IS NOT NULL]),4) AS row_mean FROM labelled GROUP BY 1""",
)
def e23(spark, sf):
    names = ["en", "de", "fr", "es"]
    p = labelled(spark, sf).groupBy("relation_key").pivot("model_key", names).agg(F.avg("n_chars"))
    some = F.filter(F.array(*names), lambda x: x.isNotNull())
    mean = F.try_divide(F.aggregate(some, F.lit(0.0), lambda a, x: a + x), F.size(some))
    return p.select("relation_key", *[_r(F.col(n), n, 4) for n in names], _r(mean, "row_mean", 4))


@Q.add("e24_frequency_table", "SELECT l_partkey AS v, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 5")
def e24(spark, sf):
    return read(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("v")).agg(F.count("*").alias("n")).where("n >= 5")


def _median_sql(take: str) -> str:
    return f"SELECT l_suppkey, round(list_sort(list(l_extendedprice))[{take}],4) AS median FROM lineitem GROUP BY 1"


def _medians(spark, sf, side: str):
    m = ordering.medians(read(spark, sf, "lineitem"), ["l_suppkey"], "l_extendedprice")
    return m.select("l_suppkey", _r(F.col(side), "median", 4))


@Q.add("e25_upper_median", _median_sql("count(*)//2 + 1"))
def e25(spark, sf):
    return _medians(spark, sf, "upper")


@Q.add("e26_lower_median", _median_sql("(count(*)+1)//2"))
def e26(spark, sf):
    return _medians(spark, sf, "lower")


@Q.add("e28_mean_of_p", f"WITH {POINTS} SELECT grp, round(avg(coalesce(CASE WHEN w > 5 THEN z * 10 END, 1)),6) AS mean_p FROM points GROUP BY 1")
def e28(spark, sf):
    """Mean of p-values, those that can't be computed as 1."""
    return points(spark, sf).groupBy("grp").agg(_r(F.avg(F.coalesce(F.when(F.col("w") > 5, F.col("z") * 10), F.lit(1.0))), "mean_p"))


@Q.add("e29_clean_rate_pivot", f"WITH {LABELLED} SELECT relation_key, count(*) FILTER (n_chars<500) AS matched, count(*) FILTER (n_chars>=500 AND n_chars<1000) AS ambiguous, count(*) FILTER (n_chars>=1000) AS clean, round(count(*) FILTER (n_chars>=1000)/count(*),6) AS clean_rate FROM labelled GROUP BY 1")
def e29(spark, sf):
    v = F.when(F.col("n_chars") < 500, "matched").when(F.col("n_chars") < 1000, "ambiguous").otherwise("clean")
    p = labelled(spark, sf).withColumn("verdict", v).groupBy("relation_key").pivot("verdict", ["matched", "ambiguous", "clean"]).count().fillna(0)
    return p.withColumn("clean_rate", F.round(ratio(F.col("clean"), F.col("matched") + F.col("ambiguous") + F.col("clean")), 6))


@Q.add("e30_first_nonblank_group", "SELECT user_id, arg_min(event_type, event_id) FILTER (event_type <> 'view') AS grp FROM events WHERE trim(event_type) <> '' GROUP BY 1 HAVING count(*) FILTER (event_type <> 'view') > 0")
def e30(spark, sf):
    rows = read(spark, sf, "events").where("trim(event_type) <> '' AND event_type <> 'view'")
    return rows.groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("grp"))


@Q.add("e31_gap_over_models", f"WITH {LABELLED}, m AS (SELECT relation_key, model_key, avg(n_chars) a FROM labelled GROUP BY 1,2) SELECT relation_key, round(min(a),4) AS min_gap, round(avg(a),4) AS mean_gap, round(max(a),4) AS max_gap, count(*) AS n_models FROM m GROUP BY 1")
def e31(spark, sf):
    m = labelled(spark, sf).groupBy("relation_key", "model_key").agg(F.avg("n_chars").alias("a"))
    return m.groupBy("relation_key").agg(_r(F.min("a"), "min_gap", 4), _r(F.avg("a"), "mean_gap", 4), _r(F.max("a"), "max_gap", 4), F.count("*").alias("n_models"))
