"""Correlations, tests and fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import correlation as C
from quern.functions import numeric as N
from quern.operators import inference as I
from quern.operators import fits, guards, ordering, ranking

from .inputs import LABELLED, POINTS, labelled, points
from .registry import Queries, read
from .vectors import DIRECTION

Q = Queries()
QUERIES, SQL = Q.QUERIES, Q.SQL


def _r(c, name, places=6):
    return F.round(c, places).alias(name)


X, Y, Z, W = "xyzw"


@Q.add("l01_pearson", f"WITH {POINTS} SELECT grp, count(*) AS n, round(corr(x,y),6) AS r FROM points GROUP BY 1")
def l01(spark, sf):
    return points(spark, sf).groupBy("grp").agg(F.count("*").alias("n"), _r(C.pearson(F.col(X), F.col(Y)), "r"))


@Q.add("l01_pearson_guarded", "SELECT l_linestatus AS grp, NULL::DOUBLE AS r FROM lineitem GROUP BY 1")
def l01g(spark, sf):
    """A constant column has no correlation: NULL, not an error."""
    return read(spark, sf, "lineitem").groupBy(F.col("l_linestatus").alias("grp")).agg(C.pearson(F.lit(1.0), F.col("l_quantity")).alias("r"))


@Q.add("l02_spearman", f"WITH {POINTS}, k AS (SELECT grp, rank() OVER (PARTITION BY grp ORDER BY w) + (count(*) OVER (PARTITION BY grp, w) - 1)/2.0 AS a, rank() OVER (PARTITION BY grp ORDER BY y) + (count(*) OVER (PARTITION BY grp, y) - 1)/2.0 AS b FROM points) SELECT grp, count(*) AS n, round(corr(a,b),6) AS spearman FROM k GROUP BY 1")
def l02(spark, sf):
    s = ordering.spearman(points(spark, sf), "w", "y", ["grp"])
    return s.withColumn("spearman", F.round("spearman", 6))


_WSUM = f"{POINTS}, m AS (SELECT grp, sum(w*x)/sum(w) mx, sum(w*y)/sum(w) my FROM points GROUP BY 1), wr AS (SELECT grp, sum(w*(x-mx)*(y-my))/sqrt(sum(w*(x-mx)*(x-mx))*sum(w*(y-my)*(y-my))) r, sum(w)*sum(w)/sum(w*w) n_eff FROM points JOIN m USING (grp) GROUP BY 1)"


@Q.add("l03_weighted_pearson", f"WITH {_WSUM} SELECT grp, round(r,5) AS r FROM wr")
def l03(spark, sf):
    return points(spark, sf).groupBy("grp").agg(_r(C.weighted_pearson(F.col(X), F.col(Y), F.col(W)), "r", 5))


@Q.add("l04_kish_effective_n", f"WITH {_WSUM} SELECT grp, round(n_eff,4) AS n_eff FROM wr")
def l04(spark, sf):
    return points(spark, sf).groupBy("grp").agg(_r(C.kish(F.col(W)), "n_eff", 4))


@Q.add("l04_weighted_p")
def l04p(spark, sf):
    """p of the weighted correlation with the effective n; the t distribution is no SQL function."""
    g = points(spark, sf).groupBy("grp").agg(C.weighted_pearson(F.col(X), F.col(Y), F.col(W)).alias("r"), C.kish(F.col(W)).alias("n_eff"))
    return g.select("grp", _r(F.col("r"), "r"), _r(N.t_p(F.col("r"), F.col("n_eff")), "p"))


@Q.add("l05_fisher_interval", f"WITH {POINTS}, c AS (SELECT grp, count(*) n, corr(x,y) r FROM points GROUP BY 1) SELECT grp, round(tanh(atanh(r)-1.96/sqrt(n-3)),6) AS lo, round(tanh(atanh(r)+1.96/sqrt(n-3)),6) AS hi FROM c WHERE n > 3 AND abs(r) < 1 UNION ALL SELECT grp, NULL, NULL FROM c WHERE n <= 3 OR abs(r) >= 1")
def l05(spark, sf):
    g = points(spark, sf).groupBy("grp").agg(F.count("*").alias("n"), C.pearson(F.col(X), F.col(Y)).alias("r"))
    return g.select("grp", _r(N.fisher_bound(F.col("r"), F.col("n"), False), "lo"), _r(N.fisher_bound(F.col("r"), F.col("n"), True), "hi"))


@Q.add("l06_t_test_p")
def l06(spark, sf):
    g = points(spark, sf).groupBy("grp").agg(F.count("*").alias("n"), C.pearson(F.col(X), F.col(Y)).alias("r"))
    return g.select("grp", "n", _r(F.col("r"), "r"), _r(N.t_p(F.col("r"), F.col("n")), "p_two"), _r(N.t_p(F.col("r"), F.col("n"), 1), "p_one"))


def _nations(spark, sf):
    n = read(spark, sf, "nation")
    return n.select("n_regionkey", F.col("n_nationkey").cast("double").alias("x"), F.length("n_name").cast("double").alias("y"))


@Q.add("l07_permutation_exact")
def l07(spark, sf):
    """Every order of at most nine points; rows only, tested by enumeration."""
    return I.permutation_exact(_nations(spark, sf), ["n_regionkey"], "x", "y")


@Q.add("l08_permutation_sampled")
def l08(spark, sf):
    return I.permutation_sampled(points(spark, sf), ["grp"], "x", "y", draws=2000)


@Q.add("l09_leave_one_out_range", f"WITH {POINTS}, p AS (SELECT a.grp, a.id, corr(b.x, b.y) r FROM points a JOIN points b ON a.grp=b.grp AND a.id<>b.id GROUP BY 1,2) SELECT grp, round(min(r),6) AS lo, round(max(r),6) AS hi FROM p GROUP BY 1")
def l09(spark, sf):
    return ranking.leave_one_out(points(spark, sf), ["grp"], "x", "y").groupBy("grp").agg(_r(F.min("r_without"), "lo"), _r(F.max("r_without"), "hi"))


@Q.add("l10_fisher_combined", f"WITH {POINTS}, s AS (SELECT grp, id // 4 AS part, -sum(ln(z)) h, count(*) k FROM points WHERE z > 0 GROUP BY grp, id // 4) SELECT grp, part, round(least(1, exp(-h)*CASE k WHEN 1 THEN 1 WHEN 2 THEN 1+h WHEN 3 THEN 1+h+h*h/2 ELSE 1+h+h*h/2+h*h*h/6 END),6) AS p FROM s")
def l10(spark, sf):
    """Suppliers in fours."""
    s = points(spark, sf).where("z > 0").groupBy("grp", F.floor(F.col("id") / 4).alias("part")).agg(F.sum(F.log("z")).alias("s"), F.count("*").alias("k"))
    return s.select("grp", "part", _r(N.fisher_combined(F.col("s"), F.col("k")), "p"))


_PARTIAL = "(a-b*c)/sqrt((1-b*b)*(1-c*c))"


@Q.add("l11_partial_correlation", f"WITH {POINTS}, c AS (SELECT grp, corr(x,y) a, corr(x,z) b, corr(y,z) c, count(*) n FROM points GROUP BY 1) SELECT grp, n, round({_PARTIAL},6) AS r_partial FROM c")
def l11(spark, sf):
    g = points(spark, sf).groupBy("grp").agg(F.count("*").alias("n"), C.pearson(F.col(X), F.col(Y)).alias("a"), C.pearson(F.col(X), F.col(Z)).alias("b"), C.pearson(F.col(Y), F.col(Z)).alias("c"))
    return g.select("grp", "n", _r(C.partial(F.col("a"), F.col("b"), F.col("c")), "r_partial"))


@Q.add("l12_pooled_fixed_effects_partial", f"WITH {POINTS}, d AS (SELECT x-avg(x) OVER g AS x, y-avg(y) OVER g AS y, z-avg(z) OVER g AS z FROM points WINDOW g AS (PARTITION BY grp)), c AS (SELECT corr(x,y) a, corr(x,z) b, corr(y,z) c, count(*) n FROM d) SELECT n, round(a,6) AS r_fe, round({_PARTIAL},6) AS r_fe_partial FROM c")
def l12(spark, sf):
    """Within-group correlation, and the same given z: demeaning is regressing on group dummies."""
    d = points(spark, sf).select(*[ranking.demean(c, ["grp"]).alias(c) for c in "xyz"])
    g = d.agg(F.count("*").alias("n"), C.pearson(F.col(X), F.col(Y)).alias("a"), C.pearson(F.col(X), F.col(Z)).alias("b"), C.pearson(F.col(Y), F.col(Z)).alias("c"))
    return g.select("n", _r(F.col("a"), "r_fe"), _r(C.partial(F.col("a"), F.col("b"), F.col("c")), "r_fe_partial"))


SPECS = {"FE only": [], "FE + z": ["z"], "FE + w": ["w"], "FE + x": ["x"], "FE + z + x": ["z", "x"], "FE + w + x": ["w", "x"]}
#: Specifications and the same with x.
WITH_X = {"FE + z": "FE + z + x", "FE + w": "FE + w + x"}


@Q.add("l13_ols_hc3")
def l13(spark, sf):
    """Least squares with group effects and HC3 errors over six specifications."""
    return I.ols_hc3(points(spark, sf), "y", "grp", SPECS)


@Q.add("l14_incremental_fit")
def l14(spark, sf):
    """Gain in adjusted R2 of each specification over the one without x, and x's own coefficient."""
    fit = I.ols_hc3(points(spark, sf), "y", "grp", SPECS)
    base = fit.where(F.col("spec").isin(*WITH_X)).select(F.col("spec").alias("base_spec"), F.col("adj_r2").alias("adj_r2_base")).distinct()
    plus = fit.where("term = 'x'").select(F.col("spec").alias("plus_spec"), F.col("adj_r2").alias("adj_r2_plus"), F.col("coef").alias("x_coef"), F.col("p_hc3").alias("x_p_hc3"))
    named = F.create_map(*[F.lit(v) for pair in WITH_X.items() for v in pair])
    return base.withColumn("plus_spec", named[F.col("base_spec")]).join(plus, "plus_spec").withColumn("adj_r2_gain", F.col("adj_r2_plus") - F.col("adj_r2_base"))


@Q.add("l15_line_fit", f"WITH {POINTS} SELECT grp, round(regr_slope(y,x),4) AS slope, round(regr_intercept(y,x),3) AS intercept FROM points GROUP BY 1")
def l15(spark, sf):
    return points(spark, sf).groupBy("grp").agg(_r(F.regr_slope("y", "x"), "slope", 4), _r(F.regr_intercept("y", "x"), "intercept", 3))


def _binary(spark, sf):
    d = labelled(spark, sf).where("label <> 'REFUSAL'")
    return d.select("doc_id", "model_key", F.log(F.col("n_chars") + 1).alias("x"), (F.col("label") == "HALLUCINATION").cast("int").alias("y"))


def _newton_sql(steps: int = 16) -> str:
    """Newton steps as a chain of common tables, far more than it takes to settle."""
    out = [f"{LABELLED}, b AS (SELECT model_key, ln(n_chars + 1) x, (label='HALLUCINATION')::INT::DOUBLE y FROM labelled WHERE label <> 'REFUSAL'), m AS (SELECT model_key, count(*) n, sum(y) k, avg(x) mu, stddev_pop(x) sd FROM b GROUP BY 1 HAVING sum(y) > 0 AND sum(y) < count(*) AND stddev_pop(x) > 0), z AS (SELECT model_key, (x-mu)/sd z, y FROM b JOIN m USING (model_key)), f0 AS (SELECT model_key, 0::DOUBLE w0, 0::DOUBLE w1 FROM m)"]
    for i in range(steps):
        out.append(f"g{i} AS (SELECT model_key, w0, w1, sum(p-y) a, sum((p-y)*z)+w1 b, sum(p*(1-p)) h, sum(p*(1-p)*z) j, sum(p*(1-p)*z*z)+1 l FROM (SELECT *, 1/(1+exp(-(w0+w1*z))) p FROM z JOIN f{i} USING (model_key)) GROUP BY 1, 2, 3), f{i + 1} AS (SELECT model_key, w0-(l*a-j*b)/(h*l-j*j) w0, w1-(h*b-j*a)/(h*l-j*j) w1 FROM g{i})")
    return "WITH " + ", ".join(out) + f" SELECT model_key, n, round(w1/sd,5) AS slope, round(w0-w1*mu/sd,5) AS intercept FROM f{steps} JOIN m USING (model_key)"


@Q.add("l16_logistic", _newton_sql())
def l16(spark, sf):
    f = fits.raw_slope(fits.logistic(_binary(spark, sf), ["model_key"], "x", "y")).where("w1 IS NOT NULL")
    return f.select("model_key", "n", _r(F.col("slope"), "slope", 5), _r(F.col("intercept"), "intercept", 5))


@Q.add("l17_cross_validated")
def l17(spark, sf):
    """Log loss, Brier score and AUC of held-out predictions."""
    return I.cross_validated(_binary(spark, sf), ["model_key"], "x", "y", "doc_id")


@Q.add("l17_spline_cross_validated")
def l17s(spark, sf):
    """The same of the spline curve."""
    return I.cross_validated(_binary(spark, sf), ["model_key"], "x", "y", "doc_id", curve="spline")


@Q.add("l18_isotonic")
def l18(spark, sf):
    """Isotonic fit of error on length over all models, as an alternative to the logistic curve."""
    b = _binary(spark, sf).select("doc_id", "x", "y")
    return b.join(fits.isotonic(b, [], "x", "y"), "x").select("doc_id", _r(F.col("fitted"), "p"))


@Q.add("l18_isotonic_by_model")
def l18m(spark, sf):
    """A monotone curve for each model, rising or falling as its errors do."""
    return fits.isotonic(_binary(spark, sf), ["model_key"], "x", "y", None).select("model_key", _r(F.col("x"), "x"), _r(F.col("fitted"), "p"), "increasing")


@Q.add("l18_spline_logistic")
def l18s(spark, sf):
    """Logistic fit on cubic splines of the length, a curve for each model."""
    b = _binary(spark, sf)
    f = fits.spline_logistic(b, ["model_key"], "x", "y").where("w IS NOT NULL").drop("n", "n_pos")
    return guards.null_safe_join(b, f, ["model_key"]).select("doc_id", _r(fits.spline_p(F.col("x")), "p"))


@Q.add("l19_threshold_grid", f"WITH {POINTS}, g AS (SELECT grp, t.t, corr(x,y) r, count(*) n FROM points JOIN (SELECT unnest([0.0, 20.0, 40.0]) AS t) t ON w >= t.t GROUP BY 1, 2) SELECT t AS threshold, count(*) AS n_groups, round(avg(abs(r)),6) AS mean_abs_r FROM g WHERE n >= 3 GROUP BY 1")
def l19(spark, sf):
    """Correlations at every threshold of the weight, ranked by their mean."""
    passed = F.explode(F.filter(F.array(*[F.lit(t) for t in (0.0, 20.0, 40.0)]), lambda t: t <= F.col("w"))).alias("threshold")
    g = points(spark, sf).select("grp", "x", "y", passed).groupBy("grp", "threshold").agg(C.pearson(F.col(X), F.col(Y), 3).alias("r"), F.count("*").alias("n")).where("n >= 3")
    return g.groupBy("threshold").agg(F.count("*").alias("n_groups"), _r(F.avg(F.abs("r")), "mean_abs_r")).orderBy(F.desc("mean_abs_r"))


@Q.add("l20_targets", f"WITH {LABELLED} SELECT model_key, round(count(*) FILTER (label='HALLUCINATION')/nullif(count(*) FILTER (label<>'REFUSAL'),0),6) AS hall_given_value, round(count(*) FILTER (label='HALLUCINATION')/nullif(count(*) FILTER (label<>'CORRECT'),0),6) AS hall_given_noncorrect, round(count(*) FILTER (label='REFUSAL')/count(*),6) AS refusal, round(count(*) FILTER (label='CORRECT')/nullif(count(*) FILTER (label<>'REFUSAL'),0),6) AS correct_given_value FROM labelled GROUP BY 1")
def l20(spark, sf):
    k = lambda x: F.count_if(F.col("label") == x)
    h, c, r = k("HALLUCINATION"), k("CORRECT"), k("REFUSAL")
    return labelled(spark, sf).groupBy("model_key").agg(_r(N.ratio(h, h + c), "hall_given_value"), _r(N.ratio(h, h + r), "hall_given_noncorrect"), _r(N.ratio(r, F.count("*")), "refusal"), _r(N.ratio(c, h + c), "correct_given_value"))


@Q.add("l21_gain_against_base", f"WITH {DIRECTION}, m AS (SELECT relation_key, avg(base_cos) b, avg(cos) c FROM scored WHERE split='test' GROUP BY 1) SELECT count(*) AS n, round(corr(b,c),5) AS r, round(avg(c-b),6) AS mean_gain FROM m")
def l21(spark, sf):
    """How the moved cosines follow the plain ones over relations."""
    from quern.operators import linearity as L

    from .inputs import triples

    m = L.summary(triples(spark, sf), ["relation_key"])
    b, c = F.col("base_cos_mean"), F.col("cos_mean")
    return m.agg(F.count("*").alias("n"), _r(C.pearson(b, c), "r", 5), _r(F.avg(c - b), "mean_gain"))


_AVG_RANK = "rank() OVER (PARTITION BY model, variant ORDER BY {0}) + (count(*) OVER (PARTITION BY model, variant, {0}) - 1) / 2.0"


def _guarded_corr(a: str, b: str) -> str:
    return f"CASE WHEN count(*) >= 3 AND min({a}) < max({a}) AND min({b}) < max({b}) THEN round(corr({a}, {b}), 5) END"


@Q.add(
    "l22_variant_sensitivity",
    f"""WITH v AS (SELECT l_suppkey AS k, l_suppkey % 3 AS model, l_returnflag AS variant, round(avg(l_discount), 9) AS v FROM lineitem GROUP BY ALL), told AS (SELECT l_suppkey AS k, round(avg((l_linestatus = 'F')::INT), 9) AS b FROM lineitem GROUP BY 1),
    both_v AS (SELECT a.model, a.variant, d.v AS x, a.v AS y FROM v a JOIN v d ON d.k = a.k AND d.variant = 'N' WHERE a.variant <> 'N'), both_r AS (SELECT *, {_AVG_RANK.format("x")} AS rx, {_AVG_RANK.format("y")} AS ry FROM both_v),
    seen_v AS (SELECT model, variant, v AS x, b AS y FROM v JOIN told USING (k) WHERE variant <> 'N'), seen_r AS (SELECT *, {_AVG_RANK.format("x")} AS rx, {_AVG_RANK.format("y")} AS ry FROM seen_v),
    m AS (SELECT model, variant, count(*) AS n, {_guarded_corr("x", "y")} AS r_default, {_guarded_corr("rx", "ry")} AS spearman_default, round(avg(abs(y - x)), 6) AS mean_abs_delta FROM both_r GROUP BY 1, 2),
    s AS (SELECT model, variant, count(*) AS n_behaviour, {_guarded_corr("x", "y")} AS r_behaviour, {_guarded_corr("rx", "ry")} AS spearman_behaviour FROM seen_r GROUP BY 1, 2)
    SELECT * FROM m LEFT JOIN s USING (model, variant)""",
)
def l22(spark, sf):
    """How variants of a measure follow its default and a behaviour: suppliers in three models, discounts by return flag, the share of closed lines."""
    from quern.operators import agreement

    li = read(spark, sf, "lineitem")
    v = li.groupBy("l_suppkey", (F.col("l_suppkey") % 3).alias("model"), F.col("l_returnflag").alias("variant")).agg(F.round(F.avg("l_discount"), 9).alias("v"))
    told = li.groupBy("l_suppkey").agg(F.round(F.avg((F.col("l_linestatus") == "F").cast("int")), 9).alias("b"))
    s = agreement.sensitivity(v.where("variant = 'N'"), v.where("variant <> 'N'"), told, ["model", "variant"], ["l_suppkey"], "v", "b")
    rounded = [_r(F.col(c), c, 6 if c == "mean_abs_delta" else 5) if c[0] in "rsm" and c != "model" else F.col(c) for c in s.columns]
    return s.select(*rounded)


# --- from labels and vectors to their relation ------------------------------

#: Rates of hallucination of each model and relation, beside the relation's mean gain in cosine on test rows.
_BOTH = f"""{LABELLED}, {DIRECTION}, rates AS (
  SELECT model_key, regexp_extract(relation_key, '[0-9]+$')::INT % 10 AS rel, count(*) FILTER (label='HALLUCINATION') / nullif(count(*) FILTER (label<>'REFUSAL'), 0) AS rate, count(*) FILTER (label<>'REFUSAL') AS w
  FROM labelled GROUP BY ALL), gains AS (SELECT relation_key AS rel, avg(cos) - avg(base_cos) AS gain FROM scored WHERE split='test' GROUP BY 1),
both_sides AS (SELECT model_key, rel, rate, w, gain FROM rates JOIN gains USING (rel) WHERE rate IS NOT NULL)"""


def _targets(spark, sf):
    from quern.operators import agreement, linearity

    from .inputs import triples

    d = labelled(spark, sf).withColumn("rel", F.try_to_number(F.regexp_extract("relation_key", "[0-9]+$", 0), F.lit("999999999")).cast("int") % 10)
    rates = agreement.three_way_summary(d, ["model_key", "rel"]).select("model_key", "rel", "hall_rate_answered", "n_refusal", "n_total", (F.col("n_total") - F.col("n_refusal")).alias("w"))
    gains = linearity.summary(triples(spark, sf), ["relation_key"]).select(F.col("relation_key").alias("rel"), F.col("delta_cos").alias("gain"))
    return rates, gains


@Q.add(
    "x01_rates_follow_gains",
    f"""WITH {_BOTH}, k AS (SELECT *, rank() OVER (PARTITION BY model_key ORDER BY gain) + (count(*) OVER (PARTITION BY model_key, gain) - 1) / 2.0 AS a, rank() OVER (PARTITION BY model_key ORDER BY rate) + (count(*) OVER (PARTITION BY model_key, rate) - 1) / 2.0 AS b FROM both_sides),
    c AS (SELECT model_key, count(*) AS n, CASE WHEN count(*) >= 3 AND min(rate) < max(rate) THEN corr(gain, rate) END AS r, CASE WHEN count(*) >= 3 AND min(rate) < max(rate) THEN corr(a, b) END AS s FROM k GROUP BY 1)
    SELECT model_key, n, round(r, 5) AS r, round(CASE WHEN n > 3 AND abs(r) < 1 THEN tanh(atanh(r) - 1.96 / sqrt(n - 3)) END, 5) AS r_ci_low, round(CASE WHEN n > 3 AND abs(r) < 1 THEN tanh(atanh(r) + 1.96 / sqrt(n - 3)) END, 5) AS r_ci_high, round(s, 5) AS spearman FROM c""",
)
def x01(spark, sf):
    """Labels to rates, vectors to gains, and how the rates follow the gains for each model."""
    from quern.operators import agreement

    rates, gains = _targets(spark, sf)
    rates = rates.groupBy("model_key", "rel").agg(F.first("hall_rate_answered").alias("hall_rate_answered"))
    m = agreement.related(rates, gains, ["rel"], ["model_key"], "hall_rate_answered", "gain")
    return m.select("model_key", "n", *[_r(F.col(c), c, 5) for c in ("r", "r_ci_low", "r_ci_high", "spearman")])


@Q.add("x02_thresholds_by_relation_size", f"""WITH {_BOTH}, g AS (SELECT t, model_key, CASE WHEN min(rate) < max(rate) AND min(gain) < max(gain) THEN corr(gain, rate) END AS r, count(*) AS n FROM both_sides JOIN (SELECT unnest([1, 5, 10, 20]) AS t) ON w >= t GROUP BY 1, 2 HAVING count(*) >= 3)
    SELECT t AS threshold, count(*) AS n_models, min(n) AS least_relations, round(avg(r), 5) AS mean_r, round(min(r), 5) AS min_r FROM g GROUP BY 1""")
def x02(spark, sf):
    """The same over relations with at least so many answered rows."""
    rates, gains = _targets(spark, sf)
    both = rates.join(gains, "rel").where("hall_rate_answered IS NOT NULL AND gain IS NOT NULL")
    at = both.select("model_key", "hall_rate_answered", "gain", F.explode(F.filter(F.array(*map(F.lit, (1, 5, 10, 20))), lambda t: t <= F.col("w"))).alias("threshold"))
    g = at.groupBy("threshold", "model_key").agg(C.pearson(F.col("gain"), F.col("hall_rate_answered"), 3).alias("r"), F.count("*").alias("n")).where("n >= 3")
    return g.groupBy("threshold").agg(F.count("*").alias("n_models"), F.min("n").alias("least_relations"), _r(F.avg("r"), "mean_r", 5), _r(F.min("r"), "min_r", 5))


@Q.add("l19_thresholds_by_p")
def l19p(spark, sf):
    """Thresholds of the denominator ranked by the mean p of both targets and all models, plain and weighted; SQL has no t distribution."""
    rates, gains = _targets(spark, sf)
    value = F.struct(F.lit("hall_given_value").alias("target"), F.col("hall_rate_answered").alias("rate"), F.col("w").alias("denom"))
    refusal = F.struct(F.lit("refusal").alias("target"), N.ratio(F.col("n_refusal"), F.col("n_total")).alias("rate"), F.col("n_total").alias("denom"))
    both = rates.join(gains, "rel").select("model_key", "gain", F.inline(F.array(value, refusal)))
    ranked = I.ranked_thresholds(I.threshold_grid(both, ["target", "model_key"], "gain", "rate", "denom", (1, 2, 5, 10, 20, 50, 100)))
    return ranked.withColumn("mean_p", F.round("mean_p", 5))


@Q.add("l21_affine_and_behaviour")
def l21a(spark, sf):
    """How rates of each model follow the gains of moved and of ridge-mapped subjects; the ridge map needs a solve that SQL lacks."""
    from quern.functions import vectors as V
    from quern.operators import agreement
    from quern.operators import linearity as L

    from .inputs import triples

    rates, gains = _targets(spark, sf)
    t = triples(spark, sf)
    mapped = L.affine(t, ["relation_key"]).join(t.select("relation_key", "id", "s", "o"), ["relation_key", "id"])
    plain, ridge = V.cosine(F.col("s"), F.col("o")), V.cosine(F.col("inferred"), F.col("o"))
    affine = mapped.groupBy(F.col("relation_key").alias("rel")).agg(F.avg(ridge - plain).alias("gain"))
    named = lambda g, name: agreement.related(rates, g, ["rel"], ["model_key"], "hall_rate_answered", "gain").select("model_key", "n", _r(F.col("r"), f"r_{name}", 5), _r(F.col("spearman"), f"spearman_{name}", 5))
    return named(gains, "translation").join(named(affine, "affine").drop("n"), "model_key")
