"""Projection, filters, joins, windows, sorting and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions.numeric import finite, wilson
from quern.operators import fuzzy, guards, ordering, ranking, resolve

from .inputs import ANSWERS, LABELLED, POINTS, answers, labelled, points
from .rates import _wilson_sql
from .registry import Queries, read

Q = Queries()
QUERIES, SQL = Q.QUERIES, Q.SQL


def _r(c, name, places=6):
    return F.round(c, places).alias(name)


# --- B: projection ----------------------------------------------------------


@Q.add("b01_alias_resolution", "SELECT n_nationkey AS id, n_name AS label, n_regionkey AS grp FROM nation")
def b01(spark, sf):
    """Four rules: exact, any case, canonical, scored."""
    df = read(spark, sf, "nation")
    a = resolve.exact(df.columns, ["nation_id", "n_nationkey"], required=True)
    b = resolve.any_case(df.columns, ["N_NAME"]) or resolve.scored(df.columns, ["name"])
    c = resolve.canonical(df.columns, ["N RegionKey"])
    return df.select(F.col(a).alias("id"), F.col(b).alias("label"), F.col(c).alias("grp"))


@Q.add("b01_scored_choice", "SELECT r_regionkey AS k, r_name AS chosen FROM region")
def b01s(spark, sf):
    df = read(spark, sf, "region")
    return df.select(F.col("r_regionkey").alias("k"), F.col(resolve.scored(df.columns, ["r_"], ["key"], ["name"])).alias("chosen"))


@Q.add("b02_conditional_rename", "SELECT r_regionkey AS relation_id, r_name FROM region")
def b02(spark, sf):
    return resolve.rename_missing(read(spark, sf, "region"), {"r_regionkey": "relation_id", "absent": "r_name"})


@Q.add("b03_flatten", """SELECT event_id, (props->>'$.k')::BIGINT AS "props.k", '["' || event_type || '"]' AS tags FROM events""")
def b03(spark, sf):
    e = read(spark, sf, "events").select("event_id", F.from_json("props", "k bigint").alias("props"), F.array("event_type").alias("tags"))
    return resolve.flatten(e)


@Q.add("b04_first_nonblank", "SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE lang END, ' '), source) AS v FROM documents")
def b04(spark, sf):
    d = read(spark, sf, "documents")
    return d.select("doc_id", T.first_nonblank(F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.col("lang")), F.col("source")).alias("v"))


@Q.add("b05_id_normalisation", "SELECT o_orderkey AS k, o_orderkey::VARCHAR AS id FROM orders")
def b05(spark, sf):
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), T.normal_id(F.concat(F.col("o_orderkey").cast("string"), F.lit(".0"))).alias("id"))


@Q.add("b06_derived_flags", f"WITH {LABELLED} SELECT doc_id, label='REFUSAL' AS is_refusal, label='CORRECT' AS is_correct, label='HALLUCINATION' AS is_hall, label<>'REFUSAL' AS is_value FROM labelled")
def b06(spark, sf):
    x = F.col("label")
    return labelled(spark, sf).select("doc_id", (x == "REFUSAL").alias("is_refusal"), (x == "CORRECT").alias("is_correct"), (x == "HALLUCINATION").alias("is_hall"), (x != "REFUSAL").alias("is_value"))


@Q.add("b07_reorder_drop", "SELECT s_name, s_suppkey, s_acctbal FROM supplier")
def b07(spark, sf):
    return resolve.reorder(read(spark, sf, "supplier"), ["s_name", "absent"], ["s_nationkey"])


@Q.add("b08_prefixed_join", "SELECT a.n_nationkey AS k, a.n_name AS a_n_name, b.n_name AS b_n_name FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey")
def b08(spark, sf):
    n = read(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    return resolve.prefixed(n, "a_", ["k"]).join(resolve.prefixed(n, "b_", ["k"]), "k")


@Q.add("b09_row_id_in_group", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS pos FROM lineitem")
def b09(spark, sf):
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", ranking.position(["l_orderkey"], ["l_linenumber"]).cast("long").alias("pos"))


@Q.add("b10_surrogate_id", "SELECT n_name, row_number() OVER (ORDER BY n_regionkey, n_nationkey) AS id FROM nation")
def b10(spark, sf):
    """Global numbering by block sums: rows are numbered inside regions, regions start where the ones before end."""
    n = read(spark, sf, "nation")
    sizes = n.groupBy("n_regionkey").agg(F.count("*").alias("m")).withColumn("start", F.sum("m").over(Window.orderBy("n_regionkey")) - F.col("m"))
    rn = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    return n.withColumn("rn", rn).join(F.broadcast(sizes), "n_regionkey").select("n_name", (F.col("start") + F.col("rn")).cast("long").alias("id"))


@Q.add("b11_template_fill", "SELECT c_custkey, replace('Where does {SUBJECT} live?', '{SUBJECT}', c_name) AS prompt FROM customer")
def b11(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", T.fill_template(F.lit("Where does {SUBJECT} live?"), F.col("c_name")).alias("prompt"))


@Q.add("b12_question_template", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'What is {}?' ELSE '{} is' END AS template FROM part")
def b12(spark, sf):
    t = F.array(F.lit("{} is"), F.when(F.col("p_size") % 2 == 0, "What is {}?").otherwise("{} was"))
    return read(spark, sf, "part").select("p_partkey", T.question_template(t).alias("template"))


@Q.add("b13_template_rewrite", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'Who made it?' WHEN 1 THEN 'By whom?' ELSE 'it is made by?' END AS q FROM part")
def b13(spark, sf):
    t = F.when(F.col("p_size") % 3 == 0, " Who made it? Say. ").when(F.col("p_size") % 3 == 1, "made by").otherwise("it is made by.")
    return read(spark, sf, "part").select("p_partkey", T.template_to_question(t, {"made by": "By whom?"}).alias("q"))


@Q.add("b14_complement", "SELECT l_suppkey, round(1 - avg(l_discount), 6) AS acc FROM lineitem GROUP BY 1")
def b14(spark, sf):
    return read(spark, sf, "lineitem").groupBy("l_suppkey").agg(_r(1 - F.avg("l_discount"), "acc"))


@Q.add("b15_padded_ids", "SELECT c_custkey, 'w_' || lpad(c_custkey::VARCHAR, 5, '0') AS wid, c_mktsegment || ':' || c_custkey AS eid FROM customer")
def b15(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", F.concat(F.lit("w_"), F.lpad(F.col("c_custkey").cast("string"), 5, "0")).alias("wid"), F.format_string("%s:%d", "c_mktsegment", "c_custkey").alias("eid"))


@Q.add("b16_rate_if_absent", "SELECT l_suppkey, count(*) FILTER (l_returnflag='R') AS k, count(*) AS n, round(count(*) FILTER (l_returnflag='R')/count(*),6) AS rate FROM lineitem GROUP BY 1")
def b16(spark, sf):
    c = read(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("k"), F.count("*").alias("n"))
    return resolve.add_rate_if_absent(c, "rate", "k", "n").withColumn("rate", F.round("rate", 6))


@Q.add("b17_id_fallback", "SELECT vec_id, coalesce(CASE WHEN vec_id % 2 = 0 THEN 'v' || vec_id END, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::VARCHAR) AS id FROM embeddings")
def b17(spark, sf):
    given = F.when(F.col("vec_id") % 2 == 0, F.concat(F.lit("v"), "vec_id"))
    return read(spark, sf, "embeddings").select("vec_id", F.coalesce(given, ranking.position(["label"], ["vec_id"]).cast("string")).alias("id"))


# --- C: filters -------------------------------------------------------------


@Q.add("c01_finite_mask", "SELECT event_id, value FROM events WHERE value IS NOT NULL AND isfinite(value) AND value > 0")
def c01(spark, sf):
    return read(spark, sf, "events").select("event_id", "value").where(finite(F.col("value")).isNotNull() & (F.col("value") > 0))


@Q.add("c02_relation_set", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def c02(spark, sf):
    wanted = spark.range(1).select(F.explode(F.array(F.lit("1-URGENT"), F.lit("2-HIGH"))).alias("o_orderpriority"))
    return read(spark, sf, "orders").join(F.broadcast(wanted), "o_orderpriority", "left_semi").select("o_orderkey")


@Q.add("c03_split_filter", "SELECT vec_id FROM embeddings WHERE vec_id % 4 = 3")
def c03(spark, sf):
    s = F.when(F.col("vec_id") % 4 == 3, "test").otherwise("train")
    return read(spark, sf, "embeddings").withColumn("split", s).where("split = 'test'").select("vec_id")


@Q.add("c04_split_normalisation", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'train' WHEN event_id % 3 = 1 THEN 'test' END AS split FROM events")
def c04(spark, sf):
    raw = F.lower(F.trim(F.when(F.col("event_id") % 3 == 0, " Train").when(F.col("event_id") % 3 == 1, "0")))
    split = F.when(raw.isin("train", "1", "true", "tr"), "train").when(raw.isin("test", "0", "false", "te"), "test")
    return read(spark, sf, "events").select("event_id", split.alias("split"))


@Q.add("c05_min_denominator", f"WITH {LABELLED} SELECT model_key, relation_key, count(*) AS n, count(*) FILTER (label<>'REFUSAL') >= 5 AS include FROM labelled GROUP BY 1,2")
def c05(spark, sf):
    return labelled(spark, sf).groupBy("model_key", "relation_key").agg(F.count("*").alias("n"), (F.count_if(F.col("label") != "REFUSAL") >= 5).alias("include"))


@Q.add(
    "c06_cross_model_intersection",
    f"""WITH {LABELLED}, r AS (SELECT model_key, relation_key, count(*) FILTER (label<>'REFUSAL') AS n_value FROM labelled GROUP BY 1,2), m AS (SELECT count(DISTINCT model_key) k FROM r),
    f AS (SELECT *, n_value >= 3 AS pass_denom, count(*) FILTER (n_value >= 3) OVER (PARTITION BY relation_key) = (SELECT k FROM m) AS in_intersection FROM r)
    SELECT *, CASE WHEN NOT pass_denom THEN 'dropped_low_denom' WHEN NOT in_intersection THEN 'dropped_not_in_intersection' ELSE 'kept_intersection' END AS drop_reason FROM f""",
)
def c06(spark, sf):
    """Relations over the threshold in every model, with the reason for dropping the others."""
    r = labelled(spark, sf).groupBy("model_key", "relation_key").agg(F.count_if(F.col("label") != "REFUSAL").alias("n_value"))
    models = r.agg(F.countDistinct("model_key").alias("k"))
    passing = F.count_if(F.col("n_value") >= 3).over(Window.partitionBy("relation_key"))
    f = r.withColumn("passing", passing).join(F.broadcast(models)).withColumn("pass_denom", F.col("n_value") >= 3).withColumn("in_intersection", F.col("passing") == F.col("k"))
    reason = F.when(~F.col("pass_denom"), "dropped_low_denom").when(~F.col("in_intersection"), "dropped_not_in_intersection").otherwise("kept_intersection")
    return f.withColumn("drop_reason", reason).drop("passing", "k")


@Q.add("c07_min_over_models", f"WITH {LABELLED}, r AS (SELECT model_key, relation_key, count(*) n FROM labelled GROUP BY 1,2) SELECT relation_key, min(n) AS least FROM r GROUP BY 1 HAVING min(n) >= 2 AND count(*) = (SELECT count(DISTINCT model_key) FROM r)")
def c07(spark, sf):
    r = labelled(spark, sf).groupBy("model_key", "relation_key").agg(F.count("*").alias("n"))
    k = r.agg(F.countDistinct("model_key").alias("k"))
    return r.groupBy("relation_key").agg(F.min("n").alias("least"), F.count("*").alias("m")).join(F.broadcast(k)).where("least >= 2 AND m = k").select("relation_key", "least")


# What a failed judge call leaves as its reason.
FAILED_CALLS = [r"Gemini call failed", r"RESOURCE_EXHAUSTED", r"Quota exceeded", r"generate_requests_per_model_per_day", r"\b429\b", r"NOT_FOUND", r"rate limit"]


def needs_rejudge(label, confidence, reason, mode: str):
    """Rows that a judge should see again: unknown, failed, needs_rationale or all."""
    unknown = F.lower(label) == "unknown"
    failed = unknown | (F.coalesce(finite(confidence), F.lit(0.0)) <= 0) | F.rlike(F.coalesce(reason, F.lit("")), F.lit("(?i)" + "|".join(FAILED_CALLS)))
    empty = F.coalesce(F.trim(reason), F.lit("")).isin("") | F.lower(reason).isin("nan", "none")
    bare = failed | empty | F.startswith(F.lower(F.coalesce(reason, F.lit(""))), F.lit("repaired_by="))
    return {"unknown": unknown, "failed": failed, "needs_rationale": bare, "all": F.lit(True)}[mode]


@Q.add("c08_needs_rejudge", "SELECT event_id, event_id % 7 = 0 AS unknown, event_id % 7 = 0 OR value <= 20 OR event_type = 'error' AS failed, event_id % 7 = 0 OR value <= 20 OR event_type = 'error' OR event_id % 5 = 0 AS needs_rationale FROM events")
def c08(spark, sf):
    e = read(spark, sf, "events")
    label = F.when(F.col("event_id") % 7 == 0, "Unknown").otherwise("REFUSAL")
    conf, reason = F.greatest(F.lit(0.0), F.col("value") - 20), F.when(F.col("event_id") % 5 == 0, " ").otherwise(F.col("event_type"))
    reason = F.when(F.col("event_type") == "error", "HTTP 429: rate limit").otherwise(reason)
    return e.select("event_id", *[needs_rejudge(label, conf, reason, m).alias(m) for m in ("unknown", "failed", "needs_rationale")])


@Q.add("c10_verdict_outputs", f"WITH {LABELLED} SELECT CASE WHEN n_chars < 500 THEN 'matched' WHEN n_chars < 1000 THEN 'ambiguous' ELSE 'clean' END AS verdict, count(*) AS n FROM labelled GROUP BY 1")
def c10(spark, sf):
    v = F.when(F.col("n_chars") < 500, "matched").when(F.col("n_chars") < 1000, "ambiguous").otherwise("clean")
    return labelled(spark, sf).groupBy(v.alias("verdict")).agg(F.count("*").alias("n"))


@Q.add("c11_cohort_filter", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey < 100000 AND c_acctbal > 0")
def c11(spark, sf):
    return read(spark, sf, "customer").where("c_mktsegment = 'BUILDING' AND c_custkey < 100000 AND c_acctbal > 0").select("c_custkey", "c_name")


# --- D: joins ---------------------------------------------------------------


@Q.add("d01_inner_composite", "SELECT a.l_orderkey, a.l_linenumber, b.l_tax FROM lineitem a JOIN lineitem b USING (l_orderkey, l_linenumber) WHERE a.l_quantity > 45")
def d01(spark, sf):
    li = read(spark, sf, "lineitem")
    return li.where("l_quantity > 45").select("l_orderkey", "l_linenumber").join(li.select("l_orderkey", "l_linenumber", "l_tax"), ["l_orderkey", "l_linenumber"])


@Q.add("d02_left", "SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def d02(spark, sf):
    o = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return read(spark, sf, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"))


@Q.add("d03_different_names", "SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def d03(spark, sf):
    n = read(spark, sf, "nation").withColumnRenamed("n_nationkey", "s_nationkey")
    return read(spark, sf, "supplier").join(n, "s_nationkey", "left").select("s_suppkey", "n_name")


@Q.add("d04_validated_join", "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey")
def d04(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return guards.checked_join(read(spark, sf, "orders").select("o_orderkey", "o_custkey"), c, ["o_custkey"]).drop("o_custkey")


@Q.add("d05_duplicate_keys", "SELECT l_suppkey, l_partkey, count(*) AS n_rows FROM lineitem GROUP BY 1,2 HAVING count(*) > 1")
def d05(spark, sf):
    return guards.duplicates(read(spark, sf, "lineitem"), ["l_suppkey", "l_partkey"])


@Q.add("d06_unmatched", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def d06(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return guards.unmatched(read(spark, sf, "customer").select("c_custkey"), o, ["c_custkey"])


@Q.add("d07_last_key_wins", "SELECT c_custkey, p FROM customer JOIN (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) p FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def d07(spark, sf):
    o = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderpriority", "o_orderkey").alias("p"))
    return read(spark, sf, "customer").select("c_custkey").join(o, "c_custkey")


@Q.add("d08_first_key_wins", "SELECT c_custkey, p FROM customer JOIN (SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) p FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def d08(spark, sf):
    o = ranking.dedup_first(read(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.col("o_orderpriority").alias("p")), ["c_custkey"], "o_orderkey")
    return read(spark, sf, "customer").select("c_custkey").join(o, "c_custkey").select("c_custkey", "p")


@Q.add("d09_fallback_chain", "SELECT s_suppkey, coalesce(c.c_mktsegment, n.n_name) AS v FROM supplier LEFT JOIN customer c ON c_custkey = s_suppkey * 20 LEFT JOIN nation n ON n_nationkey = s_nationkey")
def d09(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("k"), "c_mktsegment")
    n = read(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    s = read(spark, sf, "supplier").withColumn("k", F.col("s_suppkey") * 20)
    return s.join(c, "k", "left").join(n, "s_nationkey", "left").select("s_suppkey", F.coalesce("c_mktsegment", "n_name").alias("v"))


@Q.add("d10_positional", "WITH a AS (SELECT l_suppkey k, l_orderkey a, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) rn FROM lineitem), b AS (SELECT l_suppkey k, l_partkey b, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey, l_orderkey, l_linenumber) rn FROM lineitem) SELECT k, rn - 1 AS pos, a, b FROM a JOIN b USING (k, rn)")
def d10(spark, sf):
    li = read(spark, sf, "lineitem")
    pos = lambda *o: ranking.position(["l_suppkey"], o).cast("long").alias("pos")
    a = li.select(F.col("l_suppkey").alias("k"), F.col("l_orderkey").alias("a"), pos("l_orderkey", "l_linenumber"))
    b = li.select(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("b"), pos("l_partkey", "l_orderkey", "l_linenumber"))
    return a.join(b, ["k", "pos"])


@Q.add("d11_semi", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)")
def d11(spark, sf):
    return read(spark, sf, "part").select("p_partkey").join(read(spark, sf, "lineitem").where("l_quantity >= 50").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi")


@Q.add("d12_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def d12(spark, sf):
    return read(spark, sf, "documents").select("doc_id").join(read(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@Q.add("d13_outer_driven_merge", "SELECT d.doc_id, d.n_chars, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def d13(spark, sf):
    return read(spark, sf, "documents").select("doc_id", "n_chars").join(read(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")


@Q.add("d14_pool_product", "SELECT r_name AS a, n_name AS b FROM region, nation")
def d14(spark, sf):
    """The product of two token pools, parameter tables of known size."""
    a, b = read(spark, sf, "region").select(F.col("r_name").alias("a")), read(spark, sf, "nation").select(F.col("n_name").alias("b"))
    return b.crossJoin(F.broadcast(a)).select("a", "b")


@Q.add("d16_threshold_grid", f"WITH {LABELLED}, r AS (SELECT model_key, relation_key, count(*) n FROM labelled GROUP BY 1,2) SELECT model_key, t.t AS threshold, count(*) AS n_rel FROM r JOIN (SELECT unnest(range(0, 21, 5)) AS t) t ON n >= t.t GROUP BY 1,2")
def d16(spark, sf):
    """Every threshold at once: each row is entered under the grid points it passes."""
    r = labelled(spark, sf).groupBy("model_key", "relation_key").agg(F.count("*").alias("n"))
    passed = F.explode(F.filter(F.array(*[F.lit(t).cast("long") for t in range(0, 21, 5)]), lambda t: t <= F.col("n"))).alias("threshold")
    return r.select("model_key", passed).groupBy("model_key", "threshold").agg(F.count("*").alias("n_rel"))


@Q.add("d17_variant_comparison", "WITH a AS (SELECT l_suppkey k, avg(l_discount) x FROM lineitem WHERE l_linestatus='O' GROUP BY 1), b AS (SELECT l_suppkey k, avg(l_discount) y FROM lineitem WHERE l_linestatus='F' GROUP BY 1) SELECT count(*) AS n, round(corr(x,y),6) AS r, round(avg(abs(x-y)),6) AS mean_abs, round(max(abs(x-y)),6) AS max_abs FROM a JOIN b USING (k)")
def d17(spark, sf):
    from quern.functions.correlation import pearson

    li = read(spark, sf, "lineitem")
    side = lambda s, name: li.where(F.col("l_linestatus") == s).groupBy("l_suppkey").agg(F.avg("l_discount").alias(name))
    gap = F.abs(F.col("x") - F.col("y"))
    return side("O", "x").join(side("F", "y"), "l_suppkey").agg(F.count("*").alias("n"), _r(pearson(F.col("x"), F.col("y")), "r"), _r(F.avg(gap), "mean_abs"), _r(F.max(gap), "max_abs"))


@Q.add("d18_fuzzy_best_match")
def d18(spark, sf):
    """The most similar supplier name for each customer, among those of the nation; SQL has no such similarity."""
    c = read(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("a"), F.col("c_nationkey").alias("k"))
    s = read(spark, sf, "supplier").select(F.col("s_name").alias("b"), F.col("s_nationkey").alias("k"))
    return guards.null_safe_join(c, fuzzy.best_matches(c, s, ["k"], "a", "b"), ["k", "a"]).select("c_custkey", "best", _r(F.col("score"), "score"))


@Q.add("d19_layer_grid", "SELECT a.p_size AS subject_layer, b.p_size AS object_layer FROM (SELECT DISTINCT p_size FROM part) a JOIN (SELECT DISTINCT p_size FROM part) b ON b.p_size > a.p_size")
def d19(spark, sf):
    """Every pair of sizes of which the second is larger: a grid of parameters, each entered with those above it."""
    p = read(spark, sf, "part").where("p_size IS NOT NULL").select("p_size").distinct()
    above = F.filter(F.lit([r[0] for r in p.limit(10_001).collect()]).cast("array<int>"), lambda x: x > F.col("p_size"))
    return p.select(F.col("p_size").alias("subject_layer"), F.explode(above).alias("object_layer"))


@Q.add("d20_null_aware_difference", "SELECT d.doc_id, d.doc_id % 3 - nullif(l.quality, 0) AS diff FROM documents d JOIN labels l USING (doc_id)")
def d20(spark, sf):
    return read(spark, sf, "documents").select("doc_id").join(read(spark, sf, "labels"), "doc_id").select("doc_id", (F.col("doc_id") % 3 - F.nullif("quality", F.lit(0))).alias("diff"))


@Q.add("d21_null_safe_join", "WITH a AS (SELECT CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_nationkey % 5 END k, n_name FROM nation), b AS (SELECT CASE WHEN r_regionkey = 0 THEN NULL ELSE r_regionkey END k, r_name FROM region) SELECT a.k, n_name, r_name FROM a JOIN b ON a.k IS NOT DISTINCT FROM b.k")
def d21(spark, sf):
    a = read(spark, sf, "nation").select(F.nullif(F.col("n_nationkey") % 5, F.lit(0)).alias("k"), "n_name")
    b = read(spark, sf, "region").select(F.nullif("r_regionkey", F.lit(0)).alias("k"), "r_name")
    return guards.null_safe_join(a, b, ["k"])


# --- F: windows -------------------------------------------------------------


@Q.add("f02_average_rank", f"WITH {POINTS} SELECT id, grp, rank() OVER (PARTITION BY grp ORDER BY w) + (count(*) OVER (PARTITION BY grp, w) - 1) / 2.0 AS rk FROM points")
def f02(spark, sf):
    return ordering.average_ranks(points(spark, sf), ["grp"], "w", "rk").select("id", "grp", "rk")


@Q.add("f03_group_demean", f"WITH {POINTS} SELECT id, grp, round(x - avg(x) OVER (PARTITION BY grp), 6) AS dx FROM points")
def f03(spark, sf):
    return points(spark, sf).select("id", "grp", _r(ranking.demean("x", ["grp"]), "dx"))


@Q.add("f04_equal_count_bins", f"WITH {POINTS}, b AS (SELECT *, ntile(5) OVER (PARTITION BY grp ORDER BY x, id) AS bin FROM points) SELECT grp, bin::INT AS bin, count(*) AS n, round(min(x),6) AS lo, round(max(x),6) AS hi, {_wilson_sql('count(*) FILTER (z > 0.05)', 'count(*)', True)} AS ci_high FROM b GROUP BY 1,2")
def f04(spark, sf):
    b = ordering.equal_count_bins(points(spark, sf), ["grp"], ["x", "id"], 5)
    return b.groupBy("grp", "bin").agg(F.count("*").alias("n"), _r(F.min("x"), "lo"), _r(F.max("x"), "hi"), _r(wilson(F.count_if(F.col("z") > 0.05), F.count("*"), True), "ci_high"))


@Q.add("f05_group_head", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) rn FROM orders) WHERE rn <= 2")
def f05(spark, sf):
    return ranking.first_rows(read(spark, sf, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 2).select("o_custkey", "o_orderkey")


@Q.add("f07_duplicate_mask", "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_suppkey, l_quantity) > 1 AS dup FROM lineitem")
def f07(spark, sf):
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.count("*").over(Window.partitionBy("l_suppkey", "l_quantity")) > 1).alias("dup"))


@Q.add("f08_leave_one_out", f"WITH {POINTS}, p AS (SELECT a.grp, a.id, corr(b.x, b.y) AS r FROM points a JOIN points b ON a.grp = b.grp AND a.id <> b.id GROUP BY 1,2) SELECT grp, id, round(r, 6) AS r_without FROM p")
def f08(spark, sf):
    return ranking.leave_one_out(points(spark, sf), ["grp"], "x", "y").select("grp", "id", F.round("r_without", 6).alias("r_without"))


# --- G: sort and top-k ------------------------------------------------------


@Q.add("g01_mixed_sort_top", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_returnflag, l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25")
def g01(spark, sf):
    return read(spark, sf, "lineitem").orderBy("l_returnflag", F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(25).select("l_orderkey", "l_linenumber", "l_extendedprice")


@Q.add("g01_mixed_sort", "SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_returnflag, l_extendedprice DESC, l_orderkey, l_linenumber) AS pos FROM lineitem")
def g01w(spark, sf):
    """The place of every line in an order by four keys, one of them descending, without a window over all lines."""
    li = read(spark, sf, "lineitem").select("l_returnflag", (-F.col("l_extendedprice")).alias("down"), "l_orderkey", "l_linenumber")
    placed = ordering.Ordered(li, [], ["l_returnflag", "down", "l_orderkey", "l_linenumber"]).places()
    return placed.select("l_orderkey", "l_linenumber", (F.col("before") + 1).alias("pos"))


@Q.add("g02_custom_order", "SELECT o_orderkey, row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderkey) AS pos FROM orders")
def g02(spark, sf):
    """Places in a custom order: those before a block of 4096 keys, and those inside it, so that no window spans a category."""
    o = read(spark, sf, "orders").select("o_orderkey", ranking.order_by_list(F.col("o_orderstatus"), ["P", "O"]).alias("cat"), F.floor(F.col("o_orderkey") / 4096).alias("block"))
    sizes = o.groupBy("cat", "block").agg(F.count("*").alias("n"))
    before = sizes.select("cat", "block", (F.sum("n").over(Window.orderBy("cat", "block")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("cat", "block").orderBy("o_orderkey"))
    return o.join(before, ["cat", "block"]).select("o_orderkey", (F.col("before") + inside).alias("pos"))


@Q.add("g03_global_top", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def g03(spark, sf):
    return read(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")


@Q.add("g04_two_sided_extremes", "SELECT o_custkey, o_orderkey, side FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) hi, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) lo FROM orders), (SELECT unnest(['top','bottom']) AS side) WHERE (side='top' AND hi<=1) OR (side='bottom' AND lo<=1)")
def g04(spark, sf):
    o = read(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    top = ranking.first_rows(o, ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"]).withColumn("side", F.lit("top"))
    low = ranking.first_rows(o, ["o_custkey"], ["o_totalprice", "o_orderkey"]).withColumn("side", F.lit("bottom"))
    return top.unionByName(low).drop("o_totalprice")


#: Categories of orders by what they must be and the number that sorts them, ascending; several want the same rows.
PICKS = [
    ("1 priciest", "true", "-o_totalprice"), ("2 oldest", "true", "day"), ("3 priciest open", "o_orderstatus = 'O'", "-o_totalprice"), ("4 newest", "true", "-day"),
    ("5 cheapest", "true", "o_totalprice"), ("6 priciest of the rest", "true", "-o_totalprice"), ("7 oldest closed", "o_orderstatus = 'F'", "day"), ("8 oldest of the rest", "true", "day"),
]


def _picks_sql() -> str:
    out = ["o AS (SELECT o_orderpriority, o_orderkey, o_orderstatus, o_totalprice, date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::DOUBLE AS day FROM orders)"]
    for i, (name, what, number) in enumerate(PICKS):
        used = " AND ".join(["true", *[f"(o_orderpriority, o_orderkey) NOT IN (SELECT o_orderpriority, o_orderkey FROM p{j})" for j in range(i)]])
        out.append(f"p{i} AS (SELECT o_orderpriority, '{name}' AS category, o_orderkey FROM o WHERE {what} AND {used} QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY {number}, o_orderkey) = 1)")
    return "WITH " + ", ".join(out) + " " + " UNION ALL ".join(f"SELECT * FROM p{i}" for i in range(len(PICKS)))


@Q.add("g06_pick_without_reuse", _picks_sql())
def g06(spark, sf):
    """One order for each of eight categories, none twice, in every priority."""
    o = read(spark, sf, "orders").withColumn("day", F.unix_date(F.col("o_orderdate").cast("date")).cast("double"))
    each = [x for name, what, number in PICKS for x in (F.lit(name), F.expr(what), F.expr(number))]
    pools = o.select("o_orderpriority", "o_orderkey", F.stack(F.lit(len(PICKS)), *each).alias("category", "wanted", "number")).where("wanted").drop("wanted")
    return ranking.pick_one_each(pools, ["o_orderpriority"], "category", "o_orderkey", ["number"])


@Q.add("g07_frequent_values", "SELECT l_suppkey, l_partkey, n FROM (SELECT l_suppkey, l_partkey, count(*) n, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_partkey) rn FROM lineitem GROUP BY 1,2) WHERE rn <= 8")
def g07(spark, sf):
    c = read(spark, sf, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))
    return ranking.first_rows(c, ["l_suppkey"], [F.desc("n"), "l_partkey"], 8)


@Q.add("g08_groups_by_aggregate", "SELECT l_suppkey, round(avg(l_discount),6) AS d FROM lineitem GROUP BY 1 ORDER BY avg(l_discount) DESC, 1")
def g08(spark, sf):
    return read(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.avg("l_discount").alias("a")).orderBy(F.desc("a"), "l_suppkey").select("l_suppkey", _r(F.col("a"), "d"))


# --- H: set operations ------------------------------------------------------


@Q.add("h01_union_aligned", "SELECT n_name AS name, n_regionkey AS region, NULL::DOUBLE AS bal FROM nation UNION ALL SELECT s_name, NULL, s_acctbal FROM supplier")
def h01(spark, sf):
    a = read(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    b = read(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    return a.unionByName(b, allowMissingColumns=True)


@Q.add("h02_distinct_keep_first", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def h02(spark, sf):
    return ranking.dedup_first(read(spark, sf, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey")


@Q.add("h03_intersect", "SELECT l_partkey FROM lineitem WHERE l_returnflag='R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag='A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag='N'")
def h03(spark, sf):
    """Keys that every group has, in one pass."""
    flags = read(spark, sf, "lineitem").where(F.col("l_returnflag").isin("R", "A", "N")).groupBy("l_partkey").agg(F.countDistinct("l_returnflag").alias("k"))
    return flags.where("k = 3").select("l_partkey")


@Q.add("h04_except", "SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem")
def h04(spark, sf):
    return read(spark, sf, "part").select("p_partkey").exceptAll(read(spark, sf, "lineitem").select("l_partkey").distinct()).distinct()


@Q.add("h05_ordered_dedup", "SELECT conv_id, list_aggregate(list_distinct(list(role)), 'count') AS n_roles FROM conversations GROUP BY 1")
def h05(spark, sf):
    c = read(spark, sf, "conversations")
    roles = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]))
    return c.groupBy("conv_id").agg(F.size(roles).cast("long").alias("n_roles"))
