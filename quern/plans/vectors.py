"""Vector queries: cosines, linearity, prototypes, retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import vectors as V
from quern.functions.numeric import rounded
from quern.operators import linearity as L
from quern.operators import spans as S

from .inputs import TRIPLES, triples
from .registry import Queries, read

Q = Queries()
QUERIES, SQL = Q.QUERIES, Q.SQL
KEY = ["relation_key"]

DIRECTION = f"""{TRIPLES}, dims AS (SELECT relation_key, i, avg(o[i] - s[i]) AS v FROM triples, range(1, 65) r(i) WHERE split = 'train' GROUP BY 1, 2),
dir AS (SELECT relation_key, list(v ORDER BY i) AS d FROM dims GROUP BY 1),
moved AS (SELECT *, [x[1] + x[2] for x in list_zip(s, d)] AS hat FROM triples JOIN dir USING (relation_key)),
scored AS (SELECT *, list_cosine_similarity(s, o) AS base_cos, list_cosine_similarity(hat, o) AS cos, list_sum([(x[1]-x[2])*(x[1]-x[2]) for x in list_zip(hat, o)]) / len(o) AS err FROM moved)"""


def _rounded(df, places=6, skip=()):
    return df.select(*[rounded(F.col(c), places).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes])


def _gold(spark, sf):
    """Triples with a gold label: five objects in each relation."""
    return triples(spark, sf).withColumn("gold", F.concat(F.lit("g"), F.col("id") % 5))


GOLD = f"{DIRECTION}, gold AS (SELECT *, 'g' || (id % 5) AS gold FROM moved)"


@Q.add("k05_delta_cos_summary", f"WITH {DIRECTION} SELECT relation_key, (SELECT count(*) FROM triples t WHERE t.relation_key = scored.relation_key) AS n_total, count(*) AS n_test, round(avg(base_cos),6) AS base_cos_mean, round(avg(cos),6) AS cos_mean, round(avg(cos - base_cos),6) AS delta_cos, round(any_value(sqrt(list_sum([x*x for x in d]))),6) AS direction_norm FROM scored WHERE split = 'test' GROUP BY 1")
def k05(spark, sf):
    """The gain in cosine that each relation's mean difference gives on test rows."""
    return _rounded(L.summary(triples(spark, sf), KEY).select("relation_key", "n_total", "n_test", "base_cos_mean", "cos_mean", "delta_cos", "direction_norm"))


@Q.add("k01_cosine_rules", "WITH p AS (SELECT vec_id, embedding::DOUBLE[] a, lead(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) b FROM embeddings), n AS (SELECT vec_id, list_dot_product(a, b) d, sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)) m FROM p WHERE b IS NOT NULL) SELECT vec_id, round(d/m,6) AS c_none, round(d/(m+1e-12),6) AS c_add, round(d/greatest(m,1e-8),6) AS c_clamp FROM n")
def k01(spark, sf):
    t = triples(spark, sf)
    return t.select(F.col("id").alias("vec_id"), *[F.round(V.cosine(F.col("s"), F.col("o"), r), 6).alias(f"c_{r}") for r in ("none", "add", "clamp")])


@Q.add("k02_mean_pool", "WITH u AS (SELECT label, i, avg(embedding[i]::DOUBLE) v FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2) SELECT label, list(round(v, 6) ORDER BY i) AS pooled FROM u GROUP BY 1")
def k02(spark, sf):
    m = V.mean_vector(read(spark, sf, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v")), ["label"], "v", "pooled")
    return m.select("label", F.transform("pooled", lambda x: rounded(x)).alias("pooled"))


_WORDS = "len(regexp_extract_all({0}, '\\S+'))"


def _word_range_sql(at: str, width: int) -> tuple[str, str]:
    """First and last word that a span touches, by the words that end before and begin before it."""
    cut = f"(regexp_matches(left(text, {at}), '\\S$') AND regexp_matches(substr(text, {at} + 1, 1), '\\S'))::INT"
    return f"{_WORDS.format(f'left(text, {at})')} - {cut}", f"{_WORDS.format(f'left(text, {at} + {width})')} - 1"


_K03 = [*_word_range_sql("first_at", 6), *_word_range_sql("last_at", 6)]


@Q.add(
    "k03_span_to_tokens",
    f"""WITH d AS (SELECT doc_id, text, CASE WHEN strpos(text, 'of the') > 0 THEN strpos(text, 'of the') - 1 END AS first_at, CASE WHEN strpos(text, 'of the') > 0 THEN length(text) - strpos(reverse(text), 'eht fo') - 5 END AS last_at FROM documents)
    SELECT doc_id, first_at, last_at, {_K03[0]} AS first_from, {_K03[1]} AS first_to, {_K03[2]} AS last_from, {_K03[3]} AS last_to FROM d""",
)
def k03(spark, sf):
    """The first and last place of two words in each document, often inside longer words, and the words that these places touch."""
    d = read(spark, sf, "documents").select("doc_id", "text", *[S.span_start(F.col("text"), F.lit("of the"), w).cast("long").alias(f"{w}_at") for w in ("first", "last")])
    words = [S.words_of(F.col("text"), F.col(f"{w}_at"), F.col(f"{w}_at") + 6).alias(w) for w in ("first", "last")]
    ends = [F.col(f"{w}.{side}").cast("long").alias(f"{w}_{name}") for w in ("first", "last") for side, name in (("first", "from"), ("last", "to"))]
    return d.select("doc_id", "first_at", "last_at", *words).select("doc_id", "first_at", "last_at", *ends)


#: The third word of each turn, and the turn as a special token and pieces of five characters.
_PIECES = """turns AS (SELECT conv_id, turn, text, split_part(text, ' ', 3) AS span FROM conversations),
placed AS (SELECT *, CASE WHEN strpos(text, span) > 0 AND span <> '' THEN strpos(text, span) - 1 END AS f, CASE WHEN strpos(text, span) > 0 AND span <> '' THEN length(text) - strpos(reverse(text), reverse(span)) - length(span) + 1 END AS l FROM turns),
touched AS (SELECT conv_id, turn, 'first' AS which, [x + 1 for x in range(f // 5, (f + length(span) - 1) // 5 + 1)] AS tokens FROM placed
  UNION ALL SELECT conv_id, turn, 'last', [x + 1 for x in range(l // 5, (l + length(span) - 1) // 5 + 1)] FROM placed)"""


def _piece_spans(spark, sf):
    c = read(spark, sf, "conversations").select("conv_id", "turn", "text", F.split_part("text", F.lit(" "), F.lit(3)).alias("span"))
    n = F.length("text")
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(n / 5).cast("int") - 1)), lambda i: F.struct((i * 5).alias("start"), F.least(i * 5 + 5, n).alias("end")))
    special = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end")))
    c = c.withColumn("offsets", F.concat(special, pieces)).withColumn("which", F.explode(F.array(F.lit("first"), F.lit("last"))))
    at = F.when(F.col("which") == "first", S.span_start(F.col("text"), F.col("span"), "first")).otherwise(S.span_start(F.col("text"), F.col("span"), "last"))
    c = c.withColumn("at", at)
    return c.select("conv_id", "turn", "which", S.overlapping(F.col("offsets"), F.col("at"), F.col("at") + F.length("span")).alias("tokens"))


@Q.add("k03_span_to_pieces", f"WITH {_PIECES} SELECT conv_id, turn, which, tokens FROM touched")
def k03p(spark, sf):
    """Pieces of five characters that a turn's third word touches, at its first and last place."""
    return _piece_spans(spark, sf).withColumn("tokens", F.col("tokens").cast("array<long>"))


@Q.add(
    "k02_span_pool",
    f"""WITH {_PIECES}, n AS (SELECT count(*) AS n FROM embeddings), each_one AS (SELECT conv_id, turn, which, unnest(tokens) AS token FROM touched),
    dims AS (SELECT conv_id, turn, which, i, avg(embedding[i]::DOUBLE) AS v, count(*) AS k FROM each_one, n, embeddings, range(1, 65) r(i) WHERE vec_id = token % n.n GROUP BY 1, 2, 3, 4)
    SELECT conv_id, turn, which, max(k) AS n_tokens, list(round(v, 6) ORDER BY i) AS pooled FROM dims GROUP BY 1, 2, 3""",
)
def k02s(spark, sf):
    """Mean vector of the pieces that a span touches; a piece's vector is the embedding of its place in the turn."""
    e = read(spark, sf, "embeddings").select(F.col("vec_id").cast("int").alias("token"), F.col("embedding").cast("array<double>").alias("v"))
    n = e.count()
    at = F.transform("tokens", lambda i: i % F.lit(max(1, n)))
    spans = _piece_spans(spark, sf).withColumn("tokens", at)
    m = S.pool_rows(spans, ["conv_id", "turn", "which"], "tokens", e, [], "token", "v")
    return m.select("conv_id", "turn", "which", "n_tokens", F.transform("pooled", lambda x: rounded(x)).alias("pooled"))


@Q.add("k04_direction", f"WITH {DIRECTION} SELECT relation_key, [round(x, 6) for x in d] AS direction FROM dir")
def k04(spark, sf):
    return L.directions(triples(spark, sf), KEY).select("relation_key", F.transform("direction", lambda x: rounded(x)).alias("direction"))


@Q.add("k05_per_triple", f"WITH {DIRECTION} SELECT id, relation_key, split, round(base_cos,6) AS base_cos, round(cos,6) AS cos, round(cos-base_cos,6) AS delta_cos FROM scored")
def k05t(spark, sf):
    return _rounded(L.scored(triples(spark, sf), KEY).select("id", "relation_key", "split", "base_cos", "cos", "delta_cos"))


@Q.add("k06_linearity_summary", f"WITH {DIRECTION} SELECT relation_key, count(*) AS n_test, round(avg(cos),6) AS cos_mean, round(stddev_pop(cos),6) AS cos_std, round(stddev_pop(base_cos),6) AS base_cos_std, round(avg(err),6) AS mse FROM scored WHERE split='test' GROUP BY 1")
def k06(spark, sf):
    return _rounded(L.summary(triples(spark, sf), KEY).select("relation_key", "n_test", "cos_mean", "cos_std", "base_cos_std", "mse"))


@Q.add("k07_norm_diagnostics", f"WITH {DIRECTION} SELECT relation_key, round(any_value(sqrt(list_dot_product(d,d))),6) AS dir_l2, round(avg(sqrt(list_dot_product(s,s))),6) AS subj_l2, round(sqrt(avg(list_dot_product(o,o)/64)),6) AS obj_rms, round(sqrt(avg(list_dot_product(hat,hat)/64))/(sqrt(avg(list_dot_product(o,o)/64))+1e-12),6) AS ratio_hat_obj, round(sqrt(avg(err))/(sqrt(avg(list_dot_product(o,o)/64))+1e-12),6) AS nrmse FROM scored WHERE split='test' GROUP BY 1")
def k07(spark, sf):
    return _rounded(L.norms(triples(spark, sf), KEY).select("relation_key", "dir_l2", "subj_l2", "obj_rms", "ratio_hat_obj", "nrmse"))


@Q.add("k08_affine_ridge")
def k08(spark, sf):
    """Cosine of ridge-mapped subjects with their objects; a linear solve that SQL lacks."""
    t = triples(spark, sf)
    a = L.affine(t, KEY).join(t.select("relation_key", "id", "o"), ["relation_key", "id"])
    return _rounded(a.groupBy("relation_key").agg(F.count("*").alias("n_test"), F.avg(V.cosine(F.col("inferred"), F.col("o"))).alias("cos_affine")))


PROTO = f"""{GOLD}, pd AS (SELECT relation_key, gold AS label, i, avg(o[i]) v FROM gold, range(1, 65) r(i) WHERE split = 'train' GROUP BY ALL),
proto AS (SELECT relation_key, label, list(v ORDER BY i) p FROM pd GROUP BY 1, 2),
ranks AS (SELECT g.relation_key, g.id, g.gold, label, {{score}} AS score FROM gold g JOIN proto USING (relation_key) WHERE split = 'test'),
placed AS (SELECT *, row_number() OVER (PARTITION BY relation_key, id ORDER BY score DESC, label) rk FROM ranks),
golds AS (SELECT relation_key, id, max(rk) FILTER (label = gold) rk, count(*) m FROM placed GROUP BY 1, 2)"""
COS, SUBJ, EUC = "list_cosine_similarity(hat, p)", "list_cosine_similarity(s, p)", "-list_distance(hat, p)"


@Q.add("k09_prototypes", f"WITH {PROTO.format(score=COS)} SELECT relation_key, label AS gold, round(sqrt(list_dot_product(p, p)), 6) AS proto_norm FROM proto")
def k09(spark, sf):
    p = L.prototypes(_gold(spark, sf), KEY, "gold")
    return p.select("relation_key", "gold", F.round(V.norm(F.col("proto")), 6).alias("proto_norm"))


def _ranks(spark, sf, mode, metric="cosine", source="train", k=10):
    g = _gold(spark, sf)
    return L.ranked(L.queries_of(g, KEY, "gold", mode), L.prototypes(g, KEY, "gold", source), KEY, "gold", metric, k)


_GOLD_SQL = "SELECT relation_key, id, rk AS rank, m AS num_candidates FROM golds"
for _name, _mode, _metric, _score in (("translated_cosine", "translated", "cosine", COS), ("subject_cosine", "subject_only", "cosine", SUBJ), ("translated_euclidean", "translated", "euclidean", EUC)):

    def _retrieve(spark, sf, mode=_mode, metric=_metric):
        return L.gold_ranks(_ranks(spark, sf, mode, metric), KEY)

    Q.add(f"k10_retrieval_{_name}", f"WITH {PROTO.format(score=_score)} {_GOLD_SQL}")(_retrieve)


@Q.add("k10_retrieval_affine")
def k10a(spark, sf):
    """Retrieval under the ridge map, among all objects; SQL has no linear solve."""
    return L.gold_ranks(_ranks(spark, sf, "affine_full", source="all"), KEY)


@Q.add("e27_retrieval_metrics", f"WITH {PROTO.format(score=COS)} SELECT relation_key, count(*) AS n_test_total, count(rk) AS n_test_covered, round(avg((rk IS NOT NULL)::INT),6) AS coverage, round(avg((rk<=1)::INT),6) AS hits1, round(avg((rk<=10)::INT),6) AS hits10, round(avg(1/rk),6) AS mrr, round(avg(rk),6) AS mean_rank FROM golds GROUP BY GROUPING SETS ((relation_key),())")
def e27(spark, sf):
    return _rounded(L.metrics(L.gold_ranks(_ranks(spark, sf, "translated"), KEY), KEY))


@Q.add("g05_top_list", f"WITH {PROTO.format(score=COS)} SELECT relation_key, id, list(label ORDER BY rk) AS labels FROM placed WHERE rk <= 3 GROUP BY 1, 2")
def g05(spark, sf):
    return L.top_list(_ranks(spark, sf, "translated", k=3), KEY).select("relation_key", "id", "labels")


@Q.add("c09_rank_predicates", f"WITH {PROTO.format(score=COS)} SELECT id, CASE WHEN rk = 1 THEN 'success' WHEN rk > 3 THEN 'failure' ELSE 'gap' END AS category FROM golds WHERE rk IS NOT NULL")
def c09(spark, sf):
    g = L.gold_ranks(_ranks(spark, sf, "translated"), KEY).where("rank IS NOT NULL")
    return g.select("id", F.when(F.col("rank") == 1, "success").when(F.col("rank") > 3, "failure").otherwise("gap").alias("category"))


@Q.add("k12_delta_cos_ci", f"WITH {DIRECTION}, m AS (SELECT relation_key, count(*) n, avg(cos-base_cos) g, stddev_pop(cos) a, stddev_pop(base_cos) b FROM scored WHERE split='test' GROUP BY 1) SELECT relation_key, round(g - 1.96*sqrt((a*a+b*b)/greatest(n,1)),6) AS lo, round(g + 1.96*sqrt((a*a+b*b)/greatest(n,1)),6) AS hi FROM m")
def k12(spark, sf):
    """Normal interval of the gain, as if the two means were independent."""
    m = L.summary(triples(spark, sf), KEY)
    se = F.sqrt((F.col("cos_std") ** 2 + F.col("base_cos_std") ** 2) / F.greatest("n_test", F.lit(1)))
    return m.select("relation_key", F.round(F.col("delta_cos") - 1.96 * se, 6).alias("lo"), F.round(F.col("delta_cos") + 1.96 * se, 6).alias("hi"))
