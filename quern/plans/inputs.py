"""The driver tables in the roles of evaluation data, as frames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .registry import read

#: Labels: not labelled is a refusal, toxic or poor an error, else correct.
LABELLED = """labelled AS (
  SELECT d.doc_id, d.lang AS model_key, d.source AS relation_key, d.n_chars,
    CASE WHEN l.doc_id IS NULL THEN 'REFUSAL' WHEN l.toxic = 1 OR l.quality = 0 THEN 'HALLUCINATION' ELSE 'CORRECT' END AS label
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("model_key"), F.col("source").alias("relation_key"), "n_chars")
    marks = read(spark, sf_dir, "labels")
    label = F.when(F.col("quality").isNull() & F.col("toxic").isNull(), "REFUSAL").when((F.col("toxic") == 1) | (F.col("quality") == 0), "HALLUCINATION").otherwise("CORRECT")
    return docs.join(marks, "doc_id", "left").select("doc_id", "model_key", "relation_key", "n_chars", label.alias("label"))


#: Supplier points: x, y and a weight, in groups by line status.
POINTS = """points AS (
  SELECT l_suppkey AS id, l_returnflag AS grp, avg(l_quantity) AS x, avg(l_extendedprice) AS y, avg(l_discount) AS z, count(*)::DOUBLE AS w
  FROM lineitem GROUP BY 1, 2)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem")
    return rows.groupBy(F.col("l_suppkey").alias("id"), F.col("l_returnflag").alias("grp")).agg(F.avg("l_quantity").alias("x"), F.avg("l_extendedprice").alias("y"), F.avg("l_discount").alias("z"), F.count("*").cast("double").alias("w"))


#: Vector triples: subject, object (the next vector of the relation), and split.
TRIPLES = """pairs AS (
  SELECT vec_id AS id, label AS relation_key, embedding::DOUBLE[] AS s, lead(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS o FROM embeddings
), triples AS (
  SELECT id, relation_key, s, o, CASE WHEN rn <= least(greatest(8, floor(0.75 * n)), greatest(1, n - 4)) THEN 'train' ELSE 'test' END AS split FROM (
    SELECT *, row_number() OVER (PARTITION BY relation_key ORDER BY md5(id::VARCHAR), id) AS rn, count(*) OVER (PARTITION BY relation_key) AS n FROM pairs WHERE o IS NOT NULL))"""


def split_by_hash(df: DataFrame, keys: list[str], id_col: str = "id") -> DataFrame:
    """``split``: train for the first max(8, three quarters) of each group in the order of the id's digest, at least four test rows where there are five."""
    w = Window.partitionBy(*keys)
    n = F.count(F.lit(1)).over(w)
    rn = F.row_number().over(w.orderBy(F.md5(F.col(id_col).cast("string")), id_col))
    n_train = F.least(F.greatest(F.lit(8), F.floor(n * F.lit(0.75))), F.greatest(F.lit(1), n - 4))
    return df.withColumn("split", F.when(rn <= n_train, "train").otherwise("test"))


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("relation_key"), F.col("embedding").cast("array<double>").alias("s"))
    pairs = vec.withColumn("o", F.lead("s").over(Window.partitionBy("relation_key").orderBy("id"))).where("o IS NOT NULL")
    return split_by_hash(pairs, ["relation_key"])


#: Questions and answers: a user turn and the assistant turn after it.
ANSWERS = """answers AS (
  SELECT u.conv_id * 1000 + u.turn AS id, u.text AS prompt, a.text AS answer, split_part(u.text, ' ', 1) AS gold
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    u = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return u.join(a, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "prompt", "answer", F.split_part("prompt", F.lit(" "), F.lit(1)).alias("gold"))
