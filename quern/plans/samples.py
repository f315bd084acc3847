"""Sampling, splitting and generating."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions.permute import pair_sql
from quern.operators import guards
from quern.operators import sampling as S

from .registry import Queries, read

Q = Queries()
QUERIES, SQL = Q.QUERIES, Q.SQL


_POOLS = """a AS (SELECT p_name AS x, row_number() OVER (ORDER BY p_name) - 1 AS i FROM (SELECT DISTINCT p_name FROM part WHERE p_name IS NOT NULL)),
b AS (SELECT c_name AS y, row_number() OVER (ORDER BY c_name) - 1 AS j FROM (SELECT DISTINCT c_name FROM customer WHERE c_name IS NOT NULL)),
counted AS (SELECT k, (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM b) AS nb FROM range(5000) t(k))"""
_ANCHORED = """drawn AS (SELECT x AS p_name, y AS c_name, k FROM paired JOIN a ON i = l JOIN b ON j = r),
others AS (SELECT p_name, c_name, k, k + 1 - (k > (SELECT coalesce(min(k), 5000) FROM drawn JOIN anchor USING (p_name, c_name)))::BIGINT AS position FROM drawn ANTI JOIN anchor USING (p_name, c_name))
SELECT p_name, c_name, 0 AS position FROM anchor UNION ALL SELECT p_name, c_name, position FROM others WHERE position < 5000"""


@Q.add("m01_product_sample", f"WITH {_POOLS}, anchor AS (SELECT min(p_name) AS p_name, max(c_name) AS c_name FROM part, (SELECT max(c_name) AS c_name FROM customer)), {pair_sql('counted', 'k', 'na', 'nb', '7', 'paired')}, {_ANCHORED}")
def m01(spark, sf):
    """5,000 pairs of a part's and a customer's name, of all that there are, the first part with the last customer in front."""
    p, c = read(spark, sf, "part").select("p_name"), read(spark, sf, "customer").select("c_name")
    anchor = (p.agg(F.min("p_name")).first()[0], c.agg(F.max("c_name")).first()[0])
    return S.product_sample(p, c, 5000, "7", anchor)


@Q.add("m02_sub_seeds", "SELECT label, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('1:' || label || '|' || vec_id), vec_id) rn FROM embeddings) WHERE rn <= 3")
def m02(spark, sf):
    from pyspark.sql import Window

    k = F.md5(F.concat_ws("|", F.concat(F.lit("1:"), F.col("label").cast("string")), F.col("vec_id").cast("string")))
    e = read(spark, sf, "embeddings").select("label", "vec_id")
    return e.withColumn("rn", F.row_number().over(Window.partitionBy("label").orderBy(k, "vec_id"))).where("rn <= 3").drop("rn")


@Q.add("m03_shuffled_prefix", "SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('3|' || o_orderkey), o_orderkey) rn FROM orders) WHERE rn <= 10")
def m03(spark, sf):
    return S.shuffled_prefix(read(spark, sf, "orders").select("o_orderpriority", "o_orderkey"), ["o_orderpriority"], "o_orderkey", 10, "3")


@Q.add("m04_train_test_split", "WITH n AS (SELECT vec_id AS id, label AS relation_key, row_number() OVER (PARTITION BY label ORDER BY md5(vec_id::VARCHAR), vec_id) rn, count(*) OVER (PARTITION BY label) n FROM embeddings) SELECT id, relation_key, CASE WHEN rn <= least(greatest(8, floor(0.75*n)), greatest(1, n-4)) THEN 'train' ELSE 'test' END AS split FROM n")
def m04(spark, sf):
    from .inputs import split_by_hash

    return split_by_hash(read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("relation_key")), ["relation_key"])


@Q.add("m05_clamped_split", "WITH n AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY md5('5|' || o_orderkey), o_orderkey) rn, count(*) OVER (PARTITION BY o_custkey) n FROM orders) SELECT o_custkey, o_orderkey, CASE WHEN rn <= greatest(1, least(n-1, floor(0.75*n))) THEN 'train' ELSE 'test' END AS split FROM n")
def m05(spark, sf):
    return S.split_clamped(read(spark, sf, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey", "5")


@Q.add("m06_fallback_split", "WITH n AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY md5('6|' || o_orderkey), o_orderkey) rn, count(*) OVER (PARTITION BY o_custkey) n FROM orders) SELECT o_custkey, o_orderkey, CASE WHEN rn <= greatest(1, round_even(0.25*n, 0)) THEN 'test' ELSE 'train' END AS split FROM n WHERE n > 1")
def m06(spark, sf):
    return S.split_fallback(read(spark, sf, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey", "6")


@Q.add("m07_capped_sample", "SELECT lang, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('8|' || doc_id), doc_id) rn FROM documents) WHERE rn <= 20")
def m07(spark, sf):
    return S.capped(read(spark, sf, "documents").select("lang", "doc_id"), ["lang"], "doc_id", 20, "8")


@Q.add("m08_annotation_sample", "SELECT doc_id, lang, '' AS manual_label, '' AS note FROM documents ORDER BY md5('9|' || doc_id), doc_id LIMIT 50")
def m08(spark, sf):
    return S.annotation_sample(read(spark, sf, "documents").select("doc_id", "lang"), "doc_id", 50, "9", ["manual_label", "note"])


@Q.add("m09_top_offenders", "SELECT source, count(*) AS n_rows FROM documents GROUP BY 1 HAVING count(*) > 1 ORDER BY n_rows DESC, source LIMIT 5")
def m09(spark, sf):
    return guards.duplicates(read(spark, sf, "documents").select("source"), ["source"]).orderBy(F.desc("n_rows"), "source").limit(5)


@Q.add("m10_entity_generator", "SELECT i AS entity_id, 'Entity ' || lpad(i::VARCHAR, 4, '0') AS name, CASE WHEN i < 150 THEN 'train' ELSE 'heldout' END AS split, 'Entity ' || lpad(i::VARCHAR, 4, '0') || ' plays item ' || (i * 7 % 13) || '.' AS bio FROM range(200) t(i)")
def m10(spark, sf):
    name = F.concat(F.lit("Entity "), F.lpad(F.col("id").cast("string"), 4, "0"))
    e = spark.range(200)
    return e.select(F.col("id").alias("entity_id"), name.alias("name"), F.when(F.col("id") < 150, "train").otherwise("heldout").alias("split"), F.concat(name, F.lit(" plays item "), (F.col("id") * 7 % 13).cast("string"), F.lit(".")).alias("bio"))
