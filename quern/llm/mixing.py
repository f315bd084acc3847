"""Mixing sources to target weights, in DataFrame operations only.

A source's weight is its share of all tokens raised to an exponent, normalised.
The exponent is bisected: first to the entropy asked for (a way between that of
the shares, at exponent 1, and that of equal weights, at 0), then up again if a
source would be repeated more often than allowed. Weight times budget gives a
source's token target; it is met by whole epochs and one part of an epoch, whose
documents come in the order of a keyed digest. The digest's leading digits are
blocks: sums over 4096 blocks, and over 4096 blocks in the one that the target
falls in, find the last document that fits, so no window spans a source.

Tokens are runs of characters other than U+0020 and U+0009 to U+000D.

Defined results: null text has no tokens; a null source is the source with the
empty name; a source without tokens has weight 0 and no copies; repeated rows of a
doc_id, and rows without one, share one place in the order; a very long text that
doesn't fit what is left of its source's target ends the part; columns of the names
that the result adds stay and the result's get underscores; an empty table gives no
rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, free_name, table

SEED = "mix-1"
#: Way from the shares' entropy to the largest, most epochs of a source, budget as a multiple of all tokens.
ENTROPY_WAY, MOST_EPOCHS, BUDGET = 0.5, 2.0, 1.0
#: The same for the pipeline, where every document stays: the budget is the least that holds each source once.
PIPELINE_EPOCHS = 1.5
STEPS = 48


def n_tokens(text: F.Column) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x09-\x0D\x20]+")), F.lit(0)).cast("long")


#: Over ``p``, the shares that occur, ascending, and how many sources have each.
_POWER_SUM = "aggregate(p, 0D, (s, x) -> s + x.k * pow(x.p, {a}))"
_ENTROPY = "(ln({z}) - {a} * aggregate(p, 0D, (s, x) -> s + x.k * pow(x.p, {a}) * ln(x.p)) / {z})"


def _entropy(a: str) -> str:
    return _ENTROPY.format(a=a, z=_POWER_SUM.format(a=a))


def _bisect(low: str, high: str, raise_low: str) -> str:
    """SQL of (lo, hi) after STEPS halvings; ``raise_low`` says of ``mid`` that lo may go there."""
    mid = "((r.lo + r.hi) / 2)"
    return f"aggregate(sequence(1, {STEPS}), struct({low} AS lo, {high} AS hi), (r, k) -> IF({raise_low.format(mid=mid)}, struct({mid} AS lo, r.hi AS hi), struct(r.lo AS lo, {mid} AS hi)))"


def weights(totals: DataFrame, way: float = ENTROPY_WAY, epochs: float = MOST_EPOCHS, budget: float | None = BUDGET) -> DataFrame:
    """(source, n, weight, target, full, rest) from (source, n): token target, whole epochs of it and the tokens left.

    The only gathered row holds the distinct numbers of tokens and how many sources have
    each, no source. ``budget`` None: the least that holds every source once.
    """
    some = totals.where("n > 0")
    row = some.groupBy("n").agg(F.count(F.lit(1)).alias("k")).agg(F.array_sort(F.collect_list(F.struct("n", "k"))).alias("t"))
    row = row.withColumn("total", F.expr("aggregate(t, 0L, (s, x) -> s + x.n * x.k)")).withColumn("p", F.expr("transform(t, x -> struct(x.n / total AS p, x.k AS k))"))
    row = row.withColumn("aim", F.expr(f"(1 - {way}D) * {_entropy('1D')} + {way}D * ln(aggregate(t, 0L, (s, x) -> s + x.k))"))
    row = row.withColumn("a", F.expr(_bisect("0D", "1D", f"{_entropy('{mid}')} >= aim") + ".lo"))
    if budget is None:
        repeats = "pow(p[0].p / element_at(p, -1).p, {a} - 1)"
    else:
        repeats = f"({budget}D * pow(p[0].p, {{a}} - 1) / {_POWER_SUM})"
    over = repeats + f" > {epochs}D"
    row = row.withColumn("a", F.expr(f"IF({over.format(a='a')}, {_bisect('a', '1D', over.replace('{a}', '{mid}'))}.hi, a)"))
    row = row.withColumn("z", F.expr(_POWER_SUM.format(a="a")))
    row = row.withColumn("budget", F.expr("aggregate(t, 0D, (s, x) -> greatest(s, x.n / round(pow(x.n / total, a) / z, 12)))" if budget is None else f"total * {budget}D"))
    found = row.where("size(t) > 0").select("a", "z", "total", "budget").first() or (1.0, 1.0, 1, 0.0)
    a, z, total, tokens = (F.lit(x) for x in found)
    each = some.withColumn("weight", F.round(F.pow(F.col("n") / total, a) / z, 12))
    target = F.floor(F.col("weight") * tokens).cast("long")
    if budget is None:
        target = F.greatest("n", target)
    return each.withColumn("target", target).select("*", F.expr("target div n").alias("full"), F.expr("target % n").alias("rest"))


def _key(doc_id: F.Column, full: F.Column) -> F.Column:
    return F.md5(F.concat_ws("|", F.lit(SEED), full.cast("string"), doc_id.cast("string")))


def _crossing(rows: DataFrame, digits: F.Column) -> DataFrame:
    """Of each source, the block in which the running sum first exceeds ``rest``, and the sum before it."""
    sums = rows.groupBy("source", digits.alias("block")).agg(F.sum("tokens").alias("tokens"), F.max("rest").alias("rest"))
    running = F.sum("tokens").over(Window.partitionBy("source").orderBy("block"))
    first = sums.withColumn("sum", running).where("sum > rest").groupBy("source").agg(F.min(F.struct("block", F.expr("sum - tokens AS before"))).alias("m"))
    return first.select("source", "m.block", "m.before")


def plan(docs: DataFrame, scratch: Scratch, **how) -> DataFrame:
    """(source, weight, full, cut): each source's whole epochs, and the last key of the part of an epoch."""
    base = scratch.keep(docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), n_tokens(F.col("text")).alias("tokens")))
    per_source = scratch.keep(weights(base.groupBy("source").agg(F.sum("tokens").alias("n")), **how))
    keyed = base.join(per_source, "source").select("source", "tokens", "rest", _key(F.col("doc_id"), F.col("full")).alias("key"))
    one = scratch.keep(_crossing(keyed, F.substring("key", 1, 3)))
    inside = keyed.join(one.withColumnRenamed("block", "b1").withColumnRenamed("before", "before1"), "source").where("substring(key, 1, 3) = b1")
    inside = inside.withColumn("rest", F.col("rest") - F.col("before1"))
    two = scratch.keep(_crossing(inside, F.substring("key", 4, 3)))
    last = inside.join(two, "source").where("substring(key, 4, 3) = block")
    fits = last.withColumn("sum", F.sum("tokens").over(Window.partitionBy("source").orderBy("key"))).where("sum <= rest - before")
    cut = fits.groupBy("source").agg(F.max("key").alias("key"))
    cuts = one.select("source", "block").join(two.select("source", F.col("block").alias("second")), "source").join(cut, "source", "left")
    cuts = cuts.select("source", F.coalesce("key", F.concat("block", "second")).alias("cut"))
    return scratch.keep(per_source.join(cuts, "source", "left").select("source", "weight", "full", F.coalesce("cut", F.lit("")).alias("cut")))


def _planned(docs: DataFrame, planned: DataFrame) -> DataFrame:
    """(doc, weight, copies): the documents as structs. Nothing moves but the plan, one row for each source."""
    doc = F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns])
    named = docs.select(doc.alias("doc")).withColumn("source", F.coalesce(F.col("doc")["source"], F.lit("")))
    part = (_key(F.col("doc")["doc_id"], F.col("full")) <= F.col("cut")).cast("long")
    return named.join(planned, "source", "left").select("doc", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce(F.col("full") + part, F.lit(0)).cast("long").alias("copies"))


def copies(docs: DataFrame, planned: DataFrame) -> DataFrame:
    """The documents with ``weight`` and ``copies``, named with underscores behind where the documents have such columns."""
    names = docs.columns
    return _planned(docs, planned).select(*[F.col("doc")[c].alias(c) for c in names], *[F.col(c).alias(free_name(c, names)) for c in ("weight", "copies")])


def realise(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents as often as the mix has them, with their own columns; each at least once."""
    mixed = _planned(docs, plan(docs, Scratch(spark, "mix"), epochs=PIPELINE_EPOCHS, budget=None))
    each = mixed.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest("copies", F.lit(1)))))
    return each.select(*[F.col("doc")[c].alias(c) for c in docs.columns])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of every document of documents in the mix."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = copies(docs, plan(docs, Scratch(spark, "mix")))
    return mixed.select("doc_id", "source", n_tokens(F.col("text")).alias("n_tokens"), "weight", "copies")


OP3_SQL = f"""
WITH RECURSIVE base AS (
  SELECT doc_id, source, coalesce(source, '') AS src,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x09-\\x0D\\x20]+'))::BIGINT AS n_tokens
  FROM documents
), totals AS (
  SELECT src, sum(n_tokens)::BIGINT AS n FROM base GROUP BY src HAVING sum(n_tokens) > 0
), shares AS (
  SELECT list(n / total ORDER BY src) AS p, any_value(total) AS total
  FROM (SELECT *, (sum(n) OVER ())::DOUBLE AS total FROM totals)
), aims AS (
  SELECT p, total, {1 - ENTROPY_WAY}::DOUBLE * -list_sum([x * ln(x) for x in p]) + {ENTROPY_WAY}::DOUBLE * ln(len(p)) AS aim FROM shares
), first_way AS (
  SELECT 0 AS k, p, total, aim, 0::DOUBLE AS lo, 1::DOUBLE AS hi FROM aims
  UNION ALL
  SELECT k + 1, p, total, aim, CASE WHEN h >= aim THEN mid ELSE lo END, CASE WHEN h >= aim THEN hi ELSE mid END FROM (
    SELECT *, ln(z) - mid * list_sum([pow(x, mid) * ln(x) for x in p]) / z AS h FROM (
      SELECT *, list_sum([pow(x, mid) for x in p]) AS z FROM (SELECT *, (lo + hi) / 2 AS mid FROM first_way WHERE k < {STEPS})))
), second_way AS (
  SELECT 0 AS k, p, total, lo AS a, lo, 1::DOUBLE AS hi FROM first_way WHERE k = {STEPS}
  UNION ALL
  SELECT k + 1, p, total, a, CASE WHEN many THEN mid ELSE lo END, CASE WHEN many THEN hi ELSE mid END FROM (
    SELECT *, {BUDGET}::DOUBLE * pow(list_min(p), mid - 1) / list_sum([pow(x, mid) for x in p]) > {MOST_EPOCHS}::DOUBLE AS many
    FROM (SELECT *, (lo + hi) / 2 AS mid FROM second_way WHERE k < {STEPS}))
), exponent AS (
  SELECT p, total, CASE WHEN {BUDGET}::DOUBLE * pow(list_min(p), a - 1) / list_sum([pow(x, a) for x in p]) > {MOST_EPOCHS}::DOUBLE THEN hi ELSE a END AS a
  FROM second_way WHERE k = {STEPS}
), targets AS (
  SELECT src, n, round(pow(n / total, a) / list_sum([pow(x, a) for x in p]), 12) AS weight, total FROM totals, exponent
), parts AS (
  SELECT src, weight, floor(weight * (total * {BUDGET}::DOUBLE))::BIGINT // n AS whole, floor(weight * (total * {BUDGET}::DOUBLE))::BIGINT % n AS rest FROM targets
), placed AS (
  SELECT doc_id, source, n_tokens, weight, whole, rest,
    sum(n_tokens) OVER (PARTITION BY src ORDER BY md5(concat_ws('|', '{SEED}', whole::VARCHAR, doc_id::VARCHAR))) AS upto
  FROM base LEFT JOIN parts USING (src)
)
SELECT doc_id, source, n_tokens, coalesce(weight, 0)::DOUBLE AS weight, coalesce(whole + (upto <= rest)::INT, 0)::BIGINT AS copies FROM placed
"""
