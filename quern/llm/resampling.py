"""Quality by importance resampling.

Words and word pairs are hashed into ``BUCKETS``. Two generative models hold the
smoothed share of each bucket: the target model from documents labelled good and
not toxic (``TARGET_DOCS`` at most), the raw model from all documents. A document's log weight is the sum
over its n-grams of the log ratio. A Gumbel number keyed by the document is added
to the weight, and the documents with the k largest sums are the resample:
drawing without replacement in proportion to the weights. k is the number of
documents times the share of target documents among the labelled ones.

Counts and statistics cover every document. The only things that reach the driver
are tables of fixed size, one number for each bucket or bin.

Defined results: null and empty texts have weight 0; a word is a run of letters,
digits or other characters but space, lower-cased; a doc_id labelled twice is good
if any of its rows is; rows without doc_id draw the same Gumbel number; ties are
broken by doc_id, then by the text's digest; without labels every document is in.
Very long texts are read whole; other columns, whatever their names, are never read;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, blocks, map_arrow, table

BUCKETS = 1 << 18
#: Added to each bucket's count in the target and to that expected from the raw model: rare n-grams tell little.
SMOOTHING = 20.0
SEED = "resample-1"
#: Labelled documents that the target model is fitted on, at most.
TARGET_DOCS = 20_000
#: Buckets of this many words a worker remembers.
CACHE = 300_000
#: Bins of equal width that find the k-th largest sum.
BINS = 4096


class Grams:
    """Bucket numbers of a text's words and word pairs."""

    def __init__(self):
        self.cache: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").lower().encode("utf-8", "surrogatepass").split()
        if not words:
            return np.empty(0, np.int64)
        get = self.cache.get
        h = np.array([get(w) or self._hash(w) for w in words], np.uint64)
        pair = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ h[1:]
        pair ^= pair >> np.uint64(31)
        pair *= np.uint64(0xC2B2AE3D27D4EB4F)
        return np.concatenate([h >> np.uint64(46), pair >> np.uint64(46)]).astype(np.int64)

    def _hash(self, word: bytes) -> int:
        if len(self.cache) >= CACHE:
            self.cache.clear()
        return self.cache.setdefault(word, xxhash.xxh64_intdigest(word, 1) | 1)


assert BUCKETS == 1 << 18  # 64 - 46 bits of a hash


def gumbel(doc_id: int | None) -> float:
    """A standard Gumbel number that depends on the document alone."""
    raw = hashlib.blake2b(f"{SEED}|{doc_id}".encode(), digest_size=8).digest()
    u = (int.from_bytes(raw, "big") + 0.5) / 2.0**64
    return float(-np.log(-np.log(u)))


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """Number of n-grams in each bucket over all documents: summed in each task, then over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, total = Grams(), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for lo, hi in blocks(texts):
                total += np.bincount(np.concatenate([grams(t) for t in texts[lo:hi]]), minlength=BUCKETS)
        k = total.nonzero()[0]
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(total[k])], names=["bucket", "n"])

    out = np.zeros(BUCKETS)
    for r in map_arrow(docs.select("text"), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log of the target model's share of each bucket over the raw model's, counts on the target's scale."""
    expected = raw * (target.sum() / max(1.0, raw.sum()))
    return np.log(target + SMOOTHING) - np.log(expected + SMOOTHING)


def weigh(spark: SparkSession, docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """(doc_id, tie, log_weight, draw) of every document, where it is read; draw is the weight with the Gumbel number."""
    held = spark.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, ratio = Grams(), held.value
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            w = np.array([ratio[grams(t)].sum() for t in texts], float)
            g = np.array([gumbel(k) for k in keys], float)
            ties = [hashlib.md5((t or "").encode("utf-8", "surrogatepass")).hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ties, pa.string()), pa.array(w), pa.array(w + g)], names=["doc_id", "tie", "log_weight", "draw"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, tie string, log_weight double, draw double")


def top(rows: DataFrame, k: int) -> DataFrame:
    """The rows with ``selected``: among the k largest by draw, exactly k of them.

    Bins of the range of draws are counted, again and again inside the bin that holds
    the k-th; only rows of the last one are ranked, so no task sees all rows.
    """
    lo, hi, n = rows.agg(F.min("draw"), F.max("draw"), F.count("*")).first()
    if k >= n:
        return rows.withColumn("selected", F.lit(True))
    if k <= 0:
        return rows.withColumn("selected", F.lit(False))
    left, inside = k, F.lit(True)
    for _ in range(3):
        width = (hi - lo) / BINS
        if width <= 0:
            break
        at = F.least(F.lit(BINS - 1), F.floor((F.col("draw") - lo) / width).cast("int"))
        counts = {r["bin"]: (r["n"], r["lo"], r["hi"]) for r in rows.where(F.col("draw").between(lo, hi)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min("draw").alias("lo"), F.max("draw").alias("hi")).collect()}
        for b in sorted(counts, reverse=True):
            m, lo, hi = counts[b]
            if m >= left:
                break
            left -= m
        if m <= 1000:
            break
    inside = F.col("draw").between(lo, hi)
    rank = F.row_number().over(Window.partitionBy(inside).orderBy(F.desc("draw"), F.asc_nulls_last("doc_id"), "tie"))
    edge = rows.where(inside).withColumn("selected", rank <= left)
    return rows.where(~inside).withColumn("selected", F.col("draw") > hi).unionByName(edge)


def targets(docs: DataFrame, labels: DataFrame, most: int = TARGET_DOCS) -> tuple[DataFrame, float]:
    """Texts of documents labelled good and not toxic, and the share of such among the labelled.

    The target model is fitted on at most ``most`` of them, the first by a digest of
    doc_id; their ids are a bounded table, so that texts stay where they are read.
    """
    marked = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")).alias("good"))
    share = marked.agg(F.avg(F.coalesce("good", F.lit(0)))).first()[0]
    ids = marked.where("good = 1").orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(most).select("doc_id")
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi").select("text"), 1.0 if share is None else float(share)


def resample(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, log_weight, draw, selected) of every document."""
    good, share = targets(docs, labels)
    ratio = log_ratio(bucket_counts(good), bucket_counts(docs))
    rows = Scratch(spark, "resample").keep(weigh(spark, docs, ratio))
    n = rows.count()
    return top(rows, round(n * share)).drop("tie")


def op7_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight and choice of every document of documents."""
    return resample(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
