"""Vector codes by product quantisation, nearest entries by kd-trees.

Vectors become whole numbers and are cut into ``PARTS`` equal parts. Each part position
has a codebook of at most ``ENTRIES`` entries, at first that part of the vectors with
the smallest ids. In every round the driver builds one kd-tree for each codebook and
broadcasts them; tasks search the nearest entry of every part by branch and bound, and
send one whole-number sum and count for each entry they met; the driver divides these
(PARTS x ENTRIES rows, whatever the table's size). A far branch is left out only if its
box is farther than the best found: at an equal bound it is visited, so that of entries
at equal distance the lower index wins.

Defined results: vectors that are null, empty, or hold a null, NaN or infinite component
are dropped; so are those whose length differs from that of the first kept one (smallest
id, then smallest vector) or, if that is no multiple of ``PARTS``, all. Rows without an
id are coded, but start no codebook unless no row has an id; repeated ids are ordered by
their vectors. Components beyond +-``LARGEST`` / 256 count as that, so that no distance
leaves 64 bits. Fewer than ``ENTRIES`` vectors make smaller codebooks. Equal labels are
added up, null labels together. Other columns, whatever their names, are never read; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from .common import Scratch, free_name, map_arrow, table

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
LARGEST = 1 << 26
#: Entries of a leaf of the kd-trees.
LEAF = 8
#: Labels whose sums are broadcast; where there are more, they are joined by shuffle.
MOST_LABELS = 200_000
#: Shares that the rows of one label are dealt to in that shuffle.
SHARES = 32


class Node(NamedTuple):
    """Entries of a box: a leaf's indexes in ascending order, or two halves cut at the median of the widest component."""

    low: np.ndarray
    high: np.ndarray
    entries: np.ndarray | None
    left: Node | None = None
    right: Node | None = None


def kd_tree(book: np.ndarray, entries: np.ndarray | None = None) -> Node:
    """The tree of a codebook (entries x components)."""
    entries = np.arange(len(book)) if entries is None else entries
    held = book[entries]
    low, high = held.min(0), held.max(0)
    if len(entries) <= LEAF or (low == high).all():
        return Node(low, high, np.sort(entries))
    by = entries[np.argsort(held[:, int((high - low).argmax())], kind="stable")]
    half = len(by) // 2
    return Node(low, high, None, kd_tree(book, by[:half]), kd_tree(book, by[half:]))


def _apart(node: Node, points: np.ndarray) -> np.ndarray:
    """Squared distance of points from a node's box, the least that an entry inside can have."""
    out = np.maximum(node.low - points, 0) + np.maximum(points - node.high, 0)
    return np.einsum("ij,ij->i", out, out)


def nearest(book: np.ndarray, tree: Node, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of each point, the lower index of equal ones; the points go down the tree together."""
    best = np.full(len(points), len(book), np.int64)
    least = np.full(len(points), np.iinfo(np.int64).max)

    def visit(node: Node, rows: np.ndarray, bound: np.ndarray) -> None:
        rows = rows[bound <= least[rows]]
        if not len(rows):
            return
        p = points[rows]
        if node.entries is not None:
            off = p[:, None, :] - book[node.entries]
            d = np.einsum("ijk,ijk->ij", off, off)
            j = d.argmin(1)  # the first of equal ones, and entries ascend
            d, e = d[np.arange(len(rows)), j], node.entries[j]
            better = (d < least[rows]) | ((d == least[rows]) & (e < best[rows]))
            least[rows[better]], best[rows[better]] = d[better], e[better]
            return
        a, b = _apart(node.left, p), _apart(node.right, p)
        leftward = a <= b
        visit(node.left, rows[leftward], a[leftward])
        visit(node.right, rows[leftward], b[leftward])
        visit(node.right, rows[~leftward], b[~leftward])
        visit(node.left, rows[~leftward], a[~leftward])

    visit(tree, np.arange(len(points)), _apart(tree, points))
    return best, least


def whole_numbers(rows: DataFrame, carry: list[str], vector: str = "embedding") -> DataFrame:
    """The columns ``carry`` and ``q``, the components as whole numbers, of every usable vector."""
    q = free_name("q", carry)
    packed = rows.select(F.struct(*[F.col(f"`{c}`").alias(c) for c in carry]).alias("row"), F.col(f"`{vector}`").cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(1)
            size = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = col.flatten()
            x = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(len(size)), size)
            good = (size > 0) & (np.bincount(of[~np.isfinite(x)], minlength=len(size)) == 0)
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.clip(np.floor(x[good[of]] * SCALE), -LARGEST, LARGEST).astype(np.int32)
            ends = np.concatenate([[0], np.cumsum(size[good])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), pa.ListArray.from_arrays(pa.array(ends), pa.array(x))], names=["row", "q"])

    out = map_arrow(packed, run, StructType([packed.schema["row"]]).add("q", ArrayType(IntegerType())))
    return out.select(*[F.col("row")[c].alias(c) for c in carry], F.col("q").alias(q))


def _points(batch: pa.RecordBatch, at: int) -> np.ndarray:
    """Vectors as (rows x parts x components)."""
    return batch.column(at).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, PARTS, -1)


Books = list[tuple[np.ndarray, Node]]


def assigned(books: Books, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of every part (rows x parts)."""
    found = [nearest(book, tree, np.ascontiguousarray(points[:, k])) for k, (book, tree) in enumerate(books)]
    return np.stack([i for i, _ in found], 1), np.stack([d for _, d in found], 1)


def trees(codebooks: np.ndarray) -> Books:
    return [(book, kd_tree(book)) for book in codebooks]


def improved(spark: SparkSession, vectors: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """Each entry replaced by the mean, rounded down, of the parts nearest to it; an entry without parts stays."""
    held = spark.sparkContext.broadcast(trees(codebooks))
    _, entries, width = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((PARTS * entries, width), np.int64), np.zeros(PARTS * entries, np.int64)
        for batch in batches:
            points = _points(batch, 0)
            index, _ = assigned(held.value, points)
            cell = (index + np.arange(PARTS) * entries).ravel()
            count += np.bincount(cell, minlength=len(count))
            np.add.at(total, cell, points.reshape(-1, width))
        at = np.flatnonzero(count)
        sums = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * width, pa.int32()), pa.array(total[at].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[at]), sums], names=["cell", "n", "sums"])

    parts = map_arrow(vectors.select("q"), run, "cell long, n long, sums array<long>").select("cell", "n", F.posexplode("sums").alias("at", "x"))
    out = codebooks.copy().reshape(-1, width)
    for r in parts.groupBy("cell", "at").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect():
        out[r["cell"], r["at"]] = r["x"] // r["n"]
    return out.reshape(codebooks.shape)


def fit(spark: SparkSession, vectors: DataFrame, key: str = "vec_id", rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks (parts x entries x components) of a table with ``q``; None without usable vectors."""
    order = [F.asc_nulls_last(key), F.asc("q")]
    first = vectors.orderBy(*order).select(F.size("q").alias("n")).first()
    if first is None or first["n"] % PARTS:
        return None
    start = vectors.where(F.size("q") == first["n"]).orderBy(*order).limit(ENTRIES).select("q").collect()
    codebooks = np.array([r["q"] for r in start], np.int64).reshape(len(start), PARTS, -1).swapaxes(0, 1).copy()
    fitting = vectors.where(F.size("q") == first["n"])
    for _ in range(rounds):
        codebooks = improved(spark, fitting, codebooks)
    return codebooks


def encode(spark: SparkSession, vectors: DataFrame, codebooks: np.ndarray, carry: list[str]) -> DataFrame:
    """The columns ``carry``, code (two hex digits a part) and error (squared distances added up) of the vectors of the codebooks' length."""
    held = spark.sparkContext.broadcast(trees(codebooks))
    packed = vectors.where(F.size("q") == PARTS * codebooks.shape[2]).select(F.struct(*[F.col(f"`{c}`").alias(c) for c in carry]).alias("row"), "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, far = assigned(held.value, _points(batch, 1))
            digits = index.astype(np.uint8).tobytes().hex()
            codes = [digits[i : i + 2 * PARTS] for i in range(0, len(digits), 2 * PARTS)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.string()), pa.array(far.sum(1))], names=["row", "code", "error"])

    out = map_arrow(packed, run, StructType([packed.schema["row"], *StructType().add("code", "string").add("error", "long")]))
    return out.select(*[F.col("row")[c].alias(c) for c in carry], "code", "error")


def with_label_errors(rows: DataFrame, most: int = MOST_LABELS) -> DataFrame:
    """``rows`` (label, error, ...) with label_error, the error added up over equal labels.

    Sums are made before the shuffle. Where there are at most ``most`` labels, the sums
    are broadcast; else rows are dealt by label and share, so that a hot label spreads.
    """
    sums = rows.groupBy("label").agg(F.sum("error").alias("label_error"))
    sums = sums.withColumnRenamed("label", "_label")
    if sums.count() <= most:
        return rows.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
    shares = sums.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    dealt = rows.withColumn("_of", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SHARES)).cast("int"))
    return dealt.join(shares, F.col("label").eqNullSafe(F.col("_label")) & (F.col("_of") == F.col("_share"))).drop("_label", "_share", "_of")


def digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def compress(spark: SparkSession, rows: DataFrame) -> tuple[DataFrame, np.ndarray | None]:
    """(vec_id, label, code, error, label_error) of every usable vector of ``rows``, and the codebooks."""
    scratch = Scratch(spark, "codebooks")
    vectors = scratch.keep(whole_numbers(rows, ["vec_id", "label"]))
    codebooks = fit(spark, vectors)
    if codebooks is None:
        none = vectors.where("false").select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return none.withColumn("label_error", F.col("error")), None
    coded = scratch.keep(encode(spark, vectors, codebooks, ["vec_id", "label"]))
    scratch.drop(vectors)
    return with_label_errors(coded), codebooks


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of every usable vector of embeddings."""
    coded, codebooks = compress(spark, table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit("" if codebooks is None else digest(codebooks)).alias("codebooks_sha256"))
