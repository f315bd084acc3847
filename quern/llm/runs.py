"""Periodic runs of words by a suffix tree.

The suffix tree of a text's words is held in arrays: the suffixes in order, found by
doubling the compared length, and the lengths of the common prefixes of neighbours.
Each inner node is a stretch of that order with a depth, cut in two at one of its
least common prefixes (a node of many children is cut again and again). As in Stoye
and Gusfield's method the leaves of the smaller part are gone through: a leaf i whose
partner i + depth or i - depth lies in the other part starts, or ends, a branching
tandem repeat, as the words behind the two differ. Each leaf is in a smaller part at
most log n times. Repeats are rotated to the left as long as words agree, by the
common suffix of the two halves, and merged: those that cover the same stretch are
one run, whose period is the least.

A run is a stretch of smallest period q that no neighbouring word extends, of at least
``LEAST_WORDS`` words and ``LEAST_PERIODS`` periods. Collapsing a text drops each word
that a run holds behind its first q words. ``EDIT`` makes every tenth text partly
periodic, so that long runs of all periods occur.

Texts are worked on whole; short ones together, up to a bounded number of characters.
Memory is about 100 bytes a word of the longest text, and 4 more each time the longest
repeated stretch doubles. A text is one task's work: runs never cross texts.

Defined results: null, empty and blank texts have no words and no run; a row without
doc_id is not edited; every row has its result, repeated rows too; other columns,
whatever their names, are never read; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, StructField, StructType

from .common import map_arrow, table

LEAST_WORDS = 6
LEAST_PERIODS = 4
#: Bytes of texts that are worked on together, unless one text is longer.
TOGETHER = 1 << 20
#: Leaves of the tree's nodes that are looked at together, unless one node has more.
LEAVES = 1 << 20


class Tree(NamedTuple):
    """Suffixes in order, their places in it, common prefixes with the suffix before, and the ranks by which lengths are compared."""

    order: np.ndarray
    place: np.ndarray
    common: np.ndarray
    ranks: list[np.ndarray]


def numbers(texts: list[list[bytes]]) -> np.ndarray:
    """Words of texts behind one another: equal words of a text have equal numbers, which no other text has; a 0 ends each text."""
    out, first = np.zeros(sum(map(len, texts)) + len(texts), np.int64), 1
    at = 0
    for words in texts:
        seen: dict[bytes, int] = {}
        take = seen.setdefault
        out[at : at + len(words)] = [take(w, len(seen)) for w in words]
        out[at : at + len(words)] += first
        first += len(seen)
        at += len(words) + 1
    return out


def suffix_tree(codes: np.ndarray) -> Tree:
    """The tree over texts as ``numbers`` gives them; a suffix ends where its text does.

    A rank numbers the groups of suffixes that agree in the words compared so far by
    their first place in the order. Only suffixes that share a group are sorted on, by
    the rank of what follows these words. The ranks of every length are kept, to compare
    any two places in steps from the longest length down.
    """
    size = np.bincount(codes, minlength=1)
    order = np.argsort(codes)[size[0] :]
    size[0] = 0
    rank = (np.cumsum(size) - size)[codes].astype(np.int32) + 1
    rank[codes == 0] = 0
    ranks, length = [rank], 1
    slots = np.flatnonzero(size[codes[order]] > 1)
    while len(slots):
        at = order[slots]
        key = (rank[at].astype(np.int64) << 32) | rank[at + length]
        by = np.argsort(key)
        key, at = key[by], at[by]
        order[slots] = at
        new = np.ones(len(key) + 1, bool)
        np.not_equal(key[1:], key[:-1], out=new[1:-1])
        starts = np.flatnonzero(new[:-1])
        rank = rank.copy()
        rank[at] = np.repeat(slots[starts] + 1, np.diff(np.append(starts, len(key))))
        slots = slots[~(new[:-1] & new[1:])]
        ranks.append(rank)
        length *= 2
    place = np.zeros(len(codes), np.int64)
    place[order] = np.arange(len(order))
    common = np.zeros(len(order) + 1, np.int64)
    k = np.flatnonzero(ranks[0][order[1:]] == ranks[0][order[:-1]]) + 1
    common[k] = agreeing(ranks, order[k - 1], order[k])
    return Tree(order, place, common, ranks)


def agreeing(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
    """How many words from places a and b on are equal; with ``back``, how many just before them."""
    a, b, n = a.copy(), b.copy(), np.zeros(len(a), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        step = 1 << k
        x, y = (a - step, b - step) if back else (a, b)
        both = (x >= 0) & (y >= 0)
        rank = ranks[k]
        at = np.where(both, x, 0)
        equal = both & (rank[at] == rank[np.where(both, y, 0)]) & (rank[at] > 0)
        move = np.where(equal, -step if back else step, 0)
        a += move
        b += move
        n += np.abs(move)
    return n


def nodes(common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cut, lo, hi) of every node with a depth: its leaves are order[lo:hi], cut at a least common prefix, whose length is the depth."""
    cuts = np.flatnonzero(common)
    n = len(cuts)
    left, right, depth, at = [0] * n, [0] * n, common[cuts].tolist(), cuts.tolist()
    open_: list[int] = []
    begin, behind = 0, -1
    for i in range(n):
        k, d = at[i], depth[i]
        if k != behind:
            for j in open_:
                right[j] = behind
            open_, begin = [], k - 1
        while open_ and depth[open_[-1]] > d:
            right[open_.pop()] = k
        left[i] = at[open_[-1]] if open_ else begin
        open_.append(i)
        behind = k + 1
    for j in open_:
        right[j] = behind
    return cuts, np.array(left, np.int64), np.array(right, np.int64)


def branching(tree: Tree) -> tuple[np.ndarray, np.ndarray]:
    """(start, half) of the branching tandem repeats: the words from start to start + half and those behind are equal, what follows either differs."""
    cut, lo, hi = nodes(tree.common)
    depth = tree.common[cut]
    left = cut - lo <= hi - cut
    begin, end = np.where(left, lo, cut), np.where(left, cut, hi)
    other_lo, other_hi = np.where(left, cut, lo), np.where(left, hi, cut)
    count = end - begin
    total = np.cumsum(count)
    starts, halves = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    done = 0
    while done < len(cut):
        # The leaves of some nodes at once, of one node at least, so that memory stays bounded.
        upto = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + LEAVES, "right")))
        part = slice(done, upto)
        c = count[part]
        leaf = np.arange(c.sum()) + np.repeat(begin[part] - (np.cumsum(c) - c), c)
        d, a, b = (np.repeat(x[part], c) for x in (depth, other_lo, other_hi))
        i = tree.order[leaf]
        for partner in (i + d, i - d):
            at = np.where((partner >= 0) & (partner < len(tree.place)), partner, 0)
            p = tree.place[at]
            hit = np.flatnonzero((p >= a) & (p < b) & (tree.order[p] == partner))
            starts.append(np.minimum(i[hit], partner[hit]))
            halves.append(d[hit])
        done = upto
    return np.concatenate(starts), np.concatenate(halves)


def runs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs in texts as ``numbers`` gives them, by start, then period."""
    tree = suffix_tree(codes)
    start, period = branching(tree)
    end = start + 2 * period
    start = start - agreeing(tree.ranks, start, start + period, back=True)
    by = np.lexsort((period, end, start))
    start, end, period = start[by], end[by], period[by]
    one = np.ones(len(start), bool)
    one[1:] = (np.diff(start) != 0) | (np.diff(end) != 0)
    length = end - start
    keep = np.flatnonzero(one & (length >= LEAST_WORDS) & (length >= LEAST_PERIODS * period))
    keep = keep[np.lexsort((period[keep], start[keep]))]
    return start[keep], length[keep], period[keep]


def edited(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of every tenth document, by its id's checksum, repeat with a period from some place on."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (1 + (n - a) // p))[: n - a]


def collapsed(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> bytes:
    """The words that no run holds behind its first period, by one space."""
    if not len(start):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change)[:-1] == 0)])


RUNS = ArrayType(StructType().add("start", "long").add("length", "long").add("period", "long"))


def _together(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    lo = held = 0
    for i, t in enumerate(texts):
        if i > lo and held + len(t) > TOGETHER:
            yield lo, i
            lo = i
            held = 0
        held += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def periodic_runs(docs: DataFrame, key: str = "doc_id", edit: bool = False) -> DataFrame:
    """(key, n_words, runs, collapsed) of every row; with ``edit`` of its edited words. Runs are ordered by start, then period."""
    schema = StructType([StructField("key", docs.schema[key].dataType)]).add("n_words", "long").add("runs", RUNS).add("collapsed", "binary")
    kind = to_arrow_type(RUNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for lo, hi in _together(texts):
                words = [t.split() for t in texts[lo:hi]]
                if edit:
                    words = [edited(w, k) for w, k in zip(words, keys[lo:hi], strict=True)]
                s, n, p = runs(numbers(words))
                begins = np.cumsum([0, *(len(w) + 1 for w in words)])
                at = np.searchsorted(s, begins)
                each = [slice(at[i], at[i + 1]) for i in range(len(words))]
                found = [[{"start": x, "length": y, "period": z} for x, y, z in zip((s[e] - b).tolist(), n[e].tolist(), p[e].tolist(), strict=True)] for e, b in zip(each, begins, strict=False)]
                kept = [collapsed(w, s[e] - b, n[e], p[e]) for w, e, b in zip(words, each, begins, strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(map(len, words), pa.int64()), pa.array(found, kind), pa.array(kept, pa.binary())], names=["key", "n_words", "runs", "collapsed"])

    out = map_arrow(docs.select(F.col(f"`{key}`").alias("key"), "text"), run, schema)
    return out.select(F.col("key").alias(key), "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the edited words of every whole text of documents."""
    found = periodic_runs(table(spark, sf_dir, "documents"), edit=True)
    # Of equal exponents the first stays, as runs are ordered; lengths and periods are compared as whole numbers.
    first = F.get("runs", F.lit(0))
    most = F.aggregate("runs", first, lambda top, r: F.when(r["length"] * top["period"] > top["length"] * r["period"], r).otherwise(top))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("most", most).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("most.start").alias("start"),
        F.col("most.length").alias("length"),
        F.col("most.period").alias("period"),
        F.expr("1000 * most.length DIV most.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
