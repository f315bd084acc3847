"""The most similar candidate of each string, without comparing all pairs.

Similarity is 2 M / T: M characters in matching blocks, T in both strings. M is at most
the number of characters the two share as multisets, whatever their order. Tasks meet a
block of distinct strings with a block of distinct candidates of the same keys: an
inverted index from characters to the candidates that hold them, and how often, gives
this upper bound for all candidates at once. The blocks are also no longer than their
longest common subsequence together, which is counted for the candidates that the first
comparison leaves, bit by bit for all at once. Candidates are compared exactly in the
order of their bounds, equal ones from the last name on, until none left can replace the
best one found.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.text import ratio_of

from .guards import null_safe_join

#: Distinct strings of a block.
BLOCK = 8192
#: Characters of a string whose common subsequences are counted, one bit each.
WORD = 64


class Index:
    """Candidates by their characters."""

    def __init__(self, candidates: Sequence[str]):
        self.candidates = list(candidates)
        self.sizes = np.array([len(c) for c in candidates], float)
        # places by name, and texts as columns of character numbers, 0 behind the end
        self.rank = np.empty(len(self.candidates), np.int64)
        self.rank[sorted(range(len(self.candidates)), key=self.candidates.__getitem__)] = np.arange(len(self.candidates))
        self.number = {ch: n for n, ch in enumerate(sorted(set().union(*self.candidates)), 1)}
        self.codes = np.zeros((min(WORD, max(map(len, self.candidates), default=0)), len(self.candidates)), np.int32)
        for i, c in enumerate(self.candidates):
            self.codes[: len(c), i] = [self.number[ch] for ch in c[:WORD]]
        held: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, c in enumerate(candidates):
            for ch, n in Counter(c).items():
                held[ch].append((i, n))
        self.held = {ch: tuple(np.array(x) for x in zip(*rows, strict=True)) for ch, rows in held.items()}

    def bounds(self, string: str) -> np.ndarray:
        """An upper bound of the similarity with every candidate."""
        shared = np.zeros(len(self.candidates))
        for ch, n in Counter(string).items():
            if ch in self.held:
                at, often = self.held[ch]
                shared[at] += np.minimum(often, n)
        total = self.sizes + len(string)
        return np.where(total > 0, 2 * shared / np.maximum(total, 1), 1.0)

    def common(self, string: str, at: np.ndarray) -> np.ndarray:
        """Lengths of the longest common subsequences of a string and the candidates ``at``; both of WORD characters at most."""
        masks = np.zeros(len(self.number) + 1, np.uint64)
        for k, ch in enumerate(string):
            masks[self.number.get(ch, 0)] |= np.uint64(1 << k)
        masks[0] = 0
        # a zero bit of v is a character of the string that the subsequence has
        v = np.full(len(at), np.uint64(0xFFFFFFFFFFFFFFFF))
        for held in masks[self.codes[:, at]]:
            u = v & held
            v = (v + u) | (v - u)
        return np.bitwise_count(~v & np.uint64((1 << len(string)) - 1))

    def _tighten(self, bound: np.ndarray, at: np.ndarray, string: str) -> np.ndarray:
        """``at``, whose bounds are set by common subsequences where these can be counted."""
        short = at[self.sizes[at] <= WORD]
        if len(at) > 1 and len(short) and 0 < len(string) <= WORD:
            bound[short] = 2 * self.common(string, short) / (self.sizes[short] + len(string))
        return at

    def best(self, string: str) -> tuple[str | None, float, int]:
        """(candidate, similarity, candidates compared): of equal ones the last by name."""
        if not self.candidates:
            return None, 0.0, 0
        bound = self.bounds(string)
        first = self._tighten(bound, np.flatnonzero(bound == bound.max()), string)
        first = int(first[np.lexsort((-self.rank[first], -bound[first]))[0]])
        top, compared = (ratio_of(string, self.candidates[first]), self.candidates[first]), 1
        left = self._tighten(bound, np.flatnonzero(bound >= top[0] - 1e-12), string)
        for i in left[np.lexsort((-self.rank[left], -bound[left]))]:
            if bound[i] < top[0] - 1e-12:
                break
            # what can only be equal must come behind by name
            if i != first and (bound[i] > top[0] + 1e-12 or self.candidates[i] > top[1]):
                compared += 1
                top = max(top, (ratio_of(string, self.candidates[i]), self.candidates[i]))
        return top[1], top[0], compared


def best_matches(strings: DataFrame, candidates: DataFrame, keys: Sequence[str], string: str, candidate: str) -> DataFrame:
    """(keys, string, best, score, n_compared, n_candidates) of every distinct string whose keys have a candidate.

    Of equally similar candidates the last by name is best. NULLs are neither matched nor candidates.
    """
    keys = list(keys)

    def blocks(df: DataFrame, value: str, name: str, at: str, many: str) -> tuple[DataFrame, DataFrame]:
        one = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias(name)).distinct()
        sizes = one.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(many))
        return null_safe_join(one, sizes, keys).withColumn(at, F.pmod(F.xxhash64(name), F.col(many)).cast("int")).drop(many), sizes

    (a, na), (b, nb) = blocks(strings, string, "_a", "_x", "_nx"), blocks(candidates, candidate, "_b", "_y", "_ny")
    a = null_safe_join(a, nb, keys).withColumn("_y", F.explode(F.sequence(F.lit(0), F.col("_ny") - 1))).drop("_ny")
    b = null_safe_join(b, na, keys).withColumn("_x", F.explode(F.sequence(F.lit(0), F.col("_nx") - 1))).drop("_nx")
    b = b.select(*[F.col(c).alias(c) for c in b.columns])  # both sides may come from one frame

    def match(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        index = Index(right["_b"].tolist())
        found = [index.best(s) for s in left["_a"]]
        out = left[[*keys, "_a"]].copy()
        for i, (name, kind) in enumerate((("_best", "object"), ("_score", "float64"), ("_n", "int64"))):
            out[name] = pd.Series([f[i] for f in found], index=out.index, dtype=kind)
        return out.assign(_of=len(right))

    kinds = ", ".join([*(f"`{k}` {strings.schema[k].dataType.simpleString()}" for k in keys), "_a string, _best string, _score double, _n long, _of long"])
    # a number of partitions that is given isn't made less, as it would be by bytes: blocks are small, but take long
    n, by = int(strings.sparkSession.conf.get("spark.sql.shuffle.partitions")), [*keys, "_x", "_y"]
    part = a.repartition(n, *by).groupBy(*by).cogroup(b.repartition(n, *by).groupBy(*by)).applyInPandas(lambda p, q: match(p, q), kinds)
    top = F.max(F.when(F.col("_best").isNotNull(), F.struct("_score", "_best")))
    merged = part.groupBy(*keys, "_a").agg(top.alias("_top"), F.sum("_n").alias("n_compared"), F.sum("_of").alias("n_candidates"))
    return merged.select(*keys, F.col("_a").alias(string), F.col("_top._best").alias("best"), F.col("_top._score").alias("score"), "n_compared", "n_candidates")
