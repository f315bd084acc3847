"""Difference-vector linearity, ridge maps and retrieval over (relation_key, id, s, o, split) frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import vectors as V

from .guards import null_safe_join


def directions(triples: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, direction): mean of o - s over training rows."""
    diff = triples.where("split = 'train'").select(*keys, V.subtract(F.col("o"), F.col("s")).alias("_d"))
    return V.mean_vector(diff, keys, "_d", "direction")


def scored(triples: DataFrame, keys: list[str], rule: str = "none") -> DataFrame:
    """Triples with ``base_cos``, ``cos`` and ``delta_cos`` under their relation's direction."""
    moved = triples.join(directions(triples, keys), keys).withColumn("_hat", V.add(F.col("s"), F.col("direction")))
    out = moved.withColumn("base_cos", V.cosine(F.col("s"), F.col("o"), rule)).withColumn("cos", V.cosine(F.col("_hat"), F.col("o"), rule))
    return out.withColumn("delta_cos", F.col("cos") - F.col("base_cos"))


def summary(triples: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, cosines, their deviations, gain, and mean squared error over test rows and dimensions."""
    t = scored(triples, keys).withColumn("_err", V.mean_square(V.subtract(F.col("_hat"), F.col("o"))))
    n = triples.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_total"), F.count_if(F.col("split") == "train").alias("n_train"))
    test = t.where("split = 'test'").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_test"), F.avg("cos").alias("cos_mean"), F.stddev_pop("cos").alias("cos_std"), F.avg("base_cos").alias("base_cos_mean"),
        F.stddev_pop("base_cos").alias("base_cos_std"), F.avg("delta_cos").alias("delta_cos"), F.avg("_err").alias("mse"), F.first(V.norm(F.col("direction"))).alias("direction_norm"),
    )
    return n.join(test, keys, "left")


def norms(triples: DataFrame, keys: list[str], eps: float = 1e-12) -> DataFrame:
    """Norms and ratios of directions, subjects, objects and moved subjects over test rows."""
    t = triples.where("split = 'test'").join(directions(triples, keys), keys).withColumn("_hat", V.add(F.col("s"), F.col("direction")))
    rms = lambda c: F.sqrt(F.avg(V.mean_square(F.col(c))))
    out = t.groupBy(*keys).agg(
        F.first(V.norm(F.col("direction"))).alias("dir_l2"), F.first(F.sqrt(V.mean_square(F.col("direction")))).alias("dir_rms"), F.avg(V.norm(F.col("s"))).alias("subj_l2"),
        F.avg(V.norm(F.col("o"))).alias("obj_l2"), F.avg(V.norm(F.col("_hat"))).alias("hat_l2"), rms("o").alias("obj_rms"), rms("_hat").alias("hat_rms"), rms("s").alias("subj_rms"),
        F.sqrt(F.avg(V.mean_square(V.subtract(F.col("_hat"), F.col("o"))))).alias("rmse"),
    )
    over = lambda c: F.col(c) / (F.col("obj_rms") + eps)
    return out.select("*", over("hat_rms").alias("ratio_hat_obj"), over("dir_rms").alias("ratio_dir_obj"), over("rmse").alias("nrmse"))


def prototypes(triples: DataFrame, keys: list[str], label: str, source: str = "train") -> DataFrame:
    """(keys, label, proto): mean object vector of each label; ``source`` all includes test rows' own objects."""
    rows = triples if source == "all" else triples.where("split = 'train'")
    return V.mean_vector(rows, [*keys, label], "o", "proto")


#: Groups whose cross products a task holds at once, and parts in which a group's are added up.
HELD_GROUPS, PARTS = 256, 32
_SUMS = ["n", "sx", "sy", "xx", "xy"]


def _cross_products(train: DataFrame, keys: list[str], kinds: str) -> DataFrame:
    """(keys, n, sx, sy, xx, xy): each task's sums of s, o, s s' and s o' by group, matrices row by row."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}
        flush = lambda: pd.DataFrame([[*k, v[0], *[x.ravel().tolist() for x in v[1:]]] for k, v in held.items()], columns=[*keys, *_SUMS])
        for pdf in batches:
            for key, g in pdf.groupby(keys, dropna=False, sort=False):
                x, y = (np.stack(g[c].to_numpy()) for c in ("s", "o"))
                new = [len(x), x.sum(0), y.sum(0), x.T @ x, x.T @ y]
                held[key] = [a + b for a, b in zip(held[key], new, strict=True)] if key in held else new
                if len(held) >= HELD_GROUPS:
                    yield flush()
                    held.clear()
        if held:
            yield flush()

    return train.mapInPandas(sums, f"{kinds}, n long, sx array<double>, sy array<double>, xx array<double>, xy array<double>")


def affine(triples: DataFrame, keys: list[str], ridge: float = 1e-2) -> DataFrame:
    """(keys, id, inferred): test subjects under the ridge map of their relation's training rows.

    Primal: a group of any size is summed to cross products of the vectors' dimension,
    part by part, and one small system a group is solved; the map goes once to each block
    of the group's test rows.
    """
    kinds = ", ".join(f"`{k}` {triples.schema[k].dataType.simpleString()}" for k in keys)
    full = f"{kinds}, n long, sx array<double>, sy array<double>, xx array<double>, xy array<double>"

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        total = [np.sum(np.stack(pdf[c].to_numpy()), axis=0).tolist() for c in _SUMS[1:]]
        return pd.DataFrame([[*pdf[keys].iloc[0], int(pdf["n"].sum()), *total]], columns=[*keys, *_SUMS])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        one = added(pdf).iloc[0]
        n, sx, sy = one["n"], np.array(one["sx"]), np.array(one["sy"])
        d = len(sx)
        xx = np.array(one["xx"]).reshape(d, d) - np.outer(sx, sx) / n
        xy = np.array(one["xy"]).reshape(d, -1) - np.outer(sx, sy) / n
        w = np.linalg.solve(xx + ridge * np.eye(d), xy)
        return pd.DataFrame([[*pdf[keys].iloc[0], [c.tolist() for c in w.T], (sx / n).tolist(), (sy / n).tolist()]], columns=[*keys, "w", "mx", "my"])

    parts = _cross_products(triples.where("split = 'train'").select(*keys, "s", "o"), keys, kinds).withColumn("_part", F.spark_partition_id() % PARTS)
    fits = parts.groupBy(*keys, "_part").applyInPandas(lambda pdf: added(pdf.drop(columns="_part")), full).groupBy(*keys).applyInPandas(solve, f"{kinds}, w array<array<double>>, mx array<double>, my array<double>")
    test, sizes = _blocks(triples.where("split = 'test'").select(*keys, "id", "s"), keys, "id", "_q", "_nq")
    spread = null_safe_join(fits, sizes, keys).withColumn("_q", F.explode(F.sequence(F.lit(0), F.col("_nq") - 1))).drop("_nq")
    spread = spread.select(*[F.col(c).alias(c) for c in spread.columns])  # both sides may come from one frame

    def apply(rows: pd.DataFrame, maps: pd.DataFrame) -> pd.DataFrame:
        out = rows[[*keys, "id"]].copy()
        if not len(rows) or not len(maps):
            return out.head(0).assign(inferred=pd.Series(dtype=object))
        m = maps.iloc[0]
        x = np.stack(rows["s"].to_numpy()) - m["mx"]
        return out.assign(inferred=list(x @ np.stack(m["w"]).T + m["my"]))

    kinds_id = f"{kinds}, id {triples.schema['id'].dataType.simpleString()}, inferred array<double>"
    return test.groupBy(*keys, "_q").cogroup(spread.groupBy(*keys, "_q")).applyInPandas(lambda a, b: apply(a, b), kinds_id)


def queries_of(triples: DataFrame, keys: list[str], gold: str, mode: str) -> DataFrame:
    """(keys, id, gold, inferred) of test rows under translated, subject_only or affine_full."""
    test = triples.where("split = 'test'").select(*keys, "id", gold, "s")
    if mode == "subject_only":
        return test.withColumnRenamed("s", "inferred")
    if mode == "translated":
        return test.join(directions(triples, keys), keys).select(*keys, "id", gold, V.add(F.col("s"), F.col("direction")).alias("inferred"))
    return test.drop("s").join(affine(triples, keys), [*keys, "id"])


#: Queries and candidates of a block; a task scores one block of each.
BLOCK = 1024


def _blocks(rows: DataFrame, keys: list[str], by: str, name: str, many: str) -> tuple[DataFrame, DataFrame]:
    """Rows dealt evenly to blocks of about BLOCK, and (keys, many): how many blocks a group has."""
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(many))
    dealt = null_safe_join(rows, sizes, keys).withColumn(name, F.pmod(F.xxhash64(by), F.col(many)).cast("int")).drop(many)
    return dealt, sizes


def _scores(queries: np.ndarray, candidates: np.ndarray, metric: str) -> np.ndarray:
    """(queries x candidates): cosine, NaN for a zero vector, or the negative distance. A pair's score doesn't depend on the block it is in."""
    dots = np.einsum("id,jd->ij", queries, candidates)
    if metric == "cosine":
        norm = lambda v: np.sqrt(np.einsum("id,id->i", v, v))
        with np.errstate(divide="ignore", invalid="ignore"):
            den = norm(queries)[:, None] * norm(candidates)[None, :]
            return np.where(den > 0, dots / den, np.nan)
    return -np.sqrt(np.stack([np.einsum("jd,jd->j", c, c) for c in (candidates - q for q in queries)])) if len(queries) else dots


def ranked(queries: DataFrame, candidates: DataFrame, keys: list[str], gold: str, metric: str = "cosine", k: int = 10) -> DataFrame:
    """(keys, id, gold, rank, num_candidates, top): the gold label's rank among its relation's candidates, and the k best (label, score).

    The order is by score, then by label; NULL scores, those of zero vectors, come last.
    ``rank`` is NULL where the gold label is no candidate. Blocks of queries meet blocks of
    candidates as matrices: a block counts the candidates before the gold one, whose
    vector goes along with the query, and gives its own k best; counts are added up, lists
    merged. There is no row for a pair.
    """
    named = candidates.select(*keys, F.col(gold).alias("_label"), "proto")
    golds = named.select(*keys, F.col("_label").alias(gold), F.col("proto").alias("_gold"))
    q, nq = _blocks(null_safe_join(queries.select(*keys, "id", gold, "inferred"), golds, [*keys, gold], "left"), keys, "id", "_q", "_nq")
    c, nc = _blocks(named, keys, "_label", "_c", "_nc")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = null_safe_join(q, nc, keys).withColumn("_c", every("_nc")).drop("_nc")
    c = null_safe_join(c, nq, keys).withColumn("_q", every("_nq")).drop("_nq")
    c = c.select(*[F.col(x).alias(x) for x in c.columns])  # both sides may come from one frame
    kinds = ", ".join(f"`{x}` {queries.schema[x].dataType.simpleString()}" for x in [*keys, "id", gold])

    def block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = left[[*keys, "id", gold]].copy()
        if not len(left):
            return out.assign(before=pd.Series(dtype="int64"), held=pd.Series(dtype="int64"), best=pd.Series(dtype=object))
        labels = right["_label"].to_numpy()
        order = np.argsort(labels, kind="stable")
        labels, vectors = labels[order], np.stack(right["proto"].to_numpy()[order]) if len(right) else np.zeros((0, 1))
        x = np.stack(left["inferred"].to_numpy())
        score = _scores(x, vectors, metric) if len(right) else np.zeros((len(x), 0))
        has = left["_gold"].notna().to_numpy()
        mine = np.full(len(left), np.nan)
        if has.any():
            own = np.stack(left["_gold"].to_numpy()[has])
            mine[has] = [_scores(a[None], b[None], metric)[0, 0] for a, b in zip(x[has], own, strict=True)]
        lost = np.isnan(score)
        smaller = labels[None, :] < left[gold].to_numpy()[:, None] if len(right) else np.zeros(score.shape, bool)
        top = np.where(np.isnan(mine), -np.inf, mine)[:, None]
        # a gold label without a score comes behind all that have one
        better = np.where(np.isnan(mine)[:, None], ~lost, score > top)
        even = np.where(np.isnan(mine)[:, None], lost, score == top)
        out["before"] = (better | (even & smaller)).sum(1)
        out["held"] = len(right)
        first = np.argsort(np.where(lost, np.inf, -score), axis=1, kind="stable")[:, :k]
        out["best"] = [[{"label": labels[j], "score": None if np.isnan(score[i, j]) else float(score[i, j])} for j in row] for i, row in enumerate(first)]
        out.loc[~has, "before"] = -1
        return out

    label = queries.schema[gold].dataType.simpleString()
    part = q.groupBy(*keys, "_q", "_c").cogroup(c.groupBy(*keys, "_q", "_c")).applyInPandas(lambda a, b: block(a, b), f"{kinds}, before long, held long, best array<struct<label:{label},score:double>>")
    worse = lambda a, b: F.when(a["score"].isNull() & b["score"].isNull(), F.lit(0)).when(a["score"].isNull(), 1).when(b["score"].isNull(), -1).when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(0)
    place = lambda a, b: F.when(worse(a, b) != 0, worse(a, b)).when(a["label"] < b["label"], -1).when(a["label"] > b["label"], 1).otherwise(0)
    merged = part.groupBy(*keys, "id", gold).agg(F.sum("before").alias("before"), F.min("before").alias("_least"), F.sum("held").alias("num_candidates"), F.flatten(F.collect_list("best")).alias("best"))
    top_k = F.slice(F.array_sort("best", place), 1, k)
    return merged.select(*keys, "id", gold, F.when(F.col("_least") >= 0, F.col("before") + 1).alias("rank"), "num_candidates", top_k.alias("top"))


def gold_ranks(ranks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, rank, num_candidates): NULL rank where the gold label is no candidate."""
    return ranks.select(*keys, "id", "rank", "num_candidates")


def metrics(ranks: DataFrame, keys: list[str]) -> DataFrame:
    """Coverage, Hits@1, Hits@10, MRR and mean rank of covered queries, by key and over all."""
    r = F.col("rank")
    hit = lambda k: F.avg(F.when(r.isNotNull(), (r <= k).cast("double")))
    return ranks.rollup(*keys).agg(
        F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("n_test_total"), F.count("rank").alias("n_test_covered"), F.avg(r.isNotNull().cast("double")).alias("coverage"),
        hit(1).alias("hits1"), hit(10).alias("hits10"), F.avg(1 / r).alias("mrr"), F.avg(r).alias("mean_rank"),
    ).where(F.col("_g").isin(0, 2 ** len(keys) - 1)).drop("_g")


def top_list(ranks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, labels, scores): the best of each query in order."""
    return ranks.select(*keys, "id", F.transform("top", lambda x: x["label"]).alias("labels"), F.transform("top", lambda x: x["score"]).alias("scores"))
