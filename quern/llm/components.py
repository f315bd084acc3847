"""Connected components of links between integer nodes, in DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

MOST_ROUNDS = 60


def _settled(edges: DataFrame) -> bool:
    """Whether every u hangs on one v, and no v on another: then v is its root."""
    ends = edges.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    loose = ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 AND up > 0")
    return loose.count() == 0


def roots(links: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every linked node but the roots; root is the smallest node reachable.

    Large-star and small-star rounds: each hangs a node's neighbours on the smallest
    of them, so the number of edges never grows, and rounds grow with the logarithm
    of the longest path; links that are stars already need none. Each round is written
    to the shared folder; nothing but a count reaches the driver. Its memory grows with
    the jobs of a session, so a round has few.
    """
    edges = scratch.keep(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    for _ in range(MOST_ROUNDS):
        if _settled(edges):
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # no more rows than edges; the repeated ones go below
        large = scratch.keep(both.join(low.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = scratch.keep(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        scratch.drop(large)
        scratch.drop(edges)
        edges = after
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
