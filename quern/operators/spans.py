"""From a span of characters to the tokens it touches, and to the mean of their vectors.

A span is a string looked up in a text, at its first or last occurrence; tokens come
with character offsets, end exclusive, as tokenizers give them. A token belongs to a
span if the two share a character, so a span may cut its first and last token. Tokens
of offsets (0, 0) are special ones that stand for no character. What can't be found -
an empty span, a span the text lacks, a span between tokens - is NULL, never an error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import vectors as V
from quern.sources.files import kept


def span_start(text: Column, span: Column, which: str = "first") -> Column:
    """0-based place of a span's first or last occurrence."""
    if which == "first":
        at = F.instr(text, span)
    elif which == "last":
        behind = F.instr(F.reverse(text), F.reverse(span))
        at = F.when(behind > 0, F.length(text) - behind - F.length(span) + 2).otherwise(0)
    else:
        raise ValueError("which is 'first' or 'last'")
    return F.when((F.length(span) > 0) & (at > 0), at - 1)


def overlapping(offsets: Column, start: Column, end: Column) -> Column:
    """Indexes of the tokens that share a character with [start, end); offsets is array<struct<start, end>>."""

    def found(span: Column) -> Column:
        touches = lambda o: (o["start"] < span["end"]) & (o["end"] > span["start"]) & ~((o["start"] == 0) & (o["end"] == 0))
        return F.filter(F.transform(offsets, lambda o, i: F.when(touches(o), i)), lambda i: i.isNotNull())

    # in an array of one, so that a span is looked up once and not for each token
    once = F.array(F.struct(start.alias("start"), end.alias("end")))
    return F.element_at(F.transform(F.transform(once, found), lambda f: F.when(F.size(f) > 0, f)), 1)


def words_of(text: Column, start: Column, end: Column) -> Column:
    """(first, last) index of the blank-separated words that share a character with [start, end).

    The same as ``overlapping`` with the offsets of all words, but from counts of the
    words before, so that a long text needs no array of offsets.
    """
    head = F.substr(text, F.lit(1), start)
    inside = F.substr(text, start + 1, end - start)
    upto = F.substr(text, F.lit(1), end)
    # a word that goes on from the character before the span is counted in the head already
    cut = head.rlike(r"\S\z") & inside.rlike(r"\A\S")
    first = F.regexp_count(head, F.lit(r"\S+")) - cut.cast("int")
    last = F.regexp_count(upto, F.lit(r"\S+")) - 1
    return F.when(inside.rlike(r"\S"), F.struct(first.alias("first"), last.alias("last")))


def pool(vectors: Column, indexes: Column) -> Column:
    """Mean of the vectors (array<array<double>>) at the indexes; NULL without any."""
    picked = F.transform(indexes, lambda i: F.get(vectors, i))
    zero = F.transform(F.element_at(picked, 1), lambda x: F.lit(0.0))
    total = F.aggregate(picked, zero, lambda s, v: V.add(s, v))
    return F.when(F.size(indexes) > 0, F.transform(total, lambda x: x / F.size(indexes)))


def pool_rows(spans: DataFrame, keys: Sequence[str], indexes: str, vectors: DataFrame, on: Sequence[str], at: str, vector: str) -> DataFrame:
    """(keys, n_tokens, pooled): the same where vectors are rows.

    ``vectors`` has the columns ``on``, the token's index ``at`` and ``vector``. Spans mostly
    touch the same few places, so each distinct list of tokens is pooled once, dimension by
    dimension, and goes to its spans from a table of its own: neither a frequent token nor
    the dimensions of all spans meet in a task. Rows of the same keys are one span.
    """
    token = lambda i: F.struct(*on, i.alias(at))
    named = kept(spans.where(F.size(indexes) > 0).groupBy(*keys).agg(F.array_sort(F.flatten(F.collect_list(F.transform(indexes, token)))).alias("_list")), "spans")
    lists = kept(named.select("_list").distinct(), "lists")
    each = lists.select("_list", F.inline("_list"))
    met = each.join(vectors.select(*on, at, F.col(vector).alias("_v")), [*on, at])
    dims = met.select("_list", F.posexplode("_v").alias("_i", "_x")).groupBy("_list", "_i").agg(F.avg("_x").alias("_x"), F.count(F.lit(1)).alias("_n"))
    pooled = dims.groupBy("_list").agg(F.max("_n").alias("n_tokens"), F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda x: x["_x"]).alias("pooled"))
    return named.join(kept(pooled, "pooled"), "_list").drop("_list")
