"""Document fingerprints: invertible Bloom lookup sketches, in DataFrame operations only.

A text is the set of digests of its paragraphs: pieces between line ends and
sentence ends, of at most ``PIECE`` characters, so that an edit changes the pieces of
its sentence alone. A sketch has three tables of cells; each digest is in one cell of
each table. A cell holds the number of its digests, the XOR of the digests and the XOR
of their check values. Subtracting the sketches of two versions cancels what they
share; peeling takes digests from cells that hold just one, table after table, and
recovers the digests of either side.

The fingerprint of a text is its sketch of ``BASE`` cells a table. Two fingerprints are
subtracted first. The squares of the counts that are left estimate the size of the
difference; a small one is peeled from the subtracted fingerprints themselves, a larger
one from sketches of both digest sets with about ``ROOM`` times as many cells a table as
the estimate. A pair whose sketch doesn't peel, as estimates are rough, is tried again
with ``GROWTH`` times the cells until it does.

Subtraction and peeling are hash aggregations by (pair, cell) within partitions
dealt by row, so an attempt has one shuffle, of digests, and takes time in
proportion to the number of digests. Documents are dealt into blocks of the order by
doc_id between quantiles of it, so neither gaps nor outliers make blocks uneven.

Defined results: null text is empty and has no paragraphs; two texts without
paragraphs are alike by 1; a very long text has as many digests as it has distinct
pieces. Rows without doc_id come last in the order, ties of doc_id are ordered by
text, the last row's next is the first; repeated rows are each other's next. Columns
other than doc_id and text are never read. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, bound, table

PIECE = 160
#: Cells of each of a fingerprint's three tables; cells a table for each differing digest of the estimate.
BASE, ROOM = 4, 2
#: Passes over the three tables in an attempt, growth of a retry.
CYCLES, GROWTH = 2, 4
#: Digests that a partition peels at once, so that its cells stay in memory, and most partitions of an attempt; with more digests than both allow, cells spill.
AT_ONCE, PARTITIONS = 300_000, 1 << 15
#: Documents in a block of the order by doc_id, and most quantiles taken at once.
IN_BLOCK, QUANTILES = 1024, 256

#: Pattern of a piece: a sentence, with its marks, within a line.
SENTENCE = rf"[^\n.!?]{{1,{PIECE}}}+[.!?]*+|[.!?]++"


def digests(text: Column) -> Column:
    """Distinct paragraph digests."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SENTENCE), 0)
    return F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(F.trim(p))))


def _check(k: str) -> str:
    return f"(xxhash64({k}, 1) & 4294967295L)"


def _slot(k: str, j: int, size: str) -> str:
    """Cell of a digest in table j."""
    return f"int({j} * {size} + pmod(xxhash64({k}, 10 + {j}), {size}))"


def sketch(d: Column) -> Column:
    """A digest column's sketch of 3 x BASE cells, as structs of count ``n``, digests ``k`` and check values ``c``."""
    placed = F.transform(d, lambda x: F.struct(x.alias("k"), F.xxhash64(x, F.lit(1)).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")).alias("c"), *[F.pmod(F.xxhash64(x, F.lit(10 + j)), F.lit(BASE)).cast("int").alias(f"s{j}") for j in range(3)]))
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("c"))
    add = lambda s, x: F.struct((s.n + 1).alias("n"), s.k.bitwiseXOR(x.k).alias("k"), s.c.bitwiseXOR(x.c).alias("c"))

    def cell(held: Column, j: int, i: int) -> Column:
        return F.aggregate(F.filter(held, lambda x: x[f"s{j}"] == i), none, add)

    return bound(placed, lambda held: F.array(*[cell(held, j, i) for j in range(3) for i in range(BASE)]))


def fingerprint(cells: Column) -> Column:
    """A sketch as hex: 8 digits of count, 16 of digests, 8 of check values for each cell."""
    return F.lower(F.array_join(F.transform(cells, lambda s: F.concat(F.lpad(F.hex(s.n), 8, "0"), F.lpad(F.hex(s.k), 16, "0"), F.lpad(F.hex(s.c), 8, "0"))), ""))


def subtracted(a: Column, b: Column) -> Column:
    """The cells of a sketch less those of another: (``size``, ``delta``), the cells a table that its peeling takes, and the difference where BASE cells do.

    The counts are sums of +1 and -1
    over a cell's differing digests, so their squares add up to the number of these and
    what the difference in size gives by itself.
    """
    delta = F.zip_with(a, b, lambda x, y: F.struct((x.n - y.n).alias("n"), x.k.bitwiseXOR(y.k).alias("k"), x.c.bitwiseXOR(y.c).alias("c")))
    plus = lambda s, x: s + x
    squares = lambda d: F.aggregate(F.transform(d, lambda x: x.n * x.n), F.lit(0).cast("long"), plus)
    more = lambda d: F.aggregate(F.transform(F.slice(d, 1, BASE), lambda x: x.n), F.lit(0).cast("long"), plus)

    def sized(d: Column) -> Column:
        apart = F.abs(more(d)).cast("double")
        about = F.greatest(apart, (squares(d) / 3.0 - apart * apart / BASE) / (1 - 1 / BASE))
        size = F.when(about <= BASE, BASE).otherwise(F.pow(F.lit(2.0), F.ceil(F.log2(about * ROOM)))).cast("int")
        return F.struct(size.alias("size"), F.when(size == BASE, d).alias("delta"))

    return bound(delta, sized)


def _attempt(rows: DataFrame, pairs: Column) -> DataFrame:
    """(uid, pair, ok, only_a, only_b) of the pairs that differ.

    ``pairs`` of each row is an array of (pair, size, delta, a, b): the cells of
    ``delta`` are peeled where it isn't null, else the sketches of the digest arrays. It is
    formed behind the shuffle, so arrays that several pairs hold are sent once.
    """
    cells = "transform(filter(transform(p.delta, (x, i) -> named_struct('cell', int(i), 'n', x.n, 'k', x.k, 'c', x.c)), x -> x.n <> 0 OR x.k <> 0 OR x.c <> 0), x -> named_struct('pair', p.pair, 's', p.size, 'cell', x.cell, 'n', x.n, 'k', x.k, 'c', x.c))"
    side = lambda name, n: f"transform(p.{name}, x -> named_struct('pair', p.pair, 's', p.size, 'cell', -1, 'n', {n}L, 'k', x, 'c', 0L))"
    entries = f"flatten(transform(pairs, p -> IF(p.delta IS NOT NULL, {cells}, concat({side('a', 1)}, {side('b', -1)}))))"
    held = F.sum(F.aggregate(pairs, F.lit(0).cast("long"), lambda s, p: s + F.size(p["a"]) + F.size(p["b"])))
    parts = min(PARTITIONS, (rows.agg(held.alias("n")).first()["n"] or 0) // AT_ONCE + 1)
    each = rows.repartition(parts, "uid").select("uid", pairs.alias("pairs")).select("uid", F.explode(F.expr(entries)).alias("e")).select("uid", "e.*")
    slots = ", ".join(_slot("k", j, "s") for j in range(3))
    entered = each.select("uid", "pair", "s", "n", "k", F.expr(f"IF(cell < 0, {_check('k')}, c)").alias("c"), F.explode(F.expr(f"IF(cell < 0, array({slots}), array(cell))")).alias("cell"), F.lit(0).cast("long").alias("digest"))

    def summed(rows: DataFrame) -> DataFrame:
        out = rows.groupBy("uid", "pair", "s", "cell", "digest").agg(F.sum("n").alias("n"), F.bit_xor("k").alias("k"), F.bit_xor("c").alias("c"))
        return out.where("cell < 0 OR n <> 0 OR k <> 0 OR c <> 0")

    cells = summed(entered)
    same = "named_struct('cell', cell, 'digest', digest, 'n', n, 'k', k, 'c', c)"
    for j in list(range(3)) * CYCLES:
        others = ", ".join(f"named_struct('cell', {_slot('k', i, 's')}, 'digest', 0L, 'n', -n, 'k', k, 'c', c)" for i in range(3) if i != j)
        found = f"array(named_struct('cell', -1, 'digest', k, 'n', n, 'k', 0L, 'c', 0L), {others})"
        pure = f"cell >= 0 AND cell div s = {j} AND abs(n) = 1 AND c = {_check('k')} AND cell = {_slot('k', j, 's')}"
        cells = summed(cells.select("uid", "pair", "s", F.explode(F.expr(f"IF({pure}, {found}, array({same}))")).alias("e")).select("uid", "pair", "s", "e.*"))
    of = lambda n: F.array_sort(F.collect_list(F.when((F.col("cell") < 0) & (F.col("n") == n), F.col("digest"))))
    return cells.groupBy("uid", "pair").agg(F.bool_and(F.col("cell") < 0).alias("ok"), of(1).alias("only_a"), of(-1).alias("only_b"))


def pair(number: int, s: Column, a: Column, b: Column) -> Column:
    """Digest arrays and the ``subtracted`` of their sketches, as ``_attempt`` takes them."""
    return F.struct(F.lit(number).alias("pair"), s["size"].alias("size"), s["delta"].alias("delta"), a.alias("a"), b.alias("b"))


def _larger(pairs: Column, which: Column, times: int) -> Column:
    """The pairs of ``which`` with that many times the cells, to be sketched from their digests."""
    grown = lambda p: F.struct(p["pair"].alias("pair"), (p["size"] * times).cast("int").alias("size"), F.nullif(p["delta"], p["delta"]).alias("delta"), p["a"].alias("a"), p["b"].alias("b"))
    return F.transform(F.filter(pairs, lambda p: F.array_contains(which, p["pair"])), grown)


def differences(rows: DataFrame, pairs: Column, scratch: Scratch, result: tuple[str, ...] = ("only_a", "only_b")) -> DataFrame:
    """(uid, pair, *result) of the pairs that differ; ``result`` is SQL over ``only_a`` and ``only_b``.

    Pairs that fail are tried with GROWTH times the cells, again and again: an attempt
    with many more cells than digests fails by chance alone.
    """
    done, times = None, 1
    tried = scratch.keep(_attempt(rows, pairs).selectExpr("uid", "pair", "ok", *result))
    while True:
        good = tried.where("ok").drop("ok")
        done = good if done is None else done.union(good)
        failed = tried.where("NOT ok").groupBy("uid").agg(F.collect_set("pair").alias("failed"))
        if failed.isEmpty():
            return done
        times *= GROWTH
        again = _attempt(rows.join(failed, "uid"), _larger(pairs, F.col("failed"), times))
        tried = scratch.keep(again.selectExpr("uid", "pair", "ok", *result))


def likeness(na: Column, nb: Column, x: Column, y: Column) -> Column:
    """Shared digests over all digests of two texts with na and nb, of which x and y are theirs alone; null is none."""
    x, y = F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))
    return F.when(na + nb == 0, 1.0).otherwise((na - x) / F.greatest(F.lit(1), na + y)).cast("double")


def _quantiles(doc_id: str, n: int) -> Column:
    """The n - 1 ids that part the rows into n ranges, roughly."""
    if n < 2:
        return F.array().cast("array<bigint>")
    return F.percentile_approx(doc_id, [i / n for i in range(1, n)], 16 * QUANTILES)


def _range(bounds: Column, x: Column) -> Column:
    """How many of the sorted bounds are not above x, by binary search; at most QUANTILES - 1."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range((QUANTILES - 1).bit_length()))])
    go = lambda lo, step: F.when((lo + step <= F.size(bounds)) & (F.try_element_at(bounds, lo + step) <= x), lo + step).otherwise(lo)
    return F.aggregate(steps, F.lit(0), go)


def in_blocks(docs: DataFrame) -> DataFrame:
    """The documents with ``block``, ascending with doc_id, of about IN_BLOCK documents as long as QUANTILES squared blocks can hold them.

    Bounds are QUANTILES quantiles, and as many of each of these ranges: 256 rows of 255 numbers, whatever the input.
    """
    n = docs.count()
    many = max(1, -(-n // IN_BLOCK))
    first = docs.agg(_quantiles("doc_id", min(QUANTILES, many)).alias("q")).first()["q"] or []
    far = F.when(F.col("doc_id").isNull(), QUANTILES).otherwise(_range(F.array(*map(F.lit, first)).cast("array<bigint>"), F.col("doc_id")))
    placed = docs.withColumn("far", far)
    if many > QUANTILES:
        second = docs.select("doc_id").withColumn("far", far).groupBy("far").agg(_quantiles("doc_id", min(QUANTILES, -(-many // QUANTILES))).alias("q"))
        near = F.coalesce(_range(F.col("q"), F.col("doc_id")), F.lit(0))
        return placed.join(F.broadcast(second), "far").withColumn("block", F.col("far") * QUANTILES + near).drop("far", "q")
    return placed.withColumn("block", F.col("far") * QUANTILES).drop("far")


def _next_block(blocks: DataFrame) -> DataFrame:
    """(block, next_block) of the blocks that occur, the last's next being the first; there are at most QUANTILES squared and one."""
    w = Window.orderBy("block")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return blocks.select("block", F.coalesce(F.lead("block").over(w), F.first("block").over(whole)).alias("next_block"))


def _edited(text: str, following: str) -> Column:
    """The text with its last half (rounded down) replaced by as much of the beginning of the following one."""
    return F.expr(f"concat(substr({text}, 1, length({text}) - length({text}) div 2), substr({following}, 1, length({text}) div 2))")


def _described(df: DataFrame) -> DataFrame:
    """With ``edited_text`` replaced by its digest, its paragraph digests and its sketch."""
    out = df.withColumn("edited", digests(F.col("edited_text"))).withColumn("edited_sha256", F.sha2("edited_text", 256)).drop("edited_text")
    return out.withColumn("edited_cells", sketch(F.col("edited")))


def with_next(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(uid, doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, own, edited, next, e, n): digests of each text, its edited text and the next document's, and their sketches subtracted (``e``, ``n``).

    Documents are dealt once, by block, and the next one is a lead inside a block. Only
    first and last rows of blocks keep their text, to be joined.
    """
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    dealt = in_blocks(plain).repartition("block").withColumn("own", digests(F.col("text"))).withColumn("cells", sketch(F.col("own")))
    w = Window.partitionBy("block").orderBy(F.col("doc_id").asc_nulls_last(), "text")
    placed = dealt.select("*", F.row_number().over(w).alias("row"), *[F.lead(c).over(w).alias(f"next_{c}") for c in ("text", "own", "cells")])
    last = F.col("next_text").isNull()
    edge = placed.select(
        "block", "doc_id", F.length("text").cast("long").alias("n_chars"), "own", "cells", (F.col("row") == 1).alias("is_first"), last.alias("is_last"),
        F.when(last | (F.col("row") == 1), F.col("text")).alias("edge_text"), _edited("text", "next_text").alias("edited_text"), "next_own", "next_cells",
    )
    held = _described(edge).withColumn("uid", F.monotonically_increasing_id())
    done = lambda df, *more: df.select(
        "uid", "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("cells")).alias("fingerprint"), fingerprint(F.col("edited_cells")).alias("edited_fingerprint"),
        "own", "edited", F.col("next_own").alias("next"), subtracted(F.col("cells"), F.col("edited_cells")).alias("e"), subtracted(F.col("cells"), F.col("next_cells")).alias("n"), *more,
    )
    ends = F.col("is_first") | F.col("is_last")
    held = scratch.keep(done(held, "block", "is_first", "is_last", "edge_text", F.when(ends, F.col("cells")).alias("cells")))
    firsts = held.where("is_first").select(F.col("block").alias("next_block"), F.col("edge_text").alias("next_text"), F.col("own").alias("next_own"), F.col("cells").alias("next_cells"))
    lasts = held.where("is_last").select("block", "uid", "doc_id", "n_chars", "own", "cells", "edge_text")
    joined = lasts.join(_next_block(firsts.select(F.col("next_block").alias("block"))), "block").join(firsts, "next_block").withColumn("edited_text", _edited("edge_text", "next_text"))
    ends = scratch.keep(done(_described(joined)))
    return held.where("NOT is_last").select(ends.columns).union(ends)


def compared(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Fingerprints and likenesses of every document, its edited text and the next document."""
    rows = with_next(docs, scratch)
    pairs = F.array(pair(0, F.col("e"), F.col("own"), F.col("edited")), pair(1, F.col("n"), F.col("own"), F.col("next")))
    found = differences(rows.select("uid", "own", "edited", "next", "e", "n"), pairs, scratch, ("size(only_a) AS x", "size(only_b) AS y"))
    of = lambda p: F.max(F.when(F.col("pair") == p, F.struct("x", "y")))
    both = found.groupBy("uid").agg(of(0).alias("e"), of(1).alias("n"))
    out = rows.select("uid", "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", *[F.size(c).alias(f"n_{c}") for c in ("own", "edited", "next")])
    return out.join(both, "uid", "left").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("n_own"), F.col("n_edited"), F.col("e.x"), F.col("e.y")).alias("near_edited"),
        likeness(F.col("n_own"), F.col("n_next"), F.col("n.x"), F.col("n.y")).alias("near_next"),
    )


def op4_lookup_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents against its edited text and the next document."""
    return compared(table(spark, sf_dir, "documents"), Scratch(spark, "sketch"))
