"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint has one bit for each bit position set in over half the XXH64 values
of a text's word shingles. Its embedding is the number of set bits in each of 16
segments of 4 bits, packed into one long. Flipping a bit moves the embedding by
one in Manhattan distance, so that distance is a lower bound of the Hamming
distance. The range join under Manhattan distance 2 uses unit grid cells: of two
points at distance 2 or less, both are within distance 1 of a common point, so
each point is entered in its own cell and the at most 32 beside it, and candidates
share a cell. Candidates are then verified exactly by counting differing bits.

Only distinct fingerprints are joined, each standing for all its documents by the
smallest doc_id. The fingerprints of a cell of over ``CELL`` are joined by a finer grid
instead: an embedding into segments of 2 bits, and those crowded there again by one of
64 segments of one bit, with the same unit cells and the same exact check. In a cell of
the last grid all are within one bit of the cell's middle, so of each other within two:
checked against the smallest of them they hang together without all pairs.

Defined results: null text is the empty text; texts without words have fingerprint
zero, which links like any other; fewer words than a shingle are one shingle. Rows
without doc_id link like any others, so their fingerprints can connect two documents,
but never name a component; one without any doc_id has none. Repeated rows and rows of
one doc_id with different texts each have their own text's component. Very long texts
are read in parts; other columns, whatever their names, are never read; an empty table
gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, blocks, by_block, map_arrow, table
from .components import roots

SHINGLE, DISTANCE, SEED = 3, 2, 42
#: Near copies by shingle sets: words of a shingle, similarity.
NEAR_SHINGLE, NEAR_SIMILARITY = 5, 0.8
#: Bits of a segment, from grid to finer grid, and fingerprints in a cell beyond which they go on to the next.
WIDTHS, CELL = (4, 2, 1), 32
#: Shingle values whose bits are counted at once.
AT_ONCE = 200_000
#: Longs of parity bits of a shingle set.
PARITY_LONGS = 4
#: Counters of shingles by their leading bits, parts in which they travel, and groups in which tasks' counters are added first.
COUNTER_BITS, COUNTER_PARTS, COUNTER_GROUPS = 20, 4, 256


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64 bits as an unsigned number. ASCII letters are lower-cased; words end at bytes 9 to 13 and 32."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for lo in range(0, n, AT_ONCE):
        part = words[lo : min(n, lo + AT_ONCE) + shingle - 1]
        if len(part) <= shingle:
            joined = [b" ".join(part)]
        elif shingle == 3:
            joined = [b"%b %b %b" % x for x in zip(part, part[1:], part[2:], strict=False)]
        else:
            joined = [b" ".join(part[i : i + shingle]) for i in range(len(part) - shingle + 1)]
        h = np.array([digest(s, SEED) for s in joined], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of each row, where it is read; fp holds the bits as a signed long."""

    def work(keys: list, texts: list) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(fps)], names=["doc_id", "fp"])

    return map_arrow(docs.select("doc_id", "text"), by_block(["doc_id", "text"], work), "doc_id long, fp long")


def embedding(fp: F.Column, width: int = 4) -> F.Column:
    """Set bits of each segment of ``width`` bits, as many bits of the result to a segment."""
    if width == 1:
        return fp
    even, pair = F.lit(0x55555555).cast("long"), F.lit(0x33333333).cast("long")

    def half(x: F.Column) -> F.Column:
        by_two = x.bitwiseAND(even) + F.shiftrightunsigned(x, 1).bitwiseAND(even)
        return by_two if width == 2 else by_two.bitwiseAND(pair) + F.shiftrightunsigned(by_two, 2).bitwiseAND(pair)

    low = half(fp.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
    return F.shiftleft(half(F.shiftrightunsigned(fp, 32)), 32).bitwiseOR(low)


def cells(point: F.Column, width: int = 4) -> F.Column:
    """The point's own cell and those one step away in one segment, within 0 to ``width``."""
    if width == 1:
        # a step in a segment of one bit flips it
        flip = lambda i: point.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int")))
        return F.concat(F.array(point), F.transform(F.sequence(F.lit(0), F.lit(63)), flip))
    mask = F.lit(2 * width - 1).cast("long")
    held = [F.shiftrightunsigned(point, width * i).bitwiseAND(mask) for i in range(64 // width)]
    up = [F.when(h < width, point.bitwiseXOR(F.shiftleft(h.bitwiseXOR(h + 1), width * i))) for i, h in enumerate(held)]
    down = [F.when(h > 0, point.bitwiseXOR(F.shiftleft(h.bitwiseXOR(h - 1), width * i))) for i, h in enumerate(held)]
    return F.filter(F.array(point, *up, *down), lambda x: x.isNotNull())


def links(distinct: DataFrame, scratch: Scratch, most: int = CELL) -> DataFrame:
    """Links (a, b) between the nodes of distinct fingerprints (node, fp) that connect all at 2 or fewer differing bits."""
    todo, found = distinct.select("node", "fp"), None
    near = lambda other: F.bit_count(F.col("fp").bitwiseXOR(F.col(other))) <= DISTANCE
    for width in WIDTHS:
        entered = todo.withColumn("point", embedding(F.col("fp"), width)).select("node", "fp", F.explode(cells(F.col("point"), width)).alias("cell"))
        # counts are combined before they move, and a crowded cell's rows may be split in the join
        sizes = entered.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("node", "fp")).alias("first")).where("n > 1")
        # merged whatever Spark's estimate is, which leaves out how many rows explode makes, so that it would broadcast them all
        shared = scratch.keep(entered.join(sizes.hint("merge"), "cell"))
        light = shared.where(F.col("n") <= most).select("cell", "node", "fp")
        other = light.select("cell", F.col("node").alias("b"), F.col("fp").alias("fp_b"))
        pairs = light.join(other.hint("merge"), "cell").where((F.col("node") < F.col("b")) & near("fp_b")).select(F.col("node").alias("a"), "b")
        found = pairs if found is None else found.union(pairs)
        crowded = shared.where(F.col("n") > most)
        if width == 1:
            # a cell of this grid is a fingerprint and those one bit from it
            star = crowded.where((F.col("node") != F.col("first.node")) & near("first.fp")).select(F.col("first.node").alias("a"), F.col("node").alias("b"))
            found = found.union(star)
        else:
            todo = scratch.keep(crowded.select("node", "fp").distinct())
            if todo.isEmpty():
                break
    return found.distinct()


def components(spark: SparkSession, docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) of every document. Fingerprints are the nodes, so those of rows without doc_id link too."""
    scratch = Scratch(spark, "simhash")
    fps = scratch.keep(fingerprints(docs, shingle))
    distinct = scratch.keep(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = roots(links(distinct.select(F.col("fp").alias("node"), "fp"), scratch), scratch)
    owner = scratch.keep(distinct.join(found.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    named = owner.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(owner.join(named.hint("merge"), "root").select("fp", "component_id").hint("merge"), "fp").select("doc_id", "fp", "component_id")


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(text: str | None, shingle: int = NEAR_SHINGLE) -> np.ndarray:
    """Distinct hashes of the word shingles; fewer words are one shingle, none is none."""
    words = _words(text)
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), SEED) for i in range(max(1, len(words) - shingle + 1))], np.uint64))


def _slots(held: np.ndarray) -> np.ndarray:
    return (held >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def _prefix(held: np.ndarray, often: np.ndarray, least: float) -> np.ndarray:
    """The shingles of a sorted set, rarest first by (their counter in ``often``, value), of which two sets similar by ``least`` share one."""
    if not len(held):
        return held
    return held[np.lexsort((held, often[_slots(held)]))[: len(held) - math.ceil(least * len(held) - 1e-6) + 1]]


def _parity(held: np.ndarray) -> np.ndarray:
    """For each of 64 x PARITY_LONGS classes of shingles, whether the set has an odd number of them."""
    odd = np.bincount((held % np.uint64(64 * PARITY_LONGS)).astype(np.int64), minlength=64 * PARITY_LONGS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _counted(named: DataFrame) -> np.ndarray:
    """How many texts have shingles of each counter, over all texts. They only order shingles, no result depends on them.

    A shingle in n texts stands out of its counter's noise once n passes a few square
    roots of what the counter holds, so what stays unseen grows with the root of the input.
    """
    part = (1 << COUNTER_BITS) // COUNTER_PARTS

    def rows(counts: np.ndarray) -> list[bytes]:
        z = zstandard.ZstdCompressor(level=1)
        return [z.compress(np.minimum(counts[k * part : (k + 1) * part], 0xFFFFFFFF).astype(np.uint32).tobytes()) for k in range(len(counts) // part)]

    def count(batches):
        held = np.zeros(1 << COUNTER_BITS, np.int64)
        for batch in batches:
            for lo, hi in blocks(texts := batch.column(0).to_pylist()):
                held += np.bincount(np.concatenate([_slots(shingles(t)) for t in texts[lo:hi]]), minlength=len(held))
        group = TaskContext.get().partitionId() % COUNTER_GROUPS
        yield pa.RecordBatch.from_arrays([pa.array(range(COUNTER_PARTS), pa.int32()), pa.array([group] * COUNTER_PARTS, pa.int32()), pa.array(rows(held), pa.binary())], names=["part", "group", "counts"])

    def added(table: pa.Table) -> pa.Table:
        z, total = zstandard.ZstdDecompressor(), np.zeros(part, np.int64)
        for x in table.column("counts"):
            total += np.frombuffer(z.decompress(x.as_py()), np.uint32)
        return pa.table({"part": table.column("part")[:1], "group": table.column("group")[:1], "counts": pa.array(rows(total), pa.binary())})

    schema = "part int, group int, counts binary"
    found = map_arrow(named.select("text"), count, schema).groupBy("part", "group").applyInArrow(added, schema).groupBy("part").applyInArrow(added, schema)
    out, z = np.zeros(1 << COUNTER_BITS, np.uint32), zstandard.ZstdDecompressor()
    for r in found.collect():
        out[r["part"] * part : (r["part"] + 1) * part] = np.frombuffer(z.decompress(bytes(r["counts"])), np.uint32)
    return out


def near_links(docs: DataFrame, nodes: DataFrame | None, scratch: Scratch, least: float = NEAR_SIMILARITY, known: DataFrame | None = None) -> DataFrame:
    """Links (a, b) that connect all documents of ``nodes`` (doc_id; all if None) whose five-word shingle sets have a Jaccard similarity of ``least`` or more.

    Two sets x and y that similar share at least t = least / (1 + least) (|x| + |y|)
    shingles, so in any common order of shingles the first shared one has t - 1 or more
    behind it in both. Each distinct set enters its rarest shingles as far as that
    reaches, and pairs that meet there are all candidates there can be. First the sets
    of a shingle are verified against one of them, the one best supported by others,
    as an original is by its edited copies. Then all candidates that these links, equal
    sets and ``known`` links (a, b) leave in different components are verified: those
    outside the most frequent component of a shingle against all of its sets. Pairs
    within a component aren't, as no link between them changes it, nor are pairs whose
    parity bits differ in more places than sets that similar can differ in shingles: each
    shingle that only one has flips one bit.
    """
    links, _, more = _near_links(docs, nodes, scratch, least, known)
    return links.union(more)


def _near_links(docs: DataFrame, nodes: DataFrame | None, scratch: Scratch, least: float = NEAR_SIMILARITY, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of ``near_links``: the first links with ``known``, the same components as links of root and member, and the links between these components."""
    named = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    counters = docs.sparkSession.sparkContext.broadcast(_counted(named))

    def enter(keys: list, texts: list) -> pa.RecordBatch:
        sets, often = [shingles(t) for t in texts], counters.value
        first = [_prefix(x, often, least) for x in sets]
        ends = np.cumsum([0, *[len(x) for x in first]]).astype(np.int32)
        tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.uint64), *first]).view(np.int64)))
        names = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
        bits = np.stack([_parity(x) for x in sets])
        columns = [pa.array(keys, pa.int64()), pa.array(names), pa.array([len(x) for x in sets], pa.int32()), tokens, *[pa.array(bits[:, k]) for k in range(PARITY_LONGS)]]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "node", "size", "tokens", *parity])

    parity = [f"p{k}" for k in range(PARITY_LONGS)]
    entered = map_arrow(named, by_block(["doc_id", "text"], enter), "doc_id long, node long, size int, tokens array<long>, " + ", ".join(f"{c} long" for c in parity)).where("size > 0")
    rows = scratch.keep(entered if nodes is None else entered.join(nodes.hint("merge"), "doc_id", "left_semi"))
    known_sets = scratch.keep(rows.groupBy("node").agg(F.min("doc_id").alias("rep"), *[F.min(c).alias(c) for c in parity]))
    owner, bits = known_sets.select("node", "rep"), known_sets.select(F.col("rep").alias("doc_id"), *parity)
    equal = rows.select("node", "doc_id").join(owner.hint("merge"), "node").where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct()
    # one shuffle of the entries; equal sets enter once
    one = rows.select("node", "size", F.posexplode("tokens").alias("pos", "token")).repartition("token").distinct()
    met = one.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("n > 1")
    shared = scratch.keep(met.join(owner.hint("merge"), "node").select("token", F.col("rep").alias("doc_id"), "size", "pos", "n"))

    t = least / (1 + least)
    enough = f"ceil({t!r} * (size + size_b) - 1e-6)"
    may = f"least(size - pos, size_b - pos_b) >= {enough} AND least(size, size_b) >= {least!r} * greatest(size, size_b) - 1e-6"
    other = [F.col("size").alias("size_b"), F.col("pos").alias("pos_b")]
    support = shared.groupBy("doc_id").agg((F.sum(F.log2("n")) / F.max("size")).alias("support"))
    best = shared.join(support.hint("merge"), "doc_id").groupBy("token").agg(F.max_by(F.struct(F.col("doc_id").alias("b"), *other), F.struct("support", -F.col("doc_id"))).alias("o")).select("token", "o.*")
    star = scratch.keep(shared.join(best.hint("merge"), "token").where("doc_id <> b").where(may).select(F.col("doc_id").alias("a"), "b").distinct())
    links = equal.union(_verified(named, star, scratch, least))
    links = scratch.keep(links if known is None else links.union(known.select("a", "b")))
    scratch.drop(rows)
    scratch.drop(star)

    found = roots(links, scratch).select(F.col("node").alias("doc_id"), "root")
    rooted = shared.join(found.hint("merge"), "doc_id", "left").join(bits.hint("merge"), "doc_id")
    marked = scratch.keep(rooted.select("token", "doc_id", "size", "pos", F.coalesce("root", "doc_id").alias("root"), *parity))
    scratch.drop(shared)
    scratch.drop(known_sets)
    major = marked.groupBy("token", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("token").agg(F.max_by("root", F.struct("n", "root")).alias("major"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1").drop("kinds")
    split = scratch.keep(marked.join(major.hint("merge"), "token"))
    scratch.drop(marked)
    right = split.select("token", F.col("doc_id").alias("b"), *other, F.col("root").alias("root_b"), *[F.col(c).alias(f"{c}_b") for c in parity])
    apart = " + ".join(f"bit_count({c} ^ {c}_b)" for c in parity) + f" <= size + size_b - 2 * {enough}"
    rest = split.where("root <> major").join(right.hint("merge"), "token").where("root <> root_b AND (root_b = major OR doc_id < b)").where(may).where(apart)
    pairs = scratch.keep(rest.select(F.least("doc_id", "b").alias("a"), F.greatest("doc_id", "b").alias("b")).distinct())
    scratch.drop(split)
    return links, found.select(F.col("root").alias("a"), F.col("doc_id").alias("b")), _verified(named, pairs, scratch, least)


#: Packed bytes of the texts that are compared with one text in a row, unless one text is larger.
COMPARED_BYTES = 1 << 20


def _verified(named: DataFrame, pairs: DataFrame, scratch: Scratch, least: float) -> DataFrame:
    """Those of the pairs (a, b) of documents whose whole shingle sets are similar by ``least`` or more.

    The texts that meet a b are dealt to rows of about COMPARED_BYTES, so that the text of
    a b of many pairs goes along once for each row and its pairs spread over tasks.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()

    def pack(keys: list, texts: list) -> pa.RecordBatch:
        z = zstandard.ZstdCompressor(level=3)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([z.compress((t or "").encode("utf-8", "surrogatepass")) for t in texts], pa.binary())], names=["doc_id", "packed"])

    packed = map_arrow(named.select("doc_id", "text"), by_block(["doc_id", "text"], pack), "doc_id long, packed binary")
    texts = scratch.keep(packed.join(wanted.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"]))

    def verify(batches):
        z = zstandard.ZstdDecompressor()
        plain = lambda x: shingles(z.decompress(x).decode("utf-8", "surrogatepass"))
        for batch in batches:
            for i in range(batch.num_rows):
                two, keep = plain(batch.column(1)[i].as_py()), []
                for row in batch.column(2)[i]:
                    one = plain(row["x"].as_py())
                    both = len(np.intersect1d(one, two, assume_unique=True))
                    if both and both >= least * (len(one) + len(two) - both):
                        keep.append(row["a"].as_py())
                if keep:
                    yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int64()), pa.array([batch.column(0)[i].as_py()] * len(keep), pa.int64())], names=["a", "b"])

    sized = pairs.join(texts.select(F.col("doc_id").alias("a"), F.length("packed").alias("size")).hint("merge"), "a")
    parts = sized.groupBy("b").agg(F.ceil(F.sum("size") / COMPARED_BYTES).alias("parts"))
    dealt = pairs.join(parts.hint("merge"), "b").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts"))).drop("parts")
    left = dealt.join(texts.select(F.col("doc_id").alias("a"), F.col("packed").alias("x")).hint("merge"), "a")
    rows = left.groupBy("b", "part").agg(F.collect_list(F.struct("a", "x")).alias("met"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("packed").alias("y"))
    found = scratch.keep(map_arrow(rows.join(right.hint("merge"), "b").select("b", "y", "met"), verify, "a long, b long"))
    scratch.drop(texts)
    return found


def deduplicate(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest doc_id, nulls last.

    Groups are the components of fingerprints at DISTANCE or fewer bits, joined where
    the five-word shingles of any of their documents are similar by 0.8 or more. Rows are
    told apart by a number of their own: rows without doc_id, and rows of one doc_id with
    different texts, are documents like any others. Texts without words are one group.
    Columns, whatever their names, stay as they are. A very long text is one row of its
    task, whose shingles are held at once (8 bytes each, and its words).
    """
    scratch = Scratch(spark, "copies")
    doc = F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns])
    rows = scratch.keep(docs.select(doc.alias("doc")).withColumn("row", F.monotonically_increasing_id()))
    named = rows.select(F.col("row").alias("doc_id"), F.col("doc")["text"].alias("text"))
    found = scratch.keep(components(spark, named))
    known = found.where("doc_id <> component_id").select(F.col("component_id").alias("a"), F.col("doc_id").alias("b"))
    near = Scratch(spark, "near")
    _, stars, more = _near_links(named, None, near, known=known)
    # stars and few links need fewer rounds than all links again
    links = scratch.keep(stars.union(more))
    near.clear()
    hung = scratch.keep(roots(links, near).withColumnRenamed("node", "row"))
    near.clear()
    members = hung.union(hung.select(F.col("root").alias("row"), "root").distinct())
    # the ids grow with the texts: the plan that holds for many is the plan for few
    ranked = rows.select("row", F.col("doc")["doc_id"].alias("id")).join(members.hint("merge"), "row")
    first = ranked.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))["row"].alias("row"))
    gone = scratch.keep(members.select("row").join(first.hint("merge"), "row", "left_anti"))
    return rows.join(gone.hint("merge"), "row", "left_anti").select(*[F.col("doc")[c].alias(c) for c in docs.columns])


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every whole text of documents."""
    found = components(spark, table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
