"""Removal of byte strings repeated across documents, by a depth-limited radix sort of suffixes.

A suffix counts only through its first ``DEPTH`` bytes, its window. Windows that
occur in more than one text are found in two rounds of hash-dealt buckets:

1. Sampling. Every window contains a gram of ``GRAM`` bytes with the least hash,
   its anchor; equal windows have equal anchors at equal offsets. Only anchors
   are dealt, and those whose gram occurs in a single text drop out with all their
   windows.
2. Sorting. The fragments around surviving anchors are dealt by gram; the windows of a
   gram in over ``HOT`` texts one by one, by all their bytes, so that a string of any
   length in many contexts is many groups, of which none is larger than that of windows
   that are equal and sent once from each batch. In a bucket
   the suffixes are sorted by their 8-byte digits, most significant first and inside
   the groups of equal digits before; a group that lies in one document ends, and only
   groups of several documents go on to the next digit. Groups equal through DEPTH
   bytes are exactly the repeated windows, and a group's least doc_id tells which of
   them are covered.

Equal texts (of one 128-bit digest) are one text with the least of their doc_ids; the others are covered
whole. What repeats inside a batch of texts is settled there and sent once, so a
passage in a third of all documents sends one entry from each batch. Texts move as
compressed bytes to the sorting round, and again to have their spans cut out.

Defined results: null text is empty; texts under DEPTH bytes lose nothing; rows
without doc_id count as behind all others; repeated rows of a doc_id are no
smaller than each other, so they don't cover each other; very long texts are searched
in chunks; other columns, whatever their names, are never read; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, map_arrow, small_batches, table

DEPTH, GRAM = 50, 24
#: Bytes of text for each bucket.
BUCKET_BYTES = 24 << 20
#: Parts, by the anchor's hash, in which a bucket is sorted one after another.
PARTS = 16
#: Texts with a gram beyond which its windows are dealt one by one; so many fragments are a hundredth of a bucket.
HOT = 4096
#: Copies of a text from which it is broadcast to them, and such texts up to which it is.
MANY_COPIES, MOST_BROADCAST = 1000, 100_000
#: Window starts that are looked at at once.
CHUNK = 1 << 18
LAST = (1 << 63) - 1
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two neighbouring strings from theirs."""
    x = a * _ODD[0]
    x ^= x >> np.uint64(29)
    x += b
    x *= _ODD[1]
    return x


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes at every place."""
    by_size = {1: (raw.astype(np.uint64) + np.uint64(1)) * _ODD[2]}
    size = 1
    while 2 * size <= GRAM:
        h = by_size[size]
        by_size[2 * size] = _join(h[:-size], h[size:])
        size *= 2
    out, at = by_size[size], size
    for s in sorted(by_size, reverse=True):
        if at + s <= GRAM:
            part = by_size[s][at:]
            n = min(len(out), len(part))
            out, at = _join(out[:n], part[:n]), at + s
    out = out[: len(raw) - GRAM + 1]
    return out ^ (out >> np.uint64(32))


def anchors(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first, last, at): each anchor's gram hash, the range of window starts that it stands for, and its place."""
    windows = len(raw) - DEPTH + 1
    found = []
    for lo in range(0, max(0, windows), CHUNK):
        hi = min(windows, lo + CHUNK)
        h = gram_hashes(raw[lo : hi + DEPTH - 1])
        low = np.uint64((1 << 20) - 1)
        v = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        width, size = DEPTH - GRAM + 1, 1
        while 2 * size <= width:
            v = np.minimum(v[:-size], v[size:])
            size *= 2
        v = np.minimum(v[: hi - lo], v[width - size : width - size + hi - lo])
        at = (v & low).astype(np.int64)
        start = np.concatenate([[0], np.nonzero(np.diff(at))[0] + 1])
        found.append((h[at[start]], start + lo, np.concatenate([start[1:], [hi - lo]]) - 1 + lo, at[start] + lo))
    if not found:
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


def _utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _names(raw: bytes) -> tuple[int, int]:
    """Two signed longs that name a text."""
    d = xxhash.xxh128_digest(raw)
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def _blobs(bucket: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, list[bytes]]]:
    """Rows of columns dealt by bucket."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cuts = np.concatenate([[0], np.nonzero(np.diff(b))[0] + 1, [len(b)]])
    held = [c[order] for c in columns]
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if lo < hi:
            yield int(b[lo]), [c[lo:hi].tobytes() for c in held]


def describe(docs: DataFrame) -> DataFrame:
    """(doc_id, t1, t2, n_bytes, sha256) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [_utf8(t) for t in batch.column(1).to_pylist()]
            t1, t2 = zip(*map(_names, raw), strict=True) if raw else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(t1, pa.int64()), pa.array(t2, pa.int64()), pa.array([len(r) for r in raw], pa.int64()), pa.array([hashlib.sha256(r).hexdigest() for r in raw], pa.string())], names=["doc_id", "t1", "t2", "n_bytes", "sha256"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, t1 long, t2 long, n_bytes long, sha256 string")


def pack(docs: DataFrame) -> DataFrame:
    """(t1, t2, packed): each distinct text once, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            once = {_names(r): r for r in map(_utf8, batch.column(0).to_pylist()) if len(r) >= DEPTH}
            if once:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in once], pa.int64()), pa.array([k[1] for k in once], pa.int64()), pa.array([z.compress(r) for r in once.values()], pa.binary())], names=["t1", "t2", "packed"])

    return map_arrow(docs.select("text"), run, "t1 long, t2 long, packed binary").dropDuplicates(["t1", "t2"])


def _unpack(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)


def shared_grams(docs: DataFrame, buckets: int) -> DataFrame:
    """(t1, gram): the anchors of each text whose gram other texts have too; gram is bucket and 32 bits of its hash."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            once = {_names(r): r for r in map(_utf8, batch.column(0).to_pylist()) if len(r) >= DEPTH}
            hashes = [np.unique(anchors(np.frombuffer(r, np.uint8))[0]) for r in once.values()]
            if not hashes:
                continue
            tag = np.repeat(np.array([k[0] for k in once], np.int64), [len(h) for h in hashes])
            h = np.concatenate(hashes)
            order = np.argsort(h, kind="stable")
            h, tag = h[order], tag[order]
            new = np.concatenate([[True], h[1:] != h[:-1]])
            times = np.diff(np.append(np.nonzero(new)[0], len(h)))
            many = np.repeat(times > 1, times)
            sent = new & many
            once_here = ~many
            rows = []
            # entries: grams of one text with its tag, grams of several with tag 0 and flag 1, in the order of tags
            g = np.concatenate([h[once_here], h[sent]])
            t = np.concatenate([tag[once_here], np.zeros(int(sent.sum()), np.int64)])
            flag = np.concatenate([np.zeros(int(once_here.sum()), np.int8), np.ones(int(sent.sum()), np.int8)])
            order = np.argsort(t, kind="stable")
            g, t, flag = g[order], t[order], flag[order]
            for b, (low, tags, flags) in _blobs(_bucket(g, buckets), [g.astype(np.uint32), t, flag]):
                rows.append((b, 0, low, tags, flags))
            # those of several texts are settled here; their answers go along
            t, g = tag[many], h[many]
            for b, (tags, grams) in _blobs((t.view(np.uint64) % np.uint64(buckets)).astype(np.int64), [t, _gram_key(g, buckets)]):
                rows.append((b, 1, grams, tags, b""))
            b, k, x, y, z = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.int8()), pa.array(x, pa.binary()), pa.array(y, pa.binary()), pa.array(z, pa.binary())], names=["bucket", "kind", "grams", "tags", "flags"])

    def settle(rows: pa.Table) -> pa.Table:
        kind = rows.column("kind").to_pylist()
        cols = [rows.column(c).to_pylist() for c in ("grams", "tags", "flags")]
        asked = [i for i, k in enumerate(kind) if k == 0]
        known = [i for i, k in enumerate(kind) if k == 1]
        g = np.concatenate([np.empty(0, np.uint32), *[np.frombuffer(cols[0][i], np.uint32) for i in asked]])
        t = np.concatenate([np.empty(0, np.int64), *[np.frombuffer(cols[1][i], np.int64) for i in asked]])
        f = np.concatenate([np.empty(0, np.int8), *[np.frombuffer(cols[2][i], np.int8) for i in asked]])
        order = np.argsort(g, kind="stable")
        g, t, f = g[order], t[order], f[order]
        if len(g):
            start = np.concatenate([[0], np.nonzero(np.diff(g))[0] + 1])
            times = np.diff(np.append(start, len(g)))
            shared = (np.maximum.reduceat(t, start) != np.minimum.reduceat(t, start)) | (np.maximum.reduceat(f, start) > 0)
            keep = np.repeat(shared, times) & (f == 0)
            b = rows.column("bucket")[0].as_py()
            t, key = t[keep], (np.int64(b) << np.int64(32)) | g[keep].astype(np.int64)
        else:
            key = np.empty(0, np.int64)
        t = np.concatenate([t, *[np.frombuffer(cols[1][i], np.int64) for i in known]])
        key = np.concatenate([key, *[np.frombuffer(cols[0][i], np.int64) for i in known]])
        return pa.table({"t1": pa.array(t, pa.int64()), "gram": pa.array(key, pa.int64())})

    dealt = map_arrow(docs.select("text"), deal, "bucket int, kind tinyint, grams binary, tags binary, flags binary")
    return dealt.groupBy("bucket").applyInArrow(settle, "t1 long, gram long")


def _gram_key(h: np.ndarray, buckets: int) -> np.ndarray:
    return (_bucket(h, buckets) << np.int64(32)) | (h & np.uint64(0xFFFFFFFF)).astype(np.int64)


def equal_groups(data: np.ndarray, starts: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each suffix of ``data`` at ``starts``: whether a suffix equal through DEPTH bytes lies in a smaller document.

    Most significant digit first, 8 bytes a pass, each sorted inside the groups that the
    digits before have made; groups inside one document end early.
    """
    covered = np.zeros(len(starts), bool)
    alive = np.arange(len(starts))
    group = np.zeros(len(starts), np.int64)
    digits = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    for depth in range(0, DEPTH, 8):
        if not len(alive):
            break
        digit = digits[starts[alive] + depth].view(">u8").reshape(-1).astype(np.uint64)
        if depth + 8 > DEPTH:
            digit = digit >> np.uint64(8 * (depth + 8 - DEPTH))
        order = np.lexsort((digit, group)) if depth else np.argsort(digit)
        digit, group, alive = digit[order], group[order], alive[order]
        new = np.concatenate([[True], (digit[1:] != digit[:-1]) | (group[1:] != group[:-1])])
        first = np.nonzero(new)[0]
        times = np.diff(np.append(first, len(digit)))
        d = docs[alive]
        least, most = np.minimum.reduceat(d, first), np.maximum.reduceat(d, first)
        go_on = np.repeat(least != most, times)
        if depth + 8 >= DEPTH:
            covered[alive[d > np.repeat(least, times)]] = True
        group = np.cumsum(new)[go_on]
        alive = alive[go_on]
    return covered


def _runs(flag: np.ndarray, where: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, begin, end) of bytes covered by flagged windows; neighbours of one owner are joined."""
    w, o = where[flag], owner[flag]
    if not len(w):
        return o, w, w
    cut = np.concatenate([[True], (np.diff(w) != 1) | (np.diff(o) != 0)])
    first = np.nonzero(cut)[0]
    last = np.append(first[1:], len(w)) - 1
    return o[first], w[first], w[last] + DEPTH


def fragments(raw: np.ndarray, grams: np.ndarray, buckets: int) -> list[tuple[int, int, int, int]]:
    """(bucket, part, begin, end) of the text around its anchors in ``grams``; hot grams are there as -1 - key, and each of their windows is a fragment."""
    h, lo, hi, at = anchors(raw)
    key = _gram_key(h, buckets)
    cold, hot = np.isin(key, grams[grams >= 0]), np.isin(key, -1 - grams[grams < 0])
    x = h[cold]
    out = list(zip(_bucket(x, buckets).tolist(), (x % np.uint64(PARTS)).tolist(), lo[cold].tolist(), (hi[cold] + DEPTH).tolist(), strict=True))
    if hot.any():
        times = hi[hot] - lo[hot] + 1
        begin = np.arange(times.sum()) + np.repeat(lo[hot] - (np.cumsum(times) - times), times)
        data, digest = raw.tobytes(), xxhash.xxh64_intdigest
        x = np.array([digest(data[a : a + DEPTH]) for a in begin.tolist()], np.uint64)
        out += zip(_bucket(x, buckets).tolist(), (x % np.uint64(PARTS)).tolist(), begin.tolist(), (begin + DEPTH).tolist(), strict=True)
    return out


def with_heat(grams: DataFrame) -> DataFrame:
    """(t1, gram): grams of over HOT texts as -1 - gram."""
    hot = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("gram", F.lit(True).alias("hot"))
    return grams.join(hot, "gram", "left").select("t1", F.when(F.col("hot"), -1 - F.col("gram")).otherwise(F.col("gram")).alias("gram"))


def covered_spans(texts: DataFrame, buckets: int) -> DataFrame:
    """(t1, doc, begin, end) of covered bytes, from (t1, doc, packed, grams); spans may overlap."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t1, doc, packed = (batch.column(i).to_pylist() for i in range(3))
            grams = batch.column(3)
            least: dict[bytes, int] = {}
            mine = []
            for i, blob in enumerate(packed):
                raw = _unpack(blob)
                data = raw.tobytes()
                for b, u, x, y in fragments(raw, grams[i].values.to_numpy(zero_copy_only=False), buckets):
                    piece = data[x:y]
                    if least.setdefault(piece, doc[i]) > doc[i]:
                        least[piece] = doc[i]
                    mine.append((b, u, i, x, piece))
            sent: dict[int, list] = {}
            known: dict[int, list] = {}
            for b, u, i, x, piece in mine:
                if least[piece] < doc[i]:
                    spans = known.setdefault(int(t1[i]) % buckets, [])
                    if spans and spans[-1][0] == i and spans[-1][1] <= x <= spans[-1][1] + spans[-1][2]:
                        # windows side by side are one span
                        spans[-1] = (i, spans[-1][1], max(spans[-1][2], x + len(piece) - spans[-1][1]))
                    else:
                        spans.append((i, x, len(piece)))
                else:
                    sent.setdefault(b, []).append((i, x, piece, u))
            rows = []
            t1, doc = np.array(t1, np.int64), np.array(doc, np.int64)
            for b, x in sent.items():
                i = np.array([y[0] for y in x])
                size = np.array([len(y[2]) for y in x], np.int32)
                rows.append((b, 0, t1[i].tobytes(), doc[i].tobytes(), np.array([y[1] for y in x], np.int64).tobytes(), size.tobytes(), b"".join([y[2] for y in x]), bytes([y[3] for y in x])))
            for b, x in known.items():
                i = np.array([y[0] for y in x])
                rows.append((b, 1, t1[i].tobytes(), doc[i].tobytes(), np.array([y[1] for y in x], np.int64).tobytes(), np.array([y[2] for y in x], np.int32).tobytes(), b"", b""))
            if rows:
                c = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), pa.array(c[1], pa.int8()), *[pa.array(x, pa.binary()) for x in c[2:]]], names=["bucket", "kind", "t1", "doc", "at", "size", "data", "part"])

    def settle(rows: pa.Table) -> pa.Table:
        kind = np.array(rows.column("kind").to_pylist())

        def gather(name: str, dtype, k: int) -> np.ndarray:
            held = rows.column(name).to_pylist()
            return np.concatenate([np.empty(0, dtype), *[np.frombuffer(held[i], dtype) for i in np.nonzero(kind == k)[0]]])

        t1, doc, at, size, data = (gather(n, d, 0) for n, d in (("t1", np.int64), ("doc", np.int64), ("at", np.int64), ("size", np.int32), ("data", np.uint8)))
        part = gather("part", np.uint8, 0)
        base = np.cumsum(size.astype(np.int64)) - size
        found = []
        for k in range(PARTS):
            mine = np.nonzero(part == k)[0]
            n = (size[mine] - DEPTH + 1).astype(np.int64)
            piece = np.repeat(mine, n)
            inner = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
            hit = equal_groups(data, base[piece] + inner, doc[piece])
            found.append(_runs(hit, at[piece] + inner, piece))
        o, a, z = (np.concatenate(x) for x in zip(*found, strict=True))
        k1, kd, ka, ks = (gather(x, d, 1) for x, d in (("t1", np.int64), ("doc", np.int64), ("at", np.int64), ("size", np.int32)))
        return pa.table({"t1": np.concatenate([t1[o], k1]), "doc": np.concatenate([doc[o], kd]), "begin": np.concatenate([a, ka]), "end": np.concatenate([z, ka + ks])})

    dealt = map_arrow(texts.select("t1", "doc", "packed", "grams"), deal, "bucket int, kind tinyint, t1 binary, doc binary, at binary, size binary, data binary, part binary")
    return dealt.groupBy("bucket").applyInArrow(settle, "t1 long, doc long, begin long, end long")


def union_of_spans(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes in any span."""
    order = np.argsort(begin, kind="stable")
    b, e = begin[order], np.maximum.accumulate(end[order])
    first = np.concatenate([[0], np.nonzero(b[1:] > e[:-1])[0] + 1])
    return b[first], e[np.append(first[1:], len(b)) - 1]


def cut_out(texts: DataFrame) -> DataFrame:
    """(t1, t2, removed, spans, kept_sha256, kept) from (t1, t2, packed, begins, ends)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed, begins, ends = batch.column(2).to_pylist(), batch.column(3), batch.column(4)
            rows = []
            for i, blob in enumerate(packed):
                raw = _unpack(blob)
                b, e = union_of_spans(*(np.asarray(x[i].values.to_numpy(zero_copy_only=False), np.int64) for x in (begins, ends)))
                keep = np.ones(len(raw), bool)
                for x, y in zip(b.tolist(), e.tolist(), strict=True):
                    keep[x:y] = False
                kept = raw[keep].tobytes()
                rows.append((len(raw) - len(kept), len(b), hashlib.sha256(kept).hexdigest()))
            if rows:
                c = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.string())], names=["t1", "t2", "n_removed", "n_spans", "kept_sha256"])

    return map_arrow(texts.select("t1", "t2", "packed", "begins", "ends"), run, "t1 long, t2 long, n_removed long, n_spans long, kept_sha256 string")


def with_copies(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """``rows`` with the columns of their text (t1, t2, copies, ...).

    Rows of a text of many copies would meet in one task: such texts, if they are as few
    as they should be, are broadcast to their rows, and only the other rows are shuffled.
    """
    many = texts.where(F.col("copies") > MANY_COPIES)
    if many.limit(MOST_BROADCAST + 1).count() > MOST_BROADCAST:
        return rows.join(texts, ["t1", "t2"])
    few = rows.join(F.broadcast(many.select("t1", "t2")), ["t1", "t2"], "left_anti").join(texts.where(F.col("copies") <= MANY_COPIES), ["t1", "t2"])
    return few.unionByName(rows.join(F.broadcast(many), ["t1", "t2"]))


def remove_repeats(spark: SparkSession, docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    small_batches(spark)
    scratch = Scratch(spark, "suffixes")
    rows = scratch.keep(describe(docs))
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket_bytes))
    first = F.min(F.coalesce("doc_id", F.lit(LAST))).alias("doc")
    texts = scratch.keep(rows.groupBy("t1", "t2").agg(first, F.count(F.lit(1)).alias("copies")))
    grams = with_heat(scratch.keep(shared_grams(docs, buckets))).groupBy("t1").agg(F.collect_list("gram").alias("grams")).join(texts.drop("copies"), "t1")
    # dealt once by (t1, t2) and read by both joins: neither needs it dealt otherwise
    packed = pack(docs)
    spans = covered_spans(packed.join(grams, ["t1", "t2"]), buckets)
    each = spans.groupBy("t1", "doc").agg(F.collect_list("begin").alias("begins"), F.collect_list("end").alias("ends")).join(texts.drop("copies"), ["t1", "doc"])
    found = scratch.keep(cut_out(packed.join(each, ["t1", "t2"])))
    out = with_copies(rows, texts.join(found, ["t1", "t2"], "left"))
    copy = (F.coalesce("doc_id", F.lit(LAST)) > F.col("doc")) & (F.col("n_bytes") >= DEPTH)
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, hashlib.sha256(b"").hexdigest()).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
    )


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents without what smaller documents have."""
    return remove_repeats(spark, table(spark, sf_dir, "documents"))
