"""Vector codes against plain whole-number arithmetic."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from quern.llm import codebooks

from .helpers import as_tables

EMBEDDINGS = "vec_id long, embedding array<float>, label int"


def wanted(rows):
    """Codes, errors and the digest, every entry compared with every part."""
    kept = []
    for i, v, label in rows:
        if v and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(256 * float(np.float32(x))) for x in v], label))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // 16
    parts = [[tuple(q[k * width : (k + 1) * width]) for k in range(16)] for _, q, _ in kept]
    books = [[parts[e][k] for e in range(min(64, len(parts)))] for k in range(16)]

    def nearest(k, p):
        return min((sum((a - b) ** 2 for a, b in zip(p, e, strict=True)), j) for j, e in enumerate(books[k]))

    for _ in range(2):
        for k in range(16):
            met = {}
            for p in parts:
                met.setdefault(nearest(k, p[k])[1], []).append(p[k])
            for j, held in met.items():
                books[k][j] = tuple(sum(x) // len(held) for x in zip(*held, strict=True))
    out = []
    for (i, _, label), p in zip(kept, parts, strict=True):
        found = [nearest(k, p[k]) for k in range(16)]
        out.append((i, "".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found), label))
    sums = Counter()
    for _, _, e, label in out:
        sums[label] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, sums[label], digest) for i, c, e, label in out), key=repr)


def check(spark, path, rows):
    got = codebooks.op13_vector_codes(spark, as_tables(path, embeddings=spark.createDataFrame(rows, EMBEDDINGS).repartition(3)))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == wanted(rows)


def test_query_against_all_entries(spark, tmp_path):
    """Few distinct components, so that many distances are equal."""
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 4, 32) / 2], int(i % 3) if i % 5 else None) for i in rng.permutation(300)]
    rows += [(400, None, 1), (401, [1.0] * 31 + [None], 1), (402, [float("nan")] * 32, 1), (403, [float("inf")] + [0.0] * 31, 2)]
    rows += [(5, [0.25] * 32, 1), (5, [0.25] * 32, 1), (None, [-0.75] * 32, None)]
    check(spark, tmp_path, rows)


def test_fewer_vectors_than_entries(spark, tmp_path):
    check(spark, tmp_path, [(i, [i / 3 - 1.0] * 16, None) for i in range(7)])


def test_real_components(spark, tmp_path):
    rng = np.random.default_rng(4)
    check(spark, tmp_path, [(i, [float(x) for x in rng.normal(size=64)], i % 2) for i in range(250)])


@pytest.mark.parametrize("width", [1, 4])
def test_tree_finds_the_lowest_of_equal_entries(width):
    rng = np.random.default_rng(width)
    book, points = rng.integers(-4, 5, (64, width)), rng.integers(-6, 7, (2000, width))
    index, least = codebooks.nearest(book, codebooks.kd_tree(book), points)
    far = ((points[:, None] - book) ** 2).sum(2)
    assert (index == far.argmin(1)).all() and (least == far.min(1)).all()


def test_unusable_and_empty(spark, tmp_path):
    def run(name, rows, schema=EMBEDDINGS):
        return codebooks.op13_vector_codes(spark, as_tables(tmp_path / name, embeddings=spark.createDataFrame(rows, schema))).collect()

    assert run("none", []) == [] and run("bad", [(1, None, 1), (2, [], 1), (3, [None] * 16, 1)]) == []
    assert run("odd", [(1, [1.0] * 17, 1), (2, [1.0] * 16, 1)]) == []
    mixed = run("mixed", [(1, [1.0] * 16, 1), (2, [1.0] * 32, 1), (3, [3e38] * 16, 1)])
    assert [(r.vec_id, r.error) for r in sorted(mixed)] == [(1, 0), (3, 0)]
    extra = [(i, [i / 2] * 16, i % 2, 7, "x") for i in range(9)]
    got = run("clash", extra, EMBEDDINGS + ", q int, code string")
    assert sorted(map(tuple, got), key=repr) == wanted([r[:3] for r in extra])


def test_many_labels_are_joined_by_shares(spark):
    rows = spark.createDataFrame([(i, i % 4 if i % 4 else None, f"{i:02x}", i) for i in range(200)], "vec_id long, label int, code string, error long")
    few, many = codebooks.with_label_errors(rows), codebooks.with_label_errors(rows, most=1)
    assert sorted(map(str, few.select(sorted(few.columns)).collect())) == sorted(map(str, many.select(sorted(few.columns)).collect()))
    assert {(r.label, r.label_error) for r in many.collect()} == {(k or None, sum(range(k, 200, 4))) for k in range(4)}
