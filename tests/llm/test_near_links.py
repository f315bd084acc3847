"""near_links against all pairs."""

import os
from collections import Counter

import numpy as np
import pytest

from quern.llm import simhash as S
from quern.llm.common import Scratch

SF = "/root/testdata/sf0.01"


def sets(rows):
    out = {}
    for i, t in rows:
        w = t.lower().split()
        out[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def groups(ids, pairs):
    owner = {i: i for i in ids}

    def find(x):
        while owner[x] != x:
            x = owner[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        owner[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def compared(spark, rows):
    """Groups by all pairs and by near_links."""
    held, d = sets(rows), spark.createDataFrame(rows, "doc_id long, text string")
    every = [(a, b) for a in held for b in held if a < b and (n := len(held[a] & held[b])) and n >= 0.8 * (len(held[a]) + len(held[b]) - n)]
    links = [(r.a, r.b) for r in S.near_links(d, d.select("doc_id"), Scratch(spark, "t")).collect()]
    assert every
    return groups(held, every), groups(held, links)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
def test_driver_tables_lose_no_near_copy(spark):
    """Every copy that all pairs of the driver's documents show goes, and nothing else does."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    held, by = sets(texts.items()), {}
    for i, x in held.items():
        for s in x:
            by.setdefault(s, []).append(i)
    shared = Counter((a, b) for ids in by.values() for k, b in enumerate(ids) for a in ids[:k])
    near = [(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(held[a]) + len(held[b]) - n)]
    bits = {i: S.fingerprint(t) for i, t in texts.items()}
    ids = sorted(bits)
    near += [(a, b) for k, b in enumerate(ids) for a in ids[:k] if (bits[a] ^ bits[b]).bit_count() <= 2]
    root = groups(held, near)
    copies = {i for i in held if root[i] != i}
    assert len(copies) > 40
    assert {r.doc_id for r in S.deduplicate(spark, docs).collect()} == set(held) - copies


def test_all_pairs_of_widespread_passages_are_joined(spark):
    rng = np.random.default_rng(3)
    passages = [[f"p{p}w{int(k)}" for k in rng.integers(0, 500, 60)] for p in range(40)]
    rows = []
    for i in range(100):
        words = [w for p in rng.choice(40, 4, replace=False) for w in passages[p]]
        for k in range(3):
            copy = list(words)
            for at in rng.integers(0, len(copy), k):
                copy[at] = f"edited{i}x{k}"
            rows.append((3 * i + k, " ".join(copy)))
    want, got = compared(spark, rows)
    assert got == want


def test_short_texts_with_an_edit_are_joined(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(150):
        words = [f"w{int(k)}" for k in rng.integers(0, 5000, int(rng.integers(10, 100)))]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:-1], "changed"]))]
    want, got = compared(spark, rows)
    assert got == want


def test_links_of_other_members_than_the_first_join_groups(spark):
    """1 and 2 have one fingerprint, 3 is a near copy of 2 alone."""
    one, two = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(1, "x " * 600 + one), (2, "x " * 600 + two), (3, two)]
    assert S.fingerprint(rows[0][1]) == S.fingerprint(rows[1][1]) != S.fingerprint(two)
    kept = S.deduplicate(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r.doc_id for r in kept.collect()] == [1]


def test_parity_never_exceeds_the_difference():
    rng = np.random.default_rng(4)
    for _ in range(200):
        pool = rng.integers(0, 2**63, 900).astype(np.uint64)
        a, b = (np.unique(rng.choice(pool, int(rng.integers(0, 700)))) for _ in range(2))
        differ = sum(int(x).bit_count() for x in (S._parity(a) ^ S._parity(b)).view(np.uint64))
        assert differ <= len(np.setxor1d(a, b))
