"""Periodic runs against every period at every place."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np

from quern.llm import runs

from .helpers import DOCS, as_tables, edge_docs, edge_rows, empty_docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def every_run(w):
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                out.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, q, n) for (s, n), q in out.items())


def wanted(doc_id, text):
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = every_run(w)
    gone = {i for s, q, m in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-Fraction(r[2], r[1]), r[0], r[1]), default=None)
    lines = "".join(f"{s},{m},{q}\n" for s, q, m in found)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)]
    return (len(found), *((best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4), *sha)


def made():
    rng, out = random.Random(8), []
    for _ in range(260):
        n, k = rng.choice([0, 1, 4, 12, 50, 200]), rng.choice([1, 2, 3, 8])
        w = [rng.choice(["a", "b", "ç", "d.", "e\x1c", "f", "g", "h"][:k]) for _ in range(n)]
        for _ in range(rng.randint(0, 3)):
            p = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))]
            i = rng.randint(0, len(w))
            w[i:i] = (p * 12)[: rng.randint(1, 60)]
        out.append(rng.choice([" ", "\n ", "\t"]).join(w))
    return out


def test_query_against_every_period(spark, tmp_path):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(made())] + [(9000, None, "en", "s", 0), (None, "a " * 30, None, None, 0)]
    assert sum(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows) > 15
    got = {r.doc_id: r for r in runs.op12_periodic_runs(spark, as_tables(tmp_path, documents=spark.createDataFrame(rows, DOCS))).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        r = got[i]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == wanted(i, t), (i, t)


def test_texts_together_and_apart_agree(monkeypatch):
    """Runs don't depend on which texts are worked on together, nor on how many leaves are."""
    rng = random.Random(4)
    texts = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 90))] for _ in range(60)]
    texts[5] = texts[6] = [b"x", b"y"] * 40
    whole = runs.runs(runs.numbers(texts))
    monkeypatch.setattr(runs, "LEAVES", 3)
    begins, alone = 0, []
    for t in texts:
        s, n, p = runs.runs(runs.numbers([t]))
        alone += zip((s + begins).tolist(), n.tolist(), p.tolist(), strict=True)
        begins += len(t) + 1
    assert list(zip(*(x.tolist() for x in whole), strict=True)) == alone


def test_leaves_of_smaller_halves():
    """Leaves looked at grow as n log n, also where one word fills the text."""
    for words in ([b"a"] * 60_000, [b"a", b"b", b"c"] * 20_000, [str(i % 7).encode() for i in range(60_000)]):
        tree = runs.suffix_tree(runs.numbers([words]))
        cut, lo, hi = runs.nodes(tree.common)
        assert np.minimum(cut - lo, hi - cut).sum() <= 60_000 * 16
        s, n, p = runs.runs(runs.numbers([words]))
        assert (s.tolist(), n.tolist(), p.tolist()) == ([0], [60_000], [len(set(words))])


def test_long_text_and_edges(spark, tmp_path):
    long = " ".join(str(i * i % 9973) for i in range(400_000)) + " end" * 50
    docs = edge_docs(spark).union(spark.createDataFrame([(77, long, None, None, 0)], DOCS))
    got = runs.periodic_runs(docs).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted([*(str(r[0]) for r in edge_rows()), "77"])
    one = next(r for r in got if r.doc_id == 77)
    assert one.n_words == 400_050 and (one.runs[-1].start, one.runs[-1].length, one.runs[-1].period) == (400_000, 50, 1)
    assert one.collapsed.endswith(" end") and not one.collapsed.endswith(" end end")
    assert runs.op12_periodic_runs(spark, as_tables(tmp_path, documents=empty_docs(spark))).count() == 0
    null = next(r for r in runs.op12_periodic_runs(spark, as_tables(tmp_path, documents=docs)).collect() if r.doc_id == 1)
    assert (null.n_runs, null.start, null.collapsed_sha256) == (0, None, hashlib.sha256(b"").hexdigest())
