import numpy as np
import pytest
import xxhash

from quern.llm import simhash as S
from quern.llm.common import Scratch
from quern.llm.components import roots

from .helpers import as_tables, edge_docs, edge_rows


def brute_bits(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    sh = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """fps: list of (id, fp); component id of each, smallest id reachable."""
    n = len(fps)
    owner = list(range(n))

    def find(x):
        while owner[x] != x:
            x = owner[x]
        return x

    for i in range(n):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 2:
                a, b = find(i), find(j)
                owner[max(a, b)] = min(a, b)
    return {fps[i][0]: min(fps[j][0] for j in range(n) if find(j) == find(i)) for i in range(n)}


def test_query_against_brute_force(spark, tmp_path):
    rows = [r for r in edge_rows() if r[0] is not None]
    got = {r.doc_id: r for r in S.op6_simhash(spark, as_tables(tmp_path, documents=edge_docs(spark))).collect()}
    fps = [(r[0], brute_bits(r[1])) for r in rows]
    want = brute_components(fps)
    for i, fp in fps:
        assert got[i].fingerprint == f"{fp:016x}" and got[i].component_id == want[i], i


@pytest.mark.parametrize("cell", [0, 1, 32, 10**6])
def test_dense_groups_link_exactly(spark, cell):
    rng = np.random.default_rng(1)
    fps = {0, 2**64 - 1}
    for base in (0, 2**64 - 1, int(rng.integers(2**63))):
        for _ in range(60):
            x = base
            for b in rng.choice(64, rng.integers(0, 5), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    rows = list(enumerate(sorted(fps)))
    df = spark.createDataFrame([(i, int(np.uint64(x).astype(np.int64))) for i, x in rows], "node long, fp long")
    sc = Scratch(spark, "t")
    found = {r.node: r.root for r in roots(S.links(df, sc, cell), sc).collect()}
    assert {i: found.get(i, i) for i, _ in rows} == brute_components(rows)


def test_embedding_counts_bits_of_each_segment(spark):
    xs = [0, 2**64 - 1, 0xF0F1F2F301234567, 1 << 63]
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in xs], "fp long")
    for x, r in zip(xs, df.select(S.embedding(S.F.col("fp")).alias("e")).collect(), strict=True):
        assert [r.e >> 4 * i & 15 for i in range(16)] == [(x >> 4 * i & 15).bit_count() for i in range(16)]


def test_long_chain_settles(spark):
    n = 300
    links = spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long")
    found = roots(links, Scratch(spark, "t")).collect()
    assert {r.node for r in found} == set(range(1, n + 1)) and {r.root for r in found} == {0}


def test_settled_links_need_no_round(spark):
    """Stars are written once and never joined; a path of four takes two rounds and none to see that nothing changes."""
    for pairs, most in (([(k % 7, k) for k in range(7, 200)], 1), ([(1, 2), (2, 3), (3, 4)], 5)):
        sc = Scratch(spark, "t")
        found = {r.node: r.root for r in roots(spark.createDataFrame(pairs, "a long, b long"), sc).collect()}
        assert found == {b: a % 7 if most == 1 else 1 for a, b in pairs} and sc._n <= most


def test_one_of_each_group_stays(spark):
    kept = sorted((r.doc_id for r in S.deduplicate(spark, edge_docs(spark)).collect()), key=lambda i: (i is None, i))
    assert kept == [1, 4, 7, 8, 9, None]


def test_rows_without_id_are_documents(spark):
    one, two, three = (" ".join(f"{w}{i}" for i in range(40)) for w in "abc")
    rows = [(None, one, 1), (None, two, 2), (5, two, 3), (6, one, 4), (6, three, 5), (6, three, 5), (7, three, 6)]
    names = ["doc_id", "text", "row", "root", "_row", "doc"]
    d = spark.createDataFrame([(*r, r[2], {"k": r[2]}, "x") for r in rows], "doc_id long, text string, row int, root int, _row map<string,int>, doc string")
    out = S.deduplicate(spark, d)
    assert out.columns == names
    assert sorted((r.row, r.doc_id, r._row["k"], r.doc) for r in out.collect()) == [(3, 5, 3, "x"), (4, 6, 4, "x"), (5, 6, 5, "x")]


def test_fingerprints_of_rows_without_id_link(spark, monkeypatch):
    fps = spark.createDataFrame([(1, 0), (None, 1), (None, 7), (2, 15), (None, 1 << 40)], "doc_id long, fp long")
    monkeypatch.setattr(S, "fingerprints", lambda docs, shingle=3: fps)
    got = sorted((r.fp, r.component_id) for r in S.components(spark, None).collect())
    assert got == [(0, 1), (1, 1), (7, 1), (15, 1), (1 << 40, 1)]


def jaccard(a, b):
    sets = []
    for t in (a, b):
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return len(sets[0] & sets[1]) / max(1, len(sets[0] | sets[1]))


def near_copies():
    """Originals with edited copies, more than one of them before the original, and a passage that all share."""
    rng = np.random.default_rng(7)
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi", "ru", "te", "vo") for b in ("bra", "dan", "fil", "gus", "hen", "jor", "nim", "pel")]
    passage = " ".join(rng.choice(vocabulary, 30))
    rows, ids = [], iter(rng.permutation(1000).tolist())
    for _ in range(12):
        words = rng.choice(vocabulary, int(rng.integers(60, 400))).tolist()
        rows.append((next(ids), " ".join(words) + " " + passage))
        for edits in rng.integers(0, 12, 6):
            copy = list(words)
            for at in rng.integers(0, len(copy), edits):
                copy[at] = "edited" + str(int(rng.integers(99)))
            rows.append((next(ids), " ".join(copy) + " " + passage))
    return rows


def test_similar_shingle_sets_are_one_group(spark):
    rows = near_copies()
    d = spark.createDataFrame(rows, "doc_id long, text string")
    sc = Scratch(spark, "t")
    links = [(r.a, r.b) for r in S.near_links(d, d.select("doc_id"), sc).collect()]
    text = dict(rows)
    assert all(jaccard(text[a], text[b]) >= 0.8 for a, b in links)

    def groups(pairs):
        owner = {i: i for i in text}

        def find(x):
            while owner[x] != x:
                x = owner[x]
            return x

        for a, b in pairs:
            a, b = find(a), find(b)
            owner[max(a, b)] = min(a, b)
        return {i: find(i) for i in text}

    every = [(a, b) for a in text for b in text if a < b and jaccard(text[a], text[b]) >= 0.8]
    want, got = groups(every), groups(links)
    assert sum(want[i] == got[i] for i in text) >= 0.97 * len(text)
    assert all(want[i] == want[got[i]] for i in text)


def test_growing_tables_are_not_broadcast(spark, tmp_path, monkeypatch):
    """Spark's estimate of exploded cells leaves out how many there are, so under its default threshold it would hold them all in the driver."""
    plans, write = [], Scratch.keep

    def keep(self, df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(self, df)

    monkeypatch.setattr(Scratch, "keep", keep)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        docs = as_tables(tmp_path, documents=edge_docs(spark))
        found = S.op6_simhash(spark, docs)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        S.deduplicate(spark, edge_docs(spark))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert any("SortMergeJoin" in p for p in plans)
    assert not [p for p in plans if "Broadcast" in p]
