"""Every base query agrees on the smallest driver tables with DuckDB or, where SQL lacks its operator, with plain Python."""

import hashlib
import itertools
import os
import re
from difflib import SequenceMatcher

import duckdb
import numpy as np
import pandas as pd
import pytest
import regex

from quern.plans import catalog
from quern.plans.statistics import SPECS

from . import plain
from .test_permute import plain_mix, plain_permuted

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


def canonical(df):
    def one(v):
        if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
            v = v.tolist()
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, float):
            return round(v, 6)
        return tuple(map(one, v)) if isinstance(v, (list, tuple)) else v

    return sorted((tuple(map(one, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None)), key=repr)


def read(name):
    return pd.read_parquet(f"{SF}/{name}.parquet")


def told(got, key, value):
    return dict(zip(got[key], got[value], strict=True))


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


def qa():
    """(id, prompt, answer, first word of the prompt) of user turns and the assistant turns after them."""
    c = read("conversations")
    a = {(r.conv_id, r.turn): r.text for r in c[c.role == "assistant"].itertuples()}
    u = c[c.role == "user"]
    return [(r.conv_id * 1000 + r.turn, r.text, a[r.conv_id, r.turn + 1], r.text.split(" ")[0]) for r in u.itertuples() if (r.conv_id, r.turn + 1) in a]


def fuzzy(got):
    c, s = read("customer"), read("supplier")
    best = {}
    for r in c.itertuples():
        pool = [(ratio(r.c_name, x.s_name), x.s_name) for x in s[s.s_nationkey == r.c_nationkey].itertuples()]
        if pool:
            best[r.c_custkey] = max(pool)
    assert {k: (round(v, 6), b) for k, v, b in zip(got.c_custkey, got.score, got.best, strict=True)} == {k: (round(v, 6), b) for k, (v, b) in best.items()}


def borders(got):
    hits = told(got, "id", "hit")
    for i, _, answer, gold in qa():
        gold = re.sub(r"[.,]+$", "", gold)
        assert hits[i] == (gold.strip() != "" and re.search(rf"(?<!\w){re.escape(gold)}(?!\w)", answer, re.I) is not None)


def subjects(got):
    run = r"\p{Lu}[\p{L}\p{N}#'-]*(?: \p{Lu}[\p{L}\p{N}#'-]*)*"

    def one(t):
        m = regex.search(r"^Where does (.+?) live\?$", t.strip())
        if m:
            return m[1]
        m = regex.search("[\"“]([^\"“”]+)[\"”]", t) or regex.search(rf"(?<=[^\p{{L}}])({run}?)['’]s\b", t)
        if m:
            return m[1]
        found = regex.findall(run, regex.sub(r"^\S+\s*", "", t.strip(" ")))
        return found[-1] if found else None

    rows = {i: (p, a) for i, p, a, _ in qa()}
    assert len(got) == len(rows) and got.prompt.notna().sum() + got.answer.notna().sum() > 20
    for r in got.itertuples():
        for have, text in zip((r.prompt, r.answer), rows[r.id], strict=True):
            assert (None if have is None or have != have else have) == one(text), text


def similar(got):
    want = {r.s_suppkey: round(ratio(r.s_name, "Supplier#000000001"), 6) for r in read("supplier").itertuples()}
    assert told(got, "s_suppkey", "ratio") == want


def fnv(got):
    def one(s):
        h = 2166136261
        for b in s.encode():
            h = (h ^ b) * 16777619 % 2**32
        return h

    assert told(got, "n_name", "h") == {n: one(n) for n in read("nation").n_name}


def verdicts(got):
    base = "Supplier#000000001"
    want = {r.s_suppkey: "matched" if r.s_name == base else "ambiguous" if ratio(r.s_name, base) >= 0.93 else "clean" for r in read("supplier").itertuples()}
    assert told(got, "s_suppkey", "verdict") == want


def triples():
    """{relation: (train s, train o, test s, test o)} by the rule of the queries."""
    e, out = read("embeddings"), {}
    for label, g in e.sort_values("vec_id").groupby("label"):
        v, ids = np.stack(g.embedding.to_numpy()).astype(float), g.vec_id.to_numpy()
        s, o, ids = v[:-1], v[1:], ids[:-1]
        order = sorted(range(len(ids)), key=lambda i: (hashlib.md5(str(ids[i]).encode()).hexdigest(), ids[i]))
        n = len(ids)
        cut = int(min(max(8, np.floor(0.75 * n)), max(1, n - 4)))
        a, b = order[:cut], order[cut:]
        out[label] = s[a], o[a], s[b], o[b]
    return out


def ridge(got):
    want = {}
    for k, (x, y, z, o) in triples().items():
        mx, my = x.mean(0), y.mean(0)
        hat = (z - mx) @ (x - mx).T @ np.linalg.solve((x - mx) @ (x - mx).T + 1e-2 * np.eye(len(x)), y - my) + my
        want[k] = (hat * o).sum(1) / np.linalg.norm(hat, axis=1) / np.linalg.norm(o, axis=1)
    assert told(got, "relation_key", "n_test") == {k: len(v) for k, v in want.items()}
    assert all(abs(v - want[k].mean()) < 1e-5 for k, v in told(got, "relation_key", "cos_affine").items())


def mapped_ranks(got):
    """Places of the gold objects' means among all objects of their relation, test rows' own included, by the cosine with ridge-mapped subjects."""
    e, have = read("embeddings"), {(r.relation_key, r.id): (r.rank, r.num_candidates) for r in got.itertuples()}
    total = 0
    for label, g in e.sort_values("vec_id").groupby("label"):
        v, ids = np.stack(g.embedding.to_numpy()).astype(float), g.vec_id.to_numpy()
        s, o, ids = v[:-1], v[1:], ids[:-1]
        order = sorted(range(len(ids)), key=lambda i: (hashlib.md5(str(ids[i]).encode()).hexdigest(), ids[i]))
        cut = int(min(max(8, np.floor(0.75 * len(ids))), max(1, len(ids) - 4)))
        a, b = order[:cut], order[cut:]
        mx, my = s[a].mean(0), o[a].mean(0)
        hat = (s[b] - mx) @ np.linalg.solve((s[a] - mx).T @ (s[a] - mx) + 1e-2 * np.eye(v.shape[1]), (s[a] - mx).T @ (o[a] - my)) + my
        golds = sorted(set(ids % 5))
        protos = np.stack([o[ids % 5 == k].mean(0) for k in golds])
        score = (hat @ protos.T) / np.linalg.norm(hat, axis=1)[:, None] / np.linalg.norm(protos, axis=1)[None]
        for i, row in zip(b, score, strict=True):
            assert have[label, ids[i]] == ((row > row[golds.index(ids[i] % 5)]).sum() + 1, len(golds))
            total += 1
    assert total == len(have)


def isotonic(got):
    """Every level is the mean of its rows, levels ascend with the length, and no split of a level has a lower mean after it."""
    d, m = read("documents"), read("labels").set_index("doc_id")
    rows = sorted((np.log(r.n_chars + 1), int(m.toxic[r.doc_id] == 1 or m.quality[r.doc_id] == 0), r.doc_id) for r in d.itertuples() if r.doc_id in m.index)
    p = told(got, "doc_id", "p")
    assert set(p) == {r[2] for r in rows}
    levels = [p[i] for _, _, i in rows]
    assert all(a <= b + 1e-6 for a, b in zip(levels, levels[1:], strict=False))
    fit, weight = [], []
    for x in sorted({r[0] for r in rows}):
        y = [r[1] for r in rows if r[0] == x]
        fit.append(np.mean(y))
        weight.append(len(y))
        while len(fit) > 1 and fit[-2] >= fit[-1]:
            w = weight[-2] + weight[-1]
            fit[-2:], weight[-2:] = [(fit[-2] * weight[-2] + fit[-1] * weight[-1]) / w], [w]
    assert np.allclose(levels, np.repeat(fit, weight), atol=2e-6)


def points():
    g = read("lineitem").groupby(["l_suppkey", "l_returnflag"])
    return pd.DataFrame({"x": g.l_quantity.mean(), "y": g.l_extendedprice.mean(), "z": g.l_discount.mean(), "w": g.size().astype(float)}).reset_index()


def t_tail(t, df):
    """Two-sided tail of the t distribution by Simpson's rule over the angle."""
    at = np.arctan(abs(t) / np.sqrt(df))

    def area(a, b, m=20_001):
        q = np.linspace(a, b, m)
        f = np.cos(q) ** (df - 1)
        return (b - a) / (m - 1) / 3 * (f[0] + f[-1] + 4 * f[1:-1:2].sum() + 2 * f[2:-1:2].sum())

    return area(at, np.pi / 2) / area(0, np.pi / 2)


def t_tests(got):
    for r in got.itertuples():
        g = points().query("l_returnflag == @r.grp")
        c = np.corrcoef(g.x, g.y)[0, 1]
        p = t_tail(c * np.sqrt((len(g) - 2) / (1 - c * c)), len(g) - 2)
        assert r.n == len(g) and abs(r.r - c) < 1e-5 and abs(r.p_two - p) < 1e-4 and abs(r.p_one - (p / 2 if c > 0 else 1 - p / 2)) < 1e-4


def weighted_tests(got):
    for r in got.itertuples():
        g = points().query("l_returnflag == @r.grp")
        m = np.cov(g.x, g.y, aweights=g.w, bias=True)
        c, n = m[0, 1] / np.sqrt(m[0, 0] * m[1, 1]), g.w.sum() ** 2 / (g.w**2).sum()
        assert abs(r.r - c) < 1e-5 and abs(r.p - t_tail(c * np.sqrt((n - 2) / (1 - c * c)), n - 2)) < 1e-3


def orders(got):
    n = read("nation")
    for r in got.itertuples():
        g = n[n.n_regionkey == r.n_regionkey]
        x, y = g.n_nationkey.to_numpy(float), g.n_name.str.len().to_numpy(float)
        every = [np.corrcoef(x, y[list(p)])[0, 1] for p in itertools.permutations(range(len(y)))]
        c = np.corrcoef(x, y)[0, 1]
        assert abs(r.r - c) < 1e-9 and abs(r.p_two - np.mean(np.abs(every) >= abs(c) - 1e-9)) < 1e-9


def least_squares():
    """{spec: (terms, coefficients, HC3 errors, adjusted R2)}"""
    d, out = points(), {}
    levels = sorted(d.l_returnflag.unique())
    for spec, names in SPECS.items():
        cols = {"const": np.ones(len(d)), **{f"fe_{i}": (d.l_returnflag == v).to_numpy(float) for i, v in enumerate(levels) if i}, **{c: d[c].to_numpy() for c in names}}
        a, y = np.stack(list(cols.values()), 1), d.y.to_numpy()
        inv = np.linalg.inv(a.T @ a)
        beta = inv @ a.T @ y
        e = y - a @ beta
        h = np.einsum("ij,jk,ik->i", a, inv, a)
        v = inv @ (a * ((e / (1 - h)) ** 2)[:, None]).T @ a @ inv
        r2 = 1 - (e @ e) / ((y - y.mean()) ** 2).sum()
        out[spec] = dict(zip(cols, zip(beta, np.sqrt(np.diag(v)), strict=True), strict=True)), 1 - (1 - r2) * (len(y) - 1) / (len(y) - a.shape[1])
    return out


def fits(got):
    want = least_squares()
    assert {(r.spec, r.term) for r in got.itertuples()} == {(k, c) for k, names in SPECS.items() for c in names or [None]}
    for r in got.itertuples():
        assert np.isclose(r.adj_r2, want[r.spec][1], atol=1e-8)
        if r.term is not None:
            beta, se = want[r.spec][0][r.term]
            assert np.isclose(r.coef, beta, rtol=1e-6, atol=1e-6) and np.isclose(r.se_hc3, se, rtol=1e-5) and np.isclose(r.t_hc3, beta / se, rtol=1e-5)


def gains_of_fits(got):
    want = least_squares()
    assert len(got) == 2
    for r in got.itertuples():
        assert np.isclose(r.adj_r2_gain, want[r.plus_spec][1] - want[r.base_spec][1], atol=1e-8) and np.isclose(r.x_coef, want[r.plus_spec][0]["x"][0], rtol=1e-6)


def cosines(a, b):
    return (a * b).sum(1) / np.linalg.norm(a, axis=1) / np.linalg.norm(b, axis=1)


def rates():
    """(model, relation, rows, refusals, answered, share of errors in these) with each relation's gains by its direction and by the ridge map."""
    d = read("documents").merge(read("labels"), on="doc_id", how="left")
    d = d.assign(rel=d.source.str.extract(r"([0-9]+)$")[0].astype(float) % 10, refused=d.quality.isna() & d.toxic.isna(), wrong=(d.toxic == 1) | (d.quality == 0))
    g = d.groupby(["lang", "rel"], dropna=False).agg(n=("doc_id", "size"), refused=("refused", "sum"), wrong=("wrong", "sum")).reset_index()
    g = g.assign(answered=g.n - g.refused, rate=(g.wrong / (g.n - g.refused).where(g.n > g.refused)))
    moved, mapped = {}, {}
    for k, (x, y, z, o) in triples().items():
        mx, my = x.mean(0), y.mean(0)
        ridged = (z - mx) @ np.linalg.solve((x - mx).T @ (x - mx) + 1e-2 * np.eye(x.shape[1]), (x - mx).T @ (y - my)) + my
        moved[k], mapped[k] = (cosines(z + (y - x).mean(0), o) - cosines(z, o)).mean(), (cosines(ridged, o) - cosines(z, o)).mean()
    g = g.assign(moved=g.rel.map(moved), mapped=g.rel.map(mapped))
    return g[g.moved.notna()]


def plain_r(x, y):
    return np.corrcoef(x, y)[0, 1] if len(x) >= 3 and x.std() > 0 and y.std() > 0 else None


def p_of(r, n):
    return 1.0 if r is None or n <= 2 else 0.0 if abs(r) >= 1 - 1e-15 else t_tail(r * np.sqrt((n - 2) / (1 - r * r)), n - 2)


def thresholds_by_p(got):
    g, want = rates(), {}
    for t in (1, 2, 5, 10, 20, 50, 100):
        ps = []
        for _, m in g.groupby("lang", dropna=False):
            for rate, w in ((m.rate, m.answered), (m.refused / m.n, m.n)):
                keep = (w >= t) & rate.notna()
                x, y, w = m.moved[keep].to_numpy(), rate[keep].to_numpy(float), w[keep].to_numpy(float)
                r = plain_r(x, y)
                ps.append(p_of(r, len(x)))
                eff = w.sum() ** 2 / (w**2).sum() if len(w) else 0
                if r is None or eff <= 3:
                    ps.append(1.0)
                else:
                    c = np.cov(x, y, aweights=w, bias=True)
                    ps.append(p_of(c[0, 1] / np.sqrt(c[0, 0] * c[1, 1]), eff))
        want[float(t)] = (len(ps), np.mean(ps))
    assert told(got, "threshold", "n_tests") == {t: n for t, (n, _) in want.items()}
    assert all(abs(p - want[t][1]) < 1e-3 for t, p in told(got, "threshold", "mean_p").items())
    assert got.mean_p.is_monotonic_increasing


def affine_and_behaviour(got):
    g = rates()
    g = g[g.rate.notna()]
    assert len(got) == g.groupby("lang", dropna=True).ngroups
    for r in got.itertuples():
        m = g[g.lang == r.model_key]
        assert r.n == len(m)
        for have, x in ((r.r_translation, m.moved), (r.r_affine, m.mapped)):
            c = plain_r(x.to_numpy(), m.rate.to_numpy())
            assert (have is None or have != have) if c is None else abs(have - c) < 1e-4


def binary():
    """(doc_id, model, log length, error) of labelled documents."""
    d = read("documents").merge(read("labels"), on="doc_id")
    return pd.DataFrame({"doc_id": d.doc_id, "model": d.lang, "x": np.log(d.n_chars + 1.0), "y": ((d.toxic == 1) | (d.quality == 0)).astype(int)})


def spline(got):
    p = told(got, "doc_id", "p")
    for _, g in binary().groupby("model"):
        if g.y.nunique() == 2:
            want = plain.spline_curve(g.x.to_numpy(), g.y.to_numpy(), g.x.to_numpy())
            assert np.allclose([p[i] for i in g.doc_id], want, rtol=0, atol=1.1e-6)


def isotonic_by_model(got):
    for k, g in binary().groupby("model"):
        c = plain_r(g.x.to_numpy(), g.y.to_numpy())
        want = sorted((round(x, 6), p) for x, p in plain.pooled(g.x.tolist(), g.y.tolist(), c is None or c >= 0).items())
        mine = sorted(got[got.model_key == k][["x", "p"]].itertuples(index=False, name=None))
        assert len(mine) == len(want) and np.allclose(mine, want, rtol=0, atol=2e-6)


def held_out(curve):
    def check(got):
        seen = set()
        for k, g in binary().groupby("model"):
            if min((g.y == 0).sum(), (g.y == 1).sum()) < 2:
                continue
            r = got[got.model_key == k].iloc[0]
            want = plain.scores(g.doc_id.tolist(), g.x.to_numpy(), g.y.to_numpy(), curve)
            assert np.allclose([r.folds, r.logloss, r.brier, r.auc], want, rtol=0, atol=1e-6) and r.n == len(g)
            seen.add(k)
        assert seen == set(got.model_key)

    return check


def drawn_orders(got):
    """The same 2,000 keyed orders, one by one."""
    for r in got.itertuples():
        g = points().query("l_returnflag == @r.grp").sort_values(["x", "y"])
        x, y = g.x.to_numpy(), g.y.to_numpy()
        c, a, b = np.corrcoef(x, y)[0, 1], x - x.mean(), y - y.mean()
        every = np.array([a @ b[plain_permuted(len(x), "0", plain_mix(d))] for d in range(2000)]) / np.sqrt((a @ a) * (b @ b))
        assert abs(r.r - c) < 1e-9 and abs(r.p - ((np.abs(every) >= abs(c) - 1e-9).sum() + 1) / 2001) < 1e-9


CHECKS = {
    "d18_fuzzy_best_match": fuzzy, "i09_boundary_match": borders, "i14_subject_of_prompts": subjects, "i20_similarity": similar, "i22_fnv1a": fnv, "j07_collision_verdict": verdicts, "k08_affine_ridge": ridge, "l18_isotonic": isotonic,
    "l04_weighted_p": weighted_tests, "l06_t_test_p": t_tests, "l07_permutation_exact": orders, "l13_ols_hc3": fits, "l14_incremental_fit": gains_of_fits,
    "l19_thresholds_by_p": thresholds_by_p, "l21_affine_and_behaviour": affine_and_behaviour,
    "l08_permutation_sampled": drawn_orders, "l17_cross_validated": held_out(plain.logistic_curve), "l17_spline_cross_validated": held_out(plain.spline_curve),
    "l18_spline_logistic": spline, "l18_isotonic_by_model": isotonic_by_model, "k10_retrieval_affine": mapped_ranks,
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", catalog.queries())
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    if name not in catalog.oracle_sql():
        CHECKS[name](got)
        return
    want = duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry_and_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_flagship(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
