"""Licence scans against a plain reading of the contract and of the method."""

import random
import re

import pytest

from quern.llm import licences

from .helpers import DOCS, as_tables, edge_docs, edge_rows, empty_docs

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def base(text):
    """(n_words, n_base, first_word, last_word, base_labels) by looking at every place."""
    words, at, labels = split(text), [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        here = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        at += here
        labels |= {label} if here else set()
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def share(words, t, weight):
    """The best share of a notice at any start, if its key phrases stand in the stretch."""
    codes, n, top = split(t.text), len(words), 0.0
    total = sum(weight[w] for w in codes)
    for s in range(-len(codes) - 2, n + 3):
        ok = all(any(words[p : p + len(split(k))] == split(k) for p in range(max(0, s - 2), s + len(codes) + 2 - len(split(k)) + 1)) for k in t.keys)
        if ok:
            top = max(top, sum(weight[w] for k, w in enumerate(codes) if w in words[max(0, s + k - 2) : max(0, s + k + 3)]) / total)
    return top


def texts():
    rng, pool = random.Random(3), sorted({w for t in licences.TEMPLATES for w in t.text.split()}) + ["River", "CC", "BY", "Ärger", "été", "3", "x"]
    out = [
        "Licensed under the Apache License, Version 2.0.",
        "CC-BY cc by\tCC By-NC 4.0 mit license MIT LICENSE, mit licenses mit-license",
        "gnu general public license gnu general public license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this fine software and associated documentation files (the Software), to deal in the Software without restriction",
        "This program is licensed under the GNU Affero General Public License, version 3",
        "MİT LICENSE mit licenſe \x00mit\x7flicense",
        None,
        "",
        "mit",
        "license mit",
    ]
    for _ in range(150):
        words = rng.choices(pool, k=rng.randint(0, 40))
        for _ in range(rng.randint(0, 3)):
            t = rng.choice(licences.TEMPLATES).text.split()
            if rng.random() < 0.5 and len(t) > 4:
                t.insert(rng.randrange(len(t)), "odd")
            i = rng.randint(0, len(words))
            words[i:i] = t
        out.append(rng.choice([" ", "  ", ", ", "-\n"]).join(words))
    return out


def test_query_against_every_place(spark, tmp_path):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts())]
    got = {r.doc_id: r for r in licences.op11_license_scan(spark, as_tables(tmp_path, documents=spark.createDataFrame(rows, DOCS))).collect()}
    assert set(got) == {r[0] for r in rows}
    names = {w for t in licences.TEMPLATES for w in t.text.split()}
    held = {w: sum(w in split(t) for _, t, *_ in rows) for w in names}
    index = licences.Index(licences.TEMPLATES, held, len(rows))
    weight = {w: index.weight[index.codes[w.encode()]] for w in names}
    for i, t, *_ in rows:
        r, want = got[i], base(t)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want, t
        shares = {}
        for x in licences.NOTICES:
            shares[x.label] = max(shares.get(x.label, 0), share(split(t), x, weight))
        labels = {x for x, y in shares.items() if y >= licences.LEAST_SHARE} | set(filter(None, want[4].split(",")))
        assert r.labels == ",".join(sorted(labels)), (t, shares)
        assert r.score == pytest.approx(1.0 if want[1] else max([y for y in shares.values() if y >= licences.LEAST_SHARE], default=0.0))


def test_weights_are_counted_over_all_documents(spark):
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(["mit license", "license license", "the", None])], DOCS).repartition(3)
    index = licences.index_of(docs)
    w = {n: index.weight[index.codes[n.encode()]] for n in ("mit", "license", "the", "gnu")}
    assert w["gnu"] > w["mit"] == w["the"] > w["license"] > 0


def test_long_texts_in_pieces(monkeypatch):
    index, text = licences.Index(), ("word license MIT License. été " * 300).encode()
    whole = index.encode(text)
    monkeypatch.setattr(licences, "PIECE", 7)
    assert (index.encode(text) == whole).all()
    monkeypatch.undo()
    n, found = index.scan(b"MIT license, " * 400_000)
    assert n == 800_000 and len(found) == 400_000 and found[-1]["start"] == 799_998


def test_edges(spark, tmp_path):
    assert licences.op11_license_scan(spark, as_tables(tmp_path / "a", documents=empty_docs(spark))).count() == 0
    got = licences.op11_license_scan(spark, as_tables(tmp_path / "b", documents=edge_docs(spark))).collect()
    assert sorted((str(r.doc_id), r.n_words) for r in got) == sorted((str(i), len(split(t))) for i, t, *_ in edge_rows())
    assert all(r.score == 0 and r.labels == r.base_labels == "" and r.first_word is None for r in got)
