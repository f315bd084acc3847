import zlib

import numpy as np

from quern.llm import langid as L

EN = "the river and the stone were in that garden with a silver window".split()
FR = "les fenêtres de la maison étaient avec une lettre dans notre jardin".split()
DE = "der garten und die brücke waren mit einem fenster nicht für uns".split()


def texts(n=60):
    rng = np.random.default_rng(0)
    out = []
    for i in range(n):
        lang, words = [("en", EN), ("fr", FR), ("de", DE)][i % 3]
        out.append((" ".join(rng.choice(words, 30)), lang))
    return out


def model():
    return L.fit(*zip(*texts(), strict=True))


def test_forward_backward_is_exact():
    m = model()
    docs = ["the river dans notre jardin", "der Garten", "stone"]
    w = L.words_of(docs)
    e, a = np.exp(m.emissions(w).astype(float)), np.exp(m.transitions.astype(float))
    share, count = m.shares(docs)
    for d in range(len(docs)):
        own = e[w.doc == d]
        total, marginal = 0.0, np.zeros((len(own), len(m.labels)))
        for path in np.ndindex(*[len(m.labels)] * len(own)):
            p = np.prod([own[t, y] for t, y in enumerate(path)]) * np.prod([a[x, y] for x, y in zip(path, path[1:])])
            total += p
            for t, y in enumerate(path):
                marginal[t, y] += p
        assert np.allclose(share[d], (marginal / total).mean(0), atol=1e-4)
        assert count[d] == len(own)


def test_transitions_prefer_to_stay():
    t = model().transitions
    assert all(t[i, i] > max(t[i, j] for j in range(len(t)) if j != i) for i in range(len(t)))


def test_code_switched_words_follow_their_language():
    m = model()
    share, _ = m.shares(["the river and the stone " * 6 + "les fenêtres de la maison " * 3])
    assert m.labels[share[0].argmax()] == "en" and share[0][m.labels.index("fr")] > 0.2


def test_held_out_accuracy_and_inputs(spark):
    rows = [(i, t, lang if i % 9 else None) for i, (t, lang) in enumerate(texts(240))]
    d = spark.createDataFrame([*rows, (1000, None, "en"), (1001, "1 2 3", "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in L.predict(spark, d, L.fit_on(d)).collect()}
    truth = {i: lang for i, (_, lang) in enumerate(texts(240))}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i].lang_pred == truth[i] for i in held]) > 0.95
    assert got[1000].lang_pred == got[1001].lang_pred == "und" and got[1000].score == 0
    assert all(0 <= r.score <= 1 for r in got.values())


def test_held_out_rows_are_never_learned_from(spark):
    rows = [(i, "zzz qqq", "xx") for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert L.fit_on(d).labels == []


def test_training_words_are_those_of_all_texts(monkeypatch):
    docs = ["Ein Satz, noch einer", "", "naïve x", "ΑΒΓ " * 50, "12 34", "a" * 300, None, "letzte Worte"]
    wide = L.words_of(docs)
    monkeypatch.setattr(L, "blocks", lambda texts: [(0, 3), (3, 4), (4, 8)])
    narrow = L.narrow_words(docs)
    for name in ("doc", "hash", "grams", "first", "affixes"):
        assert np.array_equal(getattr(wide, name), getattr(narrow, name)), name
    assert narrow.grams.dtype.itemsize < wide.grams.dtype.itemsize
