"""Whole queries and the pipeline against plain Python."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np

from quern.llm import langid, resampling, sentencepieces, simhash

from .helpers import DOCS, as_tables, edge_docs
from .test_near_links import groups, sets

TONGUES = {
    "en": "the of and to in that it is for on with as at by from river stone bridge winter garden letter window market morning thunder".split(),
    "fr": "le la les de des et dans que est pour sur avec une par plus rivière pierre fenêtre jardin marché matin lettre chemin toujours jamais".split(),
    "de": "der die das und in zu den mit von ist nicht ein eine auf für sich Fluss Stein Brücke Garten Fenster Markt Morgen Straße immer".split(),
}


def made(n: int, seed: int, words: int = 70) -> list[tuple[str, str]]:
    """(text, language) of random words; numbers make the texts differ."""
    rng = np.random.default_rng(seed)
    return [(" ".join(w if k % 9 else f"{w} {rng.integers(1, 10**6)}" for k, w in enumerate(rng.choice(TONGUES[lang], words))), lang) for lang in list(TONGUES) * (n // 3)]


def test_langid_query(spark, tmp_path):
    rows = [(i, t, lang, "s", 0) for i, (t, lang) in enumerate(made(240, 1))] + [(900, None, "en", "s", 0), (901, "12 34 ??", "en", "s", 0)]
    got = {r.doc_id: r for r in langid.op2_langid_crf(spark, as_tables(tmp_path, documents=spark.createDataFrame(rows, DOCS))).collect()}
    assert set(got) == {r[0] for r in rows}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 for i, r in got.items())
    assert np.mean([got[i].lang_pred == lang for i, _, lang, *_ in rows if got[i].held_out and i < 900]) > 0.97
    assert got[900].lang_pred == got[901].lang_pred == "und"


def test_resampling_query(spark, tmp_path):
    """Exact n-grams in place of hashed ones: those of these ten words share no bucket."""
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(TONGUES["fr"][:10], 30)), None, "s", 0) for i in range(150)] + [(500, None, None, "s", 0), (501, "", None, "s", 0)]
    labels = [(i, int(i % 4 != 0), int(i % 10 == 1)) for i in range(0, 150, 2)] + [(777, 1, 0)]
    sf = as_tables(tmp_path, documents=spark.createDataFrame(rows, DOCS), labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in resampling.op7_importance_resampling(spark, sf).collect()}

    def grams(text):
        w = (text or "").lower().split()
        return Counter(w) + Counter(zip(w, w[1:], strict=False))

    good = {i for i, quality, toxic in labels if quality == 1 and toxic == 0}
    raw, target = Counter(), Counter()
    for i, t, *_ in rows:
        raw += grams(t)
        if i in good:
            target += grams(t)
    scale = sum(target.values()) / sum(raw.values())
    weight = {i: sum(n * math.log((target[g] + 20) / (raw[g] * scale + 20)) for g, n in grams(t).items()) for i, t, *_ in rows}

    def gumbel(i):
        u = (int.from_bytes(hashlib.blake2b(f"resample-1|{i}".encode(), digest_size=8).digest(), "big") + 0.5) / 2**64
        return -math.log(-math.log(u))

    draw = {i: w + gumbel(i) for i, w in weight.items()}
    first = sorted(draw, key=lambda i: (-draw[i], i))[: round(len(rows) * len(good) / len(labels))]
    assert set(got) == set(weight)
    off = {i: (r.log_weight, weight[i], r.draw, draw[i]) for i, r in got.items() if abs(r.log_weight - weight[i]) > 1e-6 or abs(r.draw - draw[i]) > 1e-6}
    assert not off
    assert {i for i, r in got.items() if r.selected} == set(first)


def test_pieces_query(spark, tmp_path):
    """Every text comes back, and no segmentation scores better than the one given."""
    v = sentencepieces.vocabulary(sentencepieces.default_vocabulary())
    normal = {x: v.scores[i] for i, x in enumerate(v.pieces) if any(e == len(x.encode()) for e, _ in v.trie.prefixes(x.encode()))}
    longest = max(map(len, normal))
    extra = ["Zürich  und\n\nЖизнь, 東京 🙂 a.b,c...", " ", "\t", "x" * 300]
    docs = edge_docs(spark).union(spark.createDataFrame([(100 + i, t, None, None, 0) for i, t in enumerate(extra)], DOCS))
    texts = {(r.doc_id, r.text) for r in docs.collect()}
    got = sentencepieces.op8_sentencepiece(spark, as_tables(tmp_path, documents=docs)).collect()
    assert Counter((r.doc_id, v.decode(np.array(r.token_ids, np.int32))) for r in got) == Counter((r.doc_id, r.text or "") for r in docs.collect())
    assert all(r.round_trip and r.n_tokens == len(r.token_ids) for r in got)
    ids = {r.doc_id: r.token_ids for r in got}
    raw = set(v.byte_ids)
    for i, text in texts:
        if i is None or not text or "▁" in text or len(text) > 5000:
            continue
        marked = "▁" + text.replace(" ", "▁")
        best = [0.0] + [-math.inf] * len(marked)
        for a in range(len(marked)):
            for b in range(a + 1, min(len(marked), a + longest) + 1):
                x = normal.get(marked[a:b], v.unknown if b == a + 1 else -math.inf)
                best[b] = max(best[b], best[a] + x)
        apart = bytes(v.byte_ids.index(k) if k in raw else 0x20 for k in ids[i]).decode("utf-8").replace(" ", "")
        score = sum(v.scores[k] for k in ids[i] if k not in raw) + v.unknown * len(apart)
        assert abs(score - best[-1]) < 1e-6, i


def test_pipeline_rows(spark, tmp_path):
    import corpus_pipeline as P

    rng = np.random.default_rng(5)
    rows = [(2 * i, t, lang, f"s{i % 3}", len(t)) for i, (t, lang) in enumerate(made(90, 4))]
    rows += [(i + 1, t, lang, s, n) for i, t, lang, s, n in rows[:20]]
    for i, t, lang, s, n in rows[20:50]:
        words = t.split()
        for at in rng.integers(0, len(words), 1 + i % 3):
            words[at] = f"edit{i}"
        rows.append((i + 1001, " ".join(words), lang, s, n))
    rows += [(5001, None, "en", "s0", 0), (5002, "??? 123", "fr", "s0", 7)]
    rows[60] = (rows[60][0], rows[60][1] + " write to anna.smith@example.org", *rows[60][2:])
    out = P.run(spark, as_tables(tmp_path, documents=spark.createDataFrame(rows, DOCS))).collect()

    texts = {r[0]: r[1] for r in rows if r[0] < 5000}
    held = sets(texts.items())
    bits = {i: simhash.fingerprint(t) for i, t in texts.items()}

    def linked(a, b):
        both = len(held[a] & held[b])
        return (bits[a] ^ bits[b]).bit_count() <= 2 or both >= 0.8 * (len(held[a]) + len(held[b]) - both)

    root = groups(texts, [(a, b) for a in texts for b in texts if a < b and linked(a, b)])
    stays = {i for i in texts if root[i] == i}
    assert len(stays) < len(texts) - 30
    assert {r.doc_id for r in out} == stays
    v = sentencepieces.vocabulary(sentencepieces.default_vocabulary())
    decoded = {r.doc_id: v.decode(np.array(r.token_ids, np.int32)) for r in out}
    assert all(r.round_trip for r in out)
    private = rows[60][0]
    if private in stays:
        assert "anna.smith@" not in decoded[private] and "@" in decoded[private]
    plain = [i for i in stays if i != private]
    assert np.mean([decoded[i] == texts[i] for i in plain]) > 0.95
