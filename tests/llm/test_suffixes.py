import hashlib

import numpy as np
import pytest

from quern.llm import suffixes as X

from .helpers import sentence


def brute(rows):
    seen: dict[bytes, int] = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            k = b[i : i + 50]
            seen[k] = min(seen.get(k, X.LAST), X.LAST if d is None else d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        hit = np.zeros(len(b) + 1, int)
        for i in range(len(b) - 49):
            if seen[b[i : i + 50]] < (X.LAST if d is None else d):
                hit[i] += 1
                hit[i + 50] -= 1
        m = np.cumsum(hit)[:-1] > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~m])
        out.append((d, len(b), int(m.sum()), int((np.diff(np.r_[0, m.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **how):
    d = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r) for r in X.remove_repeats(spark, d, **how).collect()), key=str)


def cases():
    rng = np.random.default_rng(3)
    passage = " ".join(sentence(i) for i in range(90, 94))
    rows = [(i, " ".join(sentence(int(k), 9) for k in rng.integers(0, 400, 6))) for i in range(60)]
    rows += [(60 + i, f"x{i} " + passage[int(a) : int(a) + int(n)] + f" {i}y") for i, (a, n) in enumerate(zip(rng.integers(0, 60, 40), rng.integers(30, 120, 40)))]
    rows += [(200, "a" * 49), (201, "a" * 49), (202, "b" * 50), (203, "b" * 51), (204, "b" * 400), (205, None), (206, ""), (207, "é" * 40), (208, "é" * 30 + "x")]
    rows += [(210, passage), (211, passage), (211, passage), (211, passage[:60] + "!"), (None, passage), (None, "zz " + passage), (None, "zz " + passage)]
    return rows


@pytest.mark.parametrize("bucket_bytes", [1 << 24, 2000])
def test_against_brute_force(spark, bucket_bytes):
    assert run(spark, cases(), bucket_bytes=bucket_bytes) == brute(cases())


@pytest.mark.parametrize("most", [X.MOST_BROADCAST, 0])
def test_texts_of_many_copies_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(X, "MANY_COPIES", 1)
    monkeypatch.setattr(X, "MOST_BROADCAST", most)
    assert run(spark, cases()) == brute(cases())


def test_hot_grams_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(X, "HOT", 3)
    assert run(spark, cases(), bucket_bytes=2000) == brute(cases())


@pytest.mark.parametrize("size", [30, 33, 36, 37, 40, 45, 48, 49])
def test_one_string_in_many_contexts_is_spread(size):
    """Strings of any length below a window, in 4,000 contexts: all buckets get about as much."""
    rng = np.random.default_rng(size)
    shared, sent = "one and the same string of up to forty-nine bytes."[:size], {}
    for i in range(4000):
        raw = np.frombuffer(("".join(rng.choice(list("abcdefghij"), 60)) + shared + "".join(rng.choice(list("klmnopqrst"), 60))).encode(), np.uint8)
        h, lo, hi, at = X.anchors(raw)
        inside = (at >= 60) & (at + X.GRAM <= 60 + size)
        gram = X._gram_key(h[inside], 50)
        found = X.fragments(raw, -1 - gram, 50)
        for bucket, _, a, z in found:
            assert z - a == X.DEPTH
            sent[bucket] = sent.get(bucket, 0) + 1
        if i < 50:
            windows = lambda f: sorted(s for _, _, a, z in f for s in range(a, z - X.DEPTH + 1))
            assert windows(X.fragments(raw, gram, 50)) == windows(found)
    assert len(sent) == 50 and max(sent.values()) < 3 * sum(sent.values()) / 50


def test_windows_belong_to_one_anchor_each():
    raw = np.frombuffer((" ".join(sentence(i) for i in range(3000))).encode(), np.uint8)
    chunk = X.CHUNK
    h, lo, hi, _ = X.anchors(raw)
    X.CHUNK = 1000
    try:
        h2, lo2, hi2, _ = X.anchors(raw)
    finally:
        X.CHUNK = chunk
    assert lo[0] == 0 and hi[-1] == len(raw) - X.DEPTH and (lo[1:] == hi[:-1] + 1).all()
    cover, cover2 = np.repeat(h, hi - lo + 1), np.repeat(h2, hi2 - lo2 + 1)
    # chunks break ties between equal hashes alike, as equal grams have equal hashes
    assert (cover == cover2).all()


def test_radix_groups_stop_at_the_depth():
    a, b = b"q" * 50 + b"A" * 20, b"q" * 50 + b"B" * 20
    data = np.frombuffer(a + b, np.uint8)
    hit = X.equal_groups(data, np.array([0, 1, 70, 71]), np.array([1, 1, 2, 2]))
    assert hit.tolist() == [False, False, True, False]


def test_groups_are_told_apart_by_bytes():
    """Random texts of two letters: every group of the sort against a dictionary of windows."""
    rng = np.random.default_rng(2)
    data = rng.choice(np.frombuffer(b"ab", np.uint8), 4000)
    data[1000:1300], data[3000:3300] = data[2000:2300], data[2000:2300]
    starts = np.arange(len(data) - X.DEPTH + 1)
    docs = starts // 900
    least = {}
    for i, d in zip(starts, docs, strict=True):
        least.setdefault(data[i : i + X.DEPTH].tobytes(), d)
    want = [least[data[i : i + X.DEPTH].tobytes()] < d for i, d in zip(starts, docs, strict=True)]
    assert X.equal_groups(data, starts, docs).tolist() == want and sum(want) > 400
