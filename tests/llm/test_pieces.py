import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import sentencepieces as S


@pytest.fixture(scope="module")
def pieces():
    return S.vocabulary(S.default_vocabulary())


def small():
    """A tiny vocabulary with its own scores."""
    words = ["▁", "a", "b", "ab", "▁a", "▁ab", "ba", "aba"]
    names = [f"<0x{b:02X}>" for b in range(256)] + words
    given_scores = {256 + i: x for i, x in enumerate([-3, -4, -4.5, -5, -5.5, -8, -6, -9.0])}
    return S.Pieces.make(names, list(given_scores), list(range(256)), given_scores)


def best_by_enumeration(p, text):
    best = None
    for k in range(len(text)):
        for cuts in itertools.combinations(range(1, len(text)), k):
            parts = [text[a:b] for a, b in zip((0, *cuts), (*cuts, len(text)))]
            score = 0.0
            for x in parts:
                if x in p.pieces[256:]:
                    score += p.scores[p.pieces.index(x)]
                elif len(x) == 1:
                    score += p.unknown
                else:
                    break
            else:
                best = score if best is None else max(best, score)
    return best


@settings(max_examples=80, deadline=None)
@given(st.text("abc", min_size=1, max_size=9))
def test_viterbi_is_best(text):
    p = small()
    marked = S.MARK + text
    ids = p.viterbi(marked)
    score, raw = 0.0, 0
    for i in ids:
        if i < 256:
            raw += 1
            score += p.unknown
        else:
            score += p.scores[i]
    assert abs(score - best_by_enumeration(p, marked)) < 1e-9


def test_trie_finds_exactly_the_prefixes(pieces):
    keys = set(pieces.pieces)
    for text in ("▁international", "▁the", "ing", "zzzz", "▁▁▁▁x"):
        data = text.encode()
        found = {data[:e].decode() for e, v in pieces.trie.prefixes(data)}
        want = {text[:k] for k in range(1, len(text) + 1) if text[:k] in keys and not text[:k].startswith("<0x")}
        assert found == want


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_round_trip(text):
    p = S.vocabulary(S.default_vocabulary())
    if any(0xD800 <= ord(c) < 0xE000 for c in text):
        return
    assert p.decode(p.encode(text)) == text


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["the", " ", "  ", ",", ".", "\n", "▁", "é", "你", "letter", "1.5", "e.g."]), max_size=14).map("".join))
def test_cutting_changes_nothing(text):
    p = S.vocabulary(S.default_vocabulary())
    whole = p.viterbi(S.MARK + text.replace(" ", S.MARK)) if text and S.MARK not in text else None
    if whole is not None:
        assert sum(p.scores[i] for i in p.encode(text)) == pytest.approx(sum(p.scores[i] for i in whole))
        assert p.decode(p.encode(text)) == text


def test_very_long_run_without_spaces(pieces):
    text = "abcdefghij" * 20_000
    assert pieces.decode(pieces.encode(text)) == text
