import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import chat as C

from .helpers import as_tables

TURNS = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def codec():
    return C.codec(*C.default_ranks())


tricky = st.lists(st.sampled_from(["\\", "###", "</turn>", "\n", " ", ":", "#", "### user: ", " </turn>\n", "é", "你", "a"]), max_size=12).map("".join)


@settings(max_examples=150, deadline=None)
@given(role=tricky, text=tricky)
def test_written_form_is_reversible(role, text):
    c = C.codec(*C.default_ranks())
    ids, lo, hi = c.turn_ids(role, text)
    assert c.read(ids) == [(role, text)]
    assert C.unescape(c.encoding.decode(ids[lo:hi].tolist())) == text
    assert C.parse_written(c.written(np.concatenate([ids, ids]))) == [(role, text)] * 2


def test_control_strings_never_stand_bare(codec):
    ids, _, _ = codec.turn_ids("user", C.PROBE_TEXT)
    body = codec.written(ids)[len(C.TURN) :]
    assert "\n### " not in body and body.count(C.END) == 1


def test_masks_follow_prefix_sums(spark, codec):
    rows = [(1, 0, "user", "hi there"), (1, 1, "assistant", "hello ### you"), (1, 2, "assistant", None), (2, 0, "assistant", "x")]
    enc = C.in_order(C.encode_turns(spark, spark.createDataFrame(rows, TURNS)))
    got = {(r.conv_id, r.turn): r for r in C.assemble(spark, enc).collect()}
    stream = got[1, 0].token_ids + got[1, 1].token_ids + got[1, 2].token_ids
    a = got[1, 1]
    assert a.token_offset == len(got[1, 0].token_ids)
    assert C.unescape(codec.encoding.decode(stream[a.loss_from : a.loss_to])) == "hello ### you"
    assert got[1, 0].loss_from == got[1, 0].loss_to and got[2, 0].token_offset == 0


def test_query_against_plain_python(spark, tmp_path):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (None, 0, None, "n"), (5, None, "user", "x"), (5, 0, "assistant", "é###")]
    sf = as_tables(tmp_path, conversations=spark.createDataFrame([(*r, 1) for r in rows], TURNS + ", fp int"))
    got = {r.conv_id: r for r in C.op1_chat_format(spark, sf).collect()}
    both = [*rows, (-7, 0, "user", C.PROBE_TEXT), (-7, 1, "assistant", C.PROBE_TEXT)]
    assert set(got) == {r[0] for r in both}
    for k, g in got.items():
        mine = sorted((r for r in both if r[0] == k), key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or ""))
        text = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(mine), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_no_conversations_leaves_the_probe(spark, tmp_path):
    sf = as_tables(tmp_path, conversations=spark.createDataFrame([], TURNS))
    assert [r.conv_id for r in C.op1_chat_format(spark, sf).collect()] == [-7]
