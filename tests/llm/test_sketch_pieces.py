"""op4 cuts where the content does."""

import re

from quern.llm import sketches as K

from .helpers import as_tables


def text(first):
    words = [f"w{i}" for i in range(400)]
    return " ".join([*first, *[w + ("." if i % 9 == 8 else "") for i, w in enumerate(words)]])


def test_a_word_put_before_changes_one_piece(spark, tmp_path):
    # the edited text of the first is the first half of one and the second half of two, so near_next tells one from two
    rows = [(1, text([])), (2, text(["before"])), (3, "!? ... one\n.two.")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in K.op4_lookup_sketch(spark, as_tables(tmp_path, documents=d)).collect()}

    def items(t):
        return {p.strip(" ") for p in re.findall(r"[^\n.!?]{1,160}[.!?]*|[.!?]+", t)}

    for (i, one), (_, two) in zip(rows, rows[1:] + rows[:1], strict=True):
        a, b = items(one), items(two)
        assert abs(got[i].near_next - len(a & b) / len(a | b)) < 1e-9
    assert got[1].near_next > 0.9
