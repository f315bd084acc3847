"""Each operator on empty tables, edge values and clashing extra columns."""

import hashlib

import pytest
from pyspark.sql import functions as F

from quern.llm import chat, langid, media, mixing, resampling, sentencepieces, simhash, sketches, suffixes, surrogates
from quern.llm.common import Scratch

from .helpers import CLASHING, as_tables, edge_docs, edge_rows, empty_docs


def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 1, 0), (7, 0, 1), (7, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "langid": lambda s, d: langid.predict(s, d, langid.fit_on(d)),
    "mixing": lambda s, d: mixing.copies(d, mixing.plan(d, Scratch(s, "t"))).select("doc_id", "copies"),
    "sketches": lambda s, d: sketches.compared(d, Scratch(s, "t")),
    "media": lambda s, d: media.documents_as_media(d),
    "simhash": lambda s, d: simhash.components(s, d),
    "resampling": lambda s, d: resampling.resample(s, d, labels(s)),
    "pieces": lambda s, d: sentencepieces.encode_column(s, d),
    "surrogates": lambda s, d: surrogates.replace(s, d),
    "suffixes": lambda s, d: suffixes.remove_repeats(s, d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, empty_docs(spark)).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_has_one_result(spark, name):
    rows = OPERATORS[name](spark, edge_docs(spark)).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in edge_rows())


#: Operators that return the documents' own columns, and the names of what they add.
KEEPING = {
    "mixing": (lambda s, d: mixing.copies(d, mixing.plan(d, Scratch(s, "t"))), ("weight", "copies")),
    "surrogates": (lambda s, d: surrogates.replace(s, d), ("n_entities",)),
    "accept": (lambda s, d: langid.accept(s, d), ()),
    "deduplicate": (lambda s, d: simhash.deduplicate(s, d), ()),
    "realise": (lambda s, d: mixing.realise(s, d), ()),
}
#: What an operator may use inside, beside the names of what it returns.
INSIDE = tuple(dict.fromkeys((*CLASHING, "doc", "row", "root", "n", "found", "names", "later", "full", "cut", "block", "uid", "_copy", "_source", "_row", "least")))


def crowded(df):
    """With a column of every name in INSIDE, telling its row."""
    tag = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.length("text"))
    return df.select("*", *[tag.alias(c) for c in INSIDE if c not in df.columns])


@pytest.mark.parametrize("name", KEEPING)
def test_users_columns_of_any_name_stay(spark, name):
    run, added = KEEPING[name]
    out, plain = run(spark, crowded(edge_docs(spark))), run(spark, edge_docs(spark))
    mine = [c for c in out.columns if c in INSIDE]
    assert sorted(mine) == sorted(set(INSIDE) - set(edge_docs(spark).columns))
    for r in out.collect():
        assert len({r[c] for c in mine}) == 1 and r[mine[0]].split("|")[0] == str(r["doc_id"] if r["doc_id"] is not None else "none")
    results = [c + "_" if c in INSIDE else c for c in added]
    cols = [*edge_docs(spark).columns, *results]
    assert sorted(map(tuple, out.select(*cols).collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(set(OPERATORS) - {"mixing", "surrogates"}))
def test_clashing_columns_change_nothing(spark, name):
    out, plain = OPERATORS[name](spark, crowded(edge_docs(spark))), OPERATORS[name](spark, edge_docs(spark))
    cols = plain.columns
    assert sorted(map(str, out.select(*cols).collect())) == sorted(map(str, plain.collect()))


def test_chat_edges(spark, tmp_path):
    """Very long texts, and columns of the names that the operator uses."""
    long = "word ### " * 40_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long), (None, None, None, None), (2, 0, "assistant", "")]
    turns = spark.createDataFrame([(*r, 7, "x") for r in rows], "conv_id long, turn long, role string, text string, ids int, token_offset string")
    got = {r.conv_id: r for r in chat.op1_chat_format(spark, as_tables(tmp_path, conversations=turns)).collect()}
    assert (got[1].n_turns, got[1].loss_chars, got[1].loss_sha256) == (2, len(long), hashlib.sha256(long.encode()).hexdigest())
    assert (got[None].n_turns, got[2].loss_chars) == (1, 0)


def test_stages_keep_columns(spark):
    import corpus_pipeline as P

    docs = edge_docs(spark)
    for name, stage in P.STAGES[:-1]:
        docs = Scratch(spark, "stages").keep(stage(spark, docs, ""))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    ids = {r[0] for r in docs.select("doc_id").collect()}
    assert {4, 7} <= ids and not ids & {1, 2, 3, 5, 6, 8}


def test_pipeline_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline as P

    assert P.run(spark, as_tables(tmp_path, documents=empty_docs(spark))).count() == 0
