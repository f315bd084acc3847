"""From documents to token ids: language, near copies, personal data, mix, pieces.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as
Parquet and read again for the next. All but the last keep the columns of
documents.

Defined results: rows without text or words have no language and go in the first stage,
as do those whose words agree on none; of equal and of similar texts the one with the
smallest doc_id stays, rows without doc_id behind all others; repeated rows are equal
texts. What is left is rewritten, mixed and encoded, a document of a small source more
than once, as the mix asks. Whole texts go through every stage, however long they are,
each in one task at a time. Columns beside those of documents, whatever their names, go
along until the last stage. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import langid, mixing, sentencepieces, simhash, surrogates
from quern.llm.common import Scratch, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose words agree on a language; the others go."""
    return langid.accept(spark, docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    return simhash.deduplicate(spark, docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Surrogates in place of personal data."""
    return surrogates.replace(spark, docs).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document at least once, those of small sources again as the mix asks."""
    return mixing.realise(spark, docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document."""
    return sentencepieces.encode_column(spark, docs)


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("personal_data", personal_data),
    ("mix", mix),
    ("pieces", pieces),
]

#: Stages learn a model and call tokenizers, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    scratch = Scratch(spark, "pipeline")
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
        if last is not None:
            scratch.drop(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
