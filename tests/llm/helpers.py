"""Fixtures that every operator must stand."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names operators use inside.
CLASHING = ("fp", "node", "cell", "copies", "weight", "tokens", "key", "block", "own", "edited", "draw", "_found", "n_entities", "t1", "grams", "score", "lang_pred", "norm", "made", "token_ids")

WORDS = "the of and to in that is it for on with as at by from river stone bridge winter garden letter window market morning silver harbour thunder meadow candle".split()


def sentence(i: int, n: int = 12) -> str:
    return " ".join(WORDS[(i * 7 + k * k * 3 + k) % len(WORDS)] for k in range(n))


def edge_rows() -> list[tuple]:
    """Null and empty values, a very long text, ties, repeated rows, copies, null ids."""
    long = " ".join(sentence(i) for i in range(3000))
    rows = [
        (1, None, "en", "a", None),
        (2, "", "en", "a", 0),
        (3, "   \n\t ", None, None, 6),
        (4, sentence(1, 60), "en", "a", 1),
        (5, sentence(1, 60), "en", "b", 1),
        (6, sentence(1, 60), "en", "b", 1),
        (6, sentence(1, 60), "en", "b", 1),
        (7, long, "en", "a", len(long)),
        (8, "12345 !!! 67890", None, "", 15),
        (9, "é ü ▁ 你好 \x00 𝄞 " + sentence(2), "fr", "c", 1),
        (None, sentence(3, 30), "en", "a", 1),
        (None, None, None, None, None),
    ]
    return rows


def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), DOCS)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def as_tables(tmp_path, **frames):
    """A folder of driver tables."""
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)
