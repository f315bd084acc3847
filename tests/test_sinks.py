"""Files that tasks write: sheets and archives."""

import zipfile

import pytest

from quern.functions import answers
from quern.sources import files, readers, sinks


def test_sheet_round_trip(spark, tmp_path):
    rows = [(2, "a<b>&\x07c\ufffe", 1.5, True), (1, None, float("nan"), None), (3, "line\r\nnext  ", float("inf"), False), (4, "", -2.0, True)]
    n = sinks.xlsx(spark.createDataFrame(rows, "id long, `a.b` string, x double, flag boolean"), f"file://{tmp_path}/out/one.xlsx", ["id"])
    got = [r["cells"] for r in readers.sheet_rows(spark, f"file://{tmp_path}/out").orderBy("row").collect()]
    assert n == 4
    assert got == [["id", "a.b", "x", "flag"], ["1", None, None, None], ["2", "a<b>&c", "1.5", "1"], ["3", "line\r\nnext  ", None, "0"], ["4", "", "-2.0", "1"]]
    with zipfile.ZipFile(tmp_path / "out/one.xlsx") as z:
        assert z.testzip() is None and z.namelist()[-1] == sinks.SHEET


def test_sheet_of_no_rows_and_of_too_many(spark, tmp_path, monkeypatch):
    assert sinks.xlsx(spark.createDataFrame([], "id long, name string"), f"file://{tmp_path}/none.xlsx", ["id"]) == 0
    assert [r["cells"] for r in readers.sheet_rows(spark, f"file://{tmp_path}/none.xlsx").collect()] == [["id", "name"]]
    with pytest.raises(Exception, match="a sheet has at most"):
        sinks.xlsx(spark.range(sinks.SHEET_ROWS), f"file://{tmp_path}/many.xlsx", ["id"])
    assert [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["none.xlsx"]


def test_archives_are_written_where_the_rows_are(spark, tmp_path):
    rows = [(f"{i}.bin", bytes([i]) * i) for i in range(20)]
    df = spark.createDataFrame(rows, "name string, content binary").repartition(5)
    assert sinks.archives(df, f"file://{tmp_path}/a") == 20
    assert {p.name: p.read_bytes() for p in (tmp_path / "a").iterdir()} == dict(rows)
    with pytest.raises(ValueError, match="one name"):
        sinks.archives(df.union(df.limit(1)), f"file://{tmp_path}/b")
    assert sinks.archives(df.where("false"), f"file://{tmp_path}/c") == 0


def test_a_file_that_fails_leaves_nothing(tmp_path):
    with pytest.raises(ZeroDivisionError), files.opened(f"file://{tmp_path}/x") as out:
        out.write(b"half")
        1 / 0  # noqa: B018
    assert list(tmp_path.iterdir()) == []


def test_refusals_anywhere(spark):
    rows = [("Well, I DON'T KNOW that.",), ("never  stated",), ("It was never stated",), (None,), ("Paris",)]
    df = spark.createDataFrame(rows, "s string")
    assert [r[0] for r in df.select(answers.refusal_substring(df.s)).collect()] == [True, False, True, False, False]
