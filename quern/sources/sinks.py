"""Sinks: sorted and partitioned files, reports, resumable and atomic writes."""

from __future__ import annotations

import zipfile
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import files


def sorted_csv(df: DataFrame, path: str, order: Sequence[str | Column], gz: bool = False) -> None:
    """One sorted CSV file with a header: for summaries, not for data."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).option("compression", "gzip" if gz else "none").csv(path)


def json_lines(df: DataFrame, path: str, gz: bool = False) -> None:
    df.write.mode("overwrite").option("compression", "gzip" if gz else "none").json(path)


def partitioned(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """One folder for each key; a key's rows may come from any number of tasks, so no key lands in one."""
    df.write.mode("overwrite").partitionBy(*keys).parquet(path)


def _small(df: DataFrame, most: int = 10_000) -> list:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")
    return rows


def _text(v) -> str:
    return "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)


def markdown(df: DataFrame, most: int = 10_000) -> str:
    """A report table in Markdown."""
    lines = [df.columns, ["---"] * len(df.columns), *[[_text(v).replace("|", "\\|") for v in r] for r in _small(df, most)]]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines) + "\n"


def latex(df: DataFrame, most: int = 10_000) -> str:
    """A report table in LaTeX."""
    clean = lambda s: s.replace("\\", "\\textbackslash{}").replace("_", "\\_").replace("%", "\\%").replace("&", "\\&")
    rows = [df.columns, *[[_text(v) for v in r] for r in _small(df, most)]]
    body = "".join(" & ".join(map(clean, r)) + " \\\\\n" for r in rows)
    return "\\begin{tabular}{" + "l" * len(df.columns) + "}\n" + body + "\\end{tabular}\n"


#: Rows that a sheet has room for, its header included: the format's bound.
SHEET_ROWS = 1 << 20
# The parts of a workbook of one sheet, and its namespaces.
_SHEET_NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_DOCUMENT = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
SHEET = "xl/worksheets/sheet1.xml"
_PARTS = {
    "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{_KIND}.sheet.main+xml"/><Override PartName="/{SHEET}" ContentType="{_KIND}.worksheet+xml"/></Types>',
    "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_DOCUMENT}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": f'<workbook xmlns="{_SHEET_NS}" xmlns:r="{_DOCUMENT}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_DOCUMENT}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}


def _cell(value: Column, kind: str) -> Column:
    """A value as a cell: numbers as such, flags, all else as text without the control characters that XML forbids; NULL, NaN and infinities are empty."""
    plain = value.cast("string")
    if kind == "boolean":
        cell = F.concat(F.lit('<c t="b"><v>'), value.cast("int").cast("string"), F.lit("</v></c>"))
    elif kind in ("float", "double"):
        cell = F.when(F.abs(value) < float("inf"), F.concat(F.lit("<c><v>"), plain, F.lit("</v></c>")))
    elif kind in ("tinyint", "smallint", "int", "bigint") or kind.startswith("decimal"):
        cell = F.concat(F.lit("<c><v>"), plain, F.lit("</v></c>"))
    else:
        clean = F.regexp_replace(plain, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x{FFFE}\\x{FFFF}]", "")
        for sign, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ("\r", "#13")):
            clean = F.replace(clean, F.lit(sign), F.lit(f"&{name};"))
        cell = F.concat(F.lit('<c t="inlineStr"><is><t xml:space="preserve">'), clean, F.lit("</t></is></c>"))
    return F.coalesce(cell, F.lit("<c/>"))


def _row(cells: Sequence[Column]) -> Column:
    return F.concat(F.lit("<row>"), *cells, F.lit("</row>"))


def xlsx(df: DataFrame, path: str, order: Sequence[str | Column]) -> int:
    """One sorted sheet with a header; the number of its rows. More than a sheet has room for is an error.

    A file has one writer: one task streams the sorted rows into it.
    """
    first = max(df.columns, key=len, default="") + "_first"
    head = df.sparkSession.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema], F.lit(True).alias(first))
    cells = F.when(F.col(first), _row([_cell(F.lit(c), "string") for c in df.columns])).otherwise(_row([_cell(F.col(f"`{c}`"), t) for c, t in df.dtypes]))
    xml = head.union(df.withColumn(first, F.lit(False))).orderBy(F.desc(first), *order).select(cells.alias("xml"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        with files.opened(path) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, text in _PARTS.items():
                z.writestr(name, _HEAD + text)
            with z.open(SHEET, "w", force_zip64=True) as f:
                f.write(f'{_HEAD}<worksheet xmlns="{_SHEET_NS}"><sheetData>'.encode())
                for batch in batches:
                    n += batch.num_rows
                    if n > SHEET_ROWS:
                        raise ValueError(f"a sheet has at most {SHEET_ROWS} rows")
                    f.write("".join(batch.column(0).to_pylist()).encode())
                f.write(b"</sheetData></worksheet>")
        yield pa.RecordBatch.from_pydict({"n": [n - 1]})

    return xml.coalesce(1).mapInArrow(run, "n long").first()[0]


def todo(df: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys aren't in the output yet."""
    return df.join(done.select(*keys).distinct(), list(keys), "left_anti")


def append_missing(spark: SparkSession, df: DataFrame, path: str, keys: Sequence[str]) -> int:
    """Write only rows that ``path`` lacks; the number written. Running it again after a failure goes on where it stopped."""
    rest = todo(df, spark.read.parquet(path), keys) if files.exists(spark, path) else df
    seen = Observation()
    rest.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return seen.get["n"]


def after(df: DataFrame, done: DataFrame, position: str) -> DataFrame:
    """Rows behind the first n, n being the rows in the output, by a 0-based number of the source's rows. An output that isn't those first n is an error."""
    n, last = done.agg(F.count(F.lit(1)), F.max(position)).first()
    if n and last != n - 1:
        raise ValueError(f"the output has {n} rows up to position {last}")
    return df.where(F.col(position) >= n)


def archives(df: DataFrame, folder: str) -> int:
    """Write each (name, content) as a file of the folder, where the rows are; the number of files. Two of one name are an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with files.opened(f"{folder}/{name}") as out:
                    out.write(content.as_buffer())
            yield batch.select(["name"])

    done = df.select("name", "content").mapInArrow(run, "name string").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    files_, most = done.agg(F.count(F.lit(1)), F.max("n")).first()
    if files_ and most > 1:
        raise ValueError("two archives have one name")
    return files_


def complete(source: DataFrame, output: DataFrame) -> bool:
    """Whether an output has as many rows as its source."""
    return source.count() == output.count()


def replace_table(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Write beside a table, then put the new one in its place: readers see either."""
    new = f"{path}.new"
    df.write.mode("overwrite").parquet(new)
    files.replace(spark, new, path)


def checkpointed(spark: SparkSession, df: DataFrame, path: str, key: str, work: Callable[[DataFrame], DataFrame], slices: int = 16) -> None:
    """Replace a table by ``work`` over ``df``, done in slices that a run which stopped doesn't lose.

    Rows are dealt to slices by a hash of ``key`` and written once beside the table. Each
    slice's result is written, and only then noted in the manifest, a folder of one small
    file a slice. A new run with the same arguments does the slices that are not noted;
    at the end the results' files are moved together and put in the table's place, which
    until then holds what it held before. ``work`` must give a row's result from the row.
    """
    side = f"{path}.slices"
    plan = f"{key}|{slices}|{df.schema.simpleString()}".encode()
    if not files.exists(spark, f"{side}/manifest/rows"):
        files.delete(spark, side)
        df.withColumn("_slice", F.pmod(F.xxhash64(key), F.lit(slices)).cast("int")).write.partitionBy("_slice").parquet(f"{side}/rows")
        files.write_bytes(spark, f"{side}/manifest/rows", plan)
    elif files.read_bytes(spark, f"{side}/manifest/rows") != plan:
        raise ValueError(f"{side} is of a run with other columns or slices")
    rows = spark.read.schema(f"{', '.join(f'`{n}` {t}' for n, t in df.dtypes)}, _slice int").parquet(f"{side}/rows")
    done = set(files.names(spark, f"{side}/manifest"))
    for i in range(slices):
        if f"slice-{i}" not in done:
            work(rows.where(F.col("_slice") == i).drop("_slice")).write.mode("overwrite").parquet(f"{side}/done/{i}")
            files.write_bytes(spark, f"{side}/manifest/slice-{i}", b"")
    for i in range(slices):
        files.move_all(spark, f"{side}/done/{i}", f"{side}/table", f"{i}-")
    files.replace(spark, f"{side}/table", path)
    files.delete(spark, side)


def blank_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[F.nullif(F.col(c), F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])
