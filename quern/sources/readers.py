"""Scans: CSV, JSON lines, nested JSON, text lists, with file names as columns."""

from __future__ import annotations

import io
import itertools
import json
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators import guards, resolve

from . import files


def csv(spark: SparkSession, paths: str | Sequence[str], schema: str | T.StructType | None = None, infer: bool = True) -> DataFrame:
    """CSV with a header; gz by extension; malformed UTF-8 becomes replacement characters. Give a schema where there is one: inferring reads twice."""
    r = spark.read.option("header", True).option("multiLine", False).option("escape", '"').option("encoding", "UTF-8")
    return (r.schema(schema) if schema is not None else r.option("inferSchema", infer)).csv(paths)


def _placed_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(value, _file, _split, _at): lines with their file, the offset of the part of it that a task reads, and a number that counts up inside the part."""
    meta = F.col("_metadata")
    return spark.read.text(paths).select("value", meta["file_path"].alias("_file"), meta["file_block_start"].alias("_split"), F.monotonically_increasing_id().alias("_at"))


def _line_numbers(rows: DataFrame, every: DataFrame) -> DataFrame:
    """``rows`` of ``every`` with file and line, counted from 1: lines of a file's parts are counted and added up, so no task reads a whole file."""
    parts = every.groupBy("_file", "_split").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("_file").orderBy("_split")) - F.col("_n")
    starts = parts.select("_file", "_split", (before - F.col("_first") + 1).alias("_shift"))
    return rows.join(starts, ["_file", "_split"]).withColumn("line", F.col("_at") + F.col("_shift")).withColumnRenamed("_file", "file").drop("_split", "_at", "_shift")


def numbered_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(value, file, line) of every line of text files, blank ones included, whether or not files are read in parts."""
    lines = _placed_lines(spark, paths)
    return _line_numbers(lines, lines)


class JsonLineError(ValueError):
    """A malformed line; ``file`` and ``line`` say where."""

    def __init__(self, file: str, line: int, text: str):
        super().__init__(f"{file}:{line}: malformed JSON record: {text[:200]!r}")
        self.file, self.line = file, line


def json_lines(spark: SparkSession, paths: str | Sequence[str], schema: str | T.StructType, strict: bool = True) -> DataFrame:
    """JSON lines, blank ones left out. Strict: malformed ones are looked for at once, the first is an error that names file and line. Lenient: they are kept in ``_corrupt_record``."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = T.StructType([*kind.fields, T.StructField("_corrupt_record", T.StringType())])
    record = F.from_json("value", full, {"mode": "PERMISSIVE"})
    if not strict:
        return spark.read.text(paths).where("trim(value) <> ''").select(record.alias("r")).select("r.*")
    lines = _placed_lines(spark, paths)
    bad = lines.where((F.trim("value") != "") & record["_corrupt_record"].isNotNull())
    if not bad.isEmpty():
        first = _line_numbers(bad, lines).orderBy("file", "line").first()
        raise JsonLineError(first["file"], first["line"], first["value"])
    return spark.read.schema(kind).option("mode", "FAILFAST").json(paths)


def split_bad(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows without the corrupt column, and the bad lines."""
    return df.where("_corrupt_record IS NULL").drop("_corrupt_record"), df.where("_corrupt_record IS NOT NULL").select("_corrupt_record")


def by_suffix(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The reader that a file's extension asks for."""
    bare = path.removesuffix(".gz").removesuffix("/")
    if bare.endswith(".csv"):
        return csv(spark, path, schema)
    if bare.endswith((".jsonl", ".json")):
        return json_lines(spark, path, schema) if schema else spark.read.json(path)
    if bare.endswith(".parquet"):
        return spark.read.parquet(path)
    raise ValueError(f"no reader for {path}")


def with_source(df: DataFrame, name: str = "source_file") -> DataFrame:
    """The file of each row, as its name without folders."""
    return df.select("*", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias(name))


def with_name_parts(df: DataFrame, pattern: str, names: Sequence[str]) -> DataFrame:
    """Columns from the groups of a pattern on the file's path."""
    path = F.col("_metadata.file_path")
    return df.select("*", *[F.nullif(F.regexp_extract(path, pattern, i + 1), F.lit("")).alias(n) for i, n in enumerate(names)])


def relation_set(spark: SparkSession, path: str, comments: bool = True) -> DataFrame:
    """(relation_key): lines of a text file, without blank ones and, if asked, those that begin with #."""
    t = spark.read.text(path).select(F.trim("value").alias("relation_key")).where("relation_key <> ''")
    return (t.where(~F.startswith("relation_key", F.lit("#"))) if comments else t).distinct()


RELATION = "name string, prompt_templates array<string>, prompt_templates_zs array<string>, properties struct<relation_type: string, domain_name: string, range_name: string, symmetric: boolean>, samples array<struct<subject: string, object: string>>"


def relations(spark: SparkSession, path: str) -> DataFrame:
    """Nested relation documents as prompts: one row a sample, ids by folder, file and place."""
    docs = spark.read.schema(RELATION).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    named = docs.select("*", F.col("_metadata.file_path").alias("_path"))
    group = F.element_at(F.split("_path", "/"), -2)
    key = F.regexp_extract("_path", r"([^/]+)\.json$", 1)
    from quern.functions.text import fill_template, question_template

    every = F.concat(F.coalesce("prompt_templates_zs", F.array().cast("array<string>")), F.coalesce("prompt_templates", F.array().cast("array<string>")))
    rows = named.select("_path", group.alias("relation_group"), key.alias("relation_key"), F.col("name").alias("relation_name"), question_template(every).alias("template"), F.posexplode("samples").alias("_pos", "x"))
    rows = rows.select("*", F.col("x.subject").alias("subject"), F.col("x.object").alias("gold_object")).withColumn("prompt", fill_template(F.col("template"), F.col("subject"), "{}"))
    sizes = rows.groupBy("_path").agg(F.count(F.lit(1)).alias("_m")).withColumn("_start", F.sum("_m").over(Window.orderBy("_path")) - F.col("_m"))
    return rows.join(F.broadcast(sizes), "_path").withColumn("id", F.col("_start") + F.col("_pos")).drop("_path", "_pos", "_m", "_start", "x")


def best_candidate(spark: SparkSession, paths: Iterable[str], required: Sequence[str], key: str, wanted: DataFrame | None = None) -> str | None:
    """Of several tables, the one that has the required columns and covers most distinct keys; the first among equals."""
    best: tuple[int, str] | None = None
    for p in paths:
        df = by_suffix(spark, p)
        names = [resolve.canonical(df.columns, [c]) for c in [*required, key]]
        if None in names:
            continue
        keys = df.select(F.col(names[-1]).alias(key)).distinct()
        if wanted is not None:
            keys = keys.join(wanted.select(key).distinct(), key, "left_semi")
        n = keys.count()
        if best is None or n > best[0]:
            best = (n, p)
    return best[1] if best else None


def with_columns_like(spark: SparkSession, paths: Iterable[str], required: Sequence[str]) -> list[str]:
    """Tables whose schemas have columns like the required ones; no data is read."""
    return [p for p in paths if all(resolve.canonical(by_suffix(spark, p).columns, [c]) for c in required)]


def union_of(spark: SparkSession, preferred: Sequence[str], fallback: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """All tables that match the preferred patterns, else the fallback ones, less exclusions, by column name."""
    for patterns in (preferred, fallback):
        paths = [p for p in files.expand(spark, patterns) if not any(x in p for x in exclude)]
        if paths:
            out = by_suffix(spark, paths[0])
            for p in paths[1:]:
                out = out.unionByName(by_suffix(spark, p), allowMissingColumns=True)
            return out
    raise FileNotFoundError(f"nothing matches {[*preferred, *fallback]}")


def clean_zip(data: bytes, keep: Sequence[str]) -> bytes:
    """A release archive with only the wanted fields in its JSON-lines members; other members as they are."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as src, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as dst:
        for item in src.infolist():
            body = src.read(item)
            if item.filename.endswith(".jsonl"):
                rows = (json.loads(line) for line in body.decode().splitlines() if line.strip())
                body = "".join(json.dumps({k: r[k] for k in keep if k in r}, ensure_ascii=False) + "\n" for r in rows).encode()
            dst.writestr(item.filename, body)
    return out.getvalue()


def _archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def clean_archives(spark: SparkSession, path: str, keep: Sequence[str]) -> DataFrame:
    """(name, content): every archive under ``path`` with only the wanted fields; a task holds one archive at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                yield pa.RecordBatch.from_pydict({"name": [name.as_py()], "content": pa.array([clean_zip(content.as_py(), keep)], pa.binary())})

    return _archives(spark, path).mapInArrow(run, "name string, content binary")


def sheet_rows(spark: SparkSession, path: str, at_once: int = 10_000) -> DataFrame:
    """(name, row, cells): the rows of the first sheet of every workbook that ``sinks.xlsx`` wrote, from 0 for the header; an empty cell is NULL. Read as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("name", pa.string()), ("row", pa.int64()), ("cells", pa.list_(pa.string()))])
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z, z.open("xl/worksheets/sheet1.xml") as f:
                    rows = enumerate(_sheet_cells(f))
                    while some := list(itertools.islice(rows, at_once)):
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(some)), pa.array([i for i, _ in some], pa.int64()), pa.array([c for _, c in some], pa.list_(pa.string()))], schema=schema)

    return _archives(spark, path).mapInArrow(run, "name string, row long, cells array<string>")


def _sheet_cells(stream) -> Iterator[list[str | None]]:
    held = None
    for event, e in ElementTree.iterparse(stream, ("start", "end")):
        tag = e.tag.rpartition("}")[2]
        if event == "start":
            held = e if tag == "sheetData" else held
        elif tag == "row":
            yield [text if (text := "".join(c.itertext())) or len(c) else None for c in e]
            held.clear()


def archive_lines(spark: SparkSession, path: str, at_once: int = 10_000) -> DataFrame:
    """(name, task_key, line_no, line) of the JSON-lines members of every archive, read as streams; ``task_key`` is a member's name without folder and extension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    for member in (m for m in z.namelist() if m.endswith(".jsonl")):
                        key = member.rsplit("/", 1)[-1].removesuffix(".jsonl")
                        with z.open(member) as f:
                            lines = ((i, line.decode().rstrip("\r\n")) for i, line in enumerate(f) if line.strip())
                            while some := list(itertools.islice(lines, at_once)):
                                yield pa.RecordBatch.from_pydict({"name": [name] * len(some), "task_key": [key] * len(some), "line_no": pa.array([i for i, _ in some], pa.int64()), "line": [x for _, x in some]})

    return _archives(spark, path).mapInArrow(run, "name string, task_key string, line_no long, line string")


def release_rows(lines: DataFrame, schema: str) -> DataFrame:
    """Records of ``archive_lines`` with the ids of a release: ``task_idx`` as given or by line, entity_id and example_id from it. A subject or index twice in a task is an error."""
    r = lines.select("task_key", "line_no", F.from_json("line", f"{schema}, task_idx long", {"mode": "FAILFAST"}).alias("r")).select("task_key", "line_no", "r.*")
    entity = F.concat_ws("_", "task_key", F.when(F.col("task_idx") < 10_000, F.lpad(F.col("task_idx").cast("string"), 4, "0")).otherwise(F.col("task_idx").cast("string")))
    out = r.withColumn("task_idx", F.coalesce("task_idx", "line_no")).drop("line_no").withColumn("entity_id", entity).withColumn("example_id", F.concat_ws(":", "task_key", "entity_id"))
    guards.require_unique(out, ["task_key", "task_idx"], "task_idx")
    guards.require_unique(out.where("subject IS NOT NULL"), ["task_key", "subject"], "subject")
    return out
