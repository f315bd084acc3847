"""Files on whatever store Spark reads: listing, matching, moving, a shared scratch folder."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, name: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(name)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A path for a new folder below spark.checkpoint.dir, which executors share; on a local master without that setting, a temporary one.

    It is deleted when the application ends, as frames that read it may be used until then.
    """
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.sparkContext.setCheckpointDir(place)
    path = f"{place.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    p, fs = _path(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return f"{path}/data"


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a scratch folder and read back: computed once, without lineage, safe when executors are lost."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, name: str) -> bool:
    p, fs = _path(spark, name)
    return fs.exists(p)


def expand(spark: SparkSession, patterns: Sequence[str]) -> list[str]:
    """Files that match the patterns, in their order and by name inside each, every file once."""
    found: dict[str, None] = {}
    for pattern in patterns:
        p, fs = _path(spark, pattern)
        for status in sorted((s.getPath().toString() for s in fs.globStatus(p) or [])):
            found.setdefault(status)
    return list(found)


def write_bytes(spark: SparkSession, name: str, data: bytes) -> None:
    """A small file, which must not be there yet."""
    p, fs = _path(spark, name)
    out = fs.create(p, False)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


@contextlib.contextmanager
def opened(name: str) -> Iterator[pa.NativeFile]:
    """In a task: a new file on a store that pyarrow knows (shared folders, HDFS, S3, GCS). It gets its name once it is whole, so a task that is run twice does no harm."""
    store, path = FileSystem.from_uri(name)
    folder, _, last = path.rpartition("/")
    store.create_dir(folder, recursive=True)
    part = f"{folder}/.{last}.{uuid.uuid4().hex}"
    try:
        with store.open_output_stream(part) as out:
            yield out
    except BaseException:
        store.delete_file(part)
        raise
    store.move(part, path)


def delete(spark: SparkSession, name: str) -> None:
    p, fs = _path(spark, name)
    fs.delete(p, True)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, in order; none where there is no folder."""
    p, fs = _path(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def read_bytes(spark: SparkSession, name: str) -> bytes:
    """A small file."""
    p, fs = _path(spark, name)
    source = fs.open(p)
    try:
        return bytes(source.readAllBytes())
    finally:
        source.close()


def move_all(spark: SparkSession, folder: str, to: str, prefix: str) -> None:
    """Move a folder's data files to another under names of their own; those that were moved before are skipped."""
    q, fs = _path(spark, to)
    fs.mkdirs(q)
    for name in names(spark, folder):
        if not name.startswith(("_", ".")):
            a, b = _path(spark, f"{folder}/{name}")[0], _path(spark, f"{to}/{prefix}{name}")[0]
            if not fs.rename(a, b):
                raise OSError(f"can't move {folder}/{name}")


def replace(spark: SparkSession, new: str, old: str) -> None:
    """Put a finished folder in another's place: the old one stands aside until the new one is there."""
    p, fs = _path(spark, new)
    q, _ = _path(spark, old)
    aside, _ = _path(spark, f"{old}.old-{uuid.uuid4().hex}")
    had = fs.exists(q)
    if had and not fs.rename(q, aside):
        raise OSError(f"can't move {old}")
    if not fs.rename(p, q):
        if had:
            fs.rename(aside, q)
        raise OSError(f"can't move {new}")
    if had:
        fs.delete(aside, True)
