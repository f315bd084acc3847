"""What the operators share: reading tables, scratch tables, batches of bounded size."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Characters of text that a Python operator works on at once, unless one text is longer.
BLOCK_CHARS = 500_000
#: Bytes of an Arrow batch that goes to a Python worker, unless one row is larger.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(name: str, taken: Iterable[str]) -> str:
    """The name, or with as many underscores behind it as no name of ``taken`` has, in any case."""
    held = {c.lower() for c in taken}
    while name.lower() in held:
        name += "_"
    return name


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, though ``use`` reads it many times or inside functions of elements."""
    return F.element_at(F.transform(F.array(value), use), 1)


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches have BATCH_BYTES at most, as rows may be long.

    The setting stays: it is read when a frame is run, which may be at any time, and larger batches are needed nowhere.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def give_back() -> None:
    """Return what the C allocator holds free, so that an idle process is small. Elsewhere than on glibc there is nothing to do."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow over small batches; freed memory goes back to the system after each."""
    small_batches(df.sparkSession)

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(batches):
            yield out
            pa.default_memory_pool().release_unused()
        give_back()

    return df.mapInArrow(tidy, schema)


def blocks(texts: list[str | None], most: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts together have about ``most`` characters, one row at least."""
    lo = held = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > lo and held + n > most:
            yield lo, i
            lo, held = i, 0
        held += n
    if lo < len(texts):
        yield lo, len(texts)


def by_block(
    columns: list[str],
    work: Callable[..., pa.RecordBatch | None],
    text_at: int = 1,
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that hands ``work`` the columns' Python lists, block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns]
            for lo, hi in blocks(lists[text_at]):
                out = work(*[x[lo:hi] for x in lists])
                if out is not None and out.num_rows:
                    yield out

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own on a local master where it is unset."""
    sc = spark.sparkContext
    place = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not place:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="quern-")
        sc.setCheckpointDir(place)
    return place.rstrip("/")


class Scratch:
    """Tables written to the shared folder, so that later steps neither recompute nor lose them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/quern-{name}-{uuid.uuid4().hex}"
        self._n = 0
        # what isn't dropped before goes when the application ends, as frames that read it may be used until then
        p, fs = self._path(self.root)
        fs.mkdirs(p)
        fs.deleteOnExit(p)

    def keep(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and read it back; the new frame has no lineage."""
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._quern_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table of ``keep`` that nothing will read again."""
        self._delete(df._quern_path)

    def clear(self) -> None:
        """Delete all tables, of which nothing will be read again."""
        self._delete(self.root)

    def _path(self, path: str) -> tuple:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _delete(self, path: str) -> None:
        p, fs = self._path(path)
        fs.delete(p, True)


#: Arrow types of key columns, by Spark's name.
KEY_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
