"""Shared plumbing of the training-data operators: the shared folder, tables written there, text helpers."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handed on in one Arrow batch by the Python stages; texts are streamed, never gathered.
BATCH_ROWS = 2048
#: Bytes in one Arrow batch that goes to Python while a table is written.
BATCH_BYTES = 4 << 20

_FALLBACK: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """URL of the folder that driver and executors share.

    ``spark.checkpoint.dir`` of the session decides. Only where it is unset and the master is local, as in tests
    on one machine, a temporary folder of this process takes its place; elsewhere that raises.
    """
    url = spark.conf.get("spark.checkpoint.dir", None)
    if not url:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        url = known.get() if known.isDefined() else None
    if not url and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not url:
        url = _FALLBACK.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="papyra-"))
    return url.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/papyra/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    This cuts the lineage: after the loss of an executor only the readers of the table run again.
    """
    path = scratch(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._papyra_path = path
    return out


#: The setting that bounds Arrow batches.
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Let Arrow batches of the session hold BATCH_BYTES at most, so that a task's memory does not grow with its texts."""
    spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """The same for what runs inside."""
    before = spark.conf.get(BATCH_SETTING, None)
    bound_batches(spark)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH_SETTING)
        else:
            spark.conf.set(BATCH_SETTING, before)


def release(*frames: DataFrame) -> None:
    """Delete tables made by :func:`materialise` which nothing will read again."""
    for df in frames:
        if path := getattr(df, "_papyra_path", None):
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A function for ``mapInArrow`` that gives its memory back to the system when its task ends.

    Workers outlive their tasks and wait for the next one; what allocators keep for themselves would otherwise add up
    over the workers of all stages.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    """Return free memory of Arrow's pool and, where the C library can, of the heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def filesystem(url: str) -> tuple[pafs.FileSystem, str]:
    """The pyarrow file system of a shared-folder URL and the path in it."""
    if url.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + url[5:].lstrip("/")
    if "://" not in url:
        return pafs.LocalFileSystem(), os.path.abspath(url)
    return pafs.FileSystem.from_uri(url)


def slices(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that what a step makes of one batch stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def slices_of(batches: Iterator[pa.RecordBatch], column: str, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes of a string column; a longer text is a batch by itself."""
    for batch in batches:
        lengths = [n or 0 for n in pc.binary_length(batch.column(batch.schema.get_field_index(column))).to_pylist()]
        start = total = 0
        for k, n in enumerate(lengths):
            if total and total + n > size:
                yield batch.slice(start, k - start)
                start, total = k, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)


def raw_utf8(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


#: A-Z to lower case, other ASCII that is no digit or letter to a space; bytes of longer code points stay.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words(text: bytes) -> list[bytes]:
    """Normalised words: runs of digits, ASCII letters (lower-cased) and anything beyond ASCII."""
    return text.translate(_WORD_BYTES).split()


def ident(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only id and text, under names that no extra column can clash with."""
    return df.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"))
