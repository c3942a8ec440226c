"""Files as they arrive: the model tables as streams, and progress, one row for each unit that is done."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import TABLES, parse

#: The columns of files read as binary.
FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arriving_files(spark: SparkSession, folder: str, *, glob: str = "*.pdf", files_per_batch: int = 1000) -> DataFrame:
    """Files that come into a folder: a stream of (doc_id, content, arrived). A batch holds so many files at most."""
    reader = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder).select(F.col("path").alias("doc_id"), "content", F.col("modificationTime").alias("arrived"))


def stream_table(files: DataFrame, table: str) -> DataFrame:
    """One of the model tables of a stream of files; it keeps no state, so it needs no watermark."""
    if table not in TABLES:
        raise ValueError(f"unknown table {table}")
    return parse(files, table)


def ingest(files: DataFrame, tables: list[str], folder: str, checkpoint: str, *, available_now: bool = True) -> StreamingQuery:
    """Write model tables of arriving files below ``folder`` as Parquet, with a row of progress a file and table.

    A batch is written under its number and replaces what an attempt that failed left, so every file is in the result
    once. The folder and the checkpoint must be seen by all executors.
    """

    def write(batch: DataFrame, number: int) -> None:
        done = batch.select("doc_id")
        for k, table in enumerate(tables):
            parse(batch, table).write.mode("overwrite").parquet(f"{folder}/{table}/batch={number}")
            progress(done, table, k + 1, len(tables)).write.mode("overwrite").parquet(f"{folder}/progress/batch={number}/part={k + 1}")

    writer = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def progress(units: DataFrame, step: str, done: int, total: int) -> DataFrame:
    """An event for each unit: (event, step, doc_id, done, total)."""
    return units.select(F.lit("progress").alias("event"), F.lit(step).alias("step"), "doc_id", F.lit(done).alias("done"), F.lit(total).alias("total"))


def numbered(events: DataFrame, *, step: str, order: list[str]) -> DataFrame:
    """Finished units as events with a count that rises within a step: (event, step, done, total, …)."""
    from pyspark.sql import Window

    whole = Window.partitionBy(step)
    return events.withColumns(
        {"event": F.lit("progress"), "done": F.row_number().over(whole.orderBy(*order)), "total": F.count(F.lit(1)).over(whole)}
    )


def each_batch(files: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run a function on every batch of arriving files."""
    return files.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
