"""Adapters that make a corpus of pages (doc_id, page, text) from plain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents, one turn to a page."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page"), "role", "text"
    )


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the documents: doc_id, line from 1, text. A document whose text is null has no lines."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "text")).select(
        "doc_id", (F.col("at") + 1).cast("int").alias("line"), "text"
    )


def document_pages(spark: SparkSession, sf_dir: str, lines: int = 10) -> DataFrame:
    """Documents as pages of ``lines`` lines. Cut inside the row, so nothing is shuffled. One whose text is null has none."""
    docs = table(spark, sf_dir, "documents")
    parts = F.split("text", "\n", -1)
    count = F.ceil(F.size(parts) / lines).cast("int")
    texts = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.array_join(F.slice(parts, k * lines + 1, lines), "\n"))
    return docs.select("doc_id", F.posexplode(texts).alias("at", "text")).select(
        "doc_id", (F.col("at") + 1).cast("int").alias("page"), "text"
    )
