"""The corpus pipeline over the documents table: filter, deduplicate, decontaminate, pack.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; its result is written as
Parquet and read again. All but the last return the columns of documents. A stage's result is made when it is written,
by whoever calls it, so every stage bounds the Arrow batches of the session. Any column may be null: a document
without text is an empty one and stays, one without an id is compared and packed like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from papyra.llm import decontaminate, line_dedup, minhash, packing, toxicity
from papyra.llm._common import bound_batches, materialise, release, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects as toxic go."""
    bound_batches(spark)
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of lines seen before go; a document goes if nothing of it is left."""
    bound_batches(spark)
    return line_dedup.clean(docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    bound_batches(spark)
    return minhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or a whole shorter item, go."""
    bound_batches(spark)
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All tokens that are left, in sequences of at most 2048."""
    bound_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("minhash near-dedup", keep_one_of_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL cannot express the trained model, the content-defined chunks, the signatures or the tokenizer;
#: tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    out = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, out = out, materialise(stage(spark, out, sf_dir), "stage-" + name.replace(" ", "-"))
        release(before)
    return out
