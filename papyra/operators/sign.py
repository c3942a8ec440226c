"""Signatures: what a byte range covers, and its digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def signed_digest(content: Column, start: Column, length: Column, start2: Column, length2: Column, bits: int = 256) -> Column:
    """SHA-2 over both parts of a byte range."""
    if bits not in (256, 384, 512):
        raise ValueError("only SHA-256, SHA-384 and SHA-512 are accepted")
    part = lambda a, n: F.substring(content, (a + 1).cast("int"), n.cast("int"))
    return F.sha2(F.concat(part(start, length), part(start2, length2)), bits)


def check_ranges(signatures: DataFrame, *, content: str = "content") -> DataFrame:
    """Signatures (content, a, b, c, d) with digest, whether the range is sound, and whether it covers the whole file.

    A sound range starts at 0, leaves one gap, and ends inside the file.
    """
    size = F.octet_length(content).cast("long")
    sound = (F.col("a") == 0) & (F.col("b") > 0) & (F.col("c") >= F.col("b")) & (F.col("d") >= 0) & (F.col("c") + F.col("d") <= size)
    return (
        signatures.withColumn("range_sound", sound)
        .withColumn("covers_whole", sound & (F.col("c") + F.col("d") == size))
        .withColumn("digest", F.when(sound, signed_digest(F.col(content), F.col("a"), F.col("b"), F.col("c"), F.col("d"))))
    )
