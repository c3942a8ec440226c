"""Packing: shortest-pack-first over the length histogram, joined back to the documents by rank.

Documents are cut into pieces of at most ``size`` tokens. Only the histogram of piece lengths (at most
``size`` numbers, whatever the corpus) goes to the driver. It yields packing patterns with counts; the
ranks of the pieces within their length then say which sequence, and which place in it, each one takes.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import lean, materialise, slices_of
from .tokens import encoder, with_end

SIZE = 2048
END_ID = 1
#: Pieces of one length that one task ranks; a length with more is split by a hash.
RANK_ROWS = 200_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    end_id: int = END_ID,
    size: int = SIZE,
) -> DataFrame:
    """Pieces of every document: full ones from its start, then the rest. Null texts count as empty, and
    hold ``end_id`` alone. Rows with null or repeated ids are cut like any other."""
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in slices_of(batches, "__text"):
            out: list[tuple] = []
            for key, ids in zip(batch.column(0).to_pylist(), encode.encode(batch.column(1))):
                ids = with_end(ids, end_id)
                for a in range(0, len(ids), size):
                    piece = ids[a : a + size]
                    out.append((key, a, len(piece), zlib.crc32(piece.view(np.uint8)), len(ids)))
            columns = zip(*out) if out else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            )

    return rows.mapInArrow(lean(run), PIECES)


def shortest_pack_first(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, dict[int, int]]]:
    """Packing patterns as (count, {length: how often}), lengths placed longest first.

    All pieces of a length go, as a block, to the shortest open pattern with room for them; a pattern
    that is more frequent than the pieces left splits, and the rest of it stays as it was.
    """
    open_: dict[int, list[list]] = {}
    totals: list[int] = []
    done: list[tuple[int, dict[int, int]]] = []

    def put(total: int, count: int, pattern: dict[int, int]) -> None:
        if total == size:
            done.append((count, pattern))
        elif same := open_.get(total):
            for known in same:
                if known[1] == pattern:
                    known[0] += count
                    return
            same.append([count, pattern])
        else:
            open_[total] = [[count, pattern]]
            heapq.heappush(totals, total)

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while totals and not open_.get(totals[0]):
                open_.pop(heapq.heappop(totals), None)
            if not totals or totals[0] + length > size:
                fit = size // length
                if left // fit:
                    put(fit * length, left // fit, {length: fit})
                if left % fit:
                    put(left % fit * length, 1, {length: left % fit})
                break
            shortest = totals[0]
            count, pattern = open_[shortest].pop()
            more = min((size - shortest) // length, max(1, left // count))
            taken = min(count, left // more)
            if taken < count:
                open_[shortest].append([count - taken, pattern])
            put(shortest + more * length, taken, {**pattern, length: pattern.get(length, 0) + more})
            left -= taken * more
    return done + [(count, pattern) for group in open_.values() for count, pattern in group]


def slots(patterns: list[tuple[int, dict[int, int]]]) -> dict[int, dict[str, np.ndarray]]:
    """Per length, in order of rank: first rank, pieces per sequence, first sequence, offset of the first piece."""
    rank: dict[int, int] = {}
    table: dict[int, list[tuple[int, int, int, int]]] = {}
    base = 0
    for count, pattern in patterns:
        offset = 0
        for length in sorted(pattern, reverse=True):
            k = pattern[length]
            first = rank.get(length, 0)
            table.setdefault(length, []).append((first, k, base, offset))
            rank[length] = first + k * count
            offset += k * length
        base += count
    return {
        length: dict(zip(("first", "each", "base", "offset"), np.array(rows, np.int64).T)) for length, rows in table.items()
    }


def ranked(pieces: DataFrame, counts: dict[int, int]) -> DataFrame:
    """``pieces`` with ``__rank``, 0, 1, 2 ... within their length.

    A length is split by a hash into as many parts as its count asks for, so one length with a third of
    all pieces does not meet in one task; parts are counted first and number on from one another.
    """
    parts = max(1, -(-max(counts.values(), default=0) // RANK_ROWS))
    part = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(parts))
    split = pieces.withColumn("__part", part)
    within = Window.partitionBy("length", "__part").orderBy("doc_id", "start", "ids_crc32")
    numbered = split.withColumn("__rank", F.row_number().over(within).cast("long") - 1)
    if parts == 1:
        return numbered.drop("__part")
    before = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        split.groupBy("length", "__part")
        .agg(F.count(F.lit(1)).alias("__n"))
        .select("length", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    )
    return (
        numbered.join(offsets, ["length", "__part"])
        .withColumn("__rank", F.col("__rank") + F.col("__before"))
        .drop("__part", "__before")
    )


def pack(docs: DataFrame, *, size: int = SIZE, **how) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Pieces in a sequence stand longest first, without gaps from 0. An empty table gives no rows.
    """
    pieces = materialise(cut(docs, size=size, **how), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = pieces.sparkSession.sparkContext.broadcast(slots(shortest_pack_first(counts, size)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_length = table.value
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "__rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for one in np.unique(length).tolist():
                at, row = np.flatnonzero(length == one), by_length[one]
                k = np.searchsorted(row["first"], rank[at], side="right") - 1
                j, each = rank[at] - row["first"][k], row["each"][k]
                sequence[at] = row["base"][k] + j // each
                offset[at] = row["offset"][k] + j % each * one
            kept = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence), pa.array(offset)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return ranked(pieces, counts).mapInArrow(lean(run), PIECES + ", sequence_id long, offset long")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    from ._common import table

    return pack(table(spark, sf_dir, "documents"))
