"""Token-id files: independent zstandard frames, a trailing seek table, per-frame checksums.

A shard follows the public "zstd seekable format": data frames, then skippable frames, the last of
which is the seek table (compressed size, decompressed size and the low 32 bits of the XXH64 of every
frame, a descriptor and a magic number at the very end). Before it stands one more skippable frame with
the document index: ids, token counts and first frame of each document. Any zstandard decoder reads
the plain id stream; this reader fetches and decompresses only the frames of the requested documents.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import filesystem, lean, materialise, scratch, slices_of
from .tokens import encoder, with_end

# Fixed values of the zstd seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
INDEX_MAGIC = 0x184D2A5D
SEEKABLE_MAGIC = 0x8F92EAB1
DESCRIPTOR_CHECKSUMS = 0x80

#: Bytes of ids in one frame, before compression.
FRAME_BYTES = 128 << 10
#: Bytes of text that go into one shard, about; and of the beginnings of texts that rows of equal ids are dealt by.
SHARD_BYTES = 32 << 20
DEALT_CHARS = 16
END_ID = 1

MANIFEST = "shard long, path string, n_docs long, n_tokens long, n_bytes long"


class ShardWriter:
    """Writes documents one after the other; a frame is closed when it is full, also inside a long document."""

    def __init__(self, out, width: int = 2, frame_bytes: int = FRAME_BYTES, level: int = 1):
        self.out, self.width, self.frame_bytes = out, width, frame_bytes
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=True)
        self.buffer = bytearray()
        self.frames: list[tuple[int, int, int]] = []
        # Ids, counts and nulls as plain arrays: 17 bytes a document, as in the file.
        self.ids, self.counts, self.null = array("q"), array("q"), bytearray()
        self.size = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(doc_id or 0)
        self.counts.append(len(ids))
        self.null.append(doc_id is None)
        self.buffer += ids.astype(f"<u{self.width}").tobytes()
        while len(self.buffer) >= self.frame_bytes:
            self._close(self.frame_bytes)

    def _close(self, size: int) -> None:
        data = bytes(self.buffer[:size])
        del self.buffer[:size]
        frame = self.packer.compress(data)
        self._write(frame)
        self.frames.append((len(frame), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def _skippable(self, magic: int, content: bytes) -> None:
        self._write(struct.pack("<II", magic, len(content)) + content)

    def finish(self) -> None:
        if self.buffer:
            self._close(len(self.buffer))
        ids, counts = (np.array(x, "<i8").tobytes() for x in (self.ids, self.counts))
        index = self.packer.compress(ids + counts + bytes(self.null))
        self._skippable(INDEX_MAGIC, struct.pack("<BQ", self.width, len(self.ids)) + index)
        table = b"".join(struct.pack("<III", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), DESCRIPTOR_CHECKSUMS, SEEKABLE_MAGIC)
        self._skippable(SKIPPABLE_MAGIC, table + footer)


class ShardReader:
    """Reads the seek table and the index from the end of a shard, then only the frames asked for."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - 9)
        count, descriptor, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE_MAGIC or not descriptor & DESCRIPTOR_CHECKSUMS:
            raise ValueError("no seek table with checksums at the end")
        table_at = size - 9 - 12 * count
        source.seek(table_at)
        table = np.frombuffer(source.read(12 * count), "<u4").reshape(count, 3).astype(np.int64)
        self.compressed, self.plain, self.sums = table.T if count else np.zeros((3, 0), np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.compressed)])
        self.plain_at = np.concatenate([[0], np.cumsum(self.plain)])
        source.seek(int(self.at[-1]))
        magic, length = struct.unpack("<II", source.read(8))
        if magic != INDEX_MAGIC:
            raise ValueError("no document index after the frames")
        content = source.read(length)
        self.width, n = struct.unpack("<BQ", content[:9])
        index = zstandard.ZstdDecompressor().decompress(content[9:], max_output_size=17 * n or 1)
        self.ids = np.frombuffer(index, "<i8", n)
        self.counts = np.frombuffer(index, "<i8", n, 8 * n)
        self.null = np.frombuffer(index, "u1", n, 16 * n)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        self.unpacker = zstandard.ZstdDecompressor()
        self.frames_read = 0

    def frame(self, k: int) -> bytes:
        """The plain bytes of frame ``k``; a wrong checksum raises."""
        self.source.seek(int(self.at[k]))
        data = self.unpacker.decompress(self.source.read(int(self.compressed[k])), max_output_size=int(self.plain[k]))
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"frame {k}: wrong checksum")
        self.frames_read += 1
        return data

    def tokens(self, rows: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
        """ids of the documents at these ascending index positions; each frame is decompressed once."""
        held: dict[int, bytes] = {}
        for row in rows:
            a, b = int(self.starts[row]) * self.width, int(self.starts[row + 1]) * self.width
            first = int(np.searchsorted(self.plain_at, a, side="right")) - 1
            last = int(np.searchsorted(self.plain_at, b, side="left"))
            held = {k: v for k, v in held.items() if k >= first}
            data = b""
            if b > a:
                for k in range(first, last):
                    if k not in held:
                        held[k] = self.frame(k)
                data = b"".join(held[k] for k in range(first, last))
                data = data[a - int(self.plain_at[first]) :][: b - a]
            yield row, np.frombuffer(data, f"<u{self.width}")

    def find(self, doc_id: int) -> list[int]:
        """Index positions of a document id."""
        return np.flatnonzero((self.ids == doc_id) & (self.null == 0)).tolist()


def write_shards(
    docs: DataFrame,
    folder: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    end_id: int = END_ID,
    width: int = 2,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Encode all texts and write them in ascending id order, one shard per range; returns the manifest.

    There are as many ranges as the texts hold times ``shard_bytes``, whatever the session's number of shuffle
    partitions. Rows of one id, or of none, can fill several ranges: they are dealt by the beginnings of their texts.
    Null and empty texts give ``end_id`` alone. Rows with equal ids stand in text order, rows with a
    null id come first. The range partitions make the order of shards the order of ids. A file gets a
    name of its own in every attempt and counts only by its row in the manifest, so a lost or repeated
    task leaves nothing wrong behind. ``width`` 2 holds ids below 65536; larger ids raise.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"))
    size = rows.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    ordered = rows.repartitionByRange(shards, "__id", F.substring("__text", 1, DEALT_CHARS)).sortWithinPartitions("__id", "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        shard = TaskContext.get().partitionId()
        fs, path = filesystem(f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.zst")
        out = writer = None
        total = 0
        for batch in slices_of(batches, "__text"):
            if writer is None:
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                out = fs.open_output_stream(path, compression=None)
                writer = ShardWriter(out, width)
            for key, ids in zip(batch.column(0).to_pylist(), encode.encode(batch.column(1))):
                ids = with_end(ids, end_id)
                if width == 2 and int(ids.max()) >> 16:
                    raise ValueError("an id of 65536 or more needs width 4")
                total += len(ids)
                writer.add(key, ids)
        if writer is not None:
            writer.finish()
            out.close()
            yield pa.RecordBatch.from_pydict(
                {"shard": [shard], "path": [path], "n_docs": [len(writer.ids)], "n_tokens": [total], "n_bytes": [writer.size]}
            )

    return materialise(ordered.mapInArrow(lean(run), MANIFEST), "token-manifest")


def read_shards(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """Per document of the shards, from the files alone: doc_id, start, n_tokens, ids_crc32.

    ``start`` adds the tokens of all earlier shards, from the manifest, which has one row per file.
    """
    from pyspark.sql import Window

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("shard", "path", "n_bytes", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(row["path"]) as source:
                    shard = ShardReader(source, row["n_bytes"])
                    sums = [
                        zlib.crc32(np.ascontiguousarray(ids, "<u4").view(np.uint8))
                        for _, ids in shard.tokens(range(len(shard.ids)))
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(shard.ids, pa.int64(), mask=shard.null.astype(bool)),
                            pa.array(shard.starts[:-1] + row["base"], pa.int64()),
                            pa.array(shard.counts, pa.int64()),
                            pa.array(sums, pa.int64()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    shards = files.repartition(max(1, min(manifest.count(), 4 * spark.sparkContext.defaultParallelism)), "shard")
    return shards.mapInArrow(lean(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def fetch(spark: SparkSession, manifest: DataFrame, folder: str, wanted: list[int]) -> DataFrame:
    """ids of the requested documents; of each shard only their frames are decompressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(row["path"]) as source:
                    shard = ShardReader(source, row["n_bytes"])
                    rows = sorted({r for w in wanted for r in shard.find(w)})
                    for r, ids in shard.tokens(rows):
                        yield pa.RecordBatch.from_pydict({"doc_id": [int(shard.ids[r])], "ids": [ids.astype(np.int32).tolist()]}, pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]))

    return manifest.select("path", "n_bytes").mapInArrow(lean(run), "doc_id long, ids array<int>")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents as token shards in the shared folder and read the files back."""
    from ._common import table

    folder = scratch(spark, "tokens")
    manifest = write_shards(table(spark, sf_dir, "documents"), folder)
    return read_shards(spark, manifest, folder)
