"""WARC archives: a writer with revisit records, and a reader that salvages what follows damage.

The reader goes from member to member (gzip) or from version line to version line (plain). Where a check
fails - the gzip checksum, the record's syntax, its lengths or its digests - it searches on for the next
place at which a whole record passes all checks, takes the records from there on, and reports the bytes
between as a quarantined gap. A damaged member is unpacked as far as it goes and searched likewise, so one bad
record, a wrong checksum or a cut-off end costs no other record of the member.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import filesystem, lean, materialise, scratch, slices

GZIP_MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
END = b"\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Compressed bytes after which a writer starts its next archive.
ARCHIVE_BYTES = 256 << 20
_URN = "urn:x-page:"

RECORDS = (
    "kind string, path string, offset long, length long, reason string, record_type string, record_id string, "
    "target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
)
MANIFEST = "path string, n_bytes long, n_records long"


def sha1_base32(data: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(
    kind: str,
    record_id: str,
    uri: str | None,
    payload: bytes,
    digest: str,
    refers_to: str | None = None,
    date: str = "1970-01-01T00:00:00Z",
) -> bytes:
    """One record: HTTP headers with the payload's length, and for a response the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if kind == "response" else http
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if uri is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri))
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + END + block + END


class Damaged(Exception):
    """A check failed; the text says which."""


@dataclass
class Record:
    """A record that passed all checks, with its place in the archive."""

    offset: int
    length: int
    headers: dict[str, str]
    block: bytes
    payload: bytes = b""
    payload_bytes: int = 0
    reason: str = ""

    @property
    def kind(self) -> str:
        return self.headers.get("warc-type", "")


@dataclass
class Gap:
    """Bytes in which no record passed the checks, and the check that failed first. A gap inside a member has no length
    in the archive; its reason says which plain bytes it takes."""

    offset: int
    length: int
    reason: str


def _headers(data: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    last = None
    for line in data.split(b"\r\n"):
        if line[:1] in (b" ", b"\t") and last:
            out[last] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, colon, value = line.partition(b":")
        if not colon or not re.fullmatch(rb"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name):
            raise Damaged("malformed header")
        last = name.decode().lower()
        out[last] = value.strip().decode("utf-8", "replace")
    return out


def _checked(offset: int, length: int, headers: dict[str, str], block: bytes) -> Record:
    """Digests of block and payload as stated; lengths as the HTTP headers state them."""
    if missing := [h for h in ("warc-type", "warc-record-id", "warc-date") if not headers.get(h, "").strip("<>")]:
        raise Damaged(f"no {missing[0]}")
    record = Record(offset, length, headers, block)
    if (stated := headers.get("warc-block-digest", "")).startswith("sha1:") and stated[5:] != sha1_base32(block):
        raise Damaged("wrong block digest")
    if headers.get("content-type", "").startswith("application/http"):
        head, end, body = block.partition(END)
        if not end or not head.startswith(b"HTTP/"):
            raise Damaged("malformed HTTP block")
        record.payload = body
        stated = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", head)
        record.payload_bytes = int(stated[1]) if stated and record.kind == "revisit" else len(body)
        if record.kind == "response" and stated and int(stated[1]) != len(body):
            raise Damaged("payload length differs from the HTTP header")
    else:
        record.payload, record.payload_bytes = block, len(block)
    stated = headers.get("warc-payload-digest", "")
    if record.kind == "response" and stated.startswith("sha1:") and stated[5:] != sha1_base32(record.payload):
        raise Damaged("wrong payload digest")
    return record


class Archive:
    """Records and gaps of one archive, read forward from a seekable source."""

    CHUNK = 1 << 18
    #: Compressed bytes that are unpacked at a time in a damaged member. The piece that fails is unpacked again in smaller
    #: ones, down to single bytes, so nothing before the damage is lost.
    PIECE = 4096

    def __init__(self, source, size: int):
        self.source, self.size = source, size

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(min(n, self.size - at)) if at < self.size else b""

    def _member(self, at: int) -> tuple[bytes, int]:
        """Plain bytes of the gzip member at ``at`` and where it ends; its checksum must hold."""
        unpack, parts, p = zlib.decompressobj(31), [], at
        first = True
        while not unpack.eof:
            chunk = self._read(p, self.CHUNK)
            if not chunk:
                raise Damaged("member cut off")
            try:
                parts.append(unpack.decompress(chunk))
            except zlib.error as e:
                raise Damaged(f"gzip: {str(e)[:60]}") from None
            p += len(chunk)
            if first and (head := b"".join(parts)):
                first = False
                if not head.startswith(VERSION[: len(head)]):
                    raise Damaged("member holds no record")
        return b"".join(parts), p - len(unpack.unused_data)

    def _one(self, data: bytes, p: int, at: int, length: int) -> tuple[Record, int]:
        """The record at ``p`` of a member's plain bytes, and where the next one begins."""
        if not data.startswith(VERSION, p):
            raise Damaged("no version line")
        head_end = data.find(END, p)
        if head_end < 0:
            raise Damaged("headers cut off")
        headers = _headers(data[data.index(b"\r\n", p) + 2 : head_end])
        if not re.fullmatch(r"\d+", headers.get("content-length", "")):
            raise Damaged("no Content-Length")
        a, b = head_end + 4, head_end + 4 + int(headers["content-length"])
        if data[b : b + 4] != END:
            raise Damaged("record does not end where its length says")
        return _checked(at, length, headers, data[a:b]), b + 4

    def _split(self, data: bytes, at: int, end: int) -> list[Record]:
        """All records of a member."""
        out, p = [], 0
        while p < len(data):
            record, p = self._one(data, p, at, end - at)
            out.append(record)
        if not out:
            raise Damaged("empty member")
        return out

    def _unpack(self, at: int, most: int = 0) -> tuple[bytes, int]:
        """The first ``most`` plain bytes of a damaged member (0: all before the damage) and where they end in the archive."""
        unpack, parts, p, n, size = zlib.decompressobj(31), [], at, self.PIECE, 0
        head = b""
        while not unpack.eof and not 0 < most <= size and (chunk := self._read(p, n)):
            before = unpack.copy()
            try:
                part = unpack.decompress(chunk, most and most - size)
            except zlib.error:
                if n == 1:
                    break
                unpack, n = before, n // 8 or 1
                continue
            p += len(chunk) - len(unpack.unconsumed_tail) - len(unpack.unused_data)
            parts.append(part)
            size += len(part)
            if len(head) < len(VERSION):
                head += part[: len(VERSION) - len(head)]
                if not VERSION.startswith(head):
                    return b"", at
        return b"".join(parts), p

    def _salvage(self, at: int) -> tuple[list[Record | Gap], int]:
        """What a damaged member still holds: its records, of no length in the archive, and the gaps between them; and
        where the last record ends, since a stored member shows its records to a search from an earlier place again."""
        data, out, p, last = self._unpack(at)[0], [], 0, 0
        while p < len(data):
            try:
                record, p = self._one(data, p, at, 0)
                out.append(record)
                last = p
            except Damaged as e:
                q, found = p, None
                while found is None and (q := data.find(VERSION, q + 1)) >= 0:
                    try:
                        found = self._one(data, q, at, 0)
                    except Damaged:
                        continue
                end = q if found else len(data)
                out.append(Gap(at, 0, f"{e}; plain bytes {p} to {end} of the member"))
                p = end
        return (out, max(at + 1, self._unpack(at, last)[1])) if last else ([], at + 1)

    def _plain(self, at: int) -> Record:
        """The record whose version line is at ``at``."""
        head = b""
        while END not in head:
            if head and not (head + VERSION).startswith(VERSION) or len(head) > 1 << 20:
                raise Damaged("no version line" if len(head) <= 1 << 20 else "headers too long")
            chunk = self._read(at + len(head), 4096)
            if not chunk:
                raise Damaged("headers cut off" if head.startswith(VERSION) else "no version line")
            head += chunk
        if not head.startswith(VERSION):
            raise Damaged("no version line")
        end = head.index(END)
        headers = _headers(head[head.index(b"\r\n") + 2 : end])
        if not re.fullmatch(r"\d+", headers.get("content-length", "")):
            raise Damaged("no Content-Length")
        size = int(headers["content-length"])
        if at + end + 4 + size + 4 > self.size:
            raise Damaged("record cut off")
        tail = self._read(at + end + 4, size + 4)
        if tail[size:] != END:
            raise Damaged("record does not end where its length says")
        return _checked(at, end + 8 + size, headers, tail[:size])

    def _at(self, at: int) -> tuple[list[Record], int]:
        start = self._read(at, 8)
        if start.startswith(GZIP_MAGIC):
            data, end = self._member(at)
            return self._split(data, at, end), end
        if start.startswith(VERSION):
            record = self._plain(at)
            return [record], at + record.length
        raise Damaged("neither a gzip member nor a version line")

    def _candidates(self, at: int) -> Iterator[int]:
        """Places from ``at`` on where a gzip member or a version line may start."""
        mark = re.compile(re.escape(GZIP_MAGIC) + b"|" + re.escape(VERSION))
        overlap = len(VERSION) - 1
        while at < self.size:
            chunk = self._read(at, self.CHUNK + overlap)
            for m in mark.finditer(chunk):
                if m.start() < self.CHUNK:
                    yield at + m.start()
            at += self.CHUNK

    def _try(self, at: int) -> tuple[list[Record | Gap], int | None, str, int]:
        """Records at a place and where they end; or what can be salvaged there, no end, and why. Then where to search on."""
        try:
            items, end = self._at(at)
            return items, end, "", end
        except Damaged as e:
            packed = self._read(at, len(GZIP_MAGIC)) == GZIP_MAGIC
            items, after = self._salvage(at) if packed else ([], at + 1)
            return items, None, str(e), after

    def __iter__(self) -> Iterator[Record | Gap]:
        at, found = 0, None
        while at < self.size:
            items, end, reason, after = found or self._try(at)
            found = None
            yield from items
            if end is not None:
                at = end
                continue
            for q in self._candidates(after):
                found = self._try(q)
                if found[0]:
                    break
            else:
                yield Gap(at, self.size - at, reason)
                return
            yield Gap(at, q - at, reason)
            at = q


def write_archives(
    pages: DataFrame,
    folder: str,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_revisit_bytes: int = 0,
    archive_bytes: int = ARCHIVE_BYTES,
    compress: bool = True,
) -> DataFrame:
    """One record per row; returns the manifest of the archives.

    Of rows with equal payloads of at least ``min_revisit_bytes`` the one with the smallest id is a
    response and the others are revisits that name it. Null html is the empty payload; a null url is
    left out; rows with a null id are responses, as are all rows that share the smallest id of their
    payload. Files have a name of their own in every attempt and count by the manifest only.

    Payloads move once at most: the table of repeated payloads holds a digest and an id each, Spark
    broadcasts it below its size threshold, and otherwise joins by shuffling, splitting a hot payload.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("__id"),
        F.col(url_col).cast("string").alias("__url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("__html"),
    ).withColumn("__digest", F.unhex(F.sha1("__html")))
    repeated = materialise(
        rows.where(F.col("__id").isNotNull() & (F.octet_length("__html") >= min_revisit_bytes))
        .groupBy("__digest")
        .agg(F.min("__id").alias("__first"), F.max("__id").alias("__last"))
        .where("__first < __last")
        .select(F.col("__digest").alias("__key"), "__first"),
        "payloads",
    )
    marked = rows.join(repeated, F.col("__digest") == F.col("__key"), "left").select(
        "__id", "__url", "__html", "__digest", F.when(F.col("__first") < F.col("__id"), F.col("__first")).alias("__of")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        done, out = [], None
        size = count = 0

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                done.append((path, size, count))
                out = None

        for batch in slices(batches, 256):
            for key, url, html, digest, of in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    path = f"{base}/pages-{uuid.uuid4().hex}.warc" + ".gz" * compress
                    out, size, count = fs.open_output_stream(path, compression=None), 0, 0
                data = record_bytes(
                    "response" if of is None else "revisit",
                    _URN + ("null" if key is None else str(key)),
                    url,
                    html.encode(),
                    base64.b32encode(digest).decode(),
                    None if of is None else f"{_URN}{of}",
                )
                if compress:
                    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                    data = pack.compress(data) + pack.flush()
                out.write(data)
                size += len(data)
                count += 1
                if size >= archive_bytes:
                    close()
        close()
        names, sizes, counts = zip(*done) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())],
            names=["path", "n_bytes", "n_records"],
        )

    return materialise(marked.mapInArrow(lean(run), MANIFEST), "warc-manifest")


def read_archives(files: DataFrame, folder: str, *, payloads: bool = True) -> DataFrame:
    """Records and gaps of the archives listed in ``files`` (path, n_bytes).

    ``kind`` is record or gap; a gap has offset, length and reason. ``payload`` is left null
    unless asked for. A file that is missing or empty gives no rows if its size is 0, else fails.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(folder)
        schema = pa.schema(
            [("kind", pa.string()), ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
            + [(n, pa.string()) for n in ("reason", "record_type", "record_id", "target_uri", "refers_to", "payload_digest")]
            + [("payload_bytes", pa.int64()), ("payload", pa.binary())]
        )
        bare = lambda h, n: h[n].strip("<>") if n in h else None
        for batch in batches:
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, held = [], 0
                with fs.open_input_file(path) as source:
                    for x in Archive(source, size):
                        if isinstance(x, Gap):
                            rows.append(("gap", path, x.offset, x.length, x.reason, *[None] * 7))
                        else:
                            h = x.headers
                            digest = h.get("warc-payload-digest", "sha1:")[5:] if x.kind == "revisit" else sha1_base32(x.payload)
                            rows.append(
                                ("record", path, x.offset, x.length, None, x.kind, bare(h, "warc-record-id"), h.get("warc-target-uri"),
                                 bare(h, "warc-refers-to"), digest, x.payload_bytes, x.payload if payloads else None)
                            )
                            held += len(x.payload) * payloads
                        if len(rows) >= 1000 or held > 16 << 20:
                            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)

    spread = files.select("path", "n_bytes").repartition(max(1, min(files.count(), 4 * files.sparkSession.sparkContext.defaultParallelism)), "path")
    return spread.mapInArrow(lean(run), RECORDS)


def gap_log(records: DataFrame) -> DataFrame:
    """The quarantined byte ranges."""
    return records.where("kind = 'gap'").select("path", "offset", "length", "reason")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages as WARC records and read the archives back."""
    from ._common import table

    folder = scratch(spark, "warc")
    manifest = write_archives(table(spark, sf_dir, "pages"), folder, min_revisit_bytes=0)
    number = lambda c: F.expr(f"try_cast(substring({c}, {len(_URN) + 1}) AS BIGINT)")
    return (
        read_archives(manifest, folder, payloads=False)
        .where("kind = 'record'")
        .select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
    )
