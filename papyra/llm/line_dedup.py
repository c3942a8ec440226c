"""Line dedup by content-defined chunks of lines.

A text is cut into lines, and lines into their clauses, so that a passage inside a long line is found as well.
A window of three rolls over the hashes of the lines, and a chunk ends at a line whose hash is the least of its
window. That depends on these lines only, so chunks are the same again right after any difference further up,
and two ends are never neighbours: inside a text a chunk has two lines or more, three on average. A chunk of two lines or more that
occurs twice anywhere is compared byte by byte, and all occurrences but the first, by id and position, go.

Only first occurrences within a task carry their bytes through the shuffle; later ones are compared there and
then. A chunk that a third of all documents share so reaches its reducer once per task, not once per document.

Chunks leave out what a shared passage has next to differing text, and short passages without a whole chunk. So
op3 and :func:`clean` extend them (:func:`repeated_runs`). One polynomial rolls over the hashes of the lines. Where it
is least over ``ROLLED`` lines a chunk ends; and beside the chunks stand windows, which begin and end at every line: the
fewest lines from a line on, and up to a line, that make ``LEAST_LINES`` and ``LEAST_BYTES``. Between them they cover a
shared run of lines to both its ends. Chunks and windows alike go through the shuffle as 64 bits of their digests,
packed by ranges of these. What has its digest in common with something earlier is joined to runs, the bytes of the
earlier run are fetched, and only what is the same byte by byte goes. Where a run is not, its chunks and windows are
compared one by one; those of other bytes than the first with their digest go on with their bytes, and are compared with
each other. So a digest only says what is compared, never what goes or stays.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import lean, raw_utf8, slices

#: Lines in a chunk, and its bytes, at least.
LEAST_LINES = 2
LEAST_BYTES = 64
#: Bytes of chunk text that a task remembers before it hands its first occurrences on.
HELD_BYTES = 48 << 20

#: Longer lines are cut after words whose hash says so, every WORDS_A_LINE words on average.
LONG_LINE = 200
WORDS_A_LINE = 8
#: Lines over which the polynomial rolls that ends chunks.
ROLLED = 2
#: Chunks and windows that a task sorts at a time, and ranges of their digests.
HELD_WINDOWS = 400_000
RANGE_BITS = 11
#: Bits for the length of a span in a number that also holds its start.
SPAN_BITS = 31

_WORD = re.compile(rb"\S+\s*")
_LINE_END = re.compile(rb"\n+|[.!?,;:]+[ \t\n]+")


def line_ends(text: bytes) -> list[int]:
    """Where lines end, separators included; the last end is the end of the text."""
    ends = [m.end() for m in _LINE_END.finditer(text)]
    if text and (not ends or ends[-1] < len(text)):
        ends.append(len(text))
    return ends


def chunk(texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
    """Per text its chunks as (start, end, number of lines)."""
    all_ends = [line_ends(t) for t in texts]
    digest = xxhash.xxh3_64_intdigest
    hashes = np.zeros(sum(map(len, all_ends)) + 1, np.uint64)
    first = np.zeros(len(hashes), bool)
    at = 0
    for text, ends in zip(texts, all_ends):
        first[at] = True
        hashes[at : at + len(ends)] = [digest(text[a:b].rstrip()) for a, b in zip([0, *ends], ends)]
        at += len(ends)
    last = np.zeros(len(hashes), bool)
    at = 0
    for ends in all_ends:
        at += len(ends)
        last[at - 1] |= bool(ends)
    before, after = np.roll(hashes, 1), np.roll(hashes, -1)
    before[first], after[last] = 0, 0
    stops = (hashes < before) & (hashes < after)
    out, at = [], 0
    for ends in all_ends:
        own: list[tuple[int, int, int]] = []
        begin = lines = 0
        for end, stop in zip(ends, stops[at : at + len(ends)].tolist()):
            lines += 1
            if stop:
                own.append((begin, end, lines))
                begin, lines = end, 0
        if lines:
            own.append((begin, ends[-1], lines))
        at += len(ends)
        out.append(own)
    return out


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Byte spans (__id, __row, start, end) of all chunk occurrences but the first.

    ``__row`` is a hash of id and text. Rows equal in both count as one document and lose nothing to each other.
    First is the smallest id, null before all others, then the smaller ``__row``, then the earlier place.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"))
    rows = rows.select("__id", F.xxhash64("__id", "__text").alias("__row"), "__text")
    spans = "__id long, __row long, start long, end long"
    names = ["__id", "__row", "start", "end"]
    order = lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])

    def batch_of(found: list[tuple], firsts: list[tuple]) -> pa.RecordBatch:
        both = [(*x, None, None) for x in found] + firsts
        columns = list(zip(*both)) if both else [()] * 6
        kinds = [pa.int64()] * 4 + [pa.binary()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[*names, "key", "bytes"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple] = {}
        size = 0
        digest = xxhash.xxh3_128_digest
        for batch in slices(batches, 512):
            texts = raw_utf8(batch.column(2))
            dups: list[tuple] = []
            odd: list[tuple] = []
            for key, row, text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, chunk(texts)):
                for a, b, lines in own:
                    if lines < LEAST_LINES or b - a < LEAST_BYTES:
                        continue
                    data = text[a:b].rstrip()
                    h = digest(data)
                    known = held.get(h)
                    if known is None:
                        held[h] = (key, row, a, b, h, data)
                        size += len(data)
                    elif known[5] != data:
                        odd.append((key, row, a, b, h, data))
                    else:
                        this = (key, row, a, b, h, data)
                        if this[:3] == known[:3]:
                            continue
                        if order(this) < order(known):
                            held[h], this = this, known
                        dups.append(this[:4])
            if dups or odd:
                yield batch_of(dups, odd)
            if size > HELD_BYTES:
                yield from flush(held)
                held, size = {}, 0
        yield from flush(held)

    def flush(held: dict[bytes, tuple]) -> Iterator[pa.RecordBatch]:
        firsts = list(held.values())
        for at in range(0, len(firsts), 20_000):
            yield batch_of([], firsts[at : at + 20_000])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, []
        for batch in slices(batches, 8192):
            out: list[tuple] = []
            for i, row, a, b, h, data in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if h is None:
                    out.append((i, row, a, b))
                    continue
                if h != last:
                    last, kept = h, []
                for other in kept:
                    if other[3] == data:
                        if other[:3] != (i, row, a):
                            out.append((i, row, a, b))
                        break
                else:
                    kept.append((i, row, a, data))
            columns = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    found = rows.mapInArrow(lean(emit), spans + ", key binary, bytes binary")
    deal = F.when(F.col("key").isNull(), F.xxhash64("__row")).otherwise(F.xxhash64("key"))
    dealt = found.withColumn("deal", deal).repartition("deal").sortWithinPartitions("key", "__id", "__row", "start")
    return dealt.select(*names, "key", "bytes").mapInArrow(lean(compare), spans)


def short_line_ends(text: bytes) -> list[int]:
    """Where lines end if long ones are cut at words; a cut depends on the word before it only."""
    out, begin = [], 0
    for end in line_ends(text):
        if end - begin > LONG_LINE:
            for m in _WORD.finditer(text, begin, end):
                if m.end() < end and xxhash.xxh3_64_intdigest(m[0].rstrip()) % WORDS_A_LINE == 0:
                    out.append(m.end())
        out.append(end)
        begin = end
    return out


#: An odd base of the polynomials over line hashes, and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def windows(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """All chunks and windows: index of the text, start, end, and the digest; by text, then start.

    Lines count without white space at their ends. The lines of all texts are one sequence, in which no window and no
    chunk reaches over the end of its text.
    """
    lines: list[bytes] = []
    edges: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        stops = short_line_ends(text)
        counts[k] = len(stops)
        begin = 0
        for end in stops:
            lines.append(text[begin:end].rstrip())
            begin = end
        edges += stops
    n = len(lines)
    if not n:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    text_of = np.repeat(np.arange(len(texts)), counts)
    last = np.cumsum(counts)[text_of]
    first = last - counts[text_of]
    at = np.arange(n)
    ends = np.array(edges, np.int64)
    starts = np.where(at == first, 0, np.concatenate([[0], ends[:-1]]))
    lengths = np.concatenate([[0], np.cumsum(np.fromiter(map(len, lines), np.int64, n))])
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, lines), np.uint64, n)
    powers, back = _power_tables(n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers[:n])])
    rolled = lambda a, b: (sums[b] - sums[a]) * back[a]
    to = np.maximum(np.searchsorted(lengths, lengths[:-1] + LEAST_BYTES), at + LEAST_LINES)
    fro = np.minimum(np.searchsorted(lengths, lengths[1:] - LEAST_BYTES, side="right") - 1, at + 1 - LEAST_LINES)
    forward, backward = to <= last, fro >= first
    begin, end = _chunk_lines(rolled, at, first, last)
    whole = (end - begin >= LEAST_LINES) & (lengths[end] - lengths[begin] >= LEAST_BYTES)
    a = np.concatenate([at[forward], fro[backward], begin[whole]])
    b = np.concatenate([to[forward], at[backward] + 1, end[whole]])
    pairs = np.unique(a * (n + 1) + b)
    a, b = pairs // (n + 1), pairs % (n + 1)
    return text_of[a], starts[a], ends[b - 1], rolled(a, b).view(np.int64)


def _chunk_lines(rolled, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First line of each chunk and the line after it: a chunk ends at the end of its text, and at a line where the
    hash that rolls over it and the lines before is smaller than at both its neighbours."""
    most = np.uint64((1 << 64) - 1)
    full = at + 1 - ROLLED >= first
    h = np.where(full, rolled(np.maximum(at + 1 - ROLLED, 0), at + 1), most)
    h ^= h >> np.uint64(32)  # the low bits of the polynomial count as much as the high ones
    h *= np.uint64(_BASE)
    before, after = np.roll(h, 1), np.roll(h, -1)
    inner = full & (at > first + ROLLED - 1) & (at < last - 1)
    stop = inner & (h < before) & (h < after) | (at == last - 1)
    end = at[stop] + 1
    return np.maximum(np.concatenate([[0], end[:-1]]), first[end - 1]), end


_tables: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse up to ``n``, kept by the worker as far as a batch of usual texts needs them."""
    if len(_tables[0]) > n:
        return _tables
    size = 1 << max(15, int(n).bit_length())
    made = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, x, np.uint64)])) for x in (_BASE, _INVERSE)]
    if size <= 1 << 17:
        _tables[:] = made
    return made


def _inner(ends: list[int], start: int, end: int) -> list[int]:
    return ends[bisect_right(ends, start) : bisect_left(ends, end)]


def _lines(text: bytes, ends: list[int], start: int, end: int) -> list[bytes]:
    """What is compared: the bytes of the lines of a span, white space at their ends left out."""
    edges = [start, *_inner(ends, start, end), end]
    return [text[a:b].rstrip() for a, b in zip(edges, edges[1:])]


_ENTRY = (("steps", "<u8"), ("ids", "<i8"), ("row", "<i8"), ("start", "<u4"), ("size", "<u4"))
_ENTRY_BYTES = sum(np.dtype(kind).itemsize for _, kind in _ENTRY)


def _pack(hi: np.ndarray, known: np.ndarray, *columns: np.ndarray) -> bytes:
    """Entries (digest, whether the id is known, id, row, start, size) in order of their digests as bytes, the same
    place of all entries together, compressed."""
    *others, size = columns
    columns = (np.diff(hi, prepend=hi[:1]), *others, size | (known ^ 1) << SPAN_BITS)
    planes = np.concatenate([x.astype(kind).view(np.uint8).reshape(len(hi), -1) for x, (_, kind) in zip(columns, _ENTRY)], axis=1)
    return len(hi).to_bytes(8, "little") + int(hi[0]).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(planes.T).tobytes(), "zstd", asbytes=True)


def _unpack(data: bytes) -> list[np.ndarray]:
    n, least = int.from_bytes(data[:8], "little"), int.from_bytes(data[8:16], "little")
    planes = np.frombuffer(pa.decompress(data[16:], n * _ENTRY_BYTES, "zstd", asbytes=True), np.uint8).reshape(_ENTRY_BYTES, n)
    out, at = [], 0
    for _, kind in _ENTRY:
        to = at + np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(planes[at:to].T).view(kind).reshape(n))
        at = to
    steps, ids, row, start, size = out
    size = size.astype(np.int64)
    return [np.cumsum(steps) + np.uint64(least), size >> SPAN_BITS ^ 1, ids, row, start.astype(np.int64), size & (1 << SPAN_BITS) - 1]


def repeated_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Byte spans (__id, __row, start, end) of all chunks and windows but the first of each; they overlap.

    Order and equal rows as in :func:`repeated_spans`. Of a window that overlaps the first one in the same text,
    the part behind that one goes.

    A task compares what it meets itself, and hands on its first occurrences without bytes. Those whose digest was met
    before them elsewhere meet the bytes that stand there, or, within one text, the place, and are compared. Of what has
    other bytes than the first with its digest, all but the first of the same bytes go.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"))
    rows = rows.select("__id", F.xxhash64("__id", "__text").alias("__row"), "__text")
    low = (1 << SPAN_BITS) - 1

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        keys: list[tuple[np.ndarray, ...]] = []
        texts: list[bytes] = []
        size = 0
        for batch in slices(batches, 512):
            own = raw_utf8(batch.column(2))
            of, start, end, hi = windows(own)
            ids = batch.column(0)
            known = ids.is_valid().to_numpy(zero_copy_only=False).astype(np.int64)
            held.append((hi, of + len(texts), start, end))
            keys.append((known, ids.fill_null(0).to_numpy(), batch.column(1).to_numpy()))
            texts += own
            size += len(of)
            if size > HELD_WINDOWS:
                yield from flush(held, keys, texts)
                held, keys, texts, size = [], [], [], 0
        if size:
            yield from flush(held, keys, texts)

    def flush(held: list[tuple[np.ndarray, ...]], keys: list[tuple[np.ndarray, ...]], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        hi, of, start, end = (np.concatenate(x) for x in zip(*held))
        known, ids, row = (np.concatenate(x) for x in zip(*keys))
        # Texts in order, so that a stable sort by digest is all that the windows, which are in order by text, need.
        rank = np.empty(len(known), np.int64)
        in_order = np.lexsort((row, ids, known))
        other = [x[in_order][1:] != x[in_order][:-1] for x in (known, ids, row)]
        rank[in_order] = np.cumsum(np.concatenate([[0], other[0] | other[1] | other[2]]))
        order = np.argsort(rank[of], kind="stable")
        order = order[np.argsort(hi[order].view(np.uint64), kind="stable")]
        hi, of, start, end = hi[order].view(np.uint64), of[order], start[order], end[order]
        new = np.ones(len(hi), bool)
        new[1:] = hi[1:] != hi[:-1]
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        same = rank[of] == rank[of[first]]
        later = np.flatnonzero(~new & ~(same & (start == start[first]) & (end == end[first])))
        # Byte by byte; what only shares a digest is handed on like a first occurrence.
        equal = np.zeros(len(hi), bool)
        met, data = -1, b""
        ends: dict[int, list[int]] = {}

        def lines(t: int, a: int, b: int) -> list[bytes]:
            if t not in ends:
                ends[t] = short_line_ends(texts[t])
            return _lines(texts[t], ends[t], a, b)

        for k, f, t, a, b in zip(later.tolist(), first[later].tolist(), of[later].tolist(), start[later].tolist(), end[later].tolist()):
            if f != met:
                met, place = f, (int(of[f]), int(start[f]), int(end[f]))
                data = texts[place[0]][place[1] : place[2]].rstrip()
            own = texts[t][a:b].rstrip()
            equal[k] = own == data or own.split() == data.split() and lines(t, a, b) == lines(*place)
        keyed = new.copy()
        keyed[later] = ~equal[later]
        entries = [hi[keyed], *(x[of[keyed]] for x in (known, ids, row)), start[keyed], (end - start)[keyed]]
        hi = entries[0]
        edges = np.searchsorted(hi >> np.uint64(64 - RANGE_BITS), np.arange((1 << RANGE_BITS) + 1, dtype=np.uint64)).tolist()
        packed = [(k, _pack(*(x[a:b] for x in entries))) for k, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
        for k in range(0, len(packed), 512):
            part = packed[k : k + 512]
            yield batch_of(part, *(pa.nulls(len(part), pa.int64()) for _ in range(3)))
        start = np.where(same, np.maximum(start, end[first]), start)
        gone = np.flatnonzero(equal & (start < end))
        of, start, end = of[gone], start[gone], end[gone]
        order = np.lexsort((start, of))
        of, start, end = of[order], start[order], end[order]
        if len(of):  # overlapping spans of a text are one
            reach = np.maximum.accumulate((of << 40) + end)
            opens = np.concatenate([[True], (of[1:] != of[:-1]) | ((of[1:] << 40) + start[1:] >= reach[:-1])])
            closes = reach[np.concatenate([np.flatnonzero(opens)[1:] - 1, [len(of) - 1]])] & ((1 << 40) - 1)
            of, start = of[opens], start[opens]
            span = (start << SPAN_BITS) + closes - start
            for k in range(0, len(of), 50_000):
                t = of[k : k + 50_000]
                yield batch_of([(None, None)] * len(t), pa.array(ids[t], mask=known[t] == 0), pa.array(row[t]), pa.array(span[k : k + 50_000]))

    def batch_of(packed: list[tuple], *columns: pa.Array) -> pa.RecordBatch:
        ranges, data = zip(*packed)
        return pa.RecordBatch.from_arrays([pa.array(ranges, pa.int64()), pa.array(data, pa.binary()), *columns], names=["range", "data", "__id", "__row", "span"])

    names = ["__id", "__row", "span", "of", "like"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What has its digest in common with something before it, and that; spans that were compared pass."""
        last, held = None, []
        for batch in batches:
            compared = batch.filter(batch.column(0).is_null())
            if compared.num_rows:
                yield pa.RecordBatch.from_arrays([*compared.columns[2:], *(pa.nulls(compared.num_rows, pa.int64()) for _ in range(2))], names=names)
            rest = batch.filter(batch.column(0).is_valid())
            for k, data in zip(rest.column(0).to_pylist(), rest.column(1).to_pylist()):
                if k != last and held:
                    yield repeated(held)
                    held = []
                last = k
                held.append(_unpack(data))
        if held:
            yield repeated(held)

    def repeated(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        columns = [np.concatenate(x) for x in zip(*held)]
        order = np.argsort(columns[0], kind="stable")
        hi = columns[0][order]
        again = hi[1:] == hi[:-1]
        twice = np.concatenate([again, [False]]) | np.concatenate([[False], again])
        hi, known, ids, row, start, size = (c[order[twice]] for c in columns)
        order = np.lexsort((size, start, row, ids, known, hi))
        hi, known, ids, row, start, size = (c[order] for c in (hi, known, ids, row, start, size))
        new = np.ones(len(hi), bool)
        new[1:] = hi[1:] != hi[:-1]
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        later = ~new & ~((row == row[first]) & (start == start[first]) & (size == size[first]))
        first, span = first[later], (start << SPAN_BITS) + size
        columns = [pa.array(ids[later], mask=known[later] == 0), *(pa.array(x) for x in (row[later], span[later], row[first], span[first]))]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def join_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Overlapping spans of a text that are as far from overlapping ones of another are one, ``parts`` of it."""
        for batch in slices(batches, 256):
            out: list[tuple] = []
            met = batch.column(2)
            flat = zip(*(c.fill_null(-1).to_numpy().tolist() for c in met.flatten().flatten()))
            for key, row, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), pc.list_value_length(met).to_pylist()):
                others = []
                for span, of, like in islice(flat, n):
                    if like < 0 or of == row:
                        out.append((key, row, span, row, None if like < 0 else like, None))
                    else:
                        a, b = span >> SPAN_BITS, like >> SPAN_BITS
                        others.append((of, b - a, a, a + (span & low), b + (like & low)))
                run: list[int] = []
                parts: list[tuple[int, int]] = []
                for of, shift, a, end, like_end in sorted(others):
                    if run and run[:2] == [of, shift] and a < run[3] and run[4] - run[3] == shift and (end > run[3]) == (like_end > run[4]):
                        run[3:] = max(end, run[3]), max(like_end, run[4])
                    else:
                        if run:
                            out.append(whole(key, row, parts, *run))
                        run, parts = [of, shift, a, end, like_end], []
                    parts.append((a, end, like_end))
                if run:
                    out.append(whole(key, row, parts, *run))
            if out:
                kinds = (*(pa.int64() for _ in range(5)), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), kinds)], names=[*names, "parts"])

    def whole(key: int | None, row: int, parts: list[tuple], of: int, shift: int, a: int, end: int, like_end: int) -> tuple:
        """A run; its parts as (start in the run, length, length of what it is like)."""
        packed = array("I", [n for x, y, z in parts for n in (x - a, y - x, z - x - shift)]).tobytes() if len(parts) > 1 else None
        return key, row, (a << SPAN_BITS) + end - a, of, (a + shift << SPAN_BITS) + like_end - a - shift, packed

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes of what comes first, and where its lines end."""
        kinds = (*(pa.int64() for _ in range(5)), *(pa.binary() for _ in range(3)))
        last = None
        for batch in slices(batches, 64):
            out: list[tuple] = []
            for mine, key, met, text in zip(*(batch.column(k).to_pylist() for k in ("__row", "__id", "__of")), raw_utf8(batch.column("__text"))):
                if (mine, key) == last:  # an equal row has the same to say
                    continue
                last = (mine, key)
                lines: list[int] = []
                for x in met:
                    span, like, data, ends = x["span"], x["like"], None, None
                    if x["__row"] != mine:
                        lines = lines or short_line_ends(text)
                        start = like >> SPAN_BITS
                        end = start + (like & low)
                        like, data, ends = None, text[start:end], array("I", [e - start for e in _inner(lines, start, end)]).tobytes()
                    start = span >> SPAN_BITS
                    out.append((x["__id"], x["__row"], start, start + (span & low), like, data, ends, x["parts"]))
            for k in range(0, len(out), 20_000):
                columns = zip(*out[k : k + 20_000])
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=[*spans, "like", "data", "ends", "parts"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What is the same byte by byte; what is not comes with its own bytes."""
        kinds = (*(pa.int64() for _ in range(4)), pa.binary())
        last = None
        for batch in slices(batches, 64):
            out: list[tuple] = []
            for row, key, met, text in zip(*(batch.column(k).to_pylist() for k in ("__row", "__id", "__spans")), raw_utf8(batch.column("__text"))):
                if (row, key) == last:
                    continue
                last = (row, key)
                lines: list[int] = []
                for x in met:
                    a, b, like, data, to = x["start"], x["end"], x["like"], x["data"], 0
                    if x["of"] != key:
                        continue
                    if data is None and like is None:
                        out.append((key, row, a, b, None))
                        continue
                    if data is None:
                        lines = lines or short_line_ends(text)
                        at = like >> SPAN_BITS
                        to = at + (like & low)
                        data, ends = text[at:to], [e - at for e in _inner(lines, at, to)]
                    if text[a:b].rstrip() == data.rstrip():
                        if max(a, to) < b:
                            out.append((key, row, max(a, to), b, None))
                        continue
                    lines = lines or short_line_ends(text)
                    if x["ends"] is not None:
                        ends = array("I", x["ends"]).tolist()
                    parts = array("I", x["parts"] or b"").tolist()
                    if not parts or _lines(text, lines, a, b) == _lines(data, ends, 0, len(data)):
                        parts = [0, b - a, len(data)]
                    for at, size, like_size in zip(parts[::3], parts[1::3], parts[2::3]):
                        start, end = a + at, a + at + size
                        own = _lines(text, lines, start, end)
                        if own != _lines(data, ends, at, at + like_size):
                            out.append((key, row, start, end, b"\n".join(own)))
                        elif max(start, to) < end:
                            out.append((key, row, max(start, to), end, None))
            for k in range(0, len(out), 20_000):
                columns = zip(*out[k : k + 20_000])
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=[*spans, "data"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of what comes with the same bytes all but the first; what was found to be the same passes."""
        first: tuple = (None,) * 4
        for batch in slices(batches, 8192):
            out: list[tuple] = []
            for key, row, a, b, data in zip(*(c.to_pylist() for c in batch.columns)):
                if data is not None:
                    if data != first[0]:
                        first = data, key, row, b
                        continue
                    if (key, row) == first[1:3]:
                        a = max(a, first[3])
                if a < b:
                    out.append((key, row, a, b))
            columns = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=spans)

    spans = ["__id", "__row", "start", "end"]
    span, places = "__id long, __row long, start long, end long", "__id long, __row long, span long, of long, like long"
    found = rows.mapInArrow(lean(emit), "range long, data binary, __id long, __row long, span long")
    dealt = found.repartition(F.coalesce("range", "__row")).sortWithinPartitions("range")
    met = dealt.mapInArrow(lean(meet), places)
    runs = met.groupBy("__id", "__row").agg(F.collect_list(F.struct("span", "of", "like"))).mapInArrow(lean(join_runs), places + ", parts binary")
    asked = runs.groupBy(F.col("of").alias("__key")).agg(F.collect_list(F.struct("__id", "__row", "span", "like", "parts")).alias("__of"))

    def texts_with(others: DataFrame) -> DataFrame:
        # All columns go along, so that these joins and that of the cut read one and the same exchange.
        texts = _with_row(docs, id_col, text_col).join(others, F.col("__row") == F.col("__key")).drop("__key")
        return texts.withColumns({"__id": F.col(id_col).cast("long"), "__text": F.col(text_col).cast("string")})

    fetched = texts_with(asked).mapInArrow(lean(fetch), span + ", like long, data binary, ends binary, parts binary")
    both = F.struct(F.col("__id").alias("of"), "start", "end", "like", "data", "ends", "parts")
    compared = texts_with(fetched.groupBy(F.col("__row").alias("__key")).agg(F.collect_list(both).alias("__spans"))).mapInArrow(lean(compare), span + ", data binary")
    deal = F.when(F.col("data").isNull(), F.xxhash64("__row")).otherwise(F.xxhash64("data"))
    dealt = compared.withColumn("deal", deal).repartition("deal").sortWithinPartitions("data", "__id", "__row", "start", "end")
    return dealt.select(*spans, "data").mapInArrow(lean(settle), span)


def _with_row(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.withColumn("__row", F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string")))


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", find=repeated_spans) -> DataFrame:
    """``docs`` with what ``find`` gives cut out of the text, and ``__cut``: struct(n_spans, n_bytes, n_all).

    Overlapping spans count as one, windows also where they touch.

    Untouched texts, null ones included, stay byte for byte. A text that loses something loses white space at its
    end as well. Other columns stay; an older ``__cut`` is replaced.
    """
    docs = docs.drop("__cut", "__row", "__spans", "__key", "__of")
    found = find(docs, id_col=id_col, text_col=text_col)
    touching = find is repeated_runs
    cut = F.struct(F.col("__id").alias("of"), "start", "end")
    cuts = found.groupBy(F.col("__row").alias("__key")).agg(F.collect_list(cut).alias("__spans"))
    joined = _with_row(docs, id_col, text_col).join(cuts, F.col("__row") == F.col("__key"), "left").drop("__row", "__key")
    joined = joined.withColumn("__spans", F.filter("__spans", lambda x: x["of"].eqNullSafe(F.col(id_col).cast("long"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("n_spans", pa.int64()), ("n_bytes", pa.int64()), ("n_all", pa.int64())])
        for batch in slices(batches, 512):
            at, spans = batch.schema.get_field_index(text_col), batch.schema.get_field_index("__spans")
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            info = []
            for k, cut in enumerate(batch.column(spans).to_pylist()):
                n_spans, n, text = 0, 0, texts[k]
                if cut:
                    pieces, last = [], 0
                    for a, b in sorted((x["start"], x["end"]) for x in cut):
                        n_spans += a > last or a == last and (not touching or not n_spans)
                        if b > last:
                            pieces.append(text[last:a])
                            n += b - max(a, last)
                            last = b
                    if last:
                        texts[k] = b"".join([*pieces, text[last:]]).rstrip()
                info.append({"n_spans": n_spans, "n_bytes": n, "n_all": len(text or b"")})
            columns, names = list(batch.columns), list(batch.schema.names)
            columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
            columns[spans], names[spans] = pa.array(info, kind), "__cut"
            yield pa.RecordBatch.from_arrays(columns, names=names)

    from pyspark.sql import types as T

    cut = T.StructType([T.StructField(n, T.LongType()) for n in ("n_spans", "n_bytes", "n_all")])
    return joined.mapInArrow(lean(run), T.StructType([*docs.schema.fields, T.StructField("__cut", cut)]))


def clean(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with repeated runs cut out, without documents of which nothing but white space is left.

    Columns as they were; ``length_col``, where there is one, follows a text that lost something.
    """
    out = dedup(docs, id_col=id_col, text_col=text_col, find=repeated_runs).where(
        (F.col("__cut.n_spans") == 0) | F.col(text_col).rlike(r"\S")
    )
    if length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        now = F.when(F.col("__cut.n_spans") > 0, F.length(text_col).cast(kind)).otherwise(F.col(length_col))
        out = out.withColumn(length_col, now)
    return out.select(*docs.columns)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: runs removed, their bytes, and the text that remains."""
    from ._common import table

    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), find=repeated_runs)
    return out.select(
        "doc_id",
        F.col("__cut.n_spans").alias("n_removed"),
        F.col("__cut.n_bytes").alias("bytes_removed"),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"),
        "text",
    )
