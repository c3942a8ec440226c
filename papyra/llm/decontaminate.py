"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over training token windows.

What is broadcast is an array of sorted window hashes with the place of one occurrence each, the items that hold each
window, and the normalised words of the block of the benchmark that these places point into: about 40 bytes per word
of the block, whose size is bounded by ``BLOCK_BYTES``. A hash only proposes; every proposed window is compared with
the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import _WORD_BYTES, lean, materialise, raw_utf8, release, slices_of

#: Bytes of benchmark text in one broadcast block; a larger benchmark is scanned block by block.
BLOCK_BYTES = 16 << 20
#: Bytes of document text that are scanned together.
SCAN_BYTES = 1 << 20

_LETTERS = np.frombuffer(_WORD_BYTES, np.uint8)
_U = np.uint64
_ODD = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Words:
    """The normalised words of many texts: their bytes, where each begins and ends, and a hash of each."""

    def __init__(self, texts: list[bytes], seed: int = 0):
        data = _LETTERS[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
        inside = np.concatenate([[False], data != 32])
        self.starts = np.flatnonzero(inside[1:] & ~inside[:-1])
        self.ends = np.flatnonzero(~inside[1:] & inside[:-1])
        bounds = np.cumsum([len(t) + 1 for t in texts])
        #: Per text its first word, and at the end the number of all words.
        self.first = np.concatenate([[0], np.searchsorted(self.starts, bounds)])
        self.data = data.tobytes()
        self.hashes = self._hash(data, seed)

    def _hash(self, data: np.ndarray, seed: int) -> np.ndarray:
        """Eight bytes at a time; words are taken by rising length, so that few are long when many rounds are needed."""
        length = self.ends - self.starts
        out = _mix(length.astype(_U) + _U((seed * _ODD + 1) & 0xFFFFFFFFFFFFFFFF))
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        eight = np.lib.stride_tricks.as_strided(padded, (len(data), 8), (1, 1))
        todo, at = np.flatnonzero(length > 0), 0
        while len(todo):
            part = np.ascontiguousarray(eight[self.starts[todo] + at]).view("<u8").ravel()
            left = length[todo] - at
            part = np.where(left < 8, part & ((_U(1) << (_U(8) * np.minimum(left, 7).astype(_U))) - _U(1)), part)
            out[todo] = _mix((out[todo] ^ part) * _U(_ODD) + _U(1))
            at += 8
            todo = todo[left > 8]
        return out

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of ``size`` words from every word on, and whether they lie in one text."""
        n = len(self.hashes) - size + 1
        if n <= 0:
            return np.zeros(0, _U), np.zeros(0, bool)
        out = np.full(n, _U(size))
        for k in range(size):
            out = _mix(out * _U(_ODD) + self.hashes[k : k + n])
        end = np.repeat(self.first[1:], np.diff(self.first))[:n]
        return out, np.arange(n) + size <= end

    def slice(self, at: int, size: int) -> bytes:
        """The bytes from the first to the last of ``size`` words, separators as they are."""
        return self.data[self.starts[at] : self.ends[at + size - 1]]


class WindowIndex:
    """Windows of ``n`` consecutive words of every item; an item of fewer words, but not none, is one window.

    Windows of equal hash have equal words: that is checked here, and another seed is taken where it is not so.
    """

    def __init__(self, items: list[tuple[object, str | None]], n: int = 10):
        self.n = n
        self.items = [key for key, _ in items]
        texts = [(text or "").encode("utf-8", "surrogatepass") for _, text in items]
        for seed in range(64):
            if self._build(texts, seed):
                return
        raise ValueError("no seed keeps the hashes of the windows apart")

    def _build(self, texts: list[bytes], seed: int) -> bool:
        self.seed, self.words = seed, Words(texts, seed)
        counts = np.diff(self.words.first)
        size_of = np.minimum(counts, self.n)
        #: By window size: sorted hashes, one place of each, where its items begin in ``owners``, and the owners.
        self.sizes: dict[int, tuple[np.ndarray, ...]] = {}
        item_of = np.repeat(np.arange(len(texts)), counts)
        for size in np.unique(size_of[size_of > 0]).tolist():
            hashes, whole = self.words.windows(size)
            at = np.flatnonzero(whole & (size_of[item_of[: len(whole)]] == size))
            hashes, owner = hashes[at], item_of[at]
            order = np.lexsort((owner, hashes))
            hashes, owner, at = hashes[order], owner[order], at[order]
            first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
            group = np.cumsum(np.concatenate([[False], hashes[1:] != hashes[:-1]]))
            for k in np.flatnonzero(np.bincount(group)[group] > 1).tolist():
                a, b = self.words.slice(int(at[first[group[k]]]), size), self.words.slice(int(at[k]), size)
                if a != b and a.split() != b.split():
                    return False
            own = np.concatenate([[True], (group[1:] != group[:-1]) | (owner[1:] != owner[:-1])])
            starts = np.searchsorted(group[own], np.arange(len(first) + 1))
            self.sizes[size] = hashes[first], at[first].astype(np.int32), starts.astype(np.int32), owner[own].astype(np.int32)
        self.words.hashes = self.words.hashes[:0]
        return True

    def scan(self, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int]], set[int]]]:
        """Per text: number of words, hit runs of words [start, end), numbers of the items met."""
        found = Words(texts, self.seed)
        marks: dict[int, list[tuple[int, int]]] = {}
        met: dict[int, set[int]] = {}
        for size, (known, place, starts, owners) in self.sizes.items():
            hashes, whole = found.windows(size)
            where = np.searchsorted(known, hashes)
            where[where == len(known)] = 0
            at = np.flatnonzero((known[where] == hashes) & whole)
            where = where[at]
            text_of = np.searchsorted(found.first, at, side="right") - 1
            split: dict[int, list[bytes]] = {}
            for p, w, t in zip(at.tolist(), where.tolist(), text_of.tolist()):
                if w not in split:
                    split[w] = self.words.slice(int(place[w]), size).split()
                if found.slice(p, size).split() == split[w]:
                    start = p - int(found.first[t])
                    runs = marks.setdefault(t, [])
                    if runs and start <= runs[-1][1] and runs[-1][0] <= start:
                        runs[-1] = runs[-1][0], max(runs[-1][1], start + size)
                    else:
                        runs.append((start, start + size))
                    met.setdefault(t, set()).update(owners[starts[w] : starts[w + 1]].tolist())
        return [(n, _union(marks.get(t, [])), met.get(t, set())) for t, n in enumerate(np.diff(found.first).tolist())]


def _union(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(benchmark: DataFrame, item_id: str, text_col: str, n: int, block_bytes: int) -> Iterator[WindowIndex]:
    """The benchmark as indexes of bounded size, made one after the other; the driver holds one at a time."""
    items = benchmark.select(F.col(item_id).alias("i"), F.col(text_col).cast("string").alias("t"))
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    part = F.pmod(F.xxhash64("i", "t"), F.lit(blocks))
    for b in range(blocks):
        yield WindowIndex([tuple(r) for r in (items.where(part == b) if blocks > 1 else items).collect()], n)


def hits(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    n: int = 10,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with ``__hits``: struct(n_words, runs of hit words [start, end), items met as strings, n_nameless).

    Null and empty texts have no words. An item whose id is null counts in ``n_nameless`` and is not listed.
    Columns of ``docs`` stay as they are; an older column named ``__hits`` is replaced. A benchmark beyond
    ``block_bytes`` is scanned in several blocks, one pass over the documents each. Every pass but the last is
    written, so that a worker holds one block at a time; nothing is cut off.
    """
    out, older = docs.drop("__hits"), None
    for index in _blocks(benchmark, item_id, item_text, n, block_bytes):
        if older is not None:
            written = materialise(out, "hits")
            if older:
                release(older)
            out = older = written
        out = _scan(out, index, text_col)
        older = older or False
    return out


def _scan(docs: DataFrame, index: WindowIndex, text_col: str) -> DataFrame:
    """One pass; hits of earlier passes in ``__hits`` are joined with the new ones."""
    from pyspark.sql import types as T

    shared = docs.sparkSession.sparkContext.broadcast(index)
    kind = pa.struct(
        [
            ("n_words", pa.int64()),
            ("runs", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))),
            ("items", pa.list_(pa.string())),
            ("n_nameless", pa.int64()),
        ]
    )
    fields = [f for f in docs.schema.fields if f.name != "__hits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in slices_of(batches, text_col, SCAN_BYTES):
            rows = []
            for c, runs, met in index.scan(raw_utf8(batch.column(batch.schema.get_field_index(text_col)))):
                named = sorted({str(key) for k in met if (key := index.items[k]) is not None})
                nameless = sum(index.items[k] is None for k in met)
                rows.append({"n_words": c, "runs": [{"a": a, "b": b} for a, b in runs], "items": named, "n_nameless": nameless})
            older = batch.schema.get_field_index("__hits")
            if older >= 0:
                for row, before in zip(rows, batch.column(older).to_pylist()):
                    both = _union([(x["a"], x["b"]) for x in [*before["runs"], *row["runs"]]])
                    row["runs"] = [{"a": a, "b": b} for a, b in both]
                    row["items"] = sorted({*before["items"], *row["items"]})
                    row["n_nameless"] += before["n_nameless"]
            columns = [c for c, name in zip(batch.columns, batch.schema.names) if name != "__hits"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, kind)], names=[*(f.name for f in fields), "__hits"])

    runs = T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))
    struct = T.StructType(
        [
            T.StructField("n_words", T.LongType()), T.StructField("runs", runs), T.StructField("items", T.ArrayType(T.StringType())),
            T.StructField("n_nameless", T.LongType()),
        ]
    )
    return docs.mapInArrow(lean(run), T.StructType([*fields, T.StructField("__hits", struct)]))


def report(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how
) -> DataFrame:
    """Per document: n_words, n_hit (words inside any benchmark window), the items met and whether any was.

    One row per row of ``docs``, repeated ids included. ``items_sha256`` hashes the item ids as
    strings in string order, comma-joined; for none, the empty string. An item without an id counts and is not listed.
    """
    found = hits(docs.select(id_col, text_col), benchmark, text_col=text_col, **how)
    items = F.array_sort(F.array_distinct("__hits.items"))
    return found.select(
        F.col(id_col),
        F.col("__hits.n_words").alias("n_words"),
        _covered(F.col("__hits.runs")).alias("n_hit"),
        (F.size(items) + F.col("__hits.n_nameless")).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("__hits.runs") > 0).alias("contaminated"),
        items.alias("items"),
    )


def _covered(runs: Column) -> Column:
    """Words in the union of the runs: sorted runs, counted beyond the furthest end so far."""
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, run: Column) -> Column:
        end = F.greatest(acc["end"], run["b"])
        return F.struct(end.alias("end"), (acc["n"] + end - F.greatest(acc["end"], F.least(run["a"], end))).alias("n"))

    return F.aggregate(F.array_sort(runs), start, step, lambda acc: acc["n"])


def remove_documents(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **how) -> DataFrame:
    """``docs`` without those in which any benchmark window occurs; all columns as they were."""
    return hits(docs, benchmark, text_col=text_col, **how).where(F.size("__hits.runs") == 0).drop("__hits")


def remove_spans(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **how) -> DataFrame:
    """``docs`` with the hit runs of words cut out of the text; untouched texts stay byte for byte.

    A cut takes the run from its first to its last word and leaves one space in its place.
    Null texts stay null.
    """
    found = hits(docs, benchmark, text_col=text_col, **how)
    schema = found.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        word = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
        for batch in slices_of(batches, text_col, SCAN_BYTES):
            at = batch.schema.get_field_index(text_col)
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            out = []
            for text, hit in zip(texts, batch.column(batch.schema.get_field_index("__hits")).to_pylist()):
                if text is not None and hit["runs"]:
                    spans = [m.span() for m in word.finditer(text)]
                    pieces, last = [], 0
                    for a, b in _union([(r["a"], r["b"]) for r in hit["runs"]]):
                        pieces.append(text[last : spans[a][0]])
                        last = spans[b - 1][1]
                    text = b" ".join([*pieces, text[last:]])
                out.append(text)
            columns = list(batch.columns)
            columns[at] = pa.array(out, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return found.mapInArrow(lean(run), schema).drop("__hits")


def op10(spark, sf_dir: str) -> DataFrame:
    """Words of every document that stand in a ten-word window of a benchmark item."""
    from ._common import table

    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=10).drop("items")
