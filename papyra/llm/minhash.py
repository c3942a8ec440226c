"""MinHash near-dedup of weighted bags: BagMinHash signatures, banding, verification of the multiset overlap.

A text is the multiset of its five-word shingles. For the weight of a shingle the line from 0 up is cut at the
powers of two, and each piece carries a Poisson process of its own, with a rate of its width; a point has a time,
one of the signature's places, and a level inside the piece. A text sees the points below its weight, and a place
of its signature is the time of the earliest point there. Two texts agree at a place with a probability of exactly
their weighted Jaccard similarity. Points are made in rising order and only up to a time at which all places of a
text are very likely filled; a text with a place left over is done again up to a later time.

Texts that are equal are one class first. Bands of the signature put classes into buckets. In a bucket only the
pairs with one centre, another in every bucket, are verified, in two rounds; what is connected by then needs no
further proof. Where a bucket still holds several components, every text outside the largest of them is compared
with all texts of the bucket, in blocks. So no bucket is capped and no list of all its pairs is written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import _WORD_BYTES, lean, materialise, raw_utf8, release, slices_of
from .components import components

SHINGLE = 5
SIMILARITY = 0.8
#: Bands of places; two texts of similarity s meet in one with probability 1 - (1 - s**ROWS)**BANDS, 0.999997 at 0.8.
BANDS, ROWS = 24, 4
#: Centres of one text in the first round; the second takes all that are left.
FIRST_CENTRES = 3
#: Texts that one task compares with one centre.
STAR_ROWS = 512
#: In the last round: texts that are asked for in one task, texts that they are compared with in it, and shingles
#: of the former that are held as one table.
ASKED_ROWS, OTHER_ROWS = 512, 20_000
HELD_SHINGLES = 500_000
#: Bytes of text that are signed together, and points that are made at a time: what a task holds depends on these,
#: not on the lengths of the texts.
SIGN_BYTES = 512 << 10
POINTS = 1 << 18

_LETTERS = np.frombuffer(_WORD_BYTES, np.uint8)
_U = np.uint64
_ODD = 0x9E3779B97F4A7C15
_DOC_BITS = 12


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE_CODES = _mix(np.arange(1, 257, dtype=_U) * _U(_ODD))
_powers = np.ones(1, _U), np.ones(1, _U)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd multiplier and of its inverse modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        tables = []
        for base in (_ODD, pow(_ODD, -1, 1 << 64)):
            table = np.ones(size, _U)
            done = 1
            while done < size:
                table[done : 2 * done] = table[:done] * _U(pow(base, done, 1 << 64))
                done *= 2
            tables.append(table)
        _powers = tables[0], tables[1]
    return _powers[0][:n], _powers[1][:n]


def bags(texts: list[bytes], shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The multisets of all texts: hash of the shingle, number of the text, weight; sorted by hash, then text.

    A text of fewer words, but not none, is one shingle. At most 4096 texts at a time; the hash keeps 52 bits.
    """
    assert len(texts) <= 1 << _DOC_BITS
    data = _LETTERS[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    bounds = np.cumsum([len(t) + 1 for t in texts])
    inside = np.concatenate([[False], data != 32])
    starts = np.flatnonzero(inside[1:] & ~inside[:-1])
    ends = np.flatnonzero(~inside[1:] & inside[:-1])
    power, inverse = _power_tables(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(_BYTE_CODES[data] * power[: len(data)])])
        word = _mix((sums[ends] - sums[starts]) * inverse[starts])
        doc = np.searchsorted(bounds, starts, side="right")
        n = np.bincount(doc, minlength=len(texts))
        first = np.cumsum(n) - n
        width = np.minimum(n, shingle)
        heads = np.repeat(np.maximum(n - shingle, 0) + (n > 0), 1)
        owner = np.repeat(np.arange(len(texts)), heads)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(heads) - heads, heads) + first[owner]
        h = np.zeros(len(at), _U)
        for k in range(shingle):
            more = width[owner] > k
            h[more] = _mix(h[more] * _U(_ODD) + word[at[more] + k] + _U(k + 1))
    low = _U((1 << _DOC_BITS) - 1)
    key = np.sort((h & ~low) | owner.astype(_U))
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    weight = np.diff(np.concatenate([edge, [len(key)]]))
    key = key[edge]
    return key & ~low, (key & low).astype(np.int64), weight


def signatures(texts: list[bytes], places: int = BANDS * ROWS, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Signatures (one row per text, as bits of the times) and total weights; a text without words has weight 0."""
    item, doc, weight = bags(texts, shingle)
    total = np.bincount(doc, weight, len(texts)).astype(np.int64)
    best = np.full((len(texts), places), np.inf)
    limit = np.zeros(len(texts))
    limit[total > 0] = places * (np.log(places) + 6) / total[total > 0]
    todo = total > 0
    while todo.any():
        own = todo[doc]
        # Texts of few shingles see many points of each; these are made several at a time.
        few = total[doc] < 64
        for some, together in ((np.flatnonzero(own & ~few), 1), (np.flatnonzero(own & few), 16)):
            for part in np.array_split(some, max(1, -(-len(some) * together // POINTS))):
                _points(item[part], doc[part], weight[part], limit, best, together)
        todo &= np.isinf(best).any(axis=1)
        limit[todo] *= 2
    return best.view(_U), total


def _points(item, doc, weight, limit, best, together: int) -> None:
    """Lower ``best`` by the points of all pieces of the weight line, up to the texts' time limits."""
    places = best.shape[1]
    flat = best.reshape(-1)
    piece = 0
    while len(item):
        low, width = (0, 1) if piece == 0 else (1 << (piece - 1), 1 << (piece - 1))
        seed = _mix(item + _U((piece + 1) * _ODD & 0xFFFFFFFFFFFFFFFF))
        until = limit[doc]
        index, time, k = np.arange(len(item)), np.zeros(len(item)), 0
        while len(index):
            step = np.arange(k + 1, k + together + 1, dtype=_U) * _U(0xD1B54A32D192ED03)
            bits = _mix(seed[index][:, None] + step[None])
            gap = -np.log(((bits >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / width
            # Summed one by one, so that the times do not depend on how many are made together.
            times = np.cumsum(np.concatenate([time[:, None], gap], axis=1), axis=1)[:, 1:]
            live = times < until[index][:, None]
            rows = np.broadcast_to(index[:, None], live.shape)[live]
            if len(rows):
                mark = _mix(bits[live] ^ _U(_ODD))
                seen, t = slice(None), times[live]
                if width > 1:
                    seen = low + ((mark >> _U(32)) % _U(width)).astype(np.int64) < weight[rows]
                    rows, mark, t = rows[seen], mark[seen], t[seen]
                np.minimum.at(flat, doc[rows] * places + ((mark & _U(0xFFFFFFFF)) % _U(places)).astype(np.int64), t)
            on = live[:, -1]
            index, time, k = index[on], times[on, -1], k + together
        above = weight > low + width
        item, doc, weight, piece = item[above], doc[above], weight[above], piece + 1


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One number per text and band; equal where all places of the band agree."""
    rows = signature.shape[1] // bands
    grid = signature[:, : bands * rows].reshape(len(signature), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=_U) * _U(_ODD), grid.shape[:2])
    for r in range(rows):
        key = _mix((key ^ grid[:, :, r]) * _U(_ODD) + _U(r))
    return key.view(np.int64)


class Bag:
    """The multiset of one text, for exact comparison."""

    def __init__(self, text: bytes, shingle: int = SHINGLE):
        self.items, _, self.weights = bags([text], shingle)
        self.total = int(self.weights.sum())

    @classmethod
    def of(cls, texts: list[bytes]) -> list[Bag]:
        """The bags of many texts, made together."""
        out = []
        for at in range(0, len(texts), 1 << _DOC_BITS):
            part = texts[at : at + (1 << _DOC_BITS)]
            items, doc, weights = bags(part)
            order = np.argsort(doc, kind="stable")
            ends = np.cumsum(np.bincount(doc, minlength=len(part)))
            items, weights = items[order], weights[order]
            for a, b in zip([0, *ends.tolist()], ends.tolist()):
                bag = cls.__new__(cls)
                bag.items, bag.weights = items[a:b], weights[a:b]
                bag.total = int(bag.weights.sum())
                out.append(bag)
        return out

    def similarity(self, other: Bag, at_least: float = 0.0) -> float:
        """Weighted Jaccard similarity; 0 at once where the sizes alone keep it below ``at_least``."""
        small, large = sorted((self.total, other.total))
        if not small or small < at_least * large:
            return 0.0
        at = np.searchsorted(other.items, self.items)
        at[at == len(other.items)] = 0
        both = other.items[at] == self.items
        shared = int(np.minimum(self.weights, other.weights[at])[both].sum())
        return shared / (self.total + other.total - shared)


class Shelf:
    """Many bags, to be compared with one at a time.

    Shingles that many of the bags hold are rows of a dense table, so that a text meets all bags in a few array
    operations; the others are lists of the bags that hold them.
    """

    def __init__(self, held: list[Bag], dense_from: int = 8):
        self.totals = np.array([b.total for b in held], np.int64)
        items = np.concatenate([b.items for b in held])
        owner = np.repeat(np.arange(len(held)), [len(b.items) for b in held])
        weights = np.concatenate([b.weights for b in held])
        order = np.argsort(items, kind="stable")
        items, self.owner, self.weights = items[order], owner[order], weights[order]
        self.items, self.first, self.count = np.unique(items, return_index=True, return_counts=True)
        dense = np.flatnonzero(self.count >= dense_from)
        self.row = np.full(len(self.items) + 1, -1)
        self.row[dense] = np.arange(len(dense))
        self.table = np.zeros((len(dense), len(held)), np.int32)
        where = self.row[np.repeat(np.arange(len(self.items)), self.count)]
        self.table[where[where >= 0], self.owner[where >= 0]] = self.weights[where >= 0]

    def similarities(self, bag: Bag) -> np.ndarray:
        """Weighted Jaccard similarities of the bag and all held ones."""
        at = np.searchsorted(self.items, bag.items)
        at[at == len(self.items)] = 0
        known = self.items[at] == bag.items
        at, weights = at[known], bag.weights[known]
        row = self.row[at]
        dense = row >= 0
        shared = np.minimum(self.table[row[dense]], weights[dense][:, None]).sum(axis=0).astype(np.int64)
        at, weights = at[~dense], weights[~dense]
        n = self.count[at]
        post = np.arange(n.sum()) + np.repeat(self.first[at] - (np.cumsum(n) - n), n)
        rare = np.minimum(self.weights[post], np.repeat(weights, n))
        shared = shared + np.bincount(self.owner[post], rare, len(self.totals))
        return shared / np.maximum(self.totals + bag.total - shared, 1)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).withColumn("key", F.unhex(F.md5("text")))


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(id, key, class_id) per row: the smallest id of the texts that links of ``similarity`` or more connect.

    ``key`` is the MD5 of the text. Null counts as the empty text; texts without words link with equal texts only;
    rows with equal ids are in one class; a text that has no id but null gets a null class. An empty table gives
    no rows.
    """
    rows = _keyed(docs, id_col, text_col)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_of(batches, "text", SIGN_BYTES):
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                signature, total = signatures(raw_utf8(part.column(1)))
                keys = band_keys(signature)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(np.where(total > 0, BANDS, 0))]), pa.int32()),
                    pa.array(keys[total > 0].ravel(), pa.int64()),
                )
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), lists], names=["id", "key", "bands"])

    signed = materialise(rows.mapInArrow(lean(sign), "id long, key binary, bands array<long>"), "signed")
    reps = materialise(
        signed.groupBy("key").agg(F.min("id").alias("rep"), F.any_value("bands").alias("bands")).where("rep is not null"), "reps"
    )
    exploded = reps.select("rep", F.explode("bands").alias("bucket"))
    order = F.struct(F.xxhash64("rep", "bucket"), F.col("rep").alias("rep"))
    # Written, so that the join below is dealt anew and a hot bucket can be split there.
    several = materialise(
        exploded.groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("n"), F.min(order)["rep"].alias("centre"))
        .where("n > 1")
        .withColumnRenamed("bucket", "b"),
        "buckets",
    )
    members = materialise(exploded.join(several, F.col("bucket") == F.col("b")).select("bucket", "n", "centre", "rep"), "members")
    wanted = members.select("rep").distinct().join(reps.select("rep", "key"), "rep").select("rep", F.col("key").alias("k"))
    texts = materialise(
        rows.join(wanted, (F.col("id") == F.col("rep")) & (F.col("key") == F.col("k"))).groupBy("rep").agg(F.any_value("text").alias("text")),
        "texts",
    )
    stars = members.where("rep <> centre").select("centre", "rep").distinct()
    nth = F.row_number().over(Window.partitionBy("rep").orderBy(F.xxhash64("centre", "rep"), "centre"))
    first = materialise(stars.withColumn("nth", nth).where(F.col("nth") <= FIRST_CENTRES).select("centre", "rep"), "stars")
    links = [_verify_stars(first, texts, similarity)]
    found = _labelled(members, links)
    rest = found.where("label <> centre_label").select("centre", "rep").distinct().join(first, ["centre", "rep"], "left_anti")
    rest = materialise(rest, "stars")
    links.append(_verify_stars(rest, texts, similarity))
    release(found)
    found = _labelled(members, links)
    sizes = found.where("n > 2").groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = materialise(
        sizes.groupBy(F.col("bucket").alias("b"))
        .agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("labels"))
        .where("labels > 1")
        .select("b", F.col("top.label").alias("main"), "all", (F.col("all") - F.col("top.n")).alias("asked")),
        "mixed",
    )
    left = materialise(
        found.join(mixed, F.col("bucket") == F.col("b")).select("bucket", "rep", "label", "main", "all", "asked"), "left"
    )
    links.append(_verify_rest(left, texts, similarity))
    groups = components(links[0].union(links[1]).union(links[2]), a="centre", b="rep")
    named = (
        reps.select("rep", F.col("key").alias("k"))
        .join(groups, F.col("rep") == F.col("node"), "left")
        .select("k", F.coalesce("component", "rep").alias("class_id"))
    )
    out = materialise(signed.select("id", "key").join(named, F.col("key") == F.col("k"), "left").select("id", "key", "class_id"), "classes")
    release(signed, reps, several, members, texts, first, rest, found, mixed, left, *links)
    return out


def _labelled(members: DataFrame, links: list[DataFrame]) -> DataFrame:
    """Members with the component of their own and of their centre so far."""
    both = links[0]
    for more in links[1:]:
        both = both.union(more)
    groups = components(both, a="centre", b="rep")
    own = groups.select(F.col("node").alias("n1"), F.col("component").alias("c1"))
    theirs = groups.select(F.col("node").alias("n2"), F.col("component").alias("c2"))
    out = (
        members.join(own, F.col("rep") == F.col("n1"), "left")
        .join(theirs, F.col("centre") == F.col("n2"), "left")
        .select("bucket", "n", "centre", "rep", F.coalesce("c1", "rep").alias("label"), F.coalesce("c2", "centre").alias("centre_label"))
    )
    return materialise(out, "labelled")


def _verify_stars(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (centre, rep) that reach the similarity. A centre of many goes to several tasks, each with its text."""
    parts = pairs.groupBy(F.col("centre").alias("c")).agg(F.ceil(F.count(F.lit(1)) / STAR_ROWS).cast("int").alias("parts"))
    dealt = pairs.join(parts, F.col("centre") == F.col("c")).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    others = dealt.select("centre", "part", "rep").join(texts, "rep").select("centre", "part", F.lit(1).alias("kind"), "rep", "text")
    centres = (
        parts.select(F.col("c").alias("rep"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        .join(texts, "rep")
        .select(F.col("rep").alias("centre"), "part", F.lit(0).alias("kind"), "rep", "text")
    )
    rows = centres.union(others).repartition("centre", "part").sortWithinPartitions("centre", "part", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bag = None
        for batch in slices_of(batches, "text"):
            out: list[tuple[int, int]] = []
            columns = [batch.column(k).to_pylist() for k in (0, 2, 3)]
            for centre, kind, rep, own in zip(*columns, Bag.of(raw_utf8(batch.column(4)))):
                if kind == 0:
                    bag = own
                elif bag.similarity(own, similarity) >= similarity:
                    out.append((centre, rep))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["centre", "rep"])

    return materialise(rows.mapInArrow(lean(run), "centre long, rep long"), "verified")


def _verify_rest(left: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links between members of different labels in the buckets of ``left``.

    ``left`` has bucket, rep, label, ``main`` (the most frequent label), ``all`` members, and how many are ``asked``,
    that is, are not of the main label. These are held block by block, and all members of the bucket pass by them.
    """
    parts = left.withColumns(
        {"ablocks": F.ceil(F.col("asked") / ASKED_ROWS).cast("int"), "oblocks": F.ceil(F.col("all") / OTHER_ROWS).cast("int")}
    )
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("rep", "bucket"), F.col(n)).cast("int")
    asked = parts.where("label <> main").withColumn("a", own("ablocks")).withColumn("o", every("oblocks")).withColumn("kind", F.lit(0))
    others = parts.withColumn("o", own("oblocks")).withColumn("a", every("ablocks")).withColumn("kind", F.lit(1))
    rows = asked.unionByName(others).select("bucket", "a", "o", "kind", "rep", "label").join(texts, "rep")
    rows = rows.select("bucket", "a", "o", "kind", "rep", "label", "text")
    dealt = rows.repartition("bucket", "a", "o").sortWithinPartitions("bucket", "a", "o", "kind", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, None
        for batch in slices_of(batches, "text", 4 << 20):
            out: list[tuple[int, int]] = []
            columns = [batch.column(k).to_pylist() for k in range(6)]
            for *place, kind, rep, label, bag in zip(*columns, Bag.of(raw_utf8(batch.column(6)))):
                if place != key:
                    key, group = place, _Asked(similarity)
                if kind == 0:
                    group.hold(rep, label, bag)
                else:
                    out += group.meet(rep, label, bag)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["centre", "rep"])

    return materialise(dealt.mapInArrow(lean(run), "centre long, rep long"), "verified")


class _Asked:
    """Texts held in one task of the last round, and which labels its links have joined so far."""

    def __init__(self, similarity: float):
        self.similarity = similarity
        self.held: list[tuple[int, int, Bag]] = []
        self.shelves: list[tuple[np.ndarray, np.ndarray, Shelf]] = []
        self.parent: dict[int, int] = {}

    def hold(self, rep: int, label: int, bag: Bag) -> None:
        self.held.append((rep, label, bag))

    def _find(self, x: int) -> int:
        while (up := self.parent.get(x, x)) != x:
            self.parent[x] = self.parent.get(up, up)
            x = up
        return x

    def _build(self) -> None:
        part: list[tuple[int, int, Bag]] = []
        size = 0
        for k, x in enumerate(self.held):
            part.append(x)
            size += len(x[2].items)
            if size >= HELD_SHINGLES or k + 1 == len(self.held):
                reps, labels, own = zip(*part)
                self.shelves.append((np.array(reps), np.array(labels), Shelf(list(own))))
                part, size = [], 0
        self.held = []

    def meet(self, rep: int, label: int, bag: Bag) -> list[tuple[int, int]]:
        """Links of a text to held ones that join labels not joined before."""
        if self.held:
            self._build()
        out = []
        for reps, labels, shelf in self.shelves:
            for k in np.flatnonzero((shelf.similarities(bag) >= self.similarity) & (labels != label)).tolist():
                a, b = self._find(label), self._find(int(labels[k]))
                if a != b:
                    self.parent[max(a, b)] = min(a, b)
                    out.append((rep, int(reps[k])))
        return out


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one row of each class, the one with the smallest id; rows of null class all stay.

    Columns as they were. Of rows that repeat an id within the kept, one stays.
    """
    found = classes(docs, id_col=id_col, text_col=text_col, **how)
    kept = found.where("id = class_id")
    counts = kept.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids")).first()
    names = docs.columns
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    gone = found.where("class_id is not null and id is not null and id <> class_id").select(F.col("id").alias("__i"), F.col("key").alias("__k")).distinct()
    out = docs.join(gone, (F.col(id_col).cast("long") == F.col("__i")) & (F.unhex(F.md5(text)) == F.col("__k")), "left_anti")
    if counts["n"] != counts["ids"]:
        nth = F.row_number().over(Window.partitionBy(id_col).orderBy(*[F.col(c) for c in names if c != id_col]))
        out = out.withColumn("__nth", nth).where((F.col("__nth") == 1) | F.col(id_col).isNull()).drop("__nth")
    return out.select(*names)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its class, and whether it stays."""
    from ._common import table

    return classes(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "class_id", (F.col("id") == F.col("class_id")).alias("kept")
    )
