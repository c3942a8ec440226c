"""Embedding near-dedup by an inverted multi-index.

Vectors are scaled to length one and cut in halves; each half has a codebook of its own, and the pairs of
codewords form a grid of cells. Every vector stands in the cell of its nearest codewords. As a query it visits
cells by rising distance, found by a multi-sequence traversal, so many as reach the target recall on a sample
of queries compared with all rows. Vectors in visited cells are verified by cosine in double precision.

Equal vectors are one row with a weight. A cell with many vectors is split into blocks, and its queries into
blocks as well; links are counted and merged inside the blocks, and no list of pairs is ever written.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import lean, materialise, release, slices
from .components import components

THRESHOLD = 0.9
#: Share of the sample queries' links that the visited cells must hold.
TARGET_RECALL = 0.99
#: Cells a query visits at least, whatever the calibration says.
LEAST_VISITS = 8
#: Share of made-up neighbours, at the threshold exactly, whose cells a query must visit.
NEIGHBOUR_RECALL = 0.93
#: Rows that codebooks are fitted on, at most, and queries that the traversal is calibrated with: the second number
#: where the first meets fewer than LEAST_LINKS links.
FIT_ROWS = 32_768
CALIBRATION_ROWS = (256, 4096)
LEAST_LINKS = 1000
#: Vectors a cell should hold, and codewords of a half at most.
CELL_ROWS = 256
MOST_CODEWORDS = 1024
#: Vectors in one block of a cell, and blocks of queries' size in multiples of that.
BLOCK_ROWS = 2048
QUERY_BLOCKS = 8


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; the largest component is scaled first so that nothing overflows."""
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def multi_sequence(d1: np.ndarray, d2: np.ndarray, count: int) -> list[tuple[int, int]]:
    """The ``count`` cells (i, j) of smallest d1[i] + d2[j], in rising order."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    a, b = d1[o1].tolist(), d2[o2].tolist()
    heap, out, pushed = [(a[0] + b[0], 0, 0)], [], {(0, 0)}
    while heap and len(out) < count:
        _, i, j = heapq.heappop(heap)
        out.append((int(o1[i]), int(o2[j])))
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(a) and q < len(b) and (p, q) not in pushed:
                pushed.add((p, q))
                heapq.heappush(heap, (a[p] + b[q], p, q))
    return out


@dataclass
class MultiIndex:
    """Two codebooks over the halves, and how many cells a query visits."""

    first: np.ndarray
    second: np.ndarray
    visits: int = LEAST_VISITS

    @property
    def half(self) -> int:
        return self.first.shape[1]

    def distances(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of the halves to all codewords."""
        out = []
        for part, book in ((units[:, : self.half], self.first), (units[:, self.half :], self.second)):
            out.append((part**2).sum(1)[:, None] - 2 * part @ book.T + (book**2).sum(1)[None])
        return out[0], out[1]

    def cells(self, units: np.ndarray) -> np.ndarray:
        """Numbers of the visited cells per row; the first is the cell in which the row stands."""
        d1, d2 = self.distances(units)
        k = len(self.second)
        n = min(self.visits, len(self.first) * k)
        return np.array([[i * k + j for i, j in multi_sequence(x, y, n)] for x, y in zip(d1, d2)], np.int64).reshape(len(units), n)


def codebook(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means over the points, started from evenly spaced ones; an empty cluster takes the point furthest from its centre."""
    k = min(k, len(points))
    centres = points[np.linspace(0, len(points) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        d = (points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1)[None]
        own = d.argmin(1)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        far = np.argsort(-d[np.arange(len(points)), own], kind="stable")
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        empty = np.flatnonzero(n == 0)
        centres[empty] = points[far[: len(empty)]]
    return centres


def _vectors(column: pa.Array, dtype: np.dtype, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), dim)


def _sample(rows: DataFrame, salt: int, n: int, dtype: np.dtype, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of the ``n`` rows with the smallest hashes, whatever the partitions."""
    found = rows.orderBy(F.xxhash64("rep", F.lit(salt)), "rep").limit(n).select("rep", "vec").toArrow()
    return found.column(0).to_numpy(), unit(_vectors(found.column(1).combine_chunks(), dtype, dim))


def _fit(rows: DataFrame, n: int, dtype: np.dtype, dim: int, threshold: float, target: float) -> MultiIndex:
    """Codebooks from a sample, and the visits: what the links of sampled queries need, and what made-up neighbours need.

    Queries are compared with all rows; where their links are few, more queries are. A table of few links says
    little about the visits that these need, so every sampled query also gets neighbours of exactly the threshold's
    cosine in random directions, the hardest links there are, and NEIGHBOUR_RECALL of them must be met. A link is
    met from either end, so fewer are lost than that share says.
    """
    k = int(min(MOST_CODEWORDS, max(1, np.ceil(np.sqrt(n / CELL_ROWS)))))
    _, sample = _sample(rows, 0, FIT_ROWS, dtype, dim)
    half = dim // 2
    index = MultiIndex(codebook(sample[:, :half], k), codebook(sample[:, half:], k))
    found: dict[int, int] = {}
    for queries in CALIBRATION_ROWS:
        ids, asked = _sample(rows, 1, queries, dtype, dim)
        found = _link_ranks(rows, index, ids, asked, dtype, dim, threshold)
        if sum(found.values()) >= LEAST_LINKS or queries >= n:
            break
    made = neighbour_ranks(index, asked[: CALIBRATION_ROWS[0]], threshold)
    index.visits = max(LEAST_VISITS, _quantile(found, target), _quantile(made, NEIGHBOUR_RECALL))
    return index


def _quantile(ranks: dict[int, int], share: float) -> int:
    """The smallest rank that holds ``share`` of the counts; 0 of nothing."""
    need, so_far = share * sum(ranks.values()), 0
    for rank in sorted(ranks):
        so_far += ranks[rank]
        if so_far >= need:
            return rank
    return 0


class _Ranks:
    """How many cells of a query lie no further off than a given one: two sorted halves, not the grid of all sums."""

    def __init__(self, index: MultiIndex, queries: np.ndarray):
        self.first, self.second = index.distances(queries)
        self.ordered = np.sort(self.second, axis=1)
        self.known: dict[tuple[int, int, int], int] = {}

    def of(self, q: int, i: int, j: int) -> int:
        key = (q, i, j)
        if key not in self.known:
            if len(self.known) > 1_000_000:
                self.known.clear()
            at = self.first[q, i] + self.second[q, j]
            self.known[key] = max(1, int(np.searchsorted(self.ordered[q], at - self.first[q] + 1e-12, side="right").sum()))
        return self.known[key]


def neighbour_ranks(index: MultiIndex, queries: np.ndarray, cosine: float, each: int = 8) -> dict[int, int]:
    """Ranks of the home cells of made-up vectors at this cosine to the queries, and how many have them."""
    random, ranks = np.random.default_rng(7), _Ranks(index, queries)
    found: dict[int, int] = {}
    for _ in range(each if queries.shape[1] > 1 else 0):
        off = random.normal(size=queries.shape)
        off -= (off * queries).sum(1, keepdims=True) * queries
        off /= np.maximum(np.linalg.norm(off, axis=1, keepdims=True), 1e-300)
        d1, d2 = index.distances(cosine * queries + np.sqrt(max(0.0, 1 - cosine * cosine)) * off)
        for q, (i, j) in enumerate(zip(d1.argmin(1).tolist(), d2.argmin(1).tolist())):
            rank = ranks.of(q, i, j)
            found[rank] = found.get(rank, 0) + 1
    return found


def _link_ranks(rows: DataFrame, index: MultiIndex, ids: np.ndarray, queries: np.ndarray, dtype: np.dtype, dim: int, threshold: float) -> dict[int, int]:
    """Ranks of the home cells of all vectors linked to the queries, and how many have them."""
    shared = rows.sparkSession.sparkContext.broadcast((index, ids, queries))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, ids, queries = shared.value
        ranks = _Ranks(index, queries)
        found: dict[int, int] = {}
        for batch in slices(batches):
            if not batch.num_rows:
                continue
            units = unit(_vectors(batch.column(1), dtype, dim))
            linked = (queries @ units.T >= threshold) & (ids[:, None] != batch.column(0).to_numpy()[None])
            q, x = np.nonzero(linked)
            d1, d2 = index.distances(units)
            cells = np.stack([q, d1.argmin(1)[x], d2.argmin(1)[x]])
            for (q, i, j), n in zip(*(a.tolist() for a in np.unique(cells.T, axis=0, return_counts=True))):
                rank = ranks.of(q, i, j)
                found[rank] = found.get(rank, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["rank", "n"])

    by_rank = rows.select("rep", "vec").mapInArrow(lean(count), "rank long, n long").groupBy("rank").agg(F.sum("n").alias("n")).collect()
    shared.destroy()
    return {r["rank"]: r["n"] for r in by_rank}


def near_duplicates(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = THRESHOLD,
    target_recall: float = TARGET_RECALL,
) -> DataFrame:
    """One row per row of ``vectors``: id_col, n_links, component_id, kept.

    Null, empty and zero vectors, and those with null or non-finite components, link with nothing, equal ones
    included. Vectors of different lengths do not link; every length has an index of its own. A repeated id stands
    for its smallest vector. Rows with a null id come back with no links, a null component and kept false.
    """
    given = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    kind = given.schema["v"].dataType.elementType.simpleString()
    double = kind != "float"
    dtype = np.dtype("<f8" if double else "<f4")
    given = given.withColumn("v", F.col("v").cast("array<double>" if double else "array<float>"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = given.where(F.col("id").isNotNull() & finite & F.exists("v", lambda x: x != 0))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            edges = batch.column(1).offsets.to_numpy()
            data = (batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(dtype) + 0).tobytes()  # -0.0 becomes 0.0
            edges = ((edges - edges[0]) * dtype.itemsize).tolist()
            rows = [data[a:b] for a, b in zip(edges, edges[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["id", "vec"])

    one_each = usable.groupBy("id").agg(F.min("v").alias("v"))
    packed = materialise(one_each.mapInArrow(lean(pack), "id long, vec binary"), "vectors")
    classes = materialise(
        packed.groupBy("vec").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight")).select("rep", "weight", "vec"), "classes"
    )
    spark = vectors.sparkSession
    links = spark.createDataFrame([], "rep long, n_links long")
    roots = spark.createDataFrame([], "rep long, root long")
    made = [packed, classes]
    for size, n in classes.groupBy(F.octet_length("vec").alias("size")).count().where("count > 1").orderBy("size").collect():
        rows, dim = classes.where(F.octet_length("vec") == size), size // dtype.itemsize
        index = _fit(rows, n, dtype, dim, threshold, target_recall)
        found = _links(rows, index, dtype, dim, threshold)
        made.append(found)
        links = links.union(found.groupBy("rep").agg(F.sum("n").alias("n_links")))
        roots = roots.union(found.where("root is not null and root <> rep").select("rep", "root").distinct())
    grouped = components(roots, a="rep", b="root")
    by_class = (
        classes.select("rep", "weight", F.col("vec").alias("key"))
        .join(links, "rep", "left")
        .join(grouped.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            "key",
            (F.coalesce("n_links", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    found = packed.join(by_class, F.col("vec") == F.col("key")).select(F.col("id").alias("known"), F.col("n_links").alias("n"), "component_id")
    out = (
        given.select("id")
        .join(found, F.col("id") == F.col("known"), "left")
        .select(
            F.col("id").alias(id_col),
            F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component_id", "id").alias("component_id"),
            F.coalesce(F.coalesce("component_id", "id") == F.col("id"), F.lit(False)).alias("kept"),
        )
    )
    out = materialise(out, "near-vectors")
    release(*made)
    return out


def _links(classes: DataFrame, index: MultiIndex, dtype: np.dtype, dim: int, threshold: float) -> DataFrame:
    """(rep, n, root): weighted numbers of links, to be summed by rep, and links that connect whatever is linked."""
    spark = classes.sparkSession
    shared = spark.sparkContext.broadcast(index)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in slices(batches):
            cells = index.cells(unit(_vectors(batch.column(2), dtype, dim))) if batch.num_rows else np.zeros((0, 1), np.int64)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(cells) + 1) * cells.shape[1], pa.int32()), pa.array(cells.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, listed], names=["rep", "weight", "vec", "cells"])

    placed = materialise(classes.mapInArrow(lean(place), "rep long, weight long, vec binary, cells array<long>"), "placed")
    home = F.element_at("cells", 1)
    # At most one row per cell of the grid, whose size is bounded by MOST_CODEWORDS squared: that allows the broadcasts.
    large = placed.groupBy(home.alias("of")).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks")).where("blocks > 1")
    large = F.broadcast(materialise(large, "large-cells"))
    blocks = F.coalesce("blocks", F.lit(1))
    query_blocks = F.ceil(blocks / QUERY_BLOCKS).cast("int")
    zero = F.lit(0)
    rows = (
        placed.withColumn("cell", home)
        .join(large, F.col("cell") == F.col("of"), "left")
        .withColumn("ib", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
        .withColumn("qb", F.explode(F.sequence(zero, query_blocks - 1)))
        .select("cell", "ib", "qb", zero.alias("kind"), "rep", "weight", "vec", "cells")
    )
    queries = (
        placed.withColumn("home", home)
        .withColumn("cell", F.explode("cells"))
        .join(large, F.col("cell") == F.col("of"), "left")
        .withColumn("qb", F.pmod(F.xxhash64("rep", F.lit(7)), query_blocks).cast("int"))
        .withColumn("ib", F.explode(F.sequence(zero, blocks - 1)))
        .select("cell", "ib", "qb", F.lit(1).alias("kind"), "rep", "weight", "vec", F.array("home").alias("cells"))
    )
    dealt = rows.union(queries).repartition("cell", "ib", "qb").sortWithinPartitions("cell", "ib", "qb", "kind", "rep")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: _Block | None = None
        key = None
        for batch in slices(batches, 1024):
            keys = np.stack([batch.column(k).to_numpy() for k in range(4)], axis=1)
            edges = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            bounds = [0, *edges.tolist(), len(keys)]
            for a, b in zip(bounds, bounds[1:]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if tuple(keys[a, :3]) != key:
                    if group:
                        yield from group.result()
                    key, group = tuple(keys[a, :3]), _Block(threshold)
                ids, weights = part.column(4).to_numpy(), part.column(5).to_numpy().astype(np.int64)
                units = unit(_vectors(part.column(6), dtype, dim))
                cells = part.column(7).flatten().to_numpy().reshape(len(part), -1)
                (group.ask if keys[a, 3] else group.add)(ids, weights, units, cells)
        if group:
            yield from group.result()

    found = materialise(dealt.mapInArrow(lean(compare), "rep long, n long, root long"), "block-links")
    release(placed)
    return found


class _Block:
    """Vectors of one block of a cell, asked by queries in turn.

    A query counts every linked vector. A vector counts a linked query only if it does not itself visit the
    query's cell, where it will count it; so each link counts once at both of its ends.
    """

    def __init__(self, threshold: float):
        self.threshold = threshold
        self.parts: list[tuple] = []
        self.ready = False
        self.asked: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, ids, weights, units, cells) -> None:
        self.parts.append((ids, weights, units, cells))

    def _build(self) -> None:
        self.ready = True
        self.ids, self.weights, self.units, self.cells = (np.concatenate(x) for x in zip(*self.parts))
        self.label = np.arange(len(self.ids))
        self.counts = np.zeros(len(self.ids), np.int64)

    def ask(self, ids, weights, units, cells) -> None:
        if not self.parts:
            return
        if not self.ready:
            self._build()
        linked = (units @ self.units.T >= self.threshold) & (ids[:, None] != self.ids[None])
        rows = np.flatnonzero(linked.any(axis=1))
        if not len(rows):
            return
        linked, ids, weights, homes = linked[rows], ids[rows], weights[rows], cells[rows, 0]
        for home in np.unique(homes):
            own = homes == home
            unseen = ~(self.cells == home).any(axis=1)
            if unseen.any():
                self.counts += np.where(unseen, weights[own] @ linked[own], 0)
        anchor = linked.argmax(axis=1)
        for row in linked:
            labels = np.unique(self.label[row])
            if len(labels) > 1:
                self.label[np.isin(self.label, labels)] = labels[0]
        self.asked.append((ids, linked @ self.weights, anchor))

    def result(self) -> Iterator[pa.RecordBatch]:
        if not self.asked:
            return
        ids, counts, anchor = (np.concatenate(x) for x in zip(*self.asked))
        least = np.full(len(self.ids), np.iinfo(np.int64).max)
        np.minimum.at(least, self.label, self.ids)
        np.minimum.at(least, self.label[anchor], ids)
        hit = np.zeros(len(self.ids), bool)
        hit[self.label[anchor]] = True
        own = np.flatnonzero(hit[self.label])
        for rep, n, root in (
            (ids, counts, least[self.label[anchor]]),
            (self.ids[own], self.counts[own], least[self.label[own]]),
        ):
            yield pa.RecordBatch.from_arrays([pa.array(rep, pa.int64()), pa.array(n, pa.int64()), pa.array(root, pa.int64())], names=["rep", "n", "root"])


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of every vector of cosine 0.9 or more, and its component."""
    from ._common import table

    return near_duplicates(table(spark, sf_dir, "embeddings"))
