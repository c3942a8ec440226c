"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear models over words and word beginnings. A later model
also sees the probabilities of the earlier categories; it is trained with out-of-fold predictions of those,
so that it meets in training the errors it will meet in use. Features are selected and models fitted on a
bounded sample of labelled rows; every document is scored, with its whole text.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import lean, materialise, raw_utf8, release, slices, words

#: Labelled rows that models are fitted on, at most; the ones with the smallest hash of their id.
TRAIN_ROWS = 20_000
#: Features kept per category, those that say most about it, and what they must say at least: G squared of 15
#: comes about by chance once in ten thousand features.
FEATURES = 4096
LEAST_GAIN = 15.0
LEAST_ROWS = 4
FOLDS = 5
#: Bytes of the word beginnings that are features beside the word.
BEGINNINGS = (4, 5, 6)
#: Words whose features a worker remembers.
CACHE_WORDS = 60_000
#: Features that are worked on at a time while a model is fitted.
BLOCK_FEATURES = 1 << 19

#: Category and the expression that is 1 for it, in the order of the chain. The labels know one category of toxicity
#: only; what else they know, low quality, comes before it as the category that toxic texts often share. Labels with
#: more categories are given as a longer chain.
CHAIN = (("low_quality", "1 - quality"), ("toxic", "toxic"))


def word_features(word: bytes) -> list[bytes]:
    """The word, and its beginnings where they are shorter."""
    return [word, *(b"^" + word[:n] for n in BEGINNINGS if len(word) > n)]


@dataclass
class Chain:
    """Weights of all categories over the selected features, intercepts, and weights of earlier categories."""

    names: list[str]
    vocabulary: dict[bytes, int]
    weights: np.ndarray
    bias: np.ndarray
    links: np.ndarray
    #: Probability from which a category is assigned: the best F1 over the out-of-fold predictions.
    thresholds: np.ndarray
    seen: dict[bytes, tuple[int, ...]] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"seen": {}}

    def features(self, text: bytes) -> set[int]:
        """Numbers of the selected features that occur in a text."""
        seen, vocabulary = self.seen, self.vocabulary
        if len(seen) > CACHE_WORDS:
            seen.clear()
        found: set[int] = set()
        for word in set(words(text)):
            own = seen.get(word)
            if own is None:
                own = seen[word] = tuple(vocabulary[f] for f in word_features(word) if f in vocabulary)
            if own:
                found.update(own)
        return found

    def predict(self, rows: list[set[int]]) -> np.ndarray:
        """Probabilities, one row per text and one column per category, in the order of the chain."""
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        index = np.fromiter((i for r in rows for i in sorted(r)), np.int64, len(row))
        out = np.zeros((len(rows), len(self.names)))
        for k in range(len(self.names)):
            score = np.bincount(row, self.weights[k][index], len(rows)) + self.bias[k] + out[:, :k] @ self.links[k, :k]
            out[:, k] = _sigmoid(score)
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _blocks(starts: np.ndarray) -> list[tuple[int, int]]:
    """Runs of rows that hold about BLOCK_FEATURES features."""
    edges = np.unique(np.searchsorted(starts, np.arange(0, int(starts[-1]) + BLOCK_FEATURES, BLOCK_FEATURES)))
    edges = np.unique(np.concatenate([[0], np.minimum(edges, len(starts) - 1), [len(starts) - 1]])).tolist()
    return list(zip(edges, edges[1:]))


def _scores(starts: np.ndarray, index: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Per row the sum of the weights of its features."""
    out = np.zeros(len(starts) - 1)
    for a, b in _blocks(starts):
        sums = np.concatenate([[0.0], np.cumsum(w[index[starts[a] : starts[b]]])])
        out[a:b] = sums[starts[a + 1 : b + 1] - starts[a]] - sums[starts[a:b] - starts[a]]
    return out


def _fit(starts: np.ndarray, index: np.ndarray, n_features: int, extra: np.ndarray, y: np.ndarray, used: np.ndarray, l2: float = 2e-5, steps: int = 60):
    """Logistic regression over binary features and dense extra columns, by L-BFGS with a backtracking line search.

    Row ``k`` holds the features ``index[starts[k]:starts[k + 1]]``; rows that are not ``used`` count for nothing. Rows
    are gone over in blocks, so that what is held beside the matrix does not depend on its size.
    """
    n, e = int(used.sum()), extra.shape[1]
    rate = float(np.clip(y[used].mean() if n else 0, 1e-4, 1 - 1e-4))
    w = np.zeros(n_features + e + 1)
    w[-1] = np.log(rate / (1 - rate))
    if n == 0 or y[used].min() == y[used].max():
        return w[:n_features], float(w[-1]), w[n_features:-1]
    share, blocks, lengths = used / n, _blocks(starts), np.diff(starts)

    def loss(v: np.ndarray) -> tuple[float, np.ndarray]:
        score = _scores(starts, index, v[:n_features]) + extra @ v[n_features:-1] + v[-1]
        miss = (_sigmoid(score) - y) * share
        g = np.zeros(n_features)
        for a, b in blocks:
            g += np.bincount(index[starts[a] : starts[b]], np.repeat(miss[a:b], lengths[a:b]), n_features)
        g = np.concatenate([g, extra.T @ miss, [miss.sum()]])
        g[:-1] += l2 * v[:-1]
        return float(((np.logaddexp(0, score) - y * score) * share).sum() + l2 / 2 * (v[:-1] ** 2).sum()), g

    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    value, g = loss(w)
    for _ in range(steps):
        d, used = -g, []
        for s, t, r in reversed(past):
            a = r * (s @ d)
            used.append(a)
            d = d - a * t
        if past:
            s, t, _ = past[-1]
            d = d * ((s @ t) / (t @ t))
        for (s, t, r), a in zip(past, reversed(used)):
            d = d + s * (a - r * (t @ d))
        slope, size = g @ d, 1.0 if past else 1.0 / max(1e-12, float(np.abs(g).sum()))
        for _ in range(30):
            new_value, new_g = loss(w + size * d)
            if new_value <= value + 1e-4 * size * slope:
                break
            size /= 2
        else:
            break
        s, t = size * d, new_g - g
        if s @ t > 1e-12:
            past = [*past[-9:], (s, t, 1 / (s @ t))]
        done = value - new_value < 1e-7 * max(1.0, value)
        w, value, g = w + s, new_value, new_g
        if done:
            break
    return w[:n_features], float(w[-1]), w[n_features:-1]


def fit_chain(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_id: str = "doc_id",
    chain: tuple[tuple[str, str], ...] = CHAIN,
    train_rows: int = TRAIN_ROWS,
) -> Chain:
    """Fit on at most ``train_rows`` labelled rows. Rows with a null label, id or text teach nothing; without
    labelled rows of both values a category's probability is its rate, 0 where there are no rows."""
    names = [n for n, _ in chain]
    values = [F.expr(e).cast("double").alias(f"__y{k}") for k, (_, e) in enumerate(chain)]
    picked = labels.select(F.col(label_id).cast("long").alias("__key"), *values).dropna()
    picked = picked.groupBy("__key").agg(*[F.max(f"__y{k}").alias(f"__y{k}") for k in range(len(names))])
    picked = picked.orderBy(F.xxhash64("__key"), "__key").limit(train_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text")).dropna()
    # The sample has at most train_rows rows of a few numbers each: that bound is what allows the broadcast.
    sample = materialise(texts.join(F.broadcast(picked), F.col("__id") == F.col("__key")).drop("__key"), "labelled")
    ys = [f"__y{k}" for k in range(len(names))]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        by: list[Counter] = [Counter() for _ in names]
        for batch in slices(batches, 512):
            for text, *y in zip(raw_utf8(batch.column(1)), *(c.to_pylist() for c in batch.columns[2:])):
                found = {f for w in set(words(text)) for f in word_features(w)}
                n.update(found)
                for counts, value in zip(by, y):
                    if value > 0.5:
                        counts.update(found)
        keys = list(n)
        columns = [pa.array(keys, pa.binary()), pa.array([n[k] for k in keys], pa.int64())]
        columns += [pa.array([c.get(k, 0) for k in keys], pa.int64()) for c in by]
        yield pa.RecordBatch.from_arrays(columns, names=["feature", "n", *[f"p{k}" for k in range(len(names))]])

    positives = "".join(f", p{k} long" for k in range(len(names)))
    total = sample.agg(F.count(F.lit(1)).alias("n"), *[F.sum((F.col(y) > 0.5).cast("long")).alias(y) for y in ys]).first()
    n_all = total["n"] or 0
    vocabulary: dict[bytes, int] = {}
    if n_all:
        counted = (
            sample.select("__id", "__text", *ys)
            .mapInArrow(lean(count), "feature binary, n long" + positives)
            .groupBy("feature")
            .agg(F.sum("n").alias("n"), *[F.sum(f"p{k}").alias(f"p{k}") for k in range(len(names))])
            .where(F.col("n") >= LEAST_ROWS)
        )
        zs = [_gain(f"p{k}", total[ys[k]] or 0, n_all).alias(f"z{k}") for k in range(len(names))]
        scored = materialise(counted.select("feature", *zs).where(F.greatest(F.lit(0.0), *zs) >= LEAST_GAIN), "features")
        keys = set()
        for k in range(len(names)):
            best = scored.where(F.col(f"z{k}") >= LEAST_GAIN).orderBy(F.desc(f"z{k}"), "feature").limit(FEATURES)
            keys.update(best.select("feature").toArrow().column(0).to_pylist())
        release(scored)
        vocabulary = {f: i for i, f in enumerate(sorted(keys))}
    model = Chain(names, vocabulary, np.zeros((len(names), len(vocabulary))), np.full(len(names), -40.0), np.zeros((len(names), len(names))), np.full(len(names), 0.5))
    if n_all:
        _fit_all(docs.sparkSession, model, *_matrix(sample, model, ys))
    release(sample)
    return model


def _gain(positive: str, n_positive: int, n_all: int) -> Column:
    """G squared of a feature and a label: twice the number of rows times their mutual information."""
    n, p = F.col("n").cast("double"), F.col(positive).cast("double")
    term = lambda x: F.when(x > 0, x * F.log(x)).otherwise(0.0)
    plogp = lambda x: x * math.log(x) if x else 0.0
    cells = term(p) + term(n - p) + term(n_positive - p) + term(n_all - n - n_positive + p)
    margins = term(n) + term(n_all - n) + plogp(n_positive) + plogp(n_all - n_positive)
    return 2 * (cells - margins + plogp(n_all))


def _matrix(sample: DataFrame, model: Chain, ys: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the features of every sampled row begin, their numbers, and the labels, in an order that does not depend on partitions."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            found = [sorted(model.features(t)) for t in raw_utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *batch.columns[2:], pa.array(found, pa.list_(pa.int32()))], names=["__id", *ys, "found"]
            )

    kept = sample.select("__id", "__text", *ys).mapInArrow(lean(find), "__id long, " + ", ".join(f"{y} double" for y in ys) + ", found array<int>")
    table = kept.toArrow().combine_chunks().sort_by([("__id", "ascending")])
    labels = np.column_stack([table.column(y).to_numpy() for y in ys]) > 0.5
    found = table.column("found").combine_chunks()
    offsets = found.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0], found.flatten().to_numpy(), labels


def _fit_all(spark: SparkSession, model: Chain, starts: np.ndarray, index: np.ndarray, labels: np.ndarray) -> None:
    """Fit category after category; folds are taken by position in the sorted sample.

    The model of a category and those of its folds are fitted in as many tasks. What these share is the sample's
    matrix, bounded by the number of sampled rows and of features.
    """
    n, width = len(labels), len(model.vocabulary)
    matrix = spark.sparkContext.broadcast((starts, index, labels))
    earlier = np.zeros((n, 0))
    for k in range(len(model.names)):
        before = spark.sparkContext.broadcast(earlier)
        fits = _fold_fits(spark, matrix, before, k, width)
        before.destroy()
        out = np.zeros(n)
        for fold, w, b, links, p in fits:
            if fold < 0:
                model.weights[k], model.bias[k] = np.frombuffer(w), b
                model.links[k, :k] = links
            else:
                out[fold::FOLDS] = np.frombuffer(p)
        model.thresholds[k] = _best_threshold(out, labels[:, k].astype(float))
        earlier = np.column_stack([earlier, out])
    matrix.destroy()


def _fold_fits(spark: SparkSession, matrix, before, k: int, width: int) -> list[tuple]:
    """(fold, weights, intercept, links, predictions of the fold's rows) of category ``k``; fold -1 is the whole sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, index, labels = matrix.value
        earlier, y, n = before.value, labels[:, k].astype(float), len(labels)
        for batch in batches:
            for fold in batch.column(0).to_pylist():
                rest = np.arange(n) % FOLDS != fold
                w, b, links = _fit(starts, index, width, earlier, y, rest)
                score = _scores(starts, index, w) + earlier @ links + b
                p = _sigmoid(score)[~rest]
                yield pa.RecordBatch.from_pydict(
                    {"fold": [fold], "w": [w.tobytes()], "b": [b], "links": [links.tolist()], "p": [p.tobytes()]},
                    pa.schema([("fold", pa.int64()), ("w", pa.binary()), ("b", pa.float64()), ("links", pa.list_(pa.float64())), ("p", pa.binary())]),
                )

    tasks = spark.range(-1, FOLDS, 1, FOLDS + 1)
    found = tasks.mapInArrow(lean(run), "fold long, w binary, b double, links array<double>, p binary").toArrow()
    return sorted(zip(*(c.to_pylist() for c in found.columns)))


def _best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap at which F1 is best; 0.5 where one class is missing."""
    if len(y) == 0 or y.min() == y.max():
        return 0.5
    order = np.argsort(-p, kind="stable")
    p, hit = p[order], np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][p[:-1] == p[1:]] = -1
    k = int(np.argmax(f1))
    return float((p[k] + (p[k + 1] if k + 1 < len(p) else 0)) / 2)


def score(docs: DataFrame, model: Chain, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``__p``, the probabilities in the order of the chain. Null counts as the empty text; an
    older column of that name is replaced."""
    from pyspark.sql import types as T

    docs = docs.drop("__p")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, 512):
            texts = raw_utf8(batch.column(batch.schema.get_field_index(text_col)))
            p = model.predict([model.features(t) for t in texts])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(p.tolist(), pa.list_(pa.float64()))], names=[*batch.schema.names, "__p"]
            )
        model.seen.clear()

    return docs.mapInArrow(lean(run), T.StructType([*docs.schema.fields, T.StructField("__p", T.ArrayType(T.DoubleType()))]))


def reject(docs: DataFrame, labels: DataFrame, *, category: str = "toxic", **how) -> DataFrame:
    """``docs`` without those whose probability of ``category`` reaches its threshold; columns as they were."""
    model = fit_chain(docs, labels, **how)
    at = model.names.index(category)
    clean = F.col("__p")[at] < float(model.thresholds[at])
    return score(docs, model, text_col=how.get("text_col", "text")).where(clean).drop("__p")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the probability of each category, and whether it is rejected as toxic."""
    from ._common import table

    docs = table(spark, sf_dir, "documents")
    model = fit_chain(docs, table(spark, sf_dir, "labels"))
    p = [F.col("__p")[k].alias(f"p_{n}") for k, n in enumerate(model.names)]
    at = model.names.index("toxic")
    toxic = (F.col("__p")[at] >= float(model.thresholds[at])).alias("toxic")
    return score(docs.select("doc_id", "text"), model).select("doc_id", *p, toxic)
