import math
import random

import numpy as np
import pytest

from papyra.llm import embeddings as E
from papyra.llm.components import components


def brute(rows, threshold=0.9):
    """n_links and component by comparing everything; equal ids are one vector, the smallest."""
    usable = {}
    for i, v in rows:
        if i is None or not v or len(v) != 8 or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        usable[i] = min(usable.get(i, v), v)
    ids = sorted(usable)
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = dict.fromkeys(parent, 0)
    if ids:
        u = E.unit(np.array([usable[i] for i in ids]))
        s = u @ u.T >= threshold
        for a in range(len(ids)):
            for b in range(len(ids)):
                if a != b and s[a, b]:
                    links[ids[a]] += 1
                    x, y = find(ids[a]), find(ids[b])
                    parent[max(x, y)] = min(x, y)
    return {i: (links[i], find(i), find(i) == i) for i in parent}


def vectors(n, groups, seed=1):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(8)] for _ in range(groups)]
    out = []
    for i in range(n):
        c = r.choice(centres)
        out.append((i * 3, [x + r.gauss(0, 0.15) for x in c]))
    return out


def collect(spark, rows, kind="double", **how):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, label int, rep string")
    return E.near_duplicates(df, **how).collect()


def test_same_as_brute_force(spark):
    rows = vectors(300, 12)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in collect(spark, rows)}
    assert got == brute(rows)


def test_blocks_of_a_hot_cell(spark, monkeypatch):
    rows = vectors(400, 2, seed=3)
    monkeypatch.setattr(E, "BLOCK_ROWS", 16)
    monkeypatch.setattr(E, "QUERY_BLOCKS", 2)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in collect(spark, rows)}
    assert got == brute(rows)


def test_odd_vectors_link_with_nothing(spark):
    v = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0]
    rows = [
        (1, v), (2, [x * 7 for x in v]), (3, v), (4, None), (5, []), (6, [0.0] * 8), (7, [float("nan")] * 8), (8, [None] * 8),
        (9, v[:4]), (10, [float("inf")] + v[1:]), (11, [0.0] * 8), (12, [1e300] * 8), (13, [-x for x in v]),
    ]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in collect(spark, rows)}
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[3] == (2, 1, False)
    for i in range(4, 12):
        assert got[i] == (0, i, True)
    assert got == brute(rows)


def test_repeated_and_null_ids(spark):
    v = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0]
    rows = [(1, v), (1, v), (2, v), (None, v)]
    got = sorted(((r.vec_id or -1, r.n_links, r.component_id, r.kept) for r in collect(spark, rows)), key=str)
    assert sorted(got, key=str) == sorted([(-1, 0, None, False), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False)], key=str)


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert E.near_duplicates(df).collect() == []
    only_null = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in E.near_duplicates(only_null).collect()] == [(1, 0, 1, True)]


def test_every_length_is_compared(spark):
    v = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0]
    rows = [(1, v), (2, v[:4]), (3, [2 * x for x in v[:4]]), (4, v), (5, v[:3]), (6, [1.0]), (7, [2.0]), (8, [-1.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in collect(spark, rows)}
    assert got == {1: (1, 1), 4: (1, 1), 2: (1, 2), 3: (1, 2), 5: (0, 5), 6: (1, 6), 7: (1, 6), 8: (0, 8)}


@pytest.mark.parametrize(("codewords", "least"), [(4, 0.9), (16, 0.9), (40, 0.9)])
def test_recall_of_sparse_links(spark, monkeypatch, codewords, least):
    """Links just above the threshold, too few for the sampled queries to meet."""
    n, planted = 6000, 150
    monkeypatch.setattr(E, "CELL_ROWS", n / codewords**2)
    monkeypatch.setattr(E, "CALIBRATION_ROWS", (64, 128))
    r = np.random.default_rng(codewords)
    v = E.unit(r.normal(size=(n, 64)))
    off = r.normal(size=(planted, 64))
    off -= (off * v[:planted]).sum(1, keepdims=True) * v[:planted]
    cosine = r.uniform(0.901, 0.93, size=(planted, 1))
    near = cosine * v[:planted] + np.sqrt(1 - cosine**2) * E.unit(off)
    rows = [(k, x.tolist()) for k, x in enumerate(np.concatenate([v, near]))]
    got = sum(x.n_links for x in collect(spark, rows))
    u = np.concatenate([v, near])
    true = int((u @ u.T >= 0.9).sum()) - len(u)
    assert true >= 2 * planted and least * true <= got <= true


def test_ranks_without_the_grid():
    r = np.random.default_rng(3)
    index = E.MultiIndex(r.normal(size=(7, 4)), r.normal(size=(5, 4)))
    queries = r.normal(size=(6, 8))
    ranks = E._Ranks(index, queries)
    d1, d2 = index.distances(queries)
    for q in range(6):
        order = E.multi_sequence(d1[q], d2[q], 35)
        assert [ranks.of(q, i, j) for i, j in order] == list(range(1, 36))


def test_traversal_is_in_rising_order():
    r = np.random.default_rng(0)
    a, b = r.random(9), r.random(7)
    got = E.multi_sequence(a, b, 63)
    sums = [a[i] + b[j] for i, j in got]
    assert len(set(got)) == 63 and sums == sorted(sums)


def test_recall_on_the_given_table(spark, sf_dir):
    from papyra.llm._common import table

    df = table(spark, sf_dir, "embeddings")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    u = E.unit(np.array([v for _, v in rows]))
    true = int((u @ u.T >= 0.9).sum()) - len(rows)
    got = sum(r.n_links for r in E.op1(spark, sf_dir).collect())
    assert got <= true and got >= 0.9 * true


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components(spark, seed):
    r = random.Random(seed)
    pairs = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100, 100), (101, 100)] + [(k, k + 1) for k in range(200, 260)]
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame([*pairs, (None, 3), (4, None)], "a long, b long")
    got = [tuple(x) for x in components(df).collect()]
    assert len(got) == len(set(got)) and dict(got) == {x: find(x) for x in parent}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
