import random

import numpy as np
import pytest

from papyra.llm import toxicity as X

BAD = ["scum", "moronlike", "moronish", "moronic", "clown"]


def make(n, seed, toxic_share=0.3):
    r = random.Random(seed)
    plain = [f"w{k}" for k in range(300)]
    docs, labels = [], []
    for i in range(n):
        ws = [r.choice(plain) for _ in range(r.randint(20, 200))]
        toxic, poor = int(r.random() < toxic_share), int(r.random() < 0.2)
        for _ in range(3 * toxic):
            ws[r.randrange(len(ws))] = r.choice(BAD)
        if poor:
            ws[3] = ws[7] = "lorem"
        docs.append((i, " ".join(ws)))
        labels.append((i, 1 - poor, toxic))
    return docs, labels


LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def fitted(spark, make_docs):
    docs, labels = make(700, 1)
    df = make_docs(docs)
    return X.fit_chain(df, spark.createDataFrame(labels, LABELS)), df


def test_held_out_accuracy(spark, make_docs, fitted):
    model, _ = fitted
    docs, labels = make(400, 2)
    p = {r.doc_id: r["__p"] for r in X.score(make_docs(docs), model).collect()}
    for k, column in ((1, 2), (0, 1)):
        truth = [bool(x[column]) if k else not x[column] for x in labels]
        got = [p[x[0]][k] >= model.thresholds[k] for x in labels]
        assert np.mean([a == b for a, b in zip(truth, got)]) > 0.97
    assert model.names == ["low_quality", "toxic"] and model.links[0].tolist() == [0, 0] and model.links[1, 1] == 0


def newton(x, extra, y, l2=2e-5):
    """Logistic regression by Newton's method on a dense matrix; the intercept is not held down."""
    a = np.column_stack([x, extra, np.ones(len(y))])
    w = np.zeros(a.shape[1])
    held = np.full(len(w), l2)
    held[-1] = 0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        g = a.T @ (p - y) / len(y) + held * w
        h = (a * (p * (1 - p))[:, None]).T @ a / len(y) + np.diag(held + 1e-12)
        w = w - np.linalg.solve(h, g)
    return w


def test_same_as_a_brute_force_chain(spark, make_docs, monkeypatch):
    """Three categories; every later one is trained with out-of-fold predictions of the earlier ones."""
    monkeypatch.setattr(X, "LEAST_GAIN", 8.0)
    r = random.Random(9)
    docs, labels = [], []
    for i in range(240):
        a, b = r.random() < 0.4, r.random() < 0.3
        c = (a and r.random() < 0.8) or r.random() < 0.1
        ws = [r.choice("klmnop") * 3 for _ in range(12)]
        ws += (["aaa"] if a and r.random() < 0.8 else []) + (["bbb"] if b and r.random() < 0.8 else []) + (["ccc"] if c and r.random() < 0.6 else [])
        docs.append((i, " ".join(ws)))
        labels.append((i, int(a), int(b), int(c)))
    lab = spark.createDataFrame(labels, "doc_id long, insult int, threat int, obscene int")
    chain = tuple((n, n) for n in ("insult", "threat", "obscene"))
    model = X.fit_chain(make_docs(docs), lab, chain=chain)
    x = np.array([[float(f in {g for w in t.encode().split() for g in X.word_features(w)}) for f in sorted(model.vocabulary)] for _, t in docs])
    earlier, used = np.zeros((240, 0)), np.zeros((240, 0))
    for k in range(3):
        y = np.array([row[1 + k] for row in labels], float)
        w = newton(x, earlier, y)
        p = 1 / (1 + np.exp(-(np.column_stack([x, used, np.ones(240)]) @ w)))
        used = np.column_stack([used, p])
        out = np.zeros(240)
        for f in range(X.FOLDS):
            own = np.arange(240) % X.FOLDS == f
            v = newton(x[~own], earlier[~own], y[~own])
            out[own] = 1 / (1 + np.exp(-(np.column_stack([x, earlier, np.ones(240)])[own] @ v)))
        earlier = np.column_stack([earlier, out])
    got = {row.doc_id: row["__p"] for row in X.score(make_docs(docs), model).collect()}
    assert model.links[2, :2].any() and np.abs(np.array([got[i] for i, _ in docs]) - used).max() < 0.03


def test_later_models_see_earlier_probabilities():
    model = X.Chain(["a", "b"], {b"x": 0}, np.array([[3.0], [0.0]]), np.array([-1.0, 0.0]), np.array([[0, 0], [4.0, 0]]), np.array([0.5, 0.5]))
    p = model.predict([{0}, set()])
    first = 1 / (1 + np.exp([-2.0, 1.0]))
    assert p[:, 0] == pytest.approx(first) and p[:, 1] == pytest.approx(1 / (1 + np.exp(-4 * first)))


def test_does_not_depend_on_partitions(spark, make_docs):
    docs, labels = make(300, 3)
    lab = spark.createDataFrame(labels, LABELS)
    a, b = X.fit_chain(make_docs(docs), lab), X.fit_chain(make_docs(docs).repartition(7), lab.repartition(3))
    assert a.vocabulary == b.vocabulary and a.weights == pytest.approx(b.weights)


def test_sample_bound(spark, make_docs):
    docs, labels = make(300, 3)
    model = X.fit_chain(make_docs(docs), spark.createDataFrame(labels, LABELS), train_rows=40)
    assert model.predict([set()]).shape == (1, 2)


def test_reject_keeps_columns_and_odd_rows(spark, make_docs, fitted):
    docs, labels = make(300, 4)
    odd = [(1000, None), (1001, ""), (None, "w1 w2"), (1002, "w1 " * 40_000), (1003, "SCUM, clown! moronic scum clown"), (1002, "w1 " * 40_000)]
    df = make_docs(docs + odd)
    lab = spark.createDataFrame([*labels, (None, 1, 1), (5, None, 1), (1001, 1, None), (7, 1, 1)], LABELS)
    out = X.reject(df, lab)
    kept = [r.doc_id for r in out.collect()]
    assert out.columns == df.columns
    assert 1000 in kept and 1001 in kept and None in kept and kept.count(1002) == 2 and 1003 not in kept


@pytest.mark.parametrize("labels", [[], [(0, 1, 0), (1, 1, 0)], [(0, 1, 1)]])
def test_too_few_labels(spark, make_docs, labels):
    df = make_docs([(0, "a b"), (1, "c d")])
    model = X.fit_chain(df, spark.createDataFrame(labels, LABELS))
    p = X.score(df, model).collect()
    assert len(p) == 2 and all(0 <= x <= 1 for r in p for x in r["__p"])
    assert X.score(make_docs([]), model).collect() == []


def test_query(spark, sf_dir):
    rows = X.op6(spark, sf_dir).collect()
    from papyra.llm._common import table

    assert len(rows) == table(spark, sf_dir, "documents").count()
    assert {type(r.toxic) for r in rows} == {bool}
