import hashlib
import random
import re

import numpy as np
import pytest

from papyra.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, n=10):
    out = []
    for key, text in docs:
        ws, hit, met = words(text), set(), set()
        for item, t in items:
            iw = words(t)
            size = min(n, len(iw))
            grams = {tuple(iw[k : k + size]) for k in range(len(iw) - size + 1)} if iw else set()
            for k in range(len(ws) - size + 1):
                if grams and tuple(ws[k : k + size]) in grams:
                    hit.update(range(k, k + size))
                    met.add(str(item))
        out.append((key, len(ws), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


ITEMS = [
    (1, "The quick brown fox jumps over the lazy dog and then it sleeps, at last."), (2, "Quick BROWN fox"), (10, "ÉTÉ ça va"), (11, None), (12, "... !!"),
    (13, "jumps over the lazy dog and then it sleeps at last for ever and ever and a day"), (14, "Quick brown fox"),
]
DOCS = [
    (1, "A quick-brown fox; jumps over the lazy dog and then it sleeps at last for ever"), (2, None), (3, ""), (4, "été ça va. ÉTÉ ça va"),
    (5, "quick brown\n\nfox " * 50), (6, "nothing of it"), (6, "nothing of it"), (None, "the quick brown fox"), (7, "quick brown"),
    (8, "x " * 20_000 + "quick brown fox"), (9, "the lazy dog and then it sleeps at last the quick"),
]


@pytest.fixture
def tables(spark, make_docs):
    items = spark.createDataFrame([(i, t, "z") for i, t in ITEMS], "item_id long, text string, n_words string")
    return make_docs(DOCS), items


def rows(df):
    return sorted((tuple(r)[:6] for r in df.collect()), key=str)


def test_same_as_brute_force(tables):
    assert rows(D.report(*tables)) == brute(DOCS, ITEMS)
    assert rows(D.report(*tables, n=3)) == brute(DOCS, ITEMS, 3)


def test_blocks_give_the_same(tables):
    assert rows(D.report(*tables, block_bytes=40)) == brute(DOCS, ITEMS)


def test_items_without_an_id_count_and_are_not_listed(spark, make_docs):
    items = spark.createDataFrame([(None, "quick brown fox"), (None, "nothing of it"), (5, "brown fox")], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.items) for r in D.report(make_docs([(1, "a quick brown fox"), (2, "none")]), items).collect()}
    assert got == {1: (3, 2, ["5"]), 2: (0, 0, [])}


def test_words_of_every_length():
    r = random.Random(5)
    texts = ["".join(r.choice("abAB é.,\n09") for _ in range(r.randint(0, 90))).encode() for _ in range(200)] + [b"", b"x" * 70 + b" y", b"..."]
    found = D.Words(texts)
    for k, t in enumerate(texts):
        own = [found.data[a:b] for a, b in zip(found.starts[found.first[k] : found.first[k + 1]], found.ends[found.first[k] : found.first[k + 1]])]
        assert own == [w.encode() for w in words(t.decode())]
    by_hash = {}
    for h, a, b in zip(found.hashes.tolist(), found.starts, found.ends):
        assert by_hash.setdefault(h, found.data[a:b]) == found.data[a:b]
    assert len(by_hash) == len({found.data[a:b] for a, b in zip(found.starts, found.ends)})


def test_equal_hashes_are_told_apart(monkeypatch):
    """Hashes of few values: no seed keeps windows apart, and proposals of a document are refused word by word."""
    real = D.Words._hash
    monkeypatch.setattr(D.Words, "_hash", lambda self, data, seed: real(self, data, seed) % np.uint64(3))
    with pytest.raises(ValueError):
        D.WindowIndex([(k, f"w{k} v{k} u{k}") for k in range(200)], 2)
    monkeypatch.setattr(D.Words, "windows", lambda self, size: (np.zeros(max(0, len(self.hashes) - size + 1), np.uint64), np.ones(max(0, len(self.hashes) - size + 1), bool)))
    index = D.WindowIndex([(1, "quick fox")], 2)
    assert index.scan([b"a quick fox and a quick dog"])[0] == (7, [(1, 3)], {0})


def test_index_is_compact():
    """Bytes that a worker holds per byte of benchmark text."""
    import pickle

    r = random.Random(2)
    text = " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(3, 8))) for _ in range(200_000))
    items = [(k, text[k * 1000 : k * 1000 + 1000]) for k in range(len(text) // 1000)]
    assert len(pickle.dumps(D.WindowIndex(items))) < 8 * len(text)


def test_empty_tables(spark, make_docs, tables):
    none = spark.createDataFrame([], "item_id long, text string")
    assert rows(D.report(tables[0], none)) == brute(DOCS, [])
    assert D.report(make_docs([]), tables[1]).collect() == []


def test_remove_documents(tables):
    out = D.remove_documents(*tables)
    assert out.columns == tables[0].columns
    clean = sorted(str(r[0]) for r in brute(DOCS, ITEMS) if not r[5])
    assert sorted(str(r.doc_id) for r in out.collect()) == clean


def test_remove_spans(tables):
    out = {(r.doc_id, k): r.text for k, r in enumerate(D.remove_spans(*tables).collect())}
    texts = dict(out)
    by_id = {k[0]: v for k, v in texts.items()}
    assert by_id[2] is None and by_id[6] == "nothing of it" and by_id[4] == "été ça va.  "
    assert D.report(D.remove_spans(*tables), tables[1]).where("contaminated").count() == 0


def test_query(spark, sf_dir):
    from papyra.llm._common import table

    docs = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in table(spark, sf_dir, "benchmark").collect()]
    assert rows(D.op10(spark, sf_dir)) == brute(docs, items)
