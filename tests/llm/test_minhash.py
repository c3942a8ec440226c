import collections
import random

import numpy as np
import pytest

from papyra.llm import minhash as M


def shingles(text, n=5):
    ws = text.encode().translate(M._WORD_BYTES).split()
    if not ws:
        return collections.Counter()
    n = min(n, len(ws))
    return collections.Counter(tuple(ws[k : k + n]) for k in range(len(ws) - n + 1))


def jaccard(a, b):
    x, y = shingles(a), shingles(b)
    return sum((x & y).values()) / sum((x | y).values()) if x and y else 0.0


def brute(pairs, similarity=0.8):
    """Class per row: smallest id that exact copies, equal ids and links connect."""
    rows = [(i, t or "") for i, t in pairs]
    ids = sorted({i for i, _ in rows if i is not None})
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    known = [(i, t) for i, t in rows if i is not None]
    for k, (i, t) in enumerate(known):
        for j, s in known[:k]:
            if t == s or jaccard(t, s) >= similarity:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    texts = collections.defaultdict(list)
    for i, t in known:
        texts[t].append(find(i))
    return sorted(((i if i is not None else -1), min(texts[t]) if t in texts else -1) for i, t in rows)


def got(df):
    return sorted(((r.id if r.id is not None else -1), (r.class_id if r.class_id is not None else -1)) for r in M.classes(df).collect())


def edited(text, share, seed):
    r = random.Random(seed)
    ws = text.split(" ")
    for _ in range(max(1, int(len(ws) * share))):
        ws[r.randrange(len(ws))] = "edit" + str(r.randrange(1000))
    return " ".join(ws)


@pytest.mark.parametrize("places", [1024])
def test_signatures_are_unbiased(places):
    r = random.Random(5)
    letters = [f"w{k}" for k in range(30)]
    off = []
    for k in range(40):
        a = [r.choice(letters[:4]) if r.random() < 0.6 else r.choice(letters) for _ in range(r.randint(5, 80))]
        b = list(a)
        for _ in range(r.randint(0, 6)):
            b[r.randrange(len(b))] = r.choice(letters)
        if k % 3 == 0:
            a, b = a[:5] * r.randint(1, 20), a[:5] * r.randint(1, 20)
        a, b = " ".join(a), " ".join(b)
        assert M.Bag(a.encode()).similarity(M.Bag(b.encode())) == pytest.approx(jaccard(a, b), abs=1e-12)
        s, _ = M.signatures([a.encode(), b.encode()], places)
        off.append((s[0] == s[1]).mean() - jaccard(a, b))
    assert abs(np.mean(off)) < 0.01 and max(map(abs, off)) < 0.08


def test_signatures_do_not_depend_on_the_batch(prose):
    texts = [prose(k, n).encode() for k, n in enumerate([1, 3, 5, 40, 63, 70, 900, 0, 4000])]
    together, _ = M.signatures(texts)
    for k, t in enumerate(texts):
        alone, _ = M.signatures([t])
        assert (alone[0] == together[k]).all()


def test_same_as_brute_force(make_docs, prose):
    pairs = []
    for k in range(40):
        base = prose(k, 60 + 5 * k)
        pairs.append((10 * k, base))
        for j in range(k % 4):
            pairs.append((10 * k + j + 1, edited(base, 0.012 * (j + 1), 31 * k + j)))
    assert got(make_docs(pairs)) == brute(pairs)


def test_large_group_of_near_copies(make_docs, prose, monkeypatch):
    monkeypatch.setattr(M, "STAR_ROWS", 8)
    monkeypatch.setattr(M, "ASKED_ROWS", 5)
    monkeypatch.setattr(M, "OTHER_ROWS", 11)
    monkeypatch.setattr(M, "HELD_SHINGLES", 300)
    base = prose(7, 150)
    pairs = [(k, edited(base, 0.004 * (k % 12), k)) for k in range(80)] + [(100, prose(8, 150))]
    assert got(make_docs(pairs)) == brute(pairs)


def test_shelf(prose):
    texts = [edited(prose(1, 100), 0.02, k) for k in range(20)] + [prose(2, 60), "a b c d e " * 30, ""]
    held = M.Bag.of([t.encode() for t in texts])
    shelf = M.Shelf(held)
    for t in [*texts, prose(3, 10), "a b c d e " * 7]:
        assert shelf.similarities(M.Bag(t.encode())) == pytest.approx([jaccard(t, s) for s in texts], abs=1e-12)


def test_nulls_copies_short_texts_and_ids(make_docs, prose):
    text = prose(1, 80)
    pairs = [
        (5, text), (3, text), (3, text), (None, text), (None, "alone here"), (9, None), (8, ""), (11, "... !!"), (12, "... !!"),
        (20, "one two"), (21, "One, two"), (22, "one"), (23, prose(2, 50)), (23, prose(3, 50)),
    ]
    assert got(make_docs(pairs)) == brute(pairs)


def test_empty_table(make_docs):
    assert got(make_docs([])) == []


def test_keep_one(make_docs, prose):
    text = prose(1, 80)
    df = make_docs([(5, text), (3, text), (3, text), (4, prose(2, 80)), (None, "nobody"), (6, None)])
    out = M.keep_one(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in out.collect()) == [-1, 3, 4, 6]


def test_long_text():
    text = ("one two three four five six seven " * 30_000).encode()
    signature, total = M.signatures([text])
    assert total[0] == 210_000 - 4 and np.isfinite(signature.view(float)).all()
