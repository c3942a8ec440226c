import random

import pytest

#: doc_id, text, then columns whose names clash with names that the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __id string, key string, rep long, bands string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table from (id, text) pairs, with clashing extra columns."""

    def make(pairs):
        rows = [(i, t, "en", "s", None if t is None else len(t), "x", "k", 7, "b") for i, t in pairs]
        return spark.createDataFrame(rows, SCHEMA)

    return make


@pytest.fixture(scope="session")
def prose():
    """Invented sentences: prose(seed, words)."""

    def make(seed, words):
        r = random.Random(seed)
        vocabulary = [
            "".join(r2.choice(["ka", "lo", "mi", "ture", "san", "pel", "dor", "ix", "ué", "qua"]) for _ in range(r2.randint(1, 4)))
            for r2 in [random.Random(99)]
            for _ in range(700)
        ]
        out = []
        for k in range(words):
            out.append(r.choice(vocabulary) + (r.choice([".", ".", ",", "\n"]) if r.random() < 0.12 else ""))
        return " ".join(out).replace("\n ", "\n")

    return make
