import pytest

import corpus_pipeline as C
from papyra.llm import toxicity
from papyra.llm._common import table

from .test_decontaminate import brute as contaminated
from .test_line_dedup import brute_runs as runs
from .test_minhash import brute as near
from .test_tokens import check_packed


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = [docs]
    for _, stage in C.STAGES:
        out.append(C.materialise(stage(spark, out[-1], sf_dir), "test-stage"))
    return out


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_names_and_columns(stages):
    assert [n for n, _ in C.STAGES] == ["toxicity", "line dedup", "minhash near-dedup", "benchmark decontamination", "packing"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    assert stages[-1].columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_toxicity_stage(spark, sf_dir, stages):
    model = toxicity.fit_chain(stages[0], table(spark, sf_dir, "labels"))
    p = {r.doc_id: r["__p"][1] for r in toxicity.score(stages[0], model).collect()}
    kept = {i for i, _ in pairs(stages[1])}
    assert kept == {i for i, x in p.items() if x < model.thresholds[1]} and 0 < len(kept) < len(p)


def test_line_stage(stages):
    """Repeated runs are cut; documents with nothing left go."""
    before = pairs(stages[1])
    want = {i: t for (i, _), t in runs(before).items() if t.strip() or t == dict(before)[i]}
    assert dict(pairs(stages[2])) == want and any(t != dict(before)[i] for i, t in want.items())


def test_line_stage_compares_bytes(spark, make_docs, prose, monkeypatch):
    """With digests that mean nothing, no document loses what does not stand elsewhere before."""
    from papyra.llm import line_dedup as L

    notice = prose(41, 90).replace("\n", " ") + "."
    rows = [(k, prose(50 + k, 60) + ".") for k in range(6)] + [(10, notice), (11, prose(70, 30) + ". " + notice)]
    df = make_docs(rows)
    want = dict(pairs(C.drop_repeated_lines(spark, df, "")))
    assert want == dict(rows[:7]) | {11: prose(70, 30) + "."}
    exact = L.windows
    monkeypatch.setattr(L, "windows", lambda texts: (*(found := exact(texts))[:3], *(x % 3 for x in found[3:])))
    got = dict(pairs(C.drop_repeated_lines(spark, df, "")))
    assert {i: got[i] for i in range(6)} == {i: want[i] for i in range(6)} and got[10] == notice and got[11].startswith(want[11])


def test_line_stage_cuts_repeats_whose_digest_others_have(spark, make_docs, prose, monkeypatch):
    """Of texts with one digest, each loses what stands in one before it, not only what stands in the first."""
    from papyra.llm import line_dedup as L

    one, two = (prose(k, 90).replace("\n", " ") + "." for k in (41, 43))
    rows = [(1, one), (2, two), (3, prose(44, 30) + ". " + two), (4, two), (5, None), (6, one + " " + prose(45, 40))]
    want = {i: t for (i, _), t in runs(rows).items() if t is None or t.strip()}
    exact = L.windows
    monkeypatch.setattr(L, "windows", lambda texts: (*(found := exact(texts))[:3], *(x % 2 for x in found[3:])))
    got = dict(pairs(C.drop_repeated_lines(spark, make_docs(rows).repartition(3), "")))
    assert got == want and got[3] == prose(44, 30) + "." and 4 not in got


def test_near_dedup_stage(stages):
    want = sorted(i for i, c in near(pairs(stages[2])) if i == c)
    assert sorted(i for i, _ in pairs(stages[3])) == want


def test_decontamination_stage(spark, sf_dir, stages):
    items = [tuple(r) for r in table(spark, sf_dir, "benchmark").collect()]
    want = sorted(r[0] for r in contaminated(pairs(stages[3]), items) if not r[5])
    assert sorted(i for i, _ in pairs(stages[4])) == want


def test_packing_stage(stages):
    assert check_packed(stages[5].collect(), pairs(stages[4])) < 0.05


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    key = ["doc_id", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, C.run(spark, sf_dir).select(*key).collect())) == sorted(map(tuple, stages[5].select(*key).collect()))


BENCHMARK = "one two three four five six seven eight nine ten eleven"


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    """Labels and a benchmark for documents made up here."""
    folder = str(tmp_path_factory.mktemp("odd"))
    bad = [(1000 + k, 1, int(k % 3 == 0)) for k in range(60)]
    spark.createDataFrame(bad, "doc_id long, quality int, toxic int").write.parquet(folder + "/labels.parquet")
    spark.createDataFrame([(1, BENCHMARK), (2, None)], "item_id long, text string").write.parquet(folder + "/benchmark.parquet")
    return folder


def labelled(prose):
    return [(1000 + k, prose(5000 + k, 60) + (" scumbag scumbag idiotic" if k % 3 == 0 else "")) for k in range(60)]


def through(spark, df, folder):
    out = []
    for _, stage in C.STAGES:
        df = C.materialise(stage(spark, df, folder), "test-stage")
        out.append(df)
    return out


def test_odd_documents(spark, make_docs, prose, odd_dir):
    """Nulls, empty and very long texts, repeated ids and rows, ties, columns with clashing names."""
    long = prose(1, 60_000)
    copy = prose(2, 300)
    rows = [
        (1, None), (1, None), (2, ""), (3, long), (4, copy), (4, copy), (5, copy), (None, prose(3, 50)), (None, None), (6, "short"), (7, prose(4, 80) + " " + BENCHMARK),
        (8, prose(6, 40)), (8, prose(7, 40)), (9, "\n\n"), (10, prose(8, 30) + " scumbag scumbag idiotic " + prose(9, 30)), *labelled(prose),
    ]
    df = make_docs(rows)
    stages = through(spark, df, odd_dir)
    for s in stages[:-1]:
        assert s.columns == df.columns
    ids = [{r.doc_id for r in s.collect()} for s in stages]
    assert 10 not in ids[0] and not {1000, 1003} & ids[0] and {1001, 1, 2, 3, None} <= ids[0]
    # Null, empty and blank texts stay: nothing was cut from them. The second copy has nothing left.
    assert {1, 2, 9, 4} <= ids[1] and 5 not in ids[1]
    assert 3 in ids[2] and {4, 6, 8} <= ids[2] and len(ids[2] & {1, 2}) == 1
    assert ids[3] == ids[2] - {7}
    packed = stages[4].collect()
    kept = [(r.doc_id, r.text) for r in stages[3].collect()]
    assert {r.doc_id for r in packed} == ids[3] and all(0 < r.length <= 2048 for r in packed)
    # One end id for every document, and its tokens once each.
    assert sum(r.start + r.length == r.doc_tokens for r in packed) == len(kept)
    assert sum(r.length for r in packed) == sum(r.doc_tokens for r in packed if r.start + r.length == r.doc_tokens)


def test_no_documents(spark, make_docs, odd_dir):
    assert [s.count() for s in through(spark, make_docs([]), odd_dir)] == [0] * 5
