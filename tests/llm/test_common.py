from types import SimpleNamespace

import pytest

from papyra.llm import _common as C


def session(master, conf=None, checkpoint=None):
    known = SimpleNamespace(isDefined=lambda: checkpoint is not None, get=lambda: checkpoint)
    context = SimpleNamespace(master=master, applicationId="a", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: known)))
    return SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: conf), sparkContext=context)


def test_shared_folder():
    assert C.shared_dir(session("spark://h:1", "hdfs:///x/")) == "hdfs:///x" and C.shared_dir(session("spark://h:1", None, "hdfs:///y")) == "hdfs:///y"
    assert C.shared_dir(session("local[4]")).startswith("file://")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        C.shared_dir(session("yarn"))


def test_batches_are_bounded_inside(spark):
    before = spark.conf.get(C.BATCH_SETTING, None)
    with C.small_batches(spark):
        assert spark.conf.get(C.BATCH_SETTING) == str(C.BATCH_BYTES)
    assert spark.conf.get(C.BATCH_SETTING, None) == before


def test_memory_is_given_back_at_the_end(monkeypatch):
    done = []
    monkeypatch.setattr(C, "give_back", lambda: done.append(1))
    assert list(C.lean(lambda batches: (b * 2 for b in batches))(iter([1, 2]))) == [2, 4] and done == [1]
    half = C.lean(lambda batches: (b for b in batches))(iter([1, 2]))
    next(half)
    half.close()
    assert done == [1, 1]


def test_tables_are_released(spark):
    df = C.materialise(spark.range(3), "gone")
    assert df.count() == 3
    C.release(df)
    with pytest.raises(Exception):
        spark.read.parquet(df._papyra_path).count()
