import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from papyra.llm import packing as P
from papyra.llm import token_store as S
from papyra.llm.tokens import ChunkEncoder, encoder


def ids(text):
    return np.array([*encoder().tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


ROWS = [
    (4, "Hello, World. it's"), (2, None), (9, ""), (7, "x " * 9000), (7, "b"), (7, "a"), (None, "no id"), (-3, "ünd ÉTÉ <|endoftext|> tail"),
    (11, "\x01 İ, ﬁ ́x 42.5 don't\t !?..."), (12, "same"), (12, "same"),
]


def test_chunks_equal_whole_texts():
    e = ChunkEncoder()
    r = random.Random(3)
    letters = "aAbéÉß ñ'.,\n\t\x01 ́ İΣσςﬁ٣漢字1 2-_<|>\x1c\x85’ǆ"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    texts += ["<|endoftext|>" + t for t in texts[:20]] + ["", None]
    for at in range(0, len(texts), 100):
        part = texts[at : at + 100]
        for text, got in zip(part, e.encode(pa.array(part, pa.string()))):
            assert got.tolist() == e.tokenizer.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_cache_halves(monkeypatch):
    from papyra.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_CHUNKS", 5)
    e = ChunkEncoder()
    for k in range(40):
        text = " ".join(f"word{j}, Word{j}." for j in range(k, k + 6))
        assert e.encode(pa.array([text]))[0].tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def key(row):
    return (row[0] is not None, row[0] or 0, row[1] is not None, row[1] or "")


def test_shards_round_trip(spark, make_docs, tmp_path):
    folder = f"file://{tmp_path}/shards"
    manifest = S.write_shards(make_docs(ROWS), folder)
    got = [tuple(r) for r in S.read_shards(spark, manifest, folder).collect()]
    want, start = [], 0
    for i, t in sorted(ROWS, key=key):
        own = ids(t)
        want.append((i, start, len(own), zlib.crc32(own.tobytes())))
        start += len(own)
    assert sorted(got, key=lambda x: x[1]) == want
    picked = {r.doc_id: r.ids for r in S.fetch(spark, manifest, folder, [11, 2]).collect()}
    assert picked[11] == ids(ROWS[8][1]).tolist() and picked[2] == [1]


def test_no_documents(spark, make_docs, tmp_path):
    folder = f"file://{tmp_path}/none"
    manifest = S.write_shards(make_docs([]), folder)
    assert S.read_shards(spark, manifest, folder).collect() == []
    assert P.pack(make_docs([])).collect() == []


def shard(frame_bytes=64):
    out = io.BytesIO()
    w = S.ShardWriter(out, 2, frame_bytes=frame_bytes)
    docs = [(k if k % 5 else None, np.arange(k * 7 % 50, dtype="<u4")) for k in range(60)]
    for d in docs:
        w.add(*d)
    w.finish()
    return out, w.size, docs


def test_reader_decompresses_only_what_it_needs():
    out, size, docs = shard()
    r = S.ShardReader(out, size)
    assert len(r.compressed) > 20
    [(_, got)] = list(r.tokens([31]))
    assert got.tolist() == docs[31][1].tolist() and r.frames_read <= 2
    assert [x.tolist() for _, x in S.ShardReader(out, size).tokens(range(60))] == [d.tolist() for _, d in docs]


def test_wrong_checksum_and_plain_decoder():
    import zstandard

    out, size, docs = shard()
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(out.getvalue()), read_across_frames=True).read()
    assert plain == b"".join(d.astype("<u2").tobytes() for _, d in docs)
    data = bytearray(out.getvalue())
    r = S.ShardReader(io.BytesIO(bytes(data)), size)
    r.sums[3] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        r.frame(3)
    with pytest.raises(ValueError, match="seek table"):
        S.ShardReader(io.BytesIO(bytes(data[:-1])), size - 1)


@pytest.mark.parametrize("seed", range(6))
def test_patterns_use_every_piece_once(seed):
    r = random.Random(seed)
    histogram = {r.randint(1, 2048): r.randint(1, 400) for _ in range(r.choice([0, 1, 5, 300, 1500]))}
    used = {}
    for count, pattern in P.shortest_pack_first(histogram):
        assert count > 0 and sum(length * k for length, k in pattern.items()) <= 2048
        for length, k in pattern.items():
            used[length] = used.get(length, 0) + k * count
    assert used == histogram


def check_packed(rows, docs, size=2048):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, text in docs:
        own, at = ids(text), 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(own[at : at + r.length].tobytes())
            at += r.length
        assert at == len(own)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= size
    totals = [sum(r.length for r in p) for p in by_sequence.values()]
    return sum(size - t for t in totals if t & (t - 1)) / max(1, sum(totals))


def test_packing_round_trip(make_docs, prose, monkeypatch):
    docs = [(k, prose(k, 5 + k * 13 % 900)) for k in range(200)] + [(500, None), (501, "x " * 9000)]
    padding = check_packed(P.pack(make_docs(docs)).collect(), docs)
    monkeypatch.setattr(P, "RANK_ROWS", 3)
    assert check_packed(P.pack(make_docs(docs)).collect(), docs) == pytest.approx(padding)


def test_odd_rows_are_packed(make_docs):
    rows = P.pack(make_docs(ROWS)).collect()
    assert sum(r.length for r in rows) == sum(len(ids(t)) for _, t in ROWS)
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)


def test_padding_of_the_given_table(spark, sf_dir):
    from papyra.llm._common import table

    docs = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    assert check_packed(P.op9(spark, sf_dir).collect(), docs) < 0.03


def test_shards_by_size_not_by_session(spark, make_docs, tmp_path):
    """Equal and missing ids fill several shards; a text longer than a frame comes back whole."""
    rows = [(7, f"text {k} " * 40) for k in range(60)] + [(None, f"no id {k} " * 40) for k in range(30)] + [(1, "long words here " * 40_000), (9, None)]
    got = {}
    for parts in (1, 5):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        try:
            folder = f"file://{tmp_path}/{parts}"
            manifest = S.write_shards(make_docs(rows), folder, shard_bytes=4096)
            assert manifest.count() > 20
            found = S.read_shards(spark, manifest, folder).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        starts = sorted((r.start, r.n_tokens) for r in found)
        assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:])) and starts[0][0] == 0 and len(starts) == len(rows)
        order = [r.doc_id for r in sorted(found, key=lambda r: r.start)]
        assert order == [None] * 30 + [1] + [7] * 60 + [9]
        got[parts] = sorted((r.n_tokens, r.ids_crc32) for r in found)
        assert max(r.n_tokens for r in found) * 2 > S.FRAME_BYTES
    assert got[1] == got[5]
