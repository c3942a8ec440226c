import base64
import gzip
import hashlib
import io
import random
import zlib

import pytest

from papyra.llm import warc as W


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


PAYLOADS = [b"<p>WARC/1.1\r\nfoo \x1f\x8b\x08\r\n\r\n" * k for k in range(20)]
RECORDS = [W.record_bytes("response", f"urn:x-page:{k}", "http://x/ ü\n", p, digest(p)) for k, p in enumerate(PAYLOADS)]


def read(data):
    return list(W.Archive(io.BytesIO(data), len(data)))


@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("seed", range(25))
def test_records_after_damage_are_recovered(packed, seed):
    members = [gzip.compress(r, mtime=0) if packed else r for r in RECORDS]
    data = bytearray(b"".join(members))
    r = random.Random(seed)
    kind, at, n = r.choice(["flip", "cut", "insert", "truncate"]), r.randrange(len(data)), r.randint(1, 60)
    if kind == "flip":
        data[at] ^= r.randint(1, 255)
    elif kind == "cut":
        del data[at : at + n]
    elif kind == "insert":
        data[at:at] = r.randbytes(n)
    else:
        del data[-n:]
    found = read(bytes(data))
    assert sum(x.length for x in found) == len(data)
    at = 0
    for x in found:
        assert x.offset == at
        at += x.length
    good = [x for x in found if isinstance(x, W.Record)]
    assert len(good) >= 17
    for x in good:
        assert x.payload in PAYLOADS


def test_mixed_and_hopeless_archives():
    data = gzip.compress(RECORDS[3] + RECORDS[4]) + b"junk" + RECORDS[5] + gzip.compress(b"no record") + gzip.compress(RECORDS[6])
    kinds = [type(x).__name__ for x in read(data)]
    assert kinds == ["Record", "Record", "Gap", "Record", "Gap", "Record"]
    assert read(b"") == []
    [gap] = read(b"x" * 700_000)
    assert (gap.offset, gap.length) == (0, 700_000)


def test_records_inside_a_damaged_member_are_recovered():
    bad = RECORDS[7].replace(b"foo", b"bar", 1)
    plain = RECORDS[5] + bad + RECORDS[6] + RECORDS[8]
    one = gzip.compress(plain, mtime=0)
    good = lambda xs: [RECORDS.index(W.record_bytes("response", x.headers["warc-record-id"].strip("<>"), "http://x/ ü\n", x.payload, digest(x.payload))) for x in xs if isinstance(x, W.Record)]
    found = read(one + gzip.compress(RECORDS[9], mtime=0))
    assert good(found) == [5, 6, 8, 9] and sum(x.length for x in found) == len(one) + len(gzip.compress(RECORDS[9], mtime=0))
    [inner] = [x for x in found if isinstance(x, W.Gap) and not x.length]
    assert inner.reason == f"wrong block digest; plain bytes {len(RECORDS[5])} to {len(RECORDS[5] + bad)} of the member"
    wrong_sum = bytearray(gzip.compress(RECORDS[5] + RECORDS[6], mtime=0))
    wrong_sum[-8] ^= 1
    assert good(read(bytes(wrong_sum) + bytes(wrong_sum) + RECORDS[2])) == [5, 6, 5, 6, 2]
    r = random.Random(4)
    noise = [W.record_bytes("response", f"urn:x-page:{k}", None, p := r.randbytes(3000), digest(p)) for k in range(30)]
    packed = gzip.compress(b"".join(noise), mtime=0)
    cut = read(packed[: len(packed) // 2])
    assert 13 <= sum(isinstance(x, W.Record) for x in cut) <= 15 and cut[-1].length == len(packed) // 2


def test_nothing_before_the_damage_is_lost():
    """Members shorter than a piece, whatever the compressor makes of them."""
    for level in (0, 1, 9):
        wrong_sum = bytearray(gzip.compress(RECORDS[1] + RECORDS[2], level, mtime=0))
        wrong_sum[-8] ^= 1
        assert [x.payload for x in read(bytes(wrong_sum)) if isinstance(x, W.Record)] == PAYLOADS[1:3]
    for k in range(1, 20):
        pack = zlib.compressobj(9, zlib.DEFLATED, 31)
        whole = pack.compress(RECORDS[k]) + pack.flush(zlib.Z_SYNC_FLUSH)
        record, gap = read(whole + b"\xff" + pack.compress(RECORDS[0]) + pack.flush())  # \xff begins no block
        assert record.payload == PAYLOADS[k] and "gzip" in gap.reason


def test_wrong_digest_is_quarantined():
    bad = RECORDS[7].replace(b"foo", b"bar", 1)
    found = read(RECORDS[6] + bad + RECORDS[8])
    assert [type(x).__name__ for x in found] == ["Record", "Gap", "Record"]
    assert found[1].length == len(bad) and "digest" in found[1].reason


PAGES = [
    (5, "http://a/", "same"), (3, "http://b/", "same"), (9, None, "same"), (4, "u\r\nX: y", "ünïcode"), (6, "http://c/", None), (7, "http://d/", ""),
    (None, "http://e/", "same"), (11, "http://f/", "WARC/1.1\r\n" * 30_000), (12, "g", "twice"), (12, "g", "twice"),
]


def expected(pages, least=0):
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h in pages:
        data = (h or "").encode()
        of = first.get(h or "") if i is not None and len(data) >= least else None
        of = None if of == i else of
        out.append((i, len(data), digest(data), "response" if of is None else "revisit", of))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 1, 5])
@pytest.mark.parametrize("packed", [True, False])
def test_round_trip(spark, tmp_path, least, packed):
    df = spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id long, url string, html string, __key string, n_bytes int")
    folder = f"file://{tmp_path}/w"
    manifest = W.write_archives(df, folder, min_revisit_bytes=least, archive_bytes=2000, compress=packed)
    rows = W.read_archives(manifest, folder).collect()
    assert not W.gap_log(W.read_archives(manifest, folder)).collect()
    number = lambda x: None if x in (None, "urn:x-page:null") else int(x.rpartition(":")[2])
    got = [(number(r.record_id), r.payload_bytes, r.payload_digest, r.record_type, number(r.refers_to)) for r in rows]
    assert sorted(got, key=str) == expected(PAGES, least)
    by_id = {p[0]: p for p in PAGES}
    for r in rows:
        if r.record_type == "response":
            assert bytes(r.payload) == (by_id[number(r.record_id)][2] or "").encode()


def test_no_pages(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    manifest = W.write_archives(df, f"file://{tmp_path}/none")
    assert W.read_archives(manifest, f"file://{tmp_path}/none").collect() == []


def test_query(spark, sf_dir):
    from papyra.llm._common import table

    pages = [tuple(r) for r in table(spark, sf_dir, "pages").select("page_id", "url", "html").collect()]
    assert sorted((tuple(r) for r in W.op4(spark, sf_dir).collect()), key=str) == expected(pages)
