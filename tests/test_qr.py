"""QR codes read back by a decoder that shares only the tables and the reading order."""

import numpy as np
import pytest

from papyra.sources import pdf_edit as E, qr as Q
from papyra.sources.pdf import Pdf

from .pdfs import sample


def decode(dark):
    """The bytes of a code, its checks verified."""
    size = len(dark)
    version = (size - 17) // 4
    frame, taken = Q._frame(version)
    fixed = frame.copy()
    fixed[8, :9] = fixed[:9, 8] = fixed[8, -8:] = fixed[-8:, 8] = False
    word = sum(int(dark[k if k < 6 else k + 1 if k < 8 else size - 15 + k, 8]) << k for k in range(15))
    other = sum(int(dark[8, size - 1 - k if k < 8 else 7 if k == 8 else 14 - k]) << k for k in range(15))
    assert word == other
    mask = (word ^ 0x5412) >> 10
    assert mask < 8 and Q._check(mask, 0x537, 10) ^ 0x5412 == word
    places = Q.path(taken)
    bits = [int(dark[y, x]) ^ int(Q.MASKS[mask](y, x)) for y, x in places]
    words = [int("".join(map(str, bits[k : k + 8])), 2) for k in range(0, 8 * Q.CODEWORDS[version - 1], 8)]
    sizes, checks = Q.split_blocks(version), Q.CHECKS[version - 1]
    blocks = [[] for _ in sizes]
    it = iter(words)
    for k in range(max(sizes)):
        for b, n in zip(blocks, sizes):
            if k < n:
                b.append(next(it))
    for _ in range(checks):
        for b in blocks:
            b.append(next(it))
    for b in blocks:  # every root of the generator is a root of the block
        for k in range(checks):
            value = 0
            for c in b:
                value = Q._times(value, Q._EXP[k]) ^ c
            assert value == 0
    stream = "".join(f"{c:08b}" for b, n in zip(blocks, sizes) for c in b[:n])
    assert stream[:4] == "0100"
    count = 8 if version < 10 else 16
    n = int(stream[4 : 4 + count], 2)
    return bytes(int(stream[4 + count + 8 * k :][:8], 2) for k in range(n))


@pytest.mark.parametrize("n", [0, 1, 14, 15, 26, 42, 62, 84, 106, 122, 152, 180, 213])
def test_codes_read_back(n):
    data = bytes((7 * k + n) % 256 for k in range(n))
    assert decode(Q.modules(data)) == data


def test_known_numbers():
    # The check codewords of the standard's worked example, version 1 at level M.
    data = [32, 91, 11, 120, 209, 114, 220, 77, 67, 64, 236, 17, 236, 17, 236, 17]
    assert Q.check_codewords(data, 10) == [196, 35, 39, 119, 235, 215, 231, 226, 93, 23]
    assert Q._check(0b101, 0x537, 10) ^ 0x5412 == 0b100000011001110 and Q._check(7, 0x1F25, 12) == 0b000111110010010100
    assert [Q.alignment(v) for v in (1, 2, 7, 8, 10)] == [[], [6, 18], [6, 22, 38], [6, 24, 42], [6, 28, 50]]
    assert [sum(Q.split_blocks(v)) for v in range(1, 11)] == [16, 28, 44, 64, 86, 108, 124, 154, 182, 216]


def test_frames():
    for v in range(1, 11):
        frame, taken = Q._frame(v)
        assert len(Q.path(taken)) - 8 * Q.CODEWORDS[v - 1] in (0, 7) and frame[0, :7].all() and not frame[7, :8].any() and frame[4 * v + 9, 8]


def test_too_long():
    with pytest.raises(E.Refused):
        Q.modules(bytes(214))


def test_stamped():
    done, report = E.stamp(Pdf(sample(1)), qr="https://example.com/x", anchor="top-right", width=90)
    pdf = Pdf(done)
    content = pdf.content(pdf.pages()[0])
    edge, runs = Q.rectangles(b"https://example.com/x")
    assert report["stamped_pages"] == [1] and content.count(b" re") == len(runs) + 1 and edge == 25 + 8
    drawn = np.zeros((edge, edge), bool)
    for row, column, n in runs:
        drawn[row, column : column + n] = True
    assert decode(drawn[4:-4, 4:-4]) == b"https://example.com/x"
