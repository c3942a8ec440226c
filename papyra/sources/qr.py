"""QR codes: bytes in versions 1 to 10 at error correction level M, by the public standard.

Blocks, alignment marks and check codes follow from a few rules; only the numbers of check codewords are a table.
"""

from __future__ import annotations

import numpy as np

from .pdf_edit import Refused

# For versions 1 to 10 at level M, all codewords, check codewords a block, and blocks.
CODEWORDS = (26, 44, 70, 100, 134, 172, 196, 242, 292, 346)
CHECKS = (10, 16, 26, 18, 24, 16, 18, 22, 22, 26)
BLOCKS = (1, 1, 1, 2, 2, 4, 4, 4, 5, 5)
QUIET = 4

_EXP = [1] * 512
for _k in range(1, 512):
    _EXP[_k] = _EXP[_k - 1] << 1 ^ (0x11D if _EXP[_k - 1] & 0x80 else 0)
_LOG = {_EXP[_k]: _k for _k in range(255)}


def _times(a: int, b: int) -> int:
    return _EXP[_LOG[a] + _LOG[b]] if a and b else 0


def check_codewords(data: list[int], n: int) -> list[int]:
    """The remainder of the data over the generator of degree ``n``."""
    generator = [1]
    for k in range(n):
        generator = [a ^ _times(b, _EXP[k]) for a, b in zip([*generator, 0], [0, *generator])]
    rest = [*data, *[0] * n]
    for k in range(len(data)):
        factor = rest[k]
        for j, g in enumerate(generator):
            rest[k + j] ^= _times(g, factor)
    return rest[-n:]


def _check(value: int, generator: int, bits: int) -> int:
    """A value with its check bits behind it."""
    rest = value << bits
    for k in range(rest.bit_length() - 1, bits - 1, -1):
        if rest >> k & 1:
            rest ^= generator << k - bits
    return value << bits | rest


def split_blocks(version: int) -> list[int]:
    """Data codewords of each block; the later ones hold one more where they do not come out even."""
    data = CODEWORDS[version - 1] - CHECKS[version - 1] * BLOCKS[version - 1]
    n = BLOCKS[version - 1]
    return [data // n + (k >= n - data % n) for k in range(n)]


def alignment(version: int) -> list[int]:
    """Centres of the alignment marks along an edge."""
    if version == 1:
        return []
    last, n = 4 * version + 10, version // 7 + 2
    step = -(-(last - 6) // (n - 1))
    step += step % 2
    return [6, *(last - step * k for k in range(n - 2, -1, -1))]


def codewords(data: bytes) -> tuple[int, list[int]]:
    """(version, codewords in the order they are drawn) of the smallest code that holds the bytes."""
    for version in range(1, 11):
        sizes = split_blocks(version)
        count = 8 if version < 10 else 16
        if len(data) * 8 + 4 + count <= sum(sizes) * 8:
            break
    else:
        raise Refused("the content is too long for a QR code")
    bits = f"0100{len(data):0{count}b}" + "".join(f"{b:08b}" for b in data)
    bits += "0" * min(4, 8 * sum(sizes) - len(bits))
    bits += "0" * (-len(bits) % 8)
    words = [int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)]
    words += [(0xEC, 0x11)[k % 2] for k in range(sum(sizes) - len(words))]
    blocks, at = [], 0
    for n in sizes:
        blocks.append(words[at : at + n])
        at += n
    checks = [check_codewords(b, CHECKS[version - 1]) for b in blocks]
    turn = lambda rows: [row[k] for k in range(max(map(len, rows))) for row in rows if k < len(row)]
    return version, turn(blocks) + turn(checks)


def _frame(version: int) -> tuple[np.ndarray, np.ndarray]:
    """The fixed marks, and which modules are taken by them or by the format."""
    size = 4 * version + 17
    dark, taken = np.zeros((size, size), bool), np.zeros((size, size), bool)
    far = np.maximum(*np.abs(np.mgrid[-4:5, -4:5]))
    finder = (far != 2) & (far != 4)
    for y, x in ((3, 3), (3, size - 4), (size - 4, 3)):
        rows, columns = slice(max(0, y - 4), min(size, y + 5)), slice(max(0, x - 4), min(size, x + 5))
        dark[rows, columns] = finder[rows.start - y + 4 : rows.stop - y + 4, columns.start - x + 4 : columns.stop - x + 4]
        taken[rows, columns] = True
    centres = alignment(version)
    small = np.maximum(*np.abs(np.mgrid[-2:3, -2:3])) != 1
    for y in centres:
        for x in centres:
            if not taken[y, x] or (y == 6) != (x == 6) and 8 < max(y, x) < size - 9:
                dark[y - 2 : y + 3, x - 2 : x + 3], taken[y - 2 : y + 3, x - 2 : x + 3] = small, True
    line = np.arange(8, size - 8)
    dark[6, line] = dark[line, 6] = line % 2 == 0
    taken[6, line] = taken[line, 6] = True
    taken[8, :9] = taken[:9, 8] = taken[8, -8:] = taken[-8:, 8] = True
    dark[size - 8, 8] = True
    if version >= 7:
        word = _check(version, 0x1F25, 12)
        for k in range(18):
            a, b = size - 11 + k % 3, k // 3
            dark[a, b] = dark[b, a] = bool(word >> k & 1)
            taken[a, b] = taken[b, a] = True
    return dark, taken


def _format(dark: np.ndarray, mask: int) -> None:
    """Write level M and the mask around the finders."""
    word = _check(mask, 0x537, 10) ^ 0x5412
    size = len(dark)
    for k in range(15):
        bit = bool(word >> k & 1)
        y = k if k < 6 else k + 1 if k < 8 else size - 15 + k
        dark[y, 8] = bit
        x = size - 1 - k if k < 8 else 7 if k == 8 else 14 - k
        dark[8, x] = bit


MASKS = (
    lambda y, x: (y + x) % 2 == 0, lambda y, x: y % 2 == 0, lambda y, x: x % 3 == 0, lambda y, x: (y + x) % 3 == 0, lambda y, x: (y // 2 + x // 3) % 2 == 0,
    lambda y, x: y * x % 2 + y * x % 3 == 0, lambda y, x: (y * x % 2 + y * x % 3) % 2 == 0, lambda y, x: ((y + x) % 2 + y * x % 3) % 2 == 0,
)


def path(taken: np.ndarray) -> list[tuple[int, int]]:
    """The free modules in the order that codewords fill them: two columns at a time, up and down, from the right."""
    size, out, up = len(taken), [], True
    for right in [x for x in range(size - 1, 0, -2)]:
        x = right if right > 6 else right - 1
        for y in range(size - 1, -1, -1) if up else range(size):
            out += [(y, c) for c in (x, x - 1) if not taken[y, c]]
        up = not up
    return out


def _penalty(dark: np.ndarray) -> int:
    """How hard a code is to read, by the four rules of the standard."""
    total = 0
    for lines in (dark, dark.T):
        for line in lines:
            edges = np.flatnonzero(np.diff(line.astype(int))) + 1
            runs = np.diff([0, *edges, len(line)])
            total += int((runs[runs >= 5] - 2).sum())
            text = "".join("1" if v else "0" for v in line)
            total += 40 * sum(text.startswith(p, k) for p in ("10111010000", "00001011101") for k in range(len(text) - 10))
    same = (dark[1:, 1:] == dark[:-1, 1:]) & (dark[1:, 1:] == dark[1:, :-1]) & (dark[1:, 1:] == dark[:-1, :-1])
    return total + 3 * int(same.sum()) + 10 * int(abs(dark.mean() * 100 - 50) // 5)


def modules(data: bytes) -> np.ndarray:
    """The modules of a code, True for dark, without the quiet zone."""
    version, words = codewords(data)
    frame, taken = _frame(version)
    places = path(taken)
    bits = [w >> 7 - k & 1 for w in words for k in range(8)]
    bits += [0] * (len(places) - len(bits))
    y, x = np.array(places).T
    best = None
    for mask, rule in enumerate(MASKS):
        dark = frame.copy()
        dark[y, x] = np.array(bits, bool) ^ rule(y, x)
        _format(dark, mask)
        score = _penalty(dark)
        if best is None or score < best[0]:
            best = score, dark
    return best[1]


def rectangles(data: bytes) -> tuple[int, list[tuple[int, int, int]]]:
    """(edge with the quiet zone, dark runs as row, column and length) of a code."""
    dark = modules(data)
    out = []
    for row, line in enumerate(dark):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], line.astype(int), [0]])))
        out += [(row + QUIET, int(a) + QUIET, int(b - a)) for a, b in zip(edges[::2], edges[1::2])]
    return len(dark) + 2 * QUIET, out
