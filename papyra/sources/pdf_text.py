"""From content streams to words with boxes, straight rules and drawn images.

A glyph's box reaches from 0.2 em under the baseline to 0.8 em over it. A glyph continues a word while it is set in
the same size, on the same line, and close behind the glyph before it; white space ends a word. Where marked content
states its text, the first glyph carries all of it and the others only add to its extent.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, replace
from typing import Any

import numpy as np

from .pdf import _END, Damaged, Layout, Lexer, Operator, Page, Pdf, Stream, Word, _Close, helvetica, text_string

#: Fixed values, in em: glyph box, and how near the next glyph of a word begins.
DESCENT, ASCENT = 0.2, 0.8
NEAR, OVERLAP, ASIDE, SAME_SIZE = 0.15, -0.3, 0.4, 0.1
#: Fixed values, in points: how straight and long a rule is, how thin a filled one, and the smallest glyph.
STRAIGHT, LONG, THIN = 1.0, 3.0, 2.0
SMALLEST = 0.01
#: Fixed values, in font sizes: how far the next line of running text stands apart, and the next paragraph.
LINE_DROP, LINE_STEP, PARAGRAPH_DROP = 0.5, 1.2, 1.7
#: Forms inside forms that are followed, and operands that one operator may have.
MOST_FORMS, MOST_OPERANDS = 16, 1_000_000

Matrix = tuple[float, float, float, float, float, float]
IDENTITY: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def multiply(m: Matrix, n: Matrix) -> Matrix:
    """First m, then n."""
    return (
        m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3],
        m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5],
    )


def apply(m: Matrix, x: float, y: float) -> tuple[float, float]:
    """A point moved by a matrix."""
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def invert(m: Matrix) -> Matrix | None:
    """The matrix that undoes another; none for one that flattens."""
    d = m[0] * m[3] - m[1] * m[2]
    if abs(d) < 1e-12:
        return None
    a, b, c, e = m[3] / d, -m[1] / d, -m[2] / d, m[0] / d
    return a, b, c, e, -(m[4] * a + m[5] * c), -(m[4] * b + m[5] * e)


def bounds(m: Matrix, x0: float, y0: float, x1: float, y1: float) -> list[float]:
    """The upright box around a moved rectangle."""
    points = [apply(m, x, y) for x in (x0, x1) for y in (y0, y1)]
    xs, ys = zip(*points)
    return [min(xs), min(ys), max(xs), max(ys)]


def visual_matrix(page: Page) -> tuple[Matrix, float, float]:
    """From page space to the upright page with its origin at the top left, and its size."""
    x0, y0, x1, y1 = page.box
    w, h = x1 - x0, y1 - y0
    if page.rotation == 90:
        return (0, 1, 1, 0, -y0, -x0), h, w
    if page.rotation == 180:
        return (-1, 0, 0, 1, x1, -y0), w, h
    if page.rotation == 270:
        return (0, -1, -1, 0, y1, x1), h, w
    return (1, 0, 0, -1, -x0, y1), w, h


# Glyph names of punctuation and digits in ASCII, in the order of their codes.
ASCII_NAMES = (
    "space exclam quotedbl numbersign dollar percent ampersand quotesingle parenleft parenright asterisk plus comma hyphen period slash "
    "zero one two three four five six seven eight nine colon semicolon less equal greater question at"
).split()
# Other names that are common in Western text.
OTHER_NAMES = {
    "bracketleft": "[", "backslash": "\\", "bracketright": "]", "asciicircum": "^", "underscore": "_", "grave": "`", "braceleft": "{", "bar": "|",
    "braceright": "}", "asciitilde": "~", "quoteleft": "‘", "quoteright": "’", "quotedblleft": "“", "quotedblright": "”", "endash": "–",
    "emdash": "—", "bullet": "•", "ellipsis": "…", "fi": "ﬁ", "fl": "ﬂ", "ff": "ﬀ", "germandbls": "ß", "ae": "æ", "AE": "Æ", "oslash": "ø",
    "Oslash": "Ø", "degree": "°", "Euro": "€", "nbspace": " ", "minus": "−", "periodcentered": "·",
}
_ACCENTS = {"grave": "̀", "acute": "́", "circumflex": "̂", "tilde": "̃", "dieresis": "̈", "ring": "̊", "cedilla": "̧", "caron": "̌"}


def glyph_text(name: str) -> str:
    """What a glyph name reads as; a placeholder for one that is not known."""
    name = name.split(".")[0] or name
    if len(name) == 1:
        return name
    if name in ASCII_NAMES:
        return chr(32 + ASCII_NAMES.index(name))
    if name in OTHER_NAMES:
        return OTHER_NAMES[name]
    if m := re.fullmatch(r"uni((?:[0-9A-F]{4})+)|u([0-9A-F]{4,6})", name):
        digits = [m[1][k : k + 4] for k in range(0, len(m[1]), 4)] if m[1] else [m[2]]
        return "".join(chr(int(d, 16)) for d in digits if int(d, 16) < 0x110000)
    if name[0].isalpha() and name[1:] in _ACCENTS:
        return unicodedata.normalize("NFC", name[0] + _ACCENTS[name[1:]])
    return "�"


class Font:
    """What a font says about codes: how many bytes one has, its text, its width in 1/1000 em."""

    def __init__(self, pdf: Pdf, info: Any):
        info = info if isinstance(info, dict) else {}
        # Held, since fonts without a number are known by the identity of their dictionary.
        self.info = info
        self.name = re.sub(r"^[A-Z]{6}\+", "", str(pdf.get(info.get("BaseFont")) or "Helvetica"))
        self.wide = pdf.get(info.get("Subtype")) == "Type0"
        self.texts: dict[int, str] = {}
        self.ranges: list[tuple[int, int, float]] = []
        self.widths: dict[int, float] = {}
        self.default: float | None = None
        self.codec = "cp1252"
        inner = info
        if self.wide:
            inner = pdf.get((pdf.get(info.get("DescendantFonts")) or [None])[0]) or {}
            self.default = float(pdf.get(inner.get("DW", 1000)))
            self._cid_widths(pdf, pdf.get(inner.get("W")) or [])
        else:
            self._encoding(pdf, pdf.get(info.get("Encoding")))
            first = pdf.get(info.get("FirstChar", 0)) or 0
            for k, w in enumerate(pdf.get(info.get("Widths")) or []):
                w = pdf.get(w)
                if isinstance(w, (int, float)):
                    self.widths[first + k] = float(w)
            if "Courier" in self.name and not self.widths:
                self.default = 600.0
        descriptor = pdf.get(inner.get("FontDescriptor")) if isinstance(inner, dict) else None
        descriptor = descriptor if isinstance(descriptor, dict) else {}
        weight, flags = pdf.get(descriptor.get("FontWeight", 0)), pdf.get(descriptor.get("Flags", 0))
        self.bold = isinstance(weight, (int, float)) and weight >= 600 or "bold" in self.name.lower()
        self.italic = isinstance(flags, int) and bool(flags & 64) or bool(re.search("italic|oblique", self.name, re.I))
        stream = pdf.get(info.get("ToUnicode"))
        if isinstance(stream, Stream):
            self._to_unicode(pdf.decode(stream))
        self._codes: dict[str, bytes] | None = None
        self._tables: tuple[np.ndarray, list[str]] | None = None

    def tables(self) -> tuple[np.ndarray, list[str]]:
        """Widths and texts of all codes of one byte."""
        if self._tables is None:
            self._tables = np.array([self.width(k) for k in range(256)]) / 1000.0, [self.text(k) for k in range(256)]
        return self._tables

    def _encoding(self, pdf: Pdf, x: Any) -> None:
        base = pdf.get(x.get("BaseEncoding")) if isinstance(x, dict) else x
        self.codec = "mac_roman" if base == "MacRomanEncoding" else "cp1252"
        code = 0
        for item in pdf.get(x.get("Differences")) or [] if isinstance(x, dict) else []:
            item = pdf.get(item)
            if isinstance(item, int):
                code = item
            elif isinstance(item, str):
                self.texts[code] = glyph_text(item)
                code += 1

    def _cid_widths(self, pdf: Pdf, w: list[Any]) -> None:
        k = 0
        while k + 1 < len(w):
            first, second = pdf.get(w[k]), pdf.get(w[k + 1])
            if isinstance(second, list):
                self.widths.update({first + j: float(pdf.get(x)) for j, x in enumerate(second)})
                k += 2
            elif k + 2 < len(w):
                self.ranges.append((first, second, float(pdf.get(w[k + 2]))))
                k += 3
            else:
                break

    def _to_unicode(self, data: bytes) -> None:
        text = lambda b: b.decode("utf-16-be", "replace")
        number = lambda b: int.from_bytes(b, "big")
        lexer, last = Lexer(data), []
        while (x := lexer.next()) is not _END:
            if not isinstance(x, Operator):
                last.append(x)
                continue
            if x == "endbfchar":
                self.texts.update({number(a): text(b) for a, b in zip(last[::2], last[1::2]) if isinstance(a, bytes) and isinstance(b, bytes)})
            elif x == "endbfrange":
                for a, b, c in zip(last[::3], last[1::3], last[2::3]):
                    if not isinstance(a, bytes) or not isinstance(b, bytes):
                        continue
                    # Codes have two bytes at most, so no range is longer than that.
                    codes = range(number(a), min(number(b), number(a) + 0xFFFF) + 1)
                    if isinstance(c, list):
                        self.texts.update({k: text(v) for k, v in zip(codes, c) if isinstance(v, bytes)})
                    elif isinstance(c, bytes) and c:
                        top = 1 << 8 * len(c)
                        self.texts.update({k: text(((number(c) + j) % top).to_bytes(len(c), "big")) for j, k in enumerate(codes)})
            last = []

    def codes(self, data: bytes) -> list[int]:
        if self.wide:
            return [int.from_bytes(data[k : k + 2], "big") for k in range(0, len(data) - 1, 2)]
        return list(data)

    def bytes_of(self, code: int) -> bytes:
        return code.to_bytes(2 if self.wide else 1, "big")

    def text(self, code: int) -> str:
        if code in self.texts:
            return self.texts[code]
        return "�" if self.wide else bytes([code]).decode(self.codec, "replace")

    def width(self, code: int) -> float:
        found = self.widths.get(code)
        if found is None:
            found = next((w for a, b, w in self.ranges if a <= code <= b), self.default)
        return float(helvetica(code, self.bold)) if found is None else found

    def encode(self, text: str) -> bytes | None:
        """Codes that show a text, or none where the font is not known to have every character of it."""
        if self._codes is None:
            known = {} if self.wide else {self.text(k): bytes([k]) for k in range(255, 31, -1) if not self.widths or self.widths.get(k)}
            known |= {t: self.bytes_of(k) for k, t in self.texts.items() if len(t) == 1}
            self._codes = known
        parts = [self._codes.get(c) for c in text]
        return None if None in parts else b"".join(parts)


@dataclass
class State:
    """What the operators of a content stream set."""

    ctm: Matrix = IDENTITY
    font: Font | None = None
    font_name: str = ""
    size: float = 0.0
    tc: float = 0.0
    tw: float = 0.0
    th: float = 1.0
    rise: float = 0.0
    leading: float = 0.0
    mode: int = 0
    tm: Matrix = IDENTITY
    tlm: Matrix = IDENTITY

    def move(self, x: float, y: float) -> None:
        self.tm = self.tlm = multiply((1, 0, 0, 1, x, y), self.tlm)


@dataclass
class Glyph:
    """One shown code: its text, box and baseline on the upright page, and how far it moves the pen."""

    code: int
    text: str
    box: list[float]
    start: tuple[float, float]
    end: tuple[float, float]
    along: tuple[float, float]
    size: float
    font: Font
    invisible: bool
    drawn: str | None = None


@dataclass
class Run:
    """The glyphs of one string as arrays: what ``Glyph`` says of each."""

    texts: list[str]
    boxes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    along: tuple[float, float]
    size: float
    font: Font
    invisible: bool


@dataclass
class Operation:
    """An operator with its operands and its place in the stream."""

    name: str
    args: list[Any]
    start: int
    end: int


def operations(data: bytes) -> Iterator[Operation]:
    """The operators of a content stream, as far as it can be read; an inline image is one, with its dictionary and
    bytes as operands."""
    lexer, args, start = Lexer(data), [], 0
    while True:
        if not args:
            start = lexer.at
        try:
            x = lexer.next()
        except Damaged:
            return
        if x is _END:
            return
        if isinstance(x, _Close):
            continue
        if not isinstance(x, Operator):
            args.append(x)
            if len(args) > MOST_OPERANDS:
                raise ValueError("an operator has too many operands")
            continue
        if x == "BI":
            args = [*_inline_image(lexer)]
        yield Operation(str(x), args, start, lexer.at)
        args = []


def _inline_image(lexer: Lexer) -> tuple[dict[str, Any], bytes]:
    info, key = {}, None
    while (x := lexer.next()) is not _END and x != "ID":
        if key is None:
            key = str(x)
        else:
            info[key], key = x, None
    at = lexer.at + 1
    end = re.compile(rb"\s?EI(?=[\x00\t\n\x0c\r ]|$)").search(lexer.data, at)
    lexer.at = end.end() if end else len(lexer.data)
    return info, lexer.data[at : end.start() if end else len(lexer.data)]


class Interpreter:
    """Runs content streams; keeps the words, rules and images it meets."""

    def __init__(self, pdf: Pdf, page: Page):
        self.pdf, self.page = pdf, page
        self.base, width, height = visual_matrix(page)
        self.out = Layout(width, height)
        self.fonts: dict[Any, Font] = pdf.fonts
        self.glyphs: list[Run | Glyph | None] = []
        self.stated: list[list | None] = []

    def font(self, resources: dict[str, Any], name: str) -> Font:
        fonts = self.pdf.get(resources.get("Font")) or {}
        key = fonts.get(name)
        cached = key if not isinstance(key, dict) else id(key)
        if cached not in self.fonts:
            self.fonts[cached] = Font(self.pdf, self.pdf.get(key))
        return self.fonts[cached]

    def shown(self, raw: bytes, s: State) -> Iterator[Glyph | None]:
        """The glyphs of a string; the pen moves along. None stands for one too small to count."""
        for code in s.font.codes(raw):
            w = s.font.width(code) / 1000.0
            trm = multiply((s.size * s.th, 0, 0, s.size, 0, s.rise), multiply(s.tm, multiply(s.ctm, self.base)))
            size = math.hypot(trm[2], trm[3])
            space = s.tw if code == 32 and not s.font.wide else 0.0
            s.tm = multiply((1, 0, 0, 1, (w * s.size + s.tc + space) * s.th, 0), s.tm)
            if size < SMALLEST:
                yield None
                continue
            corners = [apply(trm, x, y) for x in (0, w) for y in (-DESCENT, ASCENT)]
            xs, ys = zip(*corners)
            em = math.hypot(trm[0], trm[1]) or 1e-9
            along = (trm[0] / em, trm[1] / em)
            yield Glyph(
                code, s.font.text(code), [min(xs), min(ys), max(xs), max(ys)], apply(trm, 0, 0), apply(trm, w, 0), along, size, s.font, s.mode == 3
            )

    def run_of(self, raw: bytes, s: State) -> Run | None:
        """The glyphs of a string at once; None where they are too small to count. The pen moves along."""
        font = s.font
        if font.wide:
            codes = np.frombuffer(raw[: len(raw) // 2 * 2], ">u2")
            widths, texts = np.array([font.width(k) for k in codes.tolist()]) / 1000.0, [font.text(k) for k in codes.tolist()]
        else:
            codes = np.frombuffer(raw, np.uint8)
            table, names = font.tables()
            widths, texts = table[codes], [names[k] for k in raw]
        steps = (widths * s.size + s.tc) * s.th
        if s.tw and not font.wide:
            steps = steps + np.where(codes == 32, s.tw * s.th, 0.0)
        x = np.concatenate([[0.0], np.cumsum(steps)])
        a, b, c, d, e, f = multiply(s.tm, multiply(s.ctm, self.base))
        s.tm = multiply((1, 0, 0, 1, float(x[-1]), 0), s.tm)
        size = abs(s.size) * math.hypot(c, d)
        if size < SMALLEST or not len(codes):
            return None
        from_x = x[:-1]
        starts = np.stack([a * from_x + c * s.rise + e, b * from_x + d * s.rise + f], axis=1)
        wide = widths * s.size * s.th
        ends = starts + np.stack([a * wide, b * wide], axis=1)
        up = np.array([c, d]) * s.size
        corners = np.stack([starts - DESCENT * up, starts + ASCENT * up, ends - DESCENT * up, ends + ASCENT * up])
        em = s.size * s.th
        length = math.hypot(a * em, b * em) or 1e-9
        boxes = np.concatenate([corners.min(axis=0), corners.max(axis=0)], axis=1)
        return Run(texts, boxes, starts, ends, (a * em / length, b * em / length), size, font, s.mode == 3)

    def show(self, raw: bytes, s: State) -> None:
        """Keep the glyphs of a string, with the text that is stated for them."""
        if s.font is None:
            return
        if all(x is None for x in self.stated):
            if raw and (run := self.run_of(raw, s)) is not None:
                self.glyphs.append(run)
            return
        for g in self.shown(raw, s):
            if g is None:
                continue
            within = next((x for x in reversed(self.stated) if x is not None), None)
            if within is not None:
                g.drawn = g.text
                if not within[0]:
                    continue
                if within[1]:
                    self._extend(g)
                    continue
                within[1], g.text = True, within[0]
            self.glyphs.append(g if g.text.strip() else None)

    def _extend(self, g: Glyph) -> None:
        last = self.glyphs[-1] if self.glyphs else None
        if isinstance(last, Glyph):
            xs, ys = (g.start[0], g.end[0]), (g.start[1], g.end[1])
            b = last.box
            last.box = [min(b[0], *xs), min(b[1], *ys), max(b[2], *xs), max(b[3], *ys)]
            last.end, last.drawn = g.end, (last.drawn or "") + (g.drawn or "")

    def run(self, data: bytes, resources: dict[str, Any], s: State, depth: int = 0) -> None:
        """One content stream; forms are run where they are drawn."""
        stack: list[State] = []
        path = Path(self, s)
        for op in operations(data):
            try:
                self.operate(op, s, stack, resources, path, depth)
            except (IndexError, TypeError, ValueError, AttributeError):
                continue

    def operate(self, op: Operation, s: State, stack: list[State], resources: dict[str, Any], path: Path, depth: int) -> None:
        """One operator."""
        name, a = op.name, op.args
        if name == "q":
            stack.append(replace(s))
        elif name == "Q" and stack:
            s.__dict__.update(stack.pop().__dict__)
        elif name == "cm":
            s.ctm = multiply(tuple(map(float, a[-6:])), s.ctm)
        elif name == "BT":
            s.tm = s.tlm = IDENTITY
        elif name == "Tf":
            s.font, s.font_name, s.size = self.font(resources, a[-2]), str(a[-2]), float(a[-1])
        elif name in ("Tc", "Tw", "Ts", "TL"):
            setattr(s, {"Tc": "tc", "Tw": "tw", "Ts": "rise", "TL": "leading"}[name], float(a[-1]))
        elif name == "Tz":
            s.th = float(a[-1]) / 100
        elif name == "Tr":
            s.mode = int(a[-1])
        elif name in ("Td", "TD"):
            s.leading = -float(a[-1]) if name == "TD" else s.leading
            s.move(float(a[-2]), float(a[-1]))
        elif name == "Tm":
            s.tm = s.tlm = tuple(map(float, a[-6:]))
        elif name in ("T*", "'", '"'):
            if name == '"':
                s.tw, s.tc = float(a[-3]), float(a[-2])
            s.move(0, -s.leading)
            if name != "T*":
                self.show(a[-1], s)
        elif name == "Tj":
            self.show(a[-1], s)
        elif name == "TJ":
            for part in a[-1]:
                if isinstance(part, bytes):
                    self.show(part, s)
                else:
                    s.tm = multiply((1, 0, 0, 1, -float(part) / 1000 * s.size * s.th, 0), s.tm)
        elif name in ("BMC", "BDC"):
            self.stated.append(self._statement(a[-1] if name == "BDC" else None, resources))
        elif name == "EMC" and self.stated:
            self.stated.pop()
        elif name == "Do":
            self.draw((self.pdf.get(resources.get("XObject")) or {}).get(a[-1]), s, resources, depth)
        elif name == "BI":
            self.image(None, Stream(a[0], a[1]), s)
        else:
            path.operate(name, a)

    def _statement(self, x: Any, resources: dict[str, Any]) -> list | None:
        if isinstance(x, str):
            x = self.pdf.get((self.pdf.get(resources.get("Properties")) or {}).get(x))
        text = self.pdf.get(x.get("ActualText")) if isinstance(x, dict) else None
        return None if text is None else [text_string(text), False]

    def draw(self, key: Any, s: State, resources: dict[str, Any], depth: int) -> None:
        """A form or an image."""
        x = self.pdf.get(key)
        kind = self.pdf.get(x.info.get("Subtype")) if isinstance(x, Stream) else None
        if kind == "Form" and depth < MOST_FORMS:
            m = self.pdf.get(x.info.get("Matrix")) or IDENTITY
            inner = replace(s, ctm=multiply(tuple(float(self.pdf.get(v)) for v in m), s.ctm))
            self.run(self.pdf.decode(x), self.pdf.get(x.info.get("Resources")) or resources, inner, depth + 1)
        elif kind == "Image":
            self.image(key, x, s)

    def image(self, key: Any, x: Stream, s: State) -> None:
        self.out.images.append((key, x, bounds(multiply(s.ctm, self.base), 0, 0, 1, 1)))

    def rule(self, a: tuple[float, float], b: tuple[float, float]) -> None:
        """Keep a straight stroke."""
        (x0, x1), (y0, y1) = sorted((a[0], b[0])), sorted((a[1], b[1]))
        if y1 - y0 < STRAIGHT and x1 - x0 > LONG:
            self.out.rules.append((True, (y0 + y1) / 2, x0, x1))
        elif x1 - x0 < STRAIGHT and y1 - y0 > LONG:
            self.out.rules.append((False, (x0 + x1) / 2, y0, y1))

    def finish(self) -> Layout:
        self.out.words = words_of(self.glyphs)
        return self.out


class Path:
    """The path that is being made, as polylines on the upright page."""

    def __init__(self, run: Interpreter, s: State):
        self.run, self.s = run, s
        self.lines: list[list[tuple[float, float]]] = []
        self.curved = False

    def operate(self, name: str, a: list[Any]) -> None:
        whole = multiply(self.s.ctm, self.run.base)
        if name == "m":
            self.lines.append([apply(whole, float(a[-2]), float(a[-1]))])
        elif name == "l" and self.lines:
            self.lines[-1].append(apply(whole, float(a[-2]), float(a[-1])))
        elif name in ("c", "v", "y") and self.lines:
            # A curve is no rule; it goes on from its end.
            self.curved = True
            self.lines.append([apply(whole, float(a[-2]), float(a[-1]))])
        elif name == "re":
            x, y, w, h = map(float, a[-4:])
            corners = [apply(whole, *p) for p in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]
            self.lines.append([*corners, corners[0]])
        elif name == "h" and self.lines and len(self.lines[-1]) > 1:
            self.lines[-1].append(self.lines[-1][0])
        elif name in ("S", "s", "f", "F", "f*", "B", "B*", "b", "b*", "n"):
            self.paint(name)
            self.lines, self.curved = [], False

    def box(self) -> list[float] | None:
        points = [p for line in self.lines for p in line]
        if not points:
            return None
        xs, ys = zip(*points)
        return [min(xs), min(ys), max(xs), max(ys)]

    def paint(self, name: str) -> None:
        if name == "n":
            return
        if name in ("S", "s", "B", "B*", "b", "b*"):
            for line in self.lines:
                line = [*line, line[0]] if name in ("s", "b", "b*") and len(line) > 1 else line
                for a, b in zip(line, line[1:]):
                    self.run.rule(a, b)
        elif not self.curved and len(self.lines) >= 1:
            for line in self.lines:
                xs, ys = zip(*line)
                x0, x1, y0, y1 = min(xs), max(xs), min(ys), max(ys)
                if y1 - y0 < THIN and x1 - x0 > LONG:
                    self.run.rule((x0, (y0 + y1) / 2), (x1, (y0 + y1) / 2))
                elif x1 - x0 < THIN and y1 - y0 > LONG:
                    self.run.rule(((x0 + x1) / 2, y0), ((x0 + x1) / 2, y1))


def words_of(pieces: list[Run | Glyph | None]) -> list[Word]:
    """Glyphs in drawing order as words; white space, and None, which stands for it, ends a word.

    All neighbours are compared at once. Only where glyphs differ in size are words walked, since a glyph is measured
    against the size of its word's first one.
    """
    texts: list[str] = []
    drawn: dict[int, str] = {}
    arrays: list[tuple] = []
    fonts: list[Font] = []
    position: list[np.ndarray] = []
    at = 0
    for p in pieces:
        if p is None:
            at += 1
            continue
        if isinstance(p, Glyph):
            if p.drawn is not None:
                drawn[len(texts)] = p.drawn
            texts.append(p.text)
            arrays.append((np.array([p.box]), np.array([p.start]), np.array([p.end]), np.array([[*p.along, p.size, p.invisible, len(fonts)]])))
            position.append(np.array([at]))
            at += 1
        else:
            kept = [k for k, t in enumerate(p.texts) if t.strip()]
            if kept:
                texts += [p.texts[k] for k in kept]
                state = np.broadcast_to(np.array([*p.along, p.size, p.invisible, len(fonts)]), (len(kept), 5))
                arrays.append((p.boxes[kept], p.starts[kept], p.ends[kept], state))
                position.append(np.array(kept) + at)
            at += len(p.texts)
        fonts.append(p.font)
    if not texts:
        return []
    boxes, start, end, state = (np.concatenate(x) for x in zip(*arrays))
    place = np.concatenate(position)
    along, size, unseen, owner = state[:, :2], state[:, 2], state[:, 3], state[:, 4].astype(int)
    n = len(texts)
    step = start[1:] - end[:-1]
    ahead = (step * along[1:]).sum(axis=1)
    aside = np.abs(step[:, 0] * along[1:, 1] - step[:, 1] * along[1:, 0])
    near = (ahead < NEAR * size[1:]) & (ahead > OVERLAP * size[1:]) & (aside < ASIDE * size[1:])
    joins = near & (unseen[1:] == unseen[:-1]) & (np.diff(place) == 1)
    alike = np.abs(np.diff(size)) < SAME_SIZE * size[1:]
    new = np.concatenate([[True], ~(joins & alike)])
    first = np.flatnonzero(new)
    spread = np.maximum.reduceat(size, first) - np.minimum.reduceat(size, first)
    if (spread > 1e-9 * size[first]).any() or (joins & ~alike).any():
        anchor = size[0]
        for k in range(1, n):
            new[k] = not joins[k - 1] or abs(anchor - size[k]) >= SAME_SIZE * size[k]
            anchor = size[k] if new[k] else anchor
        first = np.flatnonzero(new)
    low, high = np.minimum.reduceat(boxes[:, :2], first).tolist(), np.maximum.reduceat(boxes[:, 2:], first).tolist()
    starts, ends, sizes = start.tolist(), end.tolist(), size.tolist()
    out = []
    for k, (a, b) in enumerate(zip(first.tolist(), [*first[1:].tolist(), n])):
        own = texts[a:b]
        seen = "".join(drawn.get(j, texts[j]) for j in range(a, b)) if drawn and any(j in drawn for j in range(a, b)) else None
        font = fonts[owner[a]]
        out.append(Word("".join(own), *low[k], *high[k], sizes[a], font.name, bool(unseen[a]), font.bold, font.italic, seen, (own, boxes[a:b]), tuple(starts[a]), tuple(ends[b - 1])))
    return out


def interpret(pdf: Pdf, page: Page) -> Layout:
    """Words, rules and images of a page."""
    run = Interpreter(pdf, page)
    run.run(pdf.content(page), pdf.get(page.info.get("Resources")) or {}, State())
    return run.finish()


# Brackets that are drawn as their mirror images in text running from the right.
MIRRORED = {"(": ")", ")": "(", "[": "]", "]": "[", "{": "}", "}": "{", "<": ">", ">": "<", "«": "»", "»": "«"}


def _levels(text: str, base: int) -> list[int]:
    """Embedding levels of the characters: strong ones by their direction, numbers above text that runs from the right,
    neutral ones with their neighbours where these agree, else with the base."""
    kinds = [unicodedata.bidirectional(c) for c in text]
    strong = {"L": 0, "R": 1, "AL": 1}
    level: list[int | None] = []
    last = base
    for kind in kinds:
        if kind in strong:
            last = strong[kind]
            level.append(last if last or not base else 2)
        elif kind in ("EN", "AN"):
            level.append(2 if last or base or kind == "AN" else 0)
        else:
            level.append(None)
    # A separator inside a number, and a sign beside one, belong to it.
    for k, kind in enumerate(kinds):
        if kind in ("CS", "ES") and 0 < k < len(kinds) - 1 and kinds[k - 1] == kinds[k + 1] and kinds[k - 1] in ("EN", "AN"):
            level[k] = level[k - 1]
        if kind == "NSM" and k:
            level[k] = level[k - 1]
    k = 0
    while k < len(level):
        if level[k] is not None:
            k += 1
            continue
        stop = k
        while stop < len(level) and level[stop] is None:
            stop += 1
        sides = {base if at < 0 or at >= len(level) else 1 if level[at] in (1, 2) and (level[at] == 1 or kinds[at] != "L") else 0 for at in (k - 1, stop)}
        direction = sides.pop() if len(sides) == 1 else base
        level[k:stop] = [1 if direction else 2 if base else 0] * (stop - k)
        k = stop
    return level


def _reads_plainly(text: str) -> bool:
    """Whether a text lies before the scripts that run from the right."""
    return text.isascii() or max(text) < "\u0590"


def reading_order(pieces: list[str]) -> list[tuple[int, bool]] | None:
    """The order in which pieces of a line are read, given from left to right, and whether each stands in text running
    from the right; None where nothing does."""
    text = "".join(pieces)
    if _reads_plainly(text):
        return None
    kinds = [unicodedata.bidirectional(c) for c in text]
    from_right = sum(k in ("R", "AL") for k in kinds)
    if not from_right:
        return None
    base = int(from_right > kinds.count("L"))
    whole, at, levels = _levels(text, base), 0, []
    for piece in pieces:
        levels.append(whole[at] if at < len(whole) else base)
        at += len(piece)
    order = list(range(len(pieces)))
    for level in range(max(levels), 0, -1):
        k = 0
        while k < len(order):
            stop = k
            while stop < len(order) and levels[order[stop]] >= level:
                stop += 1
            order[k:stop] = order[k:stop][::-1]
            k = max(stop, k + 1)
    return [(k, levels[k] % 2 == 1) for k in order]


def line_text(line: list[Word]) -> str:
    """The text of words from left to right, as it is read."""
    pieces: list[str] = []
    for k, w in enumerate(line):
        pieces += [" "] * (k > 0) + w.pieces
    order = reading_order(pieces)
    if order is None:
        return "".join(pieces)
    return "".join(MIRRORED.get(pieces[k], pieces[k]) if turned else pieces[k] for k, turned in order)


def lines_of(words: list[Word]) -> list[list[Word]]:
    """Words by lines, from the top; a word joins the last line if its centre is close to that of the line's first word."""
    lines: list[list[Word]] = []
    for w in sorted(words, key=lambda w: w.y0 + w.y1):
        if lines:
            anchor = lines[-1][0]
            if abs(anchor.y0 + anchor.y1 - w.y0 - w.y1) / 2 < 0.5 * min(anchor.size, w.size):
                lines[-1].append(w)
                continue
        lines.append([w])
    return [sorted(line, key=lambda w: w.x0) for line in lines]


def running_text(words: list[Word]) -> str:
    """Words in drawing order: a line ends where the next word stands apart from the one before, a paragraph where it
    stands further down than one line. A line that holds text running from the right is put in reading order."""
    out: list[str] = []
    line: list[Word] = []

    def finish() -> None:
        plain = " ".join(w.text for w in line)
        turned = not _reads_plainly(plain) and any(unicodedata.bidirectional(c) in ("R", "AL") for c in plain)
        out.append(line_text(sorted(line, key=lambda w: w.x0)) if turned else plain)

    for w in words:
        if line:
            before = line[-1]
            drop = abs(w.y0 + w.y1 - before.y0 - before.y1) / 2
            size = min(before.size, w.size)
            if drop >= LINE_DROP * size and math.dist(w.start, before.end) >= LINE_STEP * size:
                finish()
                out.append("\n\n" if drop > PARAGRAPH_DROP * max(before.size, w.size) else "\n")
                line = []
        line.append(w)
    if line:
        finish()
    return "".join(out)
