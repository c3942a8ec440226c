"""PDF files from Markdown, HTML or plain lines, set in the standard fonts.

Sizes, leading and gaps follow from the size of body text. Text beyond Latin-1 would need a font that is not available
in this build and is refused.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from ..functions.css import Look
from ..functions.text import HELVETICA, HELVETICA_BOLD, UNKNOWN_WIDTH
from .markdown import Block, Span, document
from .pdf import Name, Ref, Stream, Unsupported
from .pdf_edit import Refused, _tuple
from .pdf_writer import Writer, encode_text, outline_tree, serialise, standard_font, text_width

#: Leading, sizes of headings 1 to 6, and pages in points.
LEADING = 1.38
HEADINGS = (1.9, 1.5, 1.25, 1.1, 1.0, 1.0)
PAGES = {"a4": (595.28, 841.89), "letter": (612.0, 792.0)}
#: Fixed values, in sizes of body text: gaps after blocks, indents, code and table text.
AFTER_TEXT, AFTER_CODE, AFTER_TABLE, AFTER_LIST, AFTER_ITEM, LIST_INDENT, QUOTE_INDENT, CODE_SIZE, TABLE_SIZE = 0.6, 0.7, 0.8, 0.4, 0.3, 1.7, 1.3, 0.86, 0.92
PADDING = 5.0
LINK_COLOR = (13, 77, 191)

FONTS = {
    (False, False, False): "Helvetica", (True, False, False): "Helvetica-Bold", (False, True, False): "Helvetica-Oblique", (True, True, False): "Helvetica-BoldOblique",
    (False, False, True): "Courier", (True, False, True): "Courier-Bold", (False, True, True): "Courier-Oblique", (True, True, True): "Courier-BoldOblique",
}

Style = tuple[bool, bool, bool]


def width_of(text: str, style: Style, size: float) -> float:
    """Width of a text in the font of a style."""
    data = _encoded(text)
    if style[2]:
        return 0.6 * size * len(data)
    table = HELVETICA_BOLD if style[0] else HELVETICA
    return sum(table[b - 32] if 32 <= b <= 126 else UNKNOWN_WIDTH for b in data) * size / 1000


def _encoded(text: str) -> bytes:
    try:
        return text.encode("cp1252")
    except UnicodeEncodeError as error:
        raise Unsupported("a font for this text's characters is not available in this build") from error


@dataclass
class Word:
    """A word, or a piece glued to the one before, to be placed."""

    text: str
    style: Style
    link: str | None
    look: Look
    spaced: bool
    breaks: bool


Line = list[tuple[float, Word]]


def words(spans: list[Span], bold: bool = False) -> list[Word]:
    """The words of spans; white space and hard breaks are kept as marks on the word behind them."""
    out: list[Word] = []
    spaced = breaks = False
    for s in spans:
        for part in s.text.replace("\n", " \n ").split(" "):
            if part == "\n":
                breaks = True
            elif part:
                out.append(Word(part, (s.bold or bold, s.italic, s.mono), s.link, s.look, spaced, breaks))
                spaced = breaks = False
            if part != s.text or part == "":
                spaced = True
        # Only white space at the end of a span parts it from the next.
        spaced = s.text.endswith((" ", "\n")) or (spaced and not s.text.strip())
    return out


def wrap(ws: list[Word], size: float, width: float) -> list[Line]:
    """Words by lines no wider than ``width``, each with its distance from the left."""
    lines: list[Line] = []
    x = 0.0
    for w in ws:
        space = width_of(" ", w.style, size) if w.spaced else 0.0
        wide = width_of(w.text, w.style, size)
        if not lines or w.breaks or lines[-1] and x + space + wide > width:
            lines.append([])
            x = 0.0
        x += space if lines[-1] else 0.0
        lines[-1].append((x, w))
        x += wide
    return [line for line in lines if line]


def column_widths(wanted: list[float], needed: list[float], width: float) -> list[float]:
    """Widths of a table's columns: what they want if there is room; else words stay whole and what is left is shared
    by what each still wants; else shares of what words need."""
    if sum(wanted) <= width:
        return list(wanted)
    least = sum(needed)
    if least > width:
        return [n / least * width for n in needed]
    extra = max(1e-9, sum(wanted) - least)
    return [n + (w - n) / extra * (width - least) for w, n in zip(wanted, needed)]


def _paint(c: tuple[int, int, int]) -> bytes:
    return b" ".join(b"%.3f" % (v / 255) for v in c)


@dataclass
class _Page:
    ops: bytearray = field(default_factory=bytearray)
    links: list[tuple[list[float], str]] = field(default_factory=list)


class Setter:
    """Sets blocks on pages, from the top."""

    def __init__(self, size: tuple[float, float], margin: float, base: float, images: dict[str, tuple[str, float, float]]):
        self.width, self.height = size
        self.margin, self.base, self.images = margin, base, images
        self.pages: list[_Page] = []
        self.used: set[Style] = set()
        self.headings: list[tuple[int, str, int]] = []
        self.new_page()

    def new_page(self) -> None:
        self.pages.append(_Page())
        self.y = self.height - self.margin

    def need(self, height: float) -> None:
        if self.y - height < self.margin and self.y < self.height - self.margin:
            self.new_page()

    def gap(self, height: float) -> None:
        if self.y < self.height - self.margin:
            self.y -= height

    @property
    def ops(self) -> bytearray:
        return self.pages[-1].ops

    def draw(self, line: Line, x0: float, baseline: float, size: float) -> None:
        """The words of a line with what lies behind, under and through them; marks run on over the spaces between."""
        end, last = None, None
        for offset, w in line:
            x, wide = x0 + offset, width_of(w.text, w.style, size)
            since = end if end is not None and last == w.look and end <= x else x
            if w.look.highlight:
                self.ops.extend(_paint(w.look.highlight) + b" rg\n" + _tuple(since, baseline - 0.25 * size, x + wide - since, 1.1 * size) + b" re\nf\n")
            color = _paint(w.look.color or (LINK_COLOR if w.link else (0, 0, 0)))
            self.used.add(w.style)
            name = b"/F%d" % list(FONTS).index(w.style)
            self.ops.extend(b"BT\n%s rg\n%s %s Tf\n1 0 0 1 %s Tm\n%s Tj\nET\n" % (color, name, serialise(float(size)), _tuple(x, baseline), serialise(_encoded(w.text))))
            for on, at in ((w.look.underline, -0.12), (w.look.strike, 0.27)):
                if on:
                    self.ops.extend(color + b" rg\n" + _tuple(since, baseline + at * size, x + wide - since, 0.06 * size) + b" re\nf\n")
            if w.link:
                self.pages[-1].links.append(([x, baseline - 0.25 * size, x + wide, baseline + 0.8 * size], w.link))
            end, last = x + wide, w.look

    def _shift(self, line: Line, size: float, width: float, align: str | None) -> float:
        right = line[-1][0] + width_of(line[-1][1].text, line[-1][1].style, size)
        return {"right": width - right, "center": (width - right) / 2}.get(align, 0.0)

    def text(self, spans: list[Span], size: float, x0: float, width: float, bold: bool = False) -> None:
        look = spans[0].look if spans else Look()
        for line in wrap(words(spans, bold), size, width):
            self.need(size * LEADING)
            if look.fill:
                self.ops.extend(_paint(look.fill) + b" rg\n" + _tuple(x0, self.y - size * (LEADING + 0.12), width, size * LEADING) + b" re\nf\n")
            self.draw(line, x0 + self._shift(line, size, width, look.align), self.y - size, size)
            self.y -= size * LEADING

    def _size(self, spans: list[Span], usual: float) -> float:
        asked = spans[0].look.size if spans else None
        return usual if asked is None else min(96.0, max(4.0, asked[0] * (self.base if asked[1] else 1.0)))

    def block(self, b: Block, x0: float, width: float) -> None:
        base = self.base
        if b.kind == "text" and not b.level:
            self.text(b.spans, self._size(b.spans, base), x0, width)
            self.gap(AFTER_TEXT * base)
        elif b.kind == "text":
            size = self._size(b.spans, base * HEADINGS[b.level - 1])
            self.gap(0.6 * size)
            self.need((size + base) * LEADING)
            self.headings.append((b.level, "".join(s.text for s in b.spans).replace("\n", " "), len(self.pages)))
            self.text(b.spans, size, x0, width, True)
            self.gap(0.35 * size)
        elif b.kind == "rule":
            self.need(base)
            y = self.y - 0.3 * base
            self.ops.extend(b"0.6 G\n0.6 w\n" + _tuple(x0, y) + b" m\n" + _tuple(x0 + width, y) + b" l\nS\n")
            self.y -= base
        elif b.kind == "code":
            self._code(b.text, x0, width)
        elif b.kind == "list":
            self._list(b, x0, width)
        elif b.kind == "quote":
            page, top = len(self.pages), self.y
            for inner in b.parts:
                self.block(inner, x0 + QUOTE_INDENT * base, width - QUOTE_INDENT * base)
            top = top if len(self.pages) == page else self.height - self.margin
            bottom = self.y + 0.5 * base
            self.ops.extend(b"0.75 g\n" + _tuple(x0 + 0.3 * base, bottom, 2.5, max(0.0, top - bottom)) + b" re\nf\n")
        elif b.kind == "table":
            self._table(b.parts, x0, width)
        elif b.kind == "image" and b.text in self.images:
            name, natural, ratio = self.images[b.text]
            w = min(natural, width, (self.height - 2 * self.margin) / ratio)
            self.need(w * ratio)
            self.ops.extend(b"q\n" + _tuple(w, 0, 0, w * ratio, x0, self.y - w * ratio) + b" cm\n/" + name.encode() + b" Do\nQ\n")
            self.y -= w * ratio
            self.gap(AFTER_CODE * base)

    def _code(self, text: str, x0: float, width: float) -> None:
        size = CODE_SIZE * self.base
        height, style = 1.3 * size, (False, False, True)
        fit = max(1, int((width - 12) // (0.6 * size)))
        lines = [line.replace("\t", "    ") for line in text.rstrip("\n").split("\n")]
        for line in (part for whole in lines for part in [whole[k : k + fit] for k in range(0, len(whole), fit)] or [""]):
            self.need(height)
            self.ops.extend(b"0.95 g\n" + _tuple(x0, self.y - height, width, height) + b" re\nf\n")
            if line.strip():
                self.draw([(0.0, Word(line, style, None, Look(), False, False))], x0 + 6, self.y - size, size)
            self.y -= height
        self.gap(AFTER_CODE * self.base)

    def _list(self, b: Block, x0: float, width: float) -> None:
        base, indent = self.base, LIST_INDENT * self.base
        for k, item in enumerate(b.parts):
            self.need(base * LEADING)
            baseline = self.y - base
            if b.first is not None:
                self.draw([(0.0, Word(f"{b.first + k}.", (False, False, False), None, Look(), False, False))], x0, baseline, base)
            else:
                self.ops.extend(_dot(x0 + 0.5 * base, baseline + 0.3 * base, 0.14 * base))
            page = len(self.pages)
            for inner in item:
                self.block(inner, x0 + indent, width - indent)
            if len(self.pages) == page:
                self.y += AFTER_ITEM * base
        self.gap(AFTER_LIST * base)

    def _table(self, rows: list[list[tuple[list[Span], Look]]], x0: float, width: float) -> None:
        size, columns = TABLE_SIZE * self.base, max(map(len, rows))
        cells = [[(words(s, r == 0), look) for s, look in row] + [([], Look())] * (columns - len(row)) for r, row in enumerate(rows)]
        ends = lambda ws: [line[-1][0] + width_of(line[-1][1].text, line[-1][1].style, size) for line in wrap(ws, size, float("inf"))]
        single = lambda ws: [width_of(w.text, w.style, size) for w in ws]
        wanted = [max(max(ends(row[c][0]), default=0.0) for row in cells) + 2 * PADDING for c in range(columns)]
        needed = [max(max(single(row[c][0]), default=0.0) for row in cells) + 2 * PADDING for c in range(columns)]
        widths = column_widths(wanted, needed, width)
        for r, row in enumerate(cells):
            lines = [wrap(ws, size, w - 2 * PADDING) for (ws, _), w in zip(row, widths)]
            count = max(1, *map(len, lines))
            height = count * size * LEADING + 2 * PADDING - size * (LEADING - 1)
            self.need(height)
            x = x0
            for (_, look), own, w in zip(row, lines, widths):
                fill = _paint(look.fill) + b" rg\n" if look.fill else b"0.92 g\n" if r == 0 else b"1 g\n"
                self.ops.extend(fill + b"0.55 G\n0.5 w\n" + _tuple(x, self.y - height, w, height) + b" re\nB\n")
                for k, line in enumerate(own):
                    shift = self._shift(line, size, w - 2 * PADDING, look.align)
                    self.draw(line, x + PADDING + shift, self.y - PADDING - 0.82 * size - k * size * LEADING, size)
                x += w
            self.y -= height
        self.gap(AFTER_TABLE * self.base)


def _dot(x: float, y: float, r: float) -> bytes:
    """A filled circle of four curves; needs no glyph."""
    k = 0.5523 * r
    out = b"0 g\n" + _tuple(x + r, y) + b" m\n"
    for a, b in (((1, 0), (0, 1)), ((0, 1), (-1, 0)), ((-1, 0), (0, -1)), ((0, -1), (1, 0))):
        out += _tuple(x + r * a[0] + k * b[0], y + r * a[1] + k * b[1], x + r * b[0] + k * a[0], y + r * b[1] + k * a[1], x + r * b[0], y + r * b[1]) + b" c\n"
    return out + b"f\n"


def survey(blocks: list[Block]) -> tuple[dict[Style, set[str]], list[str]]:
    """The characters that every style has to draw, and the images."""
    chars: dict[Style, set[str]] = {}
    images: list[str] = []
    for b in blocks:
        rows = b.parts if b.kind == "table" else []
        spans = [(s, b.level > 0) for s in b.spans] + [(s, r == 0) for r, row in enumerate(rows) for cell, _ in row for s in cell]
        for s, bold in spans:
            chars.setdefault((s.bold or bold, s.italic, s.mono), set()).update(s.text)
        if b.kind == "code":
            chars.setdefault((False, False, True), set()).update(b.text)
        if b.kind == "image":
            images.append(b.text)
        inner = [x for item in b.parts for x in item] if b.kind == "list" else b.parts if b.kind == "quote" else []
        more, pictures = survey(inner)
        for style, own in more.items():
            chars.setdefault(style, set()).update(own)
        images += pictures
    return chars, images


def create(
    markdown: str,
    *,
    title: str | None = None,
    page_size: str = "a4",
    margin: float = 56.0,
    font_size: float = 11.0,
    image_of: Callable[[str], bytes | None] | None = None,
    blocks: list[Block] | None = None,
) -> tuple[bytes, dict[str, Any]]:
    """A file of Markdown, HTML in it included, and a report. ``image_of`` gives the bytes of an image by its source;
    remote ones are refused. Headings become bookmarks."""
    from .pdf_edit import embed_image

    size = PAGES[page_size]
    if not 4 <= font_size <= 72 or margin < 0 or size[0] - 2 * margin < 100:
        raise Refused("font size must be 4-72 points and the margin must leave at least 100 points of width")
    content, ignored = document(markdown) if blocks is None else (blocks, 0)
    chars, sources = survey(content)
    for style, own in chars.items():
        _encoded("".join(own - {"\n", "\t"}))
    out = Writer()
    root, tree = out.add(), out.add()
    images: dict[str, tuple[str, float, float]] = {}
    pictures: dict[str, Ref] = {}
    for source in dict.fromkeys(sources):
        if "://" in source:
            raise Refused(f"image '{source}' is remote; only local image files can be embedded")
        data = image_of(source) if image_of else None
        if data is None:
            raise Refused(f"cannot read image '{source}'")
        ref, ratio = embed_image(_Holder(out), data)
        name = f"Im{len(images)}"
        # Screen images are made at 96 pixels an inch.
        images[source] = name, out.objects[ref.number - 1].info["Width"] * 0.75, ratio
        pictures[name] = ref
    setter = Setter(size, margin, font_size, images)
    for b in content:
        setter.block(b, margin, size[0] - 2 * margin)
    fonts = {f"F{k}": out.add(standard_font(name)) for k, (style, name) in enumerate(FONTS.items()) if style in setter.used or k == 0}
    resources = out.add({"Font": fonts} | ({"XObject": pictures} if pictures else {}))
    pages = []
    for p in setter.pages:
        info: dict[str, Any] = {"Type": Name("Page"), "Parent": tree, "MediaBox": [0, 0, *size], "Resources": resources, "Contents": out.stream(bytes(p.ops))}
        if p.links:
            info["Annots"] = [
                out.add({"Type": Name("Annot"), "Subtype": Name("Link"), "Rect": r, "Border": [0, 0, 0], "A": {"S": Name("URI"), "URI": u.encode("utf-8")}}) for r, u in p.links
            ]
        pages.append(out.add(info))
    out.set(tree, {"Type": Name("Pages"), "Kids": pages, "Count": len(pages)})
    catalog: dict[str, Any] = {"Type": Name("Catalog"), "Pages": tree}
    if setter.headings:
        catalog["Outlines"] = outline_tree(out, [(level, text, [pages[n - 1], Name("Fit")]) for level, text, n in setter.headings])
    out.set(root, catalog)
    title = title if title is not None else setter.headings[0][1] if setter.headings else None
    info = {"Producer": b"papyra"} | ({"Title": encode_text(title)} if title else {})
    data = out.finish(root, out.add(info))
    return data, {"pages": len(pages), "title": title, "html_fragments_ignored": ignored, "size_bytes": len(data)}


class _Holder:
    """Lets a writer stand where objects are added to a file that was read."""

    def __init__(self, out: Writer):
        self.out = out
        self.entries: dict[int, Any] = {}
        self.cache = self

    def __iter__(self):
        return iter(range(1, len(self.out.objects) + 1))

    def __setitem__(self, number: int, x: Any) -> None:
        self.out.objects.append(x)


def lines_file(
    pages: list[list[str]],
    *,
    title: str | None = None,
    size: float = 10.0,
    leading: float = 12.0,
    left: float = 72.0,
    outline: list[tuple[int, str, int]] | None = None,
    links: list[tuple[int, list[float], str]] | None = None,
    drawing: dict[int, bytes] | None = None,
    font: str = "Helvetica",
    widen: bool = False,
) -> bytes:
    """A file with a page for each list of lines, set as they are from the top; pages grow with their lines.

    A line that is longer than the page is wide runs over its edge, unless pages ``widen`` with their lines, as measured
    in Helvetica. ``outline`` is (level, title, page), ``links`` (page, box from the top left, address), ``drawing`` more operators.
    """
    out = Writer()
    root, tree = out.add(), out.add()
    resources = out.add({"Font": {"F1": out.add(standard_font(font))}})
    refs = []
    for n, lines in enumerate(pages, 1):
        height = max(792.0, 144.0 + leading * len(lines))
        width = max(612.0, 2 * left + max((text_width(line, size) for line in lines), default=0.0)) if widen else 612.0
        body = b"BT /F1 %s Tf %s TL %s Td\n" % (serialise(size), serialise(leading), _tuple(left, height - 72 - 0.8 * size))
        body += b"".join(serialise(_encoded(line)) + b" Tj T*\n" for line in lines) + b"ET\n" + (drawing or {}).get(n, b"")
        info: dict[str, Any] = {"Type": Name("Page"), "Parent": tree, "MediaBox": [0, 0, width, height], "Resources": resources, "Contents": out.stream(body)}
        own = [(box, url) for page, box, url in links or [] if page == n]
        if own:
            info["Annots"] = [
                out.add(
                    {
                        "Type": Name("Annot"), "Subtype": Name("Link"), "Rect": [b[0], height - b[3], b[2], height - b[1]], "Border": [0, 0, 0],
                        "A": {"S": Name("URI"), "URI": url.encode("latin-1", "replace")},
                    }
                )
                for b, url in own
            ]
        refs.append(out.add(info))
    out.set(tree, {"Type": Name("Pages"), "Kids": refs, "Count": len(refs)})
    catalog: dict[str, Any] = {"Type": Name("Catalog"), "Pages": tree}
    if outline:
        catalog["Outlines"] = outline_tree(out, [(level, text, [refs[n - 1], Name("Fit")]) for level, text, n in outline])
    out.set(root, catalog)
    return out.finish(root, out.add({"Title": encode_text(title)}) if title else None)


__all__ = ["Stream", "column_widths", "create", "lines_file", "survey", "wrap", "words"]
