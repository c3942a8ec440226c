"""Taking text, drawings and pixels out of pages, and writing other text in their place.

Content streams are run operator by operator; what is not touched is copied as it stands. Glyphs that go leave a
movement of their own width behind, so their neighbours stay. The result is read back and looked into before it is
handed on.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field, replace
from typing import Any

from ..functions.pagespec import page_numbers
from .pdf import Name, Page, Pdf, Ref, Stream, Unsupported, Word, text_string
from .pdf_edit import Area, Refused, _tenths, _to_user, add, add_resource, append_content, compile_patterns, live, own_resources, parse_rect, samples, text_areas
from .pdf_text import MOST_FORMS, Font, Glyph, Interpreter, Operation, Path, State, bounds, interpret, invert, lines_of, multiply, operations
from .pdf_writer import encode_text, save, serialise, standard_font, text_width

#: The share of a glyph's box that makes it hit, the slack of a drawing inside an area in points, how much
#: text is drawn together at most before it runs over, and the gap in font sizes that ends what moves along.
HIT, SLACK, NARROWEST, SQUEEZE, MOVES = 0.3, 0.5, 0.7, 0.08, 0.9

PAINTS = {"S", "s", "f", "F", "f*", "B", "B*", "b", "b*", "n"}
MAKES_PATH = {"m", "l", "c", "v", "y", "re", "h", "W", "W*"}
#: Long names of the short keys of inline images.
LONG = {"W": "Width", "H": "Height", "BPC": "BitsPerComponent", "CS": "ColorSpace", "F": "Filter", "DP": "DecodeParms", "D": "Decode", "IM": "ImageMask", "I": "Interpolate"}
LONG_VALUES = {"G": "DeviceGray", "RGB": "DeviceRGB", "CMYK": "DeviceCMYK", "I": "Indexed", "Fl": "FlateDecode", "AHx": "ASCIIHexDecode", "A85": "ASCII85Decode", "DCT": "DCTDecode"}


class Areas:
    """Areas by the bands of the page that they reach into, so that a glyph is compared with those near it only."""

    BAND = 16.0

    def __init__(self, areas: list[Area]):
        self.areas = areas
        self.bands: dict[int, list[int]] = {}
        for k, a in enumerate(areas):
            for band in range(math.floor(a[1] / self.BAND), math.floor(a[3] / self.BAND) + 1):
                self.bands.setdefault(band, []).append(k)

    def near(self, box: Area) -> list[int]:
        """Numbers of the areas that may meet a box, in rising order."""
        first, last = math.floor(box[1] / self.BAND), math.floor(box[3] / self.BAND)
        if first == last:
            return self.bands.get(first, [])
        return sorted({k for band in range(first, last + 1) for k in self.bands.get(band, ())})


def hit(box: Area, areas: Areas) -> int | None:
    """The first area that covers a glyph: its centre, or a substantial part of its box."""
    near = areas.near(box)
    if not near:
        return None
    x, y = (box[0] + box[2]) / 2, (box[1] + box[3]) / 2
    size = (box[2] - box[0]) * (box[3] - box[1])
    for k in near:
        a = areas.areas[k]
        shared = max(0.0, min(box[2], a[2]) - max(box[0], a[0])) * max(0.0, min(box[3], a[3]) - max(box[1], a[1]))
        if a[0] <= x <= a[2] and a[1] <= y <= a[3] or size > 0 and shared > HIT * size:
            return k
    return None


def crosses(a: Area, b: Area) -> bool:
    """Whether two boxes share more than an edge."""
    return a[0] < b[2] and b[0] < a[2] and a[1] < b[3] and b[1] < a[3]


@dataclass
class Written:
    """How a replacement came out: in the original font or another, the old and new width, what is left over."""

    own_font: bool
    old: float
    new: float
    overflow: float = 0.0
    narrowed: bool = False


@dataclass
class Changes:
    """What is to go from a page, what stands in its place, and what was done."""

    areas: list[Area]
    texts: list[str] | None = None
    #: Per area how much wider its line may get, and what moves along on its line: (from x, to x, y, by).
    room: list[float] = field(default_factory=list)
    moves: list[tuple[float, float, float, float]] = field(default_factory=list)
    done: Counter = field(default_factory=Counter)
    written: dict[int, Written] = field(default_factory=dict)


class Rewriter(Interpreter):
    """Runs a page's content and writes it anew without what is hit."""

    def __init__(self, pdf: Pdf, page: Page, changes: Changes):
        super().__init__(pdf, page)
        self.changes, self.areas = changes, Areas(changes.areas)
        self.forms: dict[Any, Any] = {}

    def rewrite(self, data: bytes, resources: dict[str, Any], s: State, depth: int = 0) -> tuple[bytes, bool]:
        """The new content, and whether it differs; new resources are added to ``resources``."""
        out, changed = bytearray(), False
        stack: list[State] = []
        path, pending = Path(self, s), bytearray()
        clips = False
        for op in operations(data):
            raw = data[op.start : op.end]
            if op.name in MAKES_PATH:
                clips |= op.name in ("W", "W*")
                pending += raw + b"\n"
                path.operate(op.name, op.args)
                continue
            if op.name in PAINTS:
                box = path.box()
                gone = not clips and op.name != "n" and box is not None and self.changes.texts is None and self._covered(box)
                if gone:
                    self.changes.done["paths"] += 1
                    changed = True
                else:
                    out += pending + raw + b"\n"
                path.operate(op.name, op.args)
                pending, clips = bytearray(), False
                continue
            try:
                new = self._operation(op, s, stack, resources, depth)
            except (IndexError, TypeError, AttributeError):
                new = None
            changed |= new is not None
            out += (raw if new is None else new) + b"\n"
        return bytes(out + pending), changed

    def _covered(self, box: Area) -> bool:
        return any(box[0] >= a[0] - SLACK and box[1] >= a[1] - SLACK and box[2] <= a[2] + SLACK and box[3] <= a[3] + SLACK for a in self.changes.areas)

    def _operation(self, op: Operation, s: State, stack: list[State], resources: dict[str, Any], depth: int) -> bytes | None:
        """What replaces an operator; None where it stays as it is."""
        name, a = op.name, op.args
        if name in ("Tj", "'", '"', "TJ"):
            before = b""
            if name in ("'", '"'):
                if name == '"':
                    s.tw, s.tc = float(a[-3]), float(a[-2])
                    before = serialise(a[-3]) + b" Tw " + serialise(a[-2]) + b" Tc "
                s.move(0, -s.leading)
                before += b"T* "
            parts = a[-1] if name == "TJ" else [a[-1]]
            new = self._text(parts, s, resources)
            return None if new is None else before + new
        if name == "Do":
            return self._drawn(a[-1], s, resources, depth)
        if name == "BI":
            return self._inline(a[0], a[1], s, resources)
        self.operate(op, s, stack, resources, Path(self, s), depth)
        return None

    def _text(self, parts: list[Any], s: State, resources: dict[str, Any]) -> bytes | None:
        """Glyphs that are hit go; a movement keeps the others in place, and the replacement is written at the first."""
        if s.font is None:
            return None
        out: list[Any] = []
        pieces: list[bytes] = []
        changed = False
        shift = self._shift(s)
        if shift:
            out.append(-shift * 1000 / (s.size * s.th))
            changed = True

        def close() -> None:
            if out:
                pieces.append(serialise(out) + b" TJ")
                out.clear()

        for part in parts:
            if not isinstance(part, bytes):
                out.append(part)
                s.tm = multiply((1, 0, 0, 1, -float(part) / 1000 * s.size * s.th, 0), s.tm)
                continue
            codes = s.font.codes(part)
            for code, g in zip(codes, self.shown(part, s)):
                k = None if g is None or not g.text.strip() and self.changes.texts is None else hit(g.box, self.areas)
                if k is None:
                    data = s.font.bytes_of(code)
                    out[-1:] = [out[-1] + data] if out and isinstance(out[-1], bytes) else [*out[-1:], data]
                    continue
                changed = True
                self.changes.done["glyphs"] += 1
                space = s.tw if code == 32 and not s.font.wide else 0.0
                step = s.font.width(code) + (s.tc + space) * 1000 / s.size
                if self.changes.texts is None:
                    out.append(-step)
                elif k not in self.changes.written:
                    close()
                    pieces.append(self._replacement(k, g, s, resources))
        close()
        return b" ".join(pieces) if changed else None

    def _shift(self, s: State) -> float:
        """How far a string that was placed afresh moves along, in text space."""
        if not self.changes.moves or s.tm != s.tlm:
            return 0.0
        whole = multiply(s.tm, multiply(s.ctm, self.base))
        scale = math.hypot(whole[0], whole[1])
        for x0, x1, y, by in self.changes.moves:
            if x0 <= whole[4] + 0.5 <= x1 + 0.5 and abs(whole[5] - y) < 0.5 * s.size * scale:
                return by / scale
        return 0.0

    def _replacement(self, k: int, g: Glyph, s: State, resources: dict[str, Any]) -> bytes:
        """Operators that show the replacement of an area, drawn together where there is no room for its width."""
        text, area = self.changes.texts[k], self.changes.areas[k]
        scale = math.hypot(g.end[0] - g.start[0], g.end[1] - g.start[1]) / max(s.font.width(g.code) / 1000 * s.size * s.th, 1e-9) or 1.0
        own = s.font.encode(text)
        if own is not None:
            width = sum(s.font.width(c) / 1000 * s.size + s.tc + (s.tw if c == 32 and not s.font.wide else 0) for c in s.font.codes(own)) * s.th * scale
        else:
            if text.encode("cp1252", "replace").decode("cp1252") != text:
                raise Unsupported("a font with the new text's characters is not available in this build")
            width = text_width(text, s.size) * s.th * scale
        old = area[2] - area[0]
        room = self.changes.room[k] if self.changes.room else math.inf
        th, narrowed = s.th, False
        if width > old + room and width > 0:
            th = s.th * max(NARROWEST, (old + room) / width)
            narrowed = th / s.th < 1 - SQUEEZE
            width *= th / s.th
        self.changes.written[k] = Written(own is not None, old, width, max(0.0, width - old - room), narrowed)
        tz = lambda v: serialise(float(v * 100)) + b" Tz "
        out = tz(th) if th != s.th else b""
        if own is None:
            name = add_resource(resources, "Font", "PapyraF", self._substitute())
            out += b"/%s %s Tf %s Tj /%s %s Tf" % (name.encode(), serialise(float(s.size)), serialise(text.encode("cp1252")), s.font_name.encode("latin-1"), serialise(float(s.size)))
        else:
            out += serialise(own) + b" Tj"
        return out + (b" " + tz(s.th) if th != s.th else b"")

    def _substitute(self) -> Ref:
        if "font" not in self.forms:
            self.forms["font"] = add(self.pdf, standard_font())
        return self.forms["font"]

    def _drawn(self, name: str, s: State, resources: dict[str, Any], depth: int) -> bytes | None:
        group = self.pdf.get(resources.get("XObject")) or {}
        x = self.pdf.get(group.get(name))
        kind = self.pdf.get(x.info.get("Subtype")) if isinstance(x, Stream) else None
        if kind == "Form" and depth < MOST_FORMS:
            m = tuple(float(self.pdf.get(v)) for v in self.pdf.get(x.info.get("Matrix")) or (1, 0, 0, 1, 0, 0))
            found = self.pdf.get(x.info.get("Resources")) or resources
            inner = {k: dict(v) if isinstance(v := self.pdf.get(y), dict) else y for k, y in found.items()}
            body, changed = self.rewrite(self.pdf.decode(x), inner, replace(s, ctm=multiply(m, s.ctm)), depth + 1)
            if not changed:
                return None
            # A copy, so that other pages which draw the form keep theirs.
            info = {k: v for k, v in x.info.items() if k not in ("Filter", "DecodeParms", "Length")} | {"Resources": inner}
            return b"/" + self._put(resources, "PapyraFm", Stream(info, body)) + b" Do"
        if kind == "Image" and self.changes.texts is None:
            new = self._blanked(x, s)
            return None if new is None else b"/" + self._put(resources, "PapyraIm", new) + b" Do"
        return None

    def _put(self, resources: dict[str, Any], base: str, x: Stream) -> bytes:
        if not isinstance(resources.get("XObject"), dict):
            resources["XObject"] = dict(self.pdf.get(resources.get("XObject")) or {})
        return add_resource(resources, "XObject", base, add(self.pdf, x)).encode()

    def _inline(self, info: dict[str, Any], data: bytes, s: State, resources: dict[str, Any]) -> bytes | None:
        box = bounds(multiply(s.ctm, self.base), 0, 0, 1, 1)
        if self.changes.texts is not None or not any(crosses(box, a) for a in self.changes.areas):
            return None
        long = lambda v: [long(x) for x in v] if isinstance(v, list) else Name(LONG_VALUES.get(v, v)) if isinstance(v, str) else v
        own = {LONG.get(k, k): long(v) for k, v in info.items()}
        spaces = self.pdf.get(resources.get("ColorSpace")) or {}
        if own.get("ColorSpace") in spaces:
            own["ColorSpace"] = spaces[own["ColorSpace"]]
        x = Stream({"Type": Name("XObject"), "Subtype": Name("Image"), **own}, data)
        return b"/" + self._put(resources, "PapyraIm", self._blanked(x, s) or x) + b" Do"

    def _blanked(self, x: Stream, s: State) -> Stream | None:
        """An image whose samples inside the areas are zero, its soft mask likewise; None where no area meets it."""
        whole = multiply(s.ctm, self.base)
        box = bounds(whole, 0, 0, 1, 1)
        areas = [a for a in self.changes.areas if crosses(box, a)]
        if not areas:
            return None
        self.changes.done["images"] += 1
        back = invert(whole)
        if back is None:
            return None
        units = [bounds(back, *a) for a in areas]
        out = self._zeroed(x, units)
        mask = self.pdf.get(x.info.get("SMask"))
        if isinstance(mask, Stream):
            out.info["SMask"] = add(self.pdf, self._zeroed(mask, units))
        return out

    def _zeroed(self, x: Stream, units: list[Area]) -> Stream:
        try:
            width, height, channels, data = samples(self.pdf, x)
        except Unsupported as error:
            raise Refused(f"an image under an area cannot be blanked: {error}") from error
        pixels = bytearray(data)
        for u in units:
            # Image space is the unit square, its first row at the top.
            x0, x1 = max(0, math.floor(u[0] * width)), min(width, math.ceil(u[2] * width))
            y0, y1 = max(0, math.floor((1 - u[3]) * height)), min(height, math.ceil((1 - u[1]) * height))
            for row in range(y0, y1):
                a = (row * width + x0) * channels
                pixels[a : a + max(0, x1 - x0) * channels] = bytes(max(0, x1 - x0) * channels)
        gone = ("Filter", "DecodeParms", "Length", "ColorSpace", "BitsPerComponent", "ImageMask", "Decode", "Mask")
        info = {k: v for k, v in x.info.items() if k not in gone}
        info |= {"ColorSpace": Name("DeviceGray" if channels == 1 else "DeviceRGB"), "BitsPerComponent": 8, "Filter": Name("FlateDecode")}
        return Stream(info, zlib.compress(bytes(pixels)))


def _rewrite_page(pdf: Pdf, page: Page, changes: Changes) -> None:
    resources = own_resources(pdf, page)
    body, changed = Rewriter(pdf, page, changes).rewrite(pdf.content(page), resources, State())
    if changed:
        own = live(pdf, page)
        own["Contents"] = page.info["Contents"] = add(pdf, Stream({"Filter": Name("FlateDecode")}, zlib.compress(body)))


def _drop_annotations(pdf: Pdf, page: Page, areas: list[Area]) -> int:
    """Annotations that an area meets go, and with a widget its field's value."""
    own = live(pdf, page)
    user = [_to_user(page, a) for a in areas]
    kept, gone = [], 0
    for x in pdf.get(own.get("Annots")) or []:
        a = pdf.get(x)
        box = pdf._box(a.get("Rect")) if isinstance(a, dict) else None
        if box is None or not any(crosses(box, u) for u in user):
            kept.append(x)
            continue
        gone += 1
        while isinstance(a, dict):
            for key in ("V", "DV", "RV", "AP", "Contents", "RC"):
                a.pop(key, None)
            a = pdf.get(a.get("Parent")) if "Parent" in a else None
    if gone:
        own["Annots"] = kept
    return gone


def struck(text: str, patterns: list[re.Pattern]) -> str:
    """A text without the matches, pattern after pattern."""
    for p in patterns:
        text = p.sub("", text)
    return text


def _outline_items(pdf: Pdf) -> list[dict[str, Any]]:
    root = pdf.get(pdf.catalog.get("Outlines"))
    todo, seen, out = [root.get("First")] if isinstance(root, dict) else [], set(), []
    while todo:
        x = todo.pop()
        item = pdf.get(x)
        if isinstance(item, dict) and id(item) not in seen:
            seen.add(id(item))
            out.append(item)
            todo += [item.get("Next"), item.get("First")]
    return out


def _clean_beside(pdf: Pdf, patterns: list[re.Pattern]) -> dict[str, Any]:
    """The texts taken out of metadata and bookmark titles; XMP that holds them goes; attachments are only reported."""
    report = {"metadata_fields_cleaned": [], "xmp_metadata_removed": False, "bookmarks_cleaned": 0, "attachments_holding_the_text": []}
    info = pdf.get(pdf.trailer.get("Info"))
    for key, v in list(info.items()) if isinstance(info, dict) else []:
        text = text_string(v := pdf.get(v)) if isinstance(pdf.get(v), bytes) else ""
        if text and (left := struck(text, patterns)) != text:
            info[key] = encode_text(left)
            report["metadata_fields_cleaned"].append(key)
    for item in _outline_items(pdf):
        text = text_string(pdf.get(item.get("Title")))
        if (left := struck(text, patterns)) != text:
            item["Title"] = encode_text(left)
            report["bookmarks_cleaned"] += 1
    holds = lambda data: any(p.search(data.decode(c, "ignore")) for p in patterns for c in ("utf-8", "utf-16-le", "utf-16-be"))
    xmp = pdf.get(pdf.catalog.get("Metadata"))
    if isinstance(xmp, Stream) and holds(pdf.decode(xmp)):
        pdf.catalog.pop("Metadata")
        report["xmp_metadata_removed"] = True
    for number in list(pdf.entries):
        spec = pdf._quietly(number)
        files = pdf.get(spec.get("EF")) if isinstance(spec, dict) else None
        for key in ("UF", "F") if isinstance(files, dict) else ():
            x = pdf.get(files.get(key))
            if isinstance(x, Stream):
                try:
                    found = holds(pdf.decode(x))
                except ValueError:
                    found = False
                if found:
                    report["attachments_holding_the_text"].append(text_string(pdf.get(spec.get("UF", spec.get("F")))))
                break
    return report


def redact(
    pdf: Pdf, *, texts: tuple[str, ...] = (), rects: tuple[str, ...] = (), regex: bool = False, case_sensitive: bool = False, spec: str | None = None
) -> tuple[bytes, dict[str, Any]]:
    """Texts and areas taken out of pages for good, black boxes in their place.

    The result is read back and looked into; a glyph that is left inside an area is an error.
    """
    if not texts and not rects:
        raise Refused("nothing to redact: give rects (page:x0,y0,x1,y1) or texts to find")
    pages = pdf.pages()
    areas: dict[int, list[Area]] = {}
    found_by: dict[int, list[str | None]] = {}
    for r in rects:
        n, area = parse_rect(r, len(pages))
        areas.setdefault(n, []).append(area)
        found_by.setdefault(n, []).append(None)
    patterns = compile_patterns(texts, regex=regex, case_sensitive=case_sensitive)
    matches = 0
    for n in dict.fromkeys(page_numbers(spec, len(pages))) if patterns else []:
        for area, match, _ in text_areas(interpret(pdf, pages[n - 1]).words, patterns):
            areas.setdefault(n, []).append(area)
            found_by.setdefault(n, []).append(match)
            matches += 1
    beside = _clean_beside(pdf, patterns) if patterns else None
    if not areas and not (beside and (beside["metadata_fields_cleaned"] or beside["xmp_metadata_removed"] or beside["bookmarks_cleaned"])):
        raise Refused("none of the texts were found; nothing was written")
    report = []
    for n in sorted(areas):
        page, changes = pages[n - 1], Changes(areas[n])
        _rewrite_page(pdf, page, changes)
        gone = _drop_annotations(pdf, page, areas[n])
        boxes = b"".join(serialise([v[0], v[1], v[2] - v[0], v[3] - v[1]])[1:-1] + b" re\n" for v in (_to_user(page, a) for a in areas[n]))
        append_content(pdf, page, b"q\n0 0 0 rg\n" + boxes + b"f\nQ\n")
        targets = [{"bbox": _tenths(a)} | ({"text": t} if t else {}) for a, t in zip(areas[n], found_by[n])]
        report.append(
            {
                "page": n, "areas": len(areas[n]), "glyphs_removed": changes.done["glyphs"], "paths_removed": changes.done["paths"],
                "images_blanked": changes.done["images"], "annotations_removed": gone, "targets": targets,
            }
        )
    # The structure tree can repeat a page's text, and nothing ties that to areas.
    for key in ("StructTreeRoot", "MarkInfo"):
        pdf.catalog.pop(key, None)
    data, _ = save(pdf)
    check = Pdf(data, pdf.password)
    for n in sorted(areas):
        words = interpret(check, check.pages()[n - 1]).words
        index = Areas(areas[n])
        left = sum(hit(box, index) is not None for w in words for _, _, box in w.parts)
        if left:
            raise Refused(f"page {n}: {left} glyphs are still inside a redacted area after rewriting; nothing was written")
    out = {"text_matches": matches, "pages": report, "verified": True}
    return data, out | ({"beside_pages": beside} if beside else {})


def _plan(words: list[Word], rules: list, areas: list[Area], width: float) -> tuple[list[float], list[list[Word]]]:
    """Per area the room to the right of its run of words, and the words behind it that move along.

    A run ends at a gap wider than between words. Room ends at the next word on the line, at a rule across it, or at
    the right edge of the text, which the longest line near it shows, or else at a margin like the left one.
    """
    rooms, follow = [], []
    lines = lines_of(words)
    left = min((w.x0 for w in words), default=0.0)
    for a in areas:
        middle = (a[1] + a[3]) / 2
        line = min(lines, key=lambda ws: abs((ws[0].y0 + ws[0].y1) / 2 - middle), default=[])
        behind, edge, size = [], a[2], a[3] - a[1]
        rest = [w for w in line if w.x0 >= a[2] - 0.3 * size]
        for w in rest:
            if w.x0 - edge >= MOVES * w.size:
                break
            behind.append(w)
            edge = w.x1
        near = [max(w.x1 for w in ws) for ws in lines if abs((ws[0].y0 + ws[0].y1) / 2 - middle) < 4 * size and ws[0].x0 < a[2] < ws[-1].x1 + size]
        limit = max(near) if len(near) >= 2 else width - left
        limit = max(limit, edge)
        for w in rest[len(behind) : len(behind) + 1]:
            limit = min(limit, w.x0 - 0.3 * w.size)
        for across, at, y0, y1 in rules:
            if not across and at >= edge and y0 <= middle <= y1:
                limit = min(limit, at - 1)
        rooms.append(max(0.0, limit - edge))
        follow.append(behind)
    return rooms, follow


def replace_text(
    pdf: Pdf, find: str, new: str, *, regex: bool = False, case_sensitive: bool = False, spec: str | None = None
) -> tuple[bytes, dict[str, Any]]:
    """Matches on the pages' lines replaced, in their own font where it has the characters; what follows in the same run
    moves along, and text that finds no room is drawn together. Form values and comments are replaced as well."""
    if not find:
        raise Refused("the text to find is empty")
    if "\n" in new:
        raise Refused("the new text has a line break, and replace keeps text on its line; use stamp with below to add a line")
    [pattern] = compile_patterns([find], regex=regex, case_sensitive=case_sensitive)
    template = re.sub(r"\$(\$|\{\w+\}|\w+)", lambda m: "$" if m[1] == "$" else rf"\g<{m[1].strip('{}')}>", new.replace("\\", r"\\")) if regex else None
    expand = (lambda text: pattern.sub(template, text, count=1)) if regex else lambda text: new
    fields, comments = _replace_beside(pdf, pattern, (lambda t: pattern.sub(template, t)) if regex else (lambda t: pattern.sub(lambda _: new, t)))
    pages, report, total = pdf.pages(), [], 0
    for n in dict.fromkeys(page_numbers(spec, len(pages))):
        page = pages[n - 1]
        layout = interpret(pdf, page)
        found = text_areas(layout.words, [pattern])
        if not found:
            continue
        areas = [a for a, _, _ in found]
        texts = [expand(match) for _, match, _ in found]
        rooms, follow = _plan(layout.words, layout.rules, areas, layout.width)
        trial = Changes(areas, texts, rooms)
        resources = own_resources(pdf, page)
        content = pdf.content(page)
        Rewriter(pdf, page, trial).rewrite(content, resources, State())
        moves = []
        for k, behind in enumerate(follow):
            if k in trial.written and behind:
                by = trial.written[k].new - trial.written[k].old
                base = behind[0].start[1]
                moves.append((behind[0].x0 - 0.5, behind[-1].x1, base, by))
        changes = Changes(areas, texts, rooms, moves)
        body, changed = Rewriter(pdf, page, changes).rewrite(content, resources, State())
        if changed:
            live(pdf, page)["Contents"] = page.info["Contents"] = add(pdf, Stream({"Filter": Name("FlateDecode")}, zlib.compress(body)))
        done = changes.written.values()
        total += len(done)
        report.append(
            {
                "page": n, "replaced": len(done), "not_replaced_in_annotations": len(areas) - len(done), "in_original_font": sum(w.own_font for w in done),
                "in_substitute_font": sum(not w.own_font for w in done), "overflow_pt": _tenths([max((w.overflow for w in done), default=0.0)])[0],
                "lines_rewrapped": 0, "lines_narrowed": sum(w.narrowed for w in done),
            }
        )
    if not report and not fields and not comments:
        raise Refused(f"'{find}' was not found; nothing was written")
    return save(pdf)[0], {"replacements": total, "pages": report, "form_fields": fields, "annotation_comments": comments}


def _replace_beside(pdf: Pdf, pattern: re.Pattern, put) -> tuple[list[str], int]:
    """Values of text fields, passwords left alone, and comments of annotations."""
    fields = []
    for f in pdf.fields(places=True):
        if f["type"] == "text" and not f["flags"] >> 13 & 1 and f["value"] and pattern.search(f["value"]):
            pdf.get(f["ref"])["V"] = encode_text(put(f["value"]))
            for w in f["places"]:
                pdf.get(w).pop("AP", None)
            fields.append(f["name"])
    if fields:
        pdf.get(pdf.catalog["AcroForm"])["NeedAppearances"] = True
    comments = 0
    for page in pdf.pages():
        for x in pdf.get(page.info.get("Annots")) or []:
            a = pdf.get(x)
            text = text_string(pdf.get(a.get("Contents"))) if isinstance(a, dict) and a.get("Subtype") != "Widget" else ""
            if text and pattern.search(text):
                a["Contents"] = encode_text(put(text))
                a.pop("RC", None)
                if a.get("Subtype") == "FreeText":
                    a.pop("AP", None)
                comments += 1
    return fields, comments


__all__ = ["Changes", "Font", "Rewriter", "redact", "replace_text", "struck"]
