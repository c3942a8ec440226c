"""Changes to one PDF file: bytes in, bytes and a report out.

A file that was read is changed in place, its objects being plain values, and written anew; it stays protected if it
was. Coordinates are those that layout reports: points, origin at the top left of the upright page, y down.
"""

from __future__ import annotations

import json
import math
import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterable
from typing import Any

from ..functions.pagespec import page_numbers
from ..functions.text import NO, YES
from .crypt import Security, permissions
from .pdf import Name, Page, Pdf, Ref, Stream, Unsupported, Word, text_string
from .pdf_text import bounds, interpret, invert, lines_of, reading_order, visual_matrix
from .pdf_writer import Copier, Writer, encode_text, outline_tree, save, serialise, standard_font, text_width

Area = list[float]

META_KEYS = {"title": "Title", "author": "Author", "subject": "Subject", "keywords": "Keywords", "creator": "Creator"}


class Refused(ValueError):
    """The change cannot be made as asked; nothing is written."""


def add(pdf: Pdf, x: Any) -> Ref:
    """A new object in a file that was read."""
    ref = Ref(max(max(pdf.entries, default=0), max(pdf.cache, default=0)) + 1, 0)
    pdf.cache[ref.number] = x
    return ref


def live(pdf: Pdf, page: Page) -> dict[str, Any]:
    """The page's own dictionary, to be changed."""
    found = pdf.get(page.ref)
    if not isinstance(found, dict):
        raise Refused(f"page {page.number} is missing")
    return found


def own_resources(pdf: Pdf, page: Page) -> dict[str, Any]:
    """A private copy of the resources, inherited ones included, set on the page itself."""
    found = pdf.get(page.info.get("Resources")) or {}
    copy = {k: dict(v) if isinstance(v := pdf.get(x), dict) else x for k, x in found.items()}
    live(pdf, page)["Resources"] = page.info["Resources"] = copy
    return copy


def add_resource(resources: dict[str, Any], kind: str, base: str, x: Any) -> str:
    """Put something into the resources under the first free name: base, base2, base3."""
    group = resources.setdefault(kind, {})
    taken = [n for n, y in group.items() if y == x]
    if taken:
        return taken[0]
    name, k = base, 1
    while name in group:
        k += 1
        name = f"{base}{k}"
    group[name] = x
    return name


def append_content(pdf: Pdf, page: Page, data: bytes) -> None:
    """Draw over a page; what it drew before is closed off, so that none of its state reaches the addition."""
    old = pdf.get(page.info.get("Contents"))
    before = page.info.get("Contents")
    parts = list(old) if isinstance(old, list) else [] if before is None else [before]
    new = [add(pdf, Stream({}, b"q\n")), *parts, add(pdf, Stream({}, b"\nQ\n" + data))]
    live(pdf, page)["Contents"] = page.info["Contents"] = new


def _to_user(page: Page, area: Area) -> Area:
    back = invert(visual_matrix(page)[0])
    return bounds(back, *area)


def parse_rect(spec: str, total: int) -> tuple[int, Area]:
    """``page:x0,y0,x1,y1``; corners in any order, an empty area or a page beyond the last is an error."""
    m = re.fullmatch(r"\s*(\d+)\s*:\s*([^,]+),([^,]+),([^,]+),([^,]+)\s*", spec)
    try:
        page, v = int(m[1]), [float(m[k]) for k in range(2, 6)]
    except (TypeError, ValueError):
        raise Refused(f"'{spec}' is no area; expected page:x0,y0,x1,y1") from None
    area = [min(v[0], v[2]), min(v[1], v[3]), max(v[0], v[2]), max(v[1], v[3])]
    if not 1 <= page <= total:
        raise Refused(f"page {page} is out of range, the document has {total}")
    if not all(map(math.isfinite, v)) or area[0] == area[2] or area[1] == area[3]:
        raise Refused(f"'{spec}' is an empty area")
    return page, area


def parse_color(text: str) -> tuple[float, float, float]:
    """RRGGBB, with or without a leading mark, as three parts from 0 to 1."""
    if not re.fullmatch(r"#*[0-9A-Fa-f]{6}", text):
        raise Refused(f"'{text}' is no colour; expected RRGGBB")
    return tuple(int(text[-6:][k : k + 2], 16) / 255 for k in (0, 2, 4))


def compile_patterns(texts: Iterable[str], *, regex: bool = False, case_sensitive: bool = False) -> list[re.Pattern]:
    """Patterns of the texts that are not empty."""
    out = [re.compile(t if regex else re.escape(t), 0 if case_sensitive else re.I) for t in texts if t]
    return out


def text_areas(words: list[Word], patterns: list[re.Pattern]) -> list[tuple[Area, str, int]]:
    """(box, match, line) of every match of every pattern, line by line; overlaps stay.

    A line is matched as it is read. A phrase that runs over the end of a line is no match.
    """
    out = []
    for n, line in enumerate(lines_of(words)):
        pieces: list[tuple[str, Area | None]] = []
        for k, w in enumerate(line):
            pieces += [(" ", None)] * (k > 0) + [(text, box) for _, text, box in w.parts]
        order = reading_order([t for t, _ in pieces])
        if order is not None:
            pieces = [pieces[k] for k, _ in order]
        text, places = "", []
        for piece, box in pieces:
            places.append((len(text), len(text) + len(piece), box))
            text += piece
        for p in patterns:
            for m in p.finditer(text):
                hit = [box for a, b, box in places if box and a < m.end() and m.start() < b]
                if hit:
                    out.append(([min(b[0] for b in hit), min(b[1] for b in hit), max(b[2] for b in hit), max(b[3] for b in hit)], m[0], n))
    return out


def _tenths(box: Iterable[float]) -> list[float]:
    return [math.floor(abs(v) * 10 + 0.5) / 10 * (1 if v >= 0 else -1) for v in box]


# --- pages, order, files -------------------------------------------------------------------------------------------


def take_pages(inputs: list[tuple[Pdf, list[int]]]) -> bytes:
    """A file of the given pages of the given files, in this order; a page taken twice is in it twice.

    Metadata is the first file's. Outline entries whose page is taken stay, nested anew. Form fields with a widget on
    a page that is taken stay; those of a file that comes after another form go under ``doc2``, ``doc3``, …
    """
    out = Writer()
    root, tree = out.add(), out.add()
    pages: list[tuple[Ref, dict[str, Any]]] = []
    entries: list[tuple[int, str, Any]] = []
    fields: list[Any] = []
    form: dict[str, Any] = {}
    for k, (pdf, wanted) in enumerate(inputs):
        every = pdf.pages()
        copier = Copier(pdf, out, {p.ref.number for p in every if p.ref})
        made = [(every[n - 1], out.add()) for n in wanted]
        first: dict[int, Ref] = {}
        for page, ref in made:
            first.setdefault(page.number, ref)
            if page.ref:
                copier.done.setdefault(page.ref.number, ref)
        for page, ref in made:
            own = {key: v for key, v in page.info.items() if key not in ("Parent", "Kids", "StructParents", "B", "Count")}
            info = {key: copier.value(v) for key, v in own.items()} | {"Type": Name("Page"), "Parent": tree}
            info.setdefault("MediaBox", [0, 0, 612, 792])
            info.setdefault("Resources", {})
            pages.append((ref, info))
        entries += _surviving(pdf, first)
        acro = pdf.get(pdf.catalog.get("AcroForm"))
        if isinstance(acro, dict):
            shown = {x for page, _ in made for x in pdf.get(page.info.get("Annots")) or [] if isinstance(x, Ref)}
            mine = [copier.value(x) for x in pdf.get(acro.get("Fields")) or [] if _has_widget(pdf, x, shown, 0)]
            if mine and fields:
                group = out.add()
                for x in mine:
                    out.objects[x.number - 1]["Parent"] = group
                out.set(group, {"T": encode_text(f"doc{k + 1}"), "Kids": mine})
                mine = [group]
            fields += mine
            for key, v in acro.items():
                if key not in ("Fields", "XFA", "CO"):
                    form.setdefault(key, copier.value(v))
    for ref, info in pages:
        out.set(ref, info)
    out.set(tree, {"Type": Name("Pages"), "Kids": [r for r, _ in pages], "Count": len(pages)})
    catalog: dict[str, Any] = {"Type": Name("Catalog"), "Pages": tree}
    if fields:
        catalog["AcroForm"] = {**form, "Fields": fields}
    if entries:
        catalog["Outlines"] = outline_tree(out, entries)
    out.set(root, catalog)
    pdf = inputs[0][0]
    info = pdf.get(pdf.trailer.get("Info"))
    meta = out.add(Copier(pdf, out).value(info)) if isinstance(info, dict) else None
    return out.finish(root, meta, security=pdf.security)


def _has_widget(pdf: Pdf, x: Any, shown: set[Ref], depth: int) -> bool:
    node = pdf.get(x)
    if not isinstance(node, dict) or depth > 32:
        return False
    return x in shown or any(_has_widget(pdf, kid, shown, depth + 1) for kid in pdf.get(node.get("Kids")) or [])


def _surviving(pdf: Pdf, first: dict[int, Ref]) -> list[tuple[int, str, Any]]:
    """Outline entries whose page is taken; one whose parent goes moves up to what is left above it."""
    out, open_ = [], []
    for level, title, page in pdf.outline():
        while open_ and open_[-1] >= level:
            open_.pop()
        if page in first:
            open_.append(level)
            out.append((len(open_), title, [first[page], Name("Fit")]))
    return out


def keep(pdf: Pdf, spec: str) -> bytes:
    """The pages of a spec, in its order."""
    return take_pages([(pdf, page_numbers(spec, len(pdf.pages())))])


def delete(pdf: Pdf, spec: str) -> bytes:
    """All pages but those of a spec; nothing left is an error."""
    total = len(pdf.pages())
    gone = set(page_numbers(spec, total))
    left = [n for n in range(1, total + 1) if n not in gone]
    if not left:
        raise Refused("this would delete every page")
    return take_pages([(pdf, left)])


def split(pdf: Pdf, every: int = 1, ranges: list[str] | None = None) -> list[tuple[list[int], bytes]]:
    """(source pages, file) of the parts."""
    total = len(pdf.pages())
    if every < 1:
        raise Refused("every must be at least 1")
    groups = [page_numbers(r, total) for r in ranges] if ranges else [list(range(a, min(a + every, total + 1))) for a in range(1, total + 1, every)]
    return [(g, take_pages([(pdf, g)])) for g in groups]


def merge(files: list[Pdf]) -> bytes:
    """All pages of all files in this order."""
    return take_pages([(pdf, list(range(1, len(pdf.pages()) + 1))) for pdf in files])


def rotate(pdf: Pdf, angle: int, spec: str | None = None) -> bytes:
    """Pages turned clockwise, on top of what they are; a page named twice turns twice."""
    if angle % 90:
        raise Refused("angle must be a multiple of 90")
    pages = pdf.pages()
    for n, times in Counter(page_numbers(spec, len(pages))).items():
        live(pdf, pages[n - 1])["Rotate"] = (pages[n - 1].rotation + times * angle) % 360
    return save(pdf)[0]


def set_meta(pdf: Pdf, **changes: str | None) -> bytes:
    """Title, author, subject, keywords, creator; an empty text removes one. The second copy in XMP goes."""
    changes = {k: v for k, v in changes.items() if v is not None}
    if unknown := set(changes) - set(META_KEYS):
        raise Refused(f"unknown key {sorted(unknown)[0]}")
    if not changes:
        raise Refused("nothing to set")
    info = pdf.get(pdf.trailer.get("Info"))
    info = info if isinstance(info, dict) else {}
    for k, v in changes.items():
        info.pop(META_KEYS[k], None)
        if v:
            info[META_KEYS[k]] = encode_text(v)
    if not isinstance(pdf.trailer.get("Info"), Ref):
        pdf.trailer["Info"] = add(pdf, info)
    pdf.catalog.pop("Metadata", None)
    return save(pdf)[0]


def compress(pdf: Pdf) -> tuple[bytes, dict[str, Any]]:
    """Unused objects gone, streams and objects packed; a result that is no smaller is not taken."""
    for number in list(pdf.entries):
        x = pdf._quietly(number)
        if isinstance(x, Stream) and "Filter" not in x.info and "F" not in x.info:
            packed = zlib.compress(x.raw, 9)
            if len(packed) + 20 < len(x.raw):
                x.info["Filter"], x.raw = Name("FlateDecode"), packed
    data, unused = save(pdf, packed=True)
    before = len(pdf.data)
    smaller = len(data) < before
    after = len(data) if smaller else before
    saved = math.floor((before - after) * 1000 / max(before, 1) + 0.5) / 10
    report = {"size_before": before, "size_after": after, "saved_percent": saved, "unused_objects_removed": unused, "images_recompressed": 0, "rewritten": smaller}
    return (data if smaller else pdf.data), report


def encrypt(pdf: Pdf, *, owner_password: str, user_password: str = "", deny_print: bool = False, deny_copy: bool = False, deny_modify: bool = False) -> bytes:
    """Protected with AES-256; without a user password the file opens for everyone, within the permissions."""
    if not owner_password:
        raise Refused("an owner password is needed")
    if pdf.security:
        raise Refused("the file is encrypted already; decrypt it first")
    bits = permissions(deny_print=deny_print, deny_copy=deny_copy, deny_modify=deny_modify)
    return save(pdf, security=Security.make(user_password, owner_password, bits))[0]


def decrypt(pdf: Pdf) -> bytes:
    """Without protection."""
    if not pdf.security:
        raise Refused("the file is not encrypted")
    for number in pdf.entries:
        pdf._quietly(number)
    pdf.security = None
    return save(pdf)[0]


# --- stamps and annotations ----------------------------------------------------------------------------------------


def _number(v: float) -> bytes:
    return serialise(float(v))


def _tuple(*v: float) -> bytes:
    return b" ".join(map(_number, v))


def text_ops(font: str, text: str, x: float, y: float, size: float) -> bytes:
    """Operators that show a line of Helvetica, without BT and ET."""
    return b"/%s %s Tf 1 0 0 1 %s Tm %s Tj\n" % (font.encode(), _number(size), _tuple(x, y), serialise(text.encode("cp1252", "replace")))


def _upright(page: Page) -> bytes:
    """Operators that make the content space the upright page, origin at its bottom left."""
    m, _, height = visual_matrix(page)
    back = invert((m[0], -m[1], m[2], -m[3], m[4], height - m[5]))
    return _tuple(*back) + b" cm\n"


def stamp(
    pdf: Pdf,
    text: str | None = None,
    *,
    image: bytes | None = None,
    qr: str | None = None,
    position: str | None = None,
    anchor: str = "bottom-right",
    x: float | None = None,
    y: float | None = None,
    below: str | None = None,
    above: str | None = None,
    gap: float | None = None,
    width: float | None = None,
    margin: float = 24.0,
    align: str | None = None,
    size: float | None = None,
    opacity: float | None = None,
    color: str = "000000",
    spec: str | None = None,
) -> tuple[bytes, dict[str, Any]]:
    """Text, a picture or a QR code over pages: as a watermark, header or footer, at a corner, at a point, or beside a
    text that is found. Reports the stamped pages and what each stamp by a found text lies over."""
    if sum(v is not None for v in (text, image, qr)) != 1:
        raise Refused("give exactly one of text, image or qr")
    if size is not None and size <= 0 or width is not None and width <= 0:
        raise Refused("size and width must be positive")
    if (x is None) != (y is None):
        raise Refused("give both x and y, or neither")
    by_text = below if below is not None else above
    places = sum(v is not None for v in (x, below, above))
    if places > 1:
        raise Refused("give one place: x and y, below, or above")
    if places and position:
        raise Refused("position is for text without a place")
    if gap is not None and by_text is None:
        raise Refused("gap is the distance from a found text")
    watermark = text is not None and not places and position in (None, "watermark")
    if watermark and "\n" in text:
        raise Refused("a watermark is one line")
    opacity = (0.25 if watermark else 1.0) if opacity is None else opacity
    if not 0 <= opacity <= 1:
        raise Refused("opacity must be between 0 and 1")
    ink = _tuple(*parse_color(color)) + b" rg\n"
    if text is not None and text.encode("cp1252", "replace").decode("cp1252") != text:
        raise Unsupported("a font with the text's characters is not available in this build")
    pages = pdf.pages()
    wanted = sorted(set(page_numbers(spec, len(pages))))
    found: dict[int, tuple[Area, int, list[Word]]] = {}
    if by_text is not None:
        if not by_text:
            raise Refused("the text to find is empty")
        for n in wanted:
            words = interpret(pdf, pages[n - 1]).words
            if areas := text_areas(words, compile_patterns([by_text])):
                found[n] = areas[0][0], len(areas), words
        if not found:
            raise Refused(f"'{by_text}' was not found; nothing was written")
        wanted = sorted(found)
    own_size = size or 10.0
    gap = (0.2 * own_size if text is not None else 2.0) if gap is None else gap
    state = add(pdf, {"Type": Name("ExtGState"), "ca": float(opacity)})
    font = add(pdf, standard_font()) if text is not None else None
    picture = embed_image(pdf, image) if image is not None else None
    report = []
    for n in wanted:
        page = pages[n - 1]
        _, vw, vh = visual_matrix(page)
        resources = own_resources(pdf, page)
        ops = b"q\n" + _upright(page) + b"/" + add_resource(resources, "ExtGState", "PapyraGS", state).encode() + b" gs\n"
        spot = (x, y, False) if x is not None else None
        if n in found:
            area = found[n][0]
            spot = (area[0], area[1] - gap, True) if above is not None else (area[0], area[3] + gap, False)

        def box(w: float, h: float) -> Area:
            """The stamp's box from the top left of the page."""
            if spot:  # noqa: B023
                left, top = spot[0], spot[1] - h if spot[2] else spot[1]  # noqa: B023
            else:
                left = {"left": margin, "right": vw - margin - w}.get(anchor.rpartition("-")[2], (vw - w) / 2)  # noqa: B023
                top = {"top": margin, "bottom": vh - margin - h}.get(anchor.partition("-")[0], (vh - h) / 2)  # noqa: B023
            return [left, top, left + w, top + h]

        if picture is not None:
            taken = box(width or 120.0, (width or 120.0) * picture[1])
            name = add_resource(resources, "XObject", "PapyraIm", picture[0])
            ops += _tuple(taken[2] - taken[0], 0, 0, taken[3] - taken[1], taken[0], vh - taken[3]) + b" cm\n/" + name.encode() + b" Do\n"
        elif qr is not None:
            taken = box(width or 80.0, width or 80.0)
            ops += _qr_ops(qr, taken[0], vh - taken[3], taken[2] - taken[0])
        else:
            name = add_resource(resources, "Font", "PapyraF", font)
            shown = text.replace("{pages}", str(len(pages))).replace("{page}", str(n))
            if watermark:
                fit = size or min(144.0, max(8.0, 0.7 * math.hypot(vw, vh) / max(text_width(shown, 1.0), 0.001)))
                turn = math.atan2(vh, vw)
                ops += _tuple(math.cos(turn), math.sin(turn), -math.sin(turn), math.cos(turn), vw / 2, vh / 2) + b" cm\nBT\n" + ink
                ops += text_ops(name, shown, -text_width(shown, fit) / 2, -0.35 * fit, fit) + b"ET\n"
                taken = [0.0, 0.0, vw, vh]
            else:
                lines, leading = shown.splitlines(), 1.2 * own_size
                widths = [text_width(t, own_size) for t in lines]
                height = own_size + leading * (len(lines) - 1)
                if spot:
                    top = box(0, height)[1]
                    side, lefts = align or "left", {"left": [spot[0]] * len(lines), "center": [spot[0] - w / 2 for w in widths], "right": [spot[0] - w for w in widths]}
                else:
                    top = margin - 0.08 * own_size if position == "header" else vh - margin - 0.8 * own_size - leading * (len(lines) - 1)
                    side, lefts = align or "center", {"left": [margin] * len(lines), "center": [(vw - w) / 2 for w in widths], "right": [vw - margin - w for w in widths]}
                ops += b"BT\n" + ink
                for k, (line, left) in enumerate(zip(lines, lefts[side])):
                    if line.strip():
                        ops += text_ops(name, line, left, vh - top - 0.8 * own_size - k * leading, own_size)
                ops += b"ET\n"
                taken = [min(lefts[side]), top, max(a + w for a, w in zip(lefts[side], widths)), top + height]
        if n in found:
            area, matches, words = found[n]
            under = sum(w.x0 < taken[2] and taken[0] < w.x1 and w.y0 < taken[3] - 0.5 and taken[1] + 0.5 < w.y1 for w in words)
            report.append({"page": n, "found_at": _tenths(area), "matches": matches, "bbox": _tenths(taken), "words_under_it": under})
        append_content(pdf, page, ops + b"Q\n")
    return save(pdf)[0], {"stamped_pages": wanted, "placed_by": report}


def _qr_ops(content: str, x: float, y: float, side: float) -> bytes:
    """A QR code on white, its dark modules as rectangles along the rows."""
    from .qr import rectangles

    edge, runs = rectangles(content.encode("utf-8"))
    step = side / edge
    out = b"1 g\n" + _tuple(x, y, side, side) + b" re\nf\n0 g\n"
    return out + b"".join(_tuple(x + c * step, y + (edge - r - 1) * step, n * step, step) + b" re\n" for r, c, n in runs) + b"f\n"


def add_text_layer(pdf: Pdf, page: Page, words: list[tuple[str, Area]]) -> None:
    """Recognised words over a page, invisible, each stretched to the box it was seen in (1 to 1000 per cent)."""
    resources = own_resources(pdf, page)
    name = add_resource(resources, "Font", "PapyraF", add(pdf, standard_font()))
    _, _, height = visual_matrix(page)
    ops = b"q\n" + _upright(page) + b"BT\n3 Tr\n"
    for text, (x0, y0, x1, y1) in words:
        size = max(1.0, y1 - y0)
        stretch = min(1000.0, max(1.0, 100 * (x1 - x0) / max(text_width(text, size), 0.01)))
        ops += b"%s Tz\n" % _number(stretch) + text_ops(name, text, x0, height - y1 + 0.2 * size, size)
    append_content(pdf, page, ops + b"ET\nQ\n")


def recognised(pdf: Pdf, words: dict[int, list[tuple[str, Area]]]) -> bytes:
    """A file with the words that were recognised on its pages as a layer that is found and not seen."""
    pages = pdf.pages()
    for n, own in sorted(words.items()):
        if not 1 <= n <= len(pages):
            raise Refused(f"page {n} is out of range, the document has {len(pages)}")
        add_text_layer(pdf, pages[n - 1], own)
    return save(pdf)[0]


def to_unicode(codes: dict[int, str], wide: bool = False) -> bytes:
    """A map from codes to text, a hundred lines to a block."""
    digits = 4 if wide else 2
    line = lambda k, t: f"<{k:0{digits}X}> <{t.encode('utf-16-be').hex().upper()}>"
    rows = [line(k, t) for k, t in sorted(codes.items())]
    blocks = [f"{len(part)} beginbfchar\n" + "\n".join(part) + "\nendbfchar" for part in (rows[k : k + 100] for k in range(0, len(rows), 100))]
    top = "F" * digits
    head = f"/CIDInit /ProcSet findresource begin\n12 dict begin\nbegincmap\n1 begincodespacerange\n<{'0' * digits}> <{top}>\nendcodespacerange\n"
    return (head + "\n".join(blocks) + "\nendcmap\nend\nend").encode()


def cover(needed: set[str], fonts: dict[str, set[str]]) -> list[str]:
    """Fonts that together have all characters, the one that adds most first; characters that none has are left."""
    left, out = set(needed), []
    while left:
        best = max(sorted(fonts), key=lambda f: len(fonts[f] & left), default=None)
        if best is None or not fonts[best] & left:
            break
        out.append(best)
        left -= fonts[best]
    return out


def embed_image(pdf: Pdf, data: bytes) -> tuple[Ref, float]:
    """A JPEG as it is, or a PNG as samples with its transparency as a soft mask; and height over width."""
    info = {"Type": Name("XObject"), "Subtype": Name("Image"), "BitsPerComponent": 8}
    if data[:2] == b"\xff\xd8":
        height, width, channels = jpeg_size(data)
        if channels not in (1, 3):
            raise Refused("only grey and RGB JPEG pictures can be embedded")
        space = Name("DeviceGray" if channels == 1 else "DeviceRGB")
        return add(pdf, Stream(info | {"Width": width, "Height": height, "ColorSpace": space, "Filter": Name("DCTDecode")}, data)), height / width
    width, height, color, alpha = read_png(data)
    info |= {"Width": width, "Height": height, "Filter": Name("FlateDecode")}
    picture = info | {"ColorSpace": Name("DeviceRGB")}
    if any(a != 255 for a in alpha):
        picture["SMask"] = add(pdf, Stream(info | {"ColorSpace": Name("DeviceGray")}, zlib.compress(alpha)))
    return add(pdf, Stream(picture, zlib.compress(color))), height / width


def jpeg_size(data: bytes) -> tuple[int, int, int]:
    """Height, width and channels of a JPEG."""
    at = 2
    while at + 9 < len(data):
        kind, length = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if data[at] == 0xFF and 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(data[at + 5 : at + 7], "big"), int.from_bytes(data[at + 7 : at + 9], "big"), data[at + 9]
        at += 2 + length
    raise Refused("not a picture that can be read")


def read_png(data: bytes) -> tuple[int, int, bytes, bytes]:
    """Width, height, RGB samples and alpha of a PNG with eight bits a sample."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise Refused("only PNG and JPEG pictures can be read")
    at, packed, palette, clear = 8, b"", b"", b""
    width = height = bits = kind = 0
    while at + 8 <= len(data):
        size, name = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if name == b"IHDR":
            width, height, bits, kind, _, _, laced = struct.unpack(">IIBBBBB", body)
            if bits != 8 or laced:
                raise Unsupported("only PNG pictures of eight bits a sample, not interlaced, can be read in this build")
        elif name == b"PLTE":
            palette = body
        elif name == b"tRNS":
            clear = body
        elif name == b"IDAT":
            packed += body
        at += size + 12
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    raw = Pdf._predict(None, zlib.decompress(packed), {"Predictor": 15, "Colors": channels, "BitsPerComponent": 8, "Columns": width})
    color, alpha = bytearray(), bytearray()
    for k in range(0, width * height * channels, channels):
        p = raw[k : k + channels]
        if kind == 3:
            color += palette[3 * p[0] : 3 * p[0] + 3]
            alpha.append(clear[p[0]] if p[0] < len(clear) else 255)
        else:
            color += p[:3] if channels >= 3 else p[:1] * 3
            alpha.append(p[-1] if kind in (4, 6) else 255)
    return width, height, bytes(color), bytes(alpha)


def write_png(width: int, height: int, channels: int, samples: bytes) -> bytes:
    """A PNG of eight bits a sample: grey, grey and alpha, RGB or RGBA."""
    part = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    kind = {1: 0, 2: 4, 3: 2, 4: 6}[channels]
    rows = b"".join(b"\0" + samples[k : k + width * channels] for k in range(0, width * height * channels, width * channels))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


MARKS = {"highlight": "Highlight", "underline": "Underline", "strikeout": "StrikeOut", "box": "Square", "note": "Text", "link": "Link"}


def _appearance(kind: str, r: Area, color: tuple[float, float, float]) -> tuple[bytes, dict[str, Any]]:
    """What a mark draws, in page space, and its resources."""
    x0, y0, x1, y1 = r
    w, h = x1 - x0, y1 - y0
    fill, line = _tuple(*color) + b" rg\n", _tuple(*color) + b" RG\n"
    if kind == "highlight":
        return b"/Mark gs\n" + fill + _tuple(x0, y0, w, h) + b" re\nf\n", {"ExtGState": {"Mark": {"BM": Name("Multiply")}}}
    if kind in ("underline", "strikeout"):
        at = y0 + h * (0.08 if kind == "underline" else 0.42)
        return line + _number(max(0.5, 0.07 * h)) + b" w\n" + _tuple(x0, at) + b" m\n" + _tuple(x1, at) + b" l\nS\n", {}
    if kind == "box":
        return line + b"1.5 w\n" + _tuple(x0 + 0.75, y0 + 0.75, max(0, w - 1.5), max(0, h - 1.5)) + b" re\nS\n", {}
    return fill + b"0.3 G\n0.8 w\n" + _tuple(x0 + 0.4, y0 + 0.4, max(0, w - 0.8), max(0, h - 0.8)) + b" re\nB\n", {}


def annotate(
    pdf: Pdf,
    *,
    kind: str = "highlight",
    texts: tuple[str, ...] = (),
    rects: tuple[str, ...] = (),
    regex: bool = False,
    case_sensitive: bool = False,
    spec: str | None = None,
    comment: str | None = None,
    url: str | None = None,
    color: str | None = None,
    author: str | None = None,
) -> tuple[bytes, dict[str, Any]]:
    """A mark over every match of the texts and over every area, with its own drawing."""
    if kind not in MARKS:
        raise Refused(f"unknown kind {kind}")
    if not texts and not rects:
        raise Refused("nothing to mark: give texts to find or rects (page:x0,y0,x1,y1)")
    if kind == "link" and not url:
        raise Refused("a link needs a url")
    if kind == "note" and not comment:
        raise Refused("a note needs a comment")
    ink = parse_color(color or ("FFE94D" if kind in ("highlight", "note") else "E53935"))
    pages = pdf.pages()
    areas = [(*parse_rect(r, len(pages)), None) for r in rects]
    if patterns := compile_patterns(texts, regex=regex, case_sensitive=case_sensitive):
        for n in page_numbers(spec, len(pages)):
            areas += [(n, box, match) for box, match, _ in text_areas(interpret(pdf, pages[n - 1]).words, patterns)]
    if not areas:
        raise Refused("none of the texts were found; nothing was written")
    for n, area, _ in areas:
        page = pages[n - 1]
        r = _to_user(page, area)
        if kind == "note":
            r = [r[0], r[3] - 18.0, r[0] + 18.0, r[3]]
        x0, y0, x1, y1 = r
        mark: dict[str, Any] = {"Type": Name("Annot"), "Subtype": Name(MARKS[kind]), "Rect": r, "P": page.ref, "F": 4, "C": list(ink)}
        if comment:
            mark["Contents"] = encode_text(comment)
        if author:
            mark["T"] = encode_text(author)
        if kind in ("highlight", "underline", "strikeout"):
            mark["QuadPoints"] = [x0, y1, x1, y1, x0, y0, x1, y0]
        elif kind == "note":
            mark["Name"] = Name("Comment")
        elif kind == "link":
            mark |= {"A": {"S": Name("URI"), "URI": url.encode("utf-8")}, "Border": [0, 0, 0]}
        if kind != "link":
            body, resources = _appearance(kind, r, ink)
            mark["AP"] = {"N": add(pdf, Stream({"Type": Name("XObject"), "Subtype": Name("Form"), "BBox": r, "Resources": resources}, body))}
        own = live(pdf, page)
        own["Annots"] = [*(pdf.get(own.get("Annots")) or []), add(pdf, mark)]
    counts = Counter(n for n, _, _ in areas)
    targets = [{"page": n, "bbox": _tenths(a)} | ({"text": t} if t else {}) for n, a, t in areas]
    report = {"added": len(areas), "pages": [{"page": n, "added": c} for n, c in sorted(counts.items())], "targets": targets}
    return save(pdf)[0], report


# --- forms ---------------------------------------------------------------------------------------------------------

def truthy(value: str) -> bool | None:
    """Whether a value means yes or no."""
    v = value.strip().lower()
    return True if v in YES else False if v in NO else None


def wrap(text: str, width: float, size: float) -> list[str]:
    """Lines no wider than ``width`` in Helvetica; a word that is wider stands alone."""
    out = []
    for paragraph in text.splitlines():
        line = ""
        for word in paragraph.split():
            longer = f"{line} {word}" if line else word
            if line and text_width(longer, size) > width:
                out.append(line)
                longer = word
            line = longer
        out.append(line)
    return out


def fill(pdf: Pdf, values: dict[str, str]) -> tuple[bytes, dict[str, Any]]:
    """Form values set and drawn. Everything is checked first, so a wrong name or option changes nothing."""
    if not values:
        raise Refused("no field values given")
    fields = {f["name"]: f for f in pdf.fields(places=True)}
    if not fields:
        raise Refused("the document has no form fields")
    plan = []
    for name, value in values.items():
        f = fields.get(name)
        if f is None:
            raise Refused(f"no field named '{name}'; available: {', '.join(fields)}")
        plan.append((f, _resolved(f, value)))
    for f, value in plan:
        node = pdf.get(f["ref"])
        widgets = [w for w in f["places"] if isinstance(pdf.get(w), dict)]
        if f["type"] in ("checkbox", "radio"):
            node["V"] = Name(value)
            for w in widgets:
                look = pdf.get((pdf.get(pdf.get(w).get("AP")) or {}).get("N"))
                pdf.get(w)["AS"] = Name(value if isinstance(look, dict) and value in look else "Off")
            continue
        node["V"] = encode_text(value)
        for w in widgets:
            widget = pdf.get(w)
            # A stale drawing would keep showing the old value; a password is never drawn.
            widget.pop("AP", None)
            latin = value.encode("cp1252", "replace").decode("cp1252") == value
            if f["type"] == "text" and not f["flags"] >> 13 & 1 and latin and (drawn := _field_drawing(pdf, f, widget, value)):
                widget["AP"] = {"N": add(pdf, drawn)}
    form = pdf.get(pdf.catalog.get("AcroForm"))
    form["NeedAppearances"] = True
    return save(pdf)[0], {"filled": [{"name": f["name"], "value": v} for f, v in plan]}


def _resolved(f: dict[str, Any], value: str) -> str:
    kind, options, name = f["type"], f["options"], f["name"]
    wrong = Refused(f"'{value}' is not an option of '{name}'; options: {', '.join(options)}")
    if kind == "text" or kind == "choice" and not options:
        return value
    if kind in ("choice", "radio", "checkbox") and value in options:
        return value
    if kind == "checkbox":
        answer = truthy(value)
        if answer is None:
            raise Refused(f"checkbox '{name}' takes true or false, got '{value}'")
        return (options or ["Yes"])[0] if answer else "Off"
    if kind == "radio" and truthy(value) is False:
        return "Off"
    if kind in ("choice", "radio"):
        raise wrong
    raise Refused(f"field '{name}' is a {kind} and cannot be filled")


def _field_drawing(pdf: Pdf, f: dict[str, Any], widget: dict[str, Any], value: str) -> Stream | None:
    r = pdf._box(widget.get("Rect"))
    if r is None:
        return None
    w, h = r[2] - r[0], r[3] - r[1]
    asked = text_string(pdf.get(widget.get("DA"))) or f["da"] or "/Helv 0 Tf 0 g"
    m = re.search(r"/(\S+)\s+([\d.]+)\s+Tf", asked)
    name, size = (m[1], float(m[2])) if m else ("Helv", 0.0)
    color = (asked[: m.start()] + asked[m.end() :]).strip() if m else "0 g"
    size = size or min(12.0, max(4.0, h - 4.0))
    form = pdf.get(pdf.catalog.get("AcroForm")) or {}
    fonts = dict(pdf.get((pdf.get(form.get("DR")) or {}).get("Font")) or {})
    fonts.setdefault(name, standard_font())
    leading = 1.15 * size
    several = bool(f["flags"] >> 12 & 1) and h >= 2 * leading + 4
    lines = wrap(value, w - 4, size) if several else [" ".join(value.split())]
    base = h - 2 - 0.9 * size if several else (h - size) / 2 + 0.22 * size
    shown = b"\nT*\n".join(serialise(line.encode("cp1252", "replace")) + b" Tj" for line in lines)
    body = b"/Tx BMC\nq\n1 1 %s re W n\nBT\n/%s %s Tf\n%s\n%s TL\n2 %s Td\n%s\nET\nQ\nEMC\n" % (
        _tuple(max(0, w - 2), max(0, h - 2)), name.encode("latin-1"), _number(size), color.encode("latin-1"), _number(leading), _number(base), shown,
    )
    return Stream({"Type": Name("XObject"), "Subtype": Name("Form"), "BBox": [0, 0, w, h], "Resources": {"Font": fonts}}, body)


# --- images --------------------------------------------------------------------------------------------------------


def channels_of(pdf: Pdf, space: Any) -> int:
    """Samples of a pixel by its colour space; 0 for one that cannot be shown."""
    space = pdf.get(space)
    if isinstance(space, list):
        kind = pdf.get(space[0]) if space else None
        if kind == "ICCBased":
            n = pdf.get(pdf.get(space[1]).info.get("N"))
            return n if n in (1, 3) else 0
        return {"CalGray": 1, "CalRGB": 3, "Indexed": -1, "I": -1}.get(kind, 0)
    return {"DeviceGray": 1, "G": 1, "DeviceRGB": 3, "RGB": 3}.get(space, 0)


def sole_filter(pdf: Pdf, x: Stream) -> str | None:
    """The name of the filter where there is exactly one."""
    f = pdf.get(x.info.get("Filter", x.info.get("F")))
    if isinstance(f, list):
        f = pdf.get(f[0]) if len(f) == 1 else None
    return str(f) if isinstance(f, str) else None


def samples(pdf: Pdf, x: Stream) -> tuple[int, int, int, bytes]:
    """Width, height, channels and samples of eight bits of an image."""
    get = lambda *names: next((pdf.get(x.info[n]) for n in names if n in x.info), None)
    width, height = int(get("Width", "W") or 0), int(get("Height", "H") or 0)
    bits = 1 if get("ImageMask", "IM") is True else int(get("BitsPerComponent", "BPC") or 8)
    channels = 1 if get("ImageMask", "IM") is True else channels_of(pdf, get("ColorSpace", "CS"))
    if not channels or bits not in (1, 2, 4, 8) or width <= 0 or height <= 0:
        raise Unsupported("cannot decode image data")
    raw, per_row = pdf.decode(x), abs(channels) * width
    step = (per_row * bits + 7) // 8
    if len(raw) < step * height:
        raise Unsupported("unexpected image data size")
    if bits == 8:
        data = raw[: step * height]
    else:
        scale = 1 if channels < 0 else 255 // ((1 << bits) - 1)
        rows = [raw[k : k + step] for k in range(0, step * height, step)]
        mask = (1 << bits) - 1
        data = bytes((row[k * bits >> 3] >> 8 - bits - (k * bits & 7) & mask) * scale for row in rows for k in range(per_row))
    if channels < 0:
        space = pdf.get(get("ColorSpace", "CS"))
        base, table = channels_of(pdf, space[1]), pdf.get(space[3])
        table = pdf.decode(table) if isinstance(table, Stream) else table
        if base not in (1, 3):
            raise Unsupported("cannot decode image data")
        return width, height, base, b"".join(table[base * v : base * v + base].ljust(base, b"\0") for v in data)
    return width, height, channels, data


def export_image(pdf: Pdf, x: Stream) -> tuple[str, bytes]:
    """(extension, file) of an image: JPEG and JPEG 2000 as stored, all else a PNG with its soft mask as alpha."""
    kind = sole_filter(pdf, x)
    if kind in ("DCTDecode", "DCT"):
        return "jpg", x.raw
    if kind == "JPXDecode":
        return "jp2", x.raw
    width, height, channels, data = samples(pdf, x)
    mask = pdf.get(x.info.get("SMask"))
    if isinstance(mask, Stream):
        mw, mh, _, alpha = samples(pdf, mask)
        if (mw, mh) == (width, height):
            data = b"".join(data[channels * k : channels * k + channels] + alpha[k : k + 1] for k in range(width * height))
            channels += 1
    return "png", write_png(width, height, channels, data)


def images(pdf: Pdf, spec: str | None = None, min_size: int = 1) -> list[dict[str, Any]]:
    """Every image under the first page that draws it, numbered on the page, with its file or why there is none."""
    pages, seen, out = pdf.pages(), set(), []
    for n in page_numbers(spec, len(pages)):
        k = 0
        for key, x, _ in interpret(pdf, pages[n - 1]).images:
            mark = key if isinstance(key, Ref) else x.raw
            width, height = (int(pdf.get(x.info.get(a, x.info.get(b, 0))) or 0) for a, b in (("Width", "W"), ("Height", "H")))
            if mark in seen or min(width, height) < min_size:
                continue
            seen.add(mark)
            k += 1
            row = {"page": n, "n": k, "width": width, "height": height, "kind": None, "content": None, "skipped": None}
            try:
                row["kind"], row["content"] = export_image(pdf, x)
            except ValueError as error:
                row["skipped"] = str(error)
            out.append(row)
    return out


def report_json(report: dict[str, Any]) -> str:
    """A report as JSON."""
    return json.dumps(report, ensure_ascii=False)
