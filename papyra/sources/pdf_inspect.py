"""What a scan needs to know about a file: facts of its bytes, and of every dictionary in its objects.

A dictionary becomes one flat record, whose fields the rules in ``operators.inspect`` look at; nothing is judged here.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import Any

from .pdf import MOST_DEPTH, Name, Pdf, Ref, Stream, text_string

#: Bytes that a stream may expand to before it counts as a bomb, and the share of it below which none can.
BOMB, MOST_RATIO = 256 << 20, 1100
#: Bytes of a script and of an attachment that are read.
SCRIPT_BYTES, HEAD_BYTES = 4096, 16

# Names that stand for something a scan reports, with the kind, in the order of the severity they have at most.
RAW_NAMES = (
    ("JavaScript", "javascript", "high"), ("Launch", "launch", "high"), ("OpenAction", "auto_action", "medium"), ("XFA", "xfa", "medium"),
    ("EmbeddedFile", "embedded_file", "medium"), ("EmbeddedFiles", "embedded_file", "medium"), ("RichMedia", "rich_media", "high"),
    ("SubmitForm", "submit_form", "medium"), ("ImportData", "import_data", "medium"), ("GoToR", "remote_goto", "low"),
)

_STREAM = re.compile(rb"(?<!end)stream(?=[\r\n]).*?endstream", re.S)
_NAME = re.compile(rb"/([^\x00\t\n\x0c\r ()<>\[\]{}/%]{1,127})")
_ESCAPE = re.compile(rb"#([0-9A-Fa-f]{2})")
_DEFINED = re.compile(rb"(?:^|[\r\n])[ \t]*(\d{1,10})[ \t]+(\d{1,5})[ \t]+obj\b")


def raw_facts(data: bytes) -> dict[str, Any]:
    """Facts of the bytes alone: where the header stands, revisions, what follows the end, names, objects defined twice."""
    ends = [m.end() for m in re.finditer(rb"%%EOF", data)]
    # Stream data is no structure: a page about PDF may well say /JavaScript.
    outside = _STREAM.sub(b" ", data)
    counts: dict[str, int] = {}
    escaped: dict[tuple[str, str], int] = {}
    known = {n for n, _, _ in RAW_NAMES}
    for m in _NAME.finditer(outside):
        written = m[1]
        plain = _ESCAPE.sub(lambda x: bytes([int(x[1], 16)]), written)
        if (name := plain.decode("latin-1")) in known:
            counts[name] = counts.get(name, 0) + 1
        needless = any(chr(int(x, 16)).isascii() and chr(int(x, 16)).isalnum() for x in _ESCAPE.findall(written))
        if needless and all(33 <= b <= 126 for b in plain):
            pair = written.decode("latin-1"), name
            escaped[pair] = escaped.get(pair, 0) + 1
    defined = [m.groups() for m in _DEFINED.finditer(data)]
    return {
        "header_offset": data.find(b"%PDF-", 0, 1 << 20),
        "revisions": len(ends),
        "bytes_after_end": len(data[ends[-1] :].rstrip(b" \t\r\n\x0b\x0c")) if ends else 0,
        "redefined": len(defined) - len(set(defined)),
        "names": counts,
        "escaped": [{"written": w, "means": p, "times": n} for (w, p), n in escaped.items()],
        "trailer_encrypt": trailer_has_encrypt(data),
    }


def trailer_has_encrypt(data: bytes) -> bool:
    """Whether the trailer, or the stream that stands for it, which the end of the file points to, says that it is encrypted."""
    starts = re.findall(rb"startxref\s+(\d+)", data[-2048:])
    if not starts:
        return False
    at = int(starts[-1])
    if data[at : at + 4] == b"xref":
        at = data.find(b"trailer", at)
    section = data[at : at + (1 << 16)] if at >= 0 else b""
    end = re.search(rb"\bstream[\r\n]|startxref", section)
    return b"/Encrypt" in section[: end.start() if end else len(section)]


def stated_encryption(data: bytes) -> tuple[int, int] | None:
    """The object that the last mention of an encryption dictionary refers to."""
    found = re.findall(rb"/Encrypt\s+(\d+)\s+(\d+)\s+R", data)
    return (int(found[-1][0]), int(found[-1][1])) if found else None


def info_reference(data: bytes) -> tuple[int, int] | None:
    """The object that the last mention of document information refers to."""
    found = re.findall(rb"/Info\s+(\d+)\s+(\d+)\s+R", data)
    return (int(found[-1][0]), int(found[-1][1])) if found else None


def expands(raw: bytes, most: int = BOMB) -> int:
    """Bytes that Flate data expands to, counted up to just beyond ``most`` and never kept."""
    unpack, total, data = zlib.decompressobj(), 0, raw
    while total <= most:
        try:
            out = unpack.decompress(data, 1 << 20)
        except zlib.error:
            break
        total += len(out)
        data = unpack.unconsumed_tail
        if not out and not data:
            break
    return total


def _text(pdf: Pdf, x: Any) -> str | None:
    x = pdf.get(x)
    if isinstance(x, Stream):
        try:
            x = pdf.decode(x)[:SCRIPT_BYTES]
        except ValueError:
            return None
    return text_string(x) if isinstance(x, bytes) else None


def _target(pdf: Pdf, x: Any) -> str | None:
    """A file specification or address as text."""
    x = pdf.get(x)
    if isinstance(x, dict):
        return next((t for k in ("UF", "F", "DOS", "Mac", "Unix") if (t := _text(pdf, x.get(k))) is not None), None)
    return _text(pdf, x)


def _name(pdf: Pdf, x: Any) -> str | None:
    x = pdf.get(x)
    return str(x) if isinstance(x, Name) else None


def _record(pdf: Pdf, number: int, d: dict[str, Any], stream: Stream | None) -> dict[str, Any]:
    get = lambda k: pdf.get(d.get(k))
    out: dict[str, Any] = {
        "obj": number, "keys": sorted(map(str, d)), "names": sorted({str(v) for v in d.values() if isinstance(v, Name)}), "s": _name(pdf, d.get("S")),
        "subtype": _name(pdf, d.get("Subtype")),
    }
    if "JS" in d:
        out["script"] = _text(pdf, d["JS"])
    if "URI" in d:
        out["uri"] = _text(pdf, d["URI"])
    if "F" in d and out["s"]:
        out["target"] = _target(pdf, d["F"])
    if isinstance(win := get("Win"), dict):
        out["program"], out["parameters"] = _text(pdf, win.get("F")), _text(pdf, win.get("P"))
    if isinstance(opens := get("OpenAction"), dict):
        out["opens"] = _name(pdf, opens.get("S")) or ""
    if isinstance(aa := get("AA"), dict):
        out["events"] = sorted(map(str, aa))
    if isinstance(ef := get("EF"), dict):
        out["file_name"] = next((t for k in ("UF", "F") if (t := _text(pdf, d.get(k)))), "")
        x = next((s for k in ("UF", "F", "DOS", "Mac", "Unix") if isinstance(s := pdf.get(ef.get(k)), Stream)), None)
        if x is not None:
            try:
                out["file_head"] = pdf.decode(x)[:HEAD_BYTES]
            except ValueError:
                out["file_head"] = x.raw[:HEAD_BYTES]
            stated = pdf.get((pdf.get(x.info.get("Params")) or {}).get("Size"))
            out["file_size"] = stated if isinstance(stated, int) else len(x.raw)
    if stream is not None:
        f = get("Filter")
        filters = [str(pdf.get(v)) for v in f] if isinstance(f, list) else [str(f)] if isinstance(f, Name) else []
        out |= {"filters": filters, "stored": len(stream.raw)}
        if filters[:1] == ["FlateDecode"] and len(stream.raw) > BOMB // MOST_RATIO:
            out["expanded"] = expands(stream.raw)
        number_of = lambda v: float(v) if isinstance(v := pdf.get(v), (int, float)) else None
        out["width"], out["height"] = number_of(d.get("Width")), number_of(d.get("Height"))
        parms = get("DecodeParms")
        parms = pdf.get(parms[0]) if isinstance(parms, list) and parms else parms
        if isinstance(parms, dict):
            out["fax_columns"], out["fax_rows"] = number_of(parms.get("Columns")), number_of(parms.get("Rows"))
    return out


def dictionaries(pdf: Pdf) -> Iterator[dict[str, Any]]:
    """A record of every dictionary in every object, nested ones included."""
    for number in sorted(pdf.entries):
        x = pdf._quietly(number)
        todo: list[tuple[Any, int]] = [(x, 0)]
        while todo:
            x, depth = todo.pop()
            if depth > MOST_DEPTH or isinstance(x, Ref):
                continue
            if isinstance(x, Stream):
                if x.info.get("Type") not in ("XRef", "ObjStm"):
                    yield _record(pdf, number, x.info, x)
                    todo += [(v, depth + 1) for v in x.info.values()]
            elif isinstance(x, dict):
                yield _record(pdf, number, x, None)
                todo += [(v, depth + 1) for v in x.values()]
            elif isinstance(x, list):
                todo += [(v, depth + 1) for v in x]
    yield _record(pdf, 0, {k: v for k, v in pdf.trailer.items() if k not in ("Encrypt",)}, None)


def references(pdf: Pdf) -> Iterator[tuple[int, int]]:
    """(from, to) of every reference between objects; the trailer is object 0."""
    for number, x in [(0, {k: pdf.trailer.get(k) for k in ("Root", "Info", "Encrypt")}), *((n, pdf._quietly(n)) for n in sorted(pdf.entries))]:
        todo, seen = [x], set()
        while todo:
            x = todo.pop()
            if isinstance(x, Ref):
                seen.add(x.number)
            elif isinstance(x, Stream):
                todo += x.info.values()
            elif isinstance(x, dict):
                todo += x.values()
            elif isinstance(x, list):
                todo += x
        yield from ((number, to) for to in sorted(seen))


def cyclic_pages(pdf: Pdf) -> bool:
    """Whether the page tree reaches a node twice."""
    todo, seen = [pdf.catalog.get("Pages")], set()
    while todo:
        x = todo.pop()
        if not isinstance(x, Ref):
            continue
        if x.number in seen:
            return True
        seen.add(x.number)
        node = pdf._quietly(x.number)
        kids = pdf.get(node.get("Kids")) if isinstance(node, dict) else None
        todo += kids if isinstance(kids, list) else []
    return False
