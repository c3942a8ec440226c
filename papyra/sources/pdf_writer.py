"""Writing PDF files: objects to bytes, plain or packed, protected or not, and copies of what a file's objects reach.

Only what is reached is ever written, numbered from 1, so objects that nothing refers to any more stay behind and
numbers are never sparse.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from dataclasses import dataclass, field
from typing import Any

from .crypt import Security
from .pdf import Name, Pdf, Ref, Stream, helvetica

#: Objects in one object stream.
PACKED = 200


def encode_text(text: str) -> bytes:
    """A text string: Latin-1 where it can be, else UTF-16 with a mark."""
    try:
        data = text.encode("latin-1")
        return data if not data.startswith((b"\xfe\xff", b"\xef\xbb\xbf")) else b"\xfe\xff" + text.encode("utf-16-be")
    except UnicodeEncodeError:
        return b"\xfe\xff" + text.encode("utf-16-be")


def serialise(x: Any) -> bytes:
    """An object in PDF syntax."""
    if x is None:
        return b"null"
    if isinstance(x, bool):
        return b"true" if x else b"false"
    if isinstance(x, Ref):
        return b"%d %d R" % x
    if isinstance(x, int):
        return b"%d" % x
    if isinstance(x, float):
        text = f"{x:.6f}".rstrip("0").rstrip(".")
        return (text if text not in ("", "-0", "-") else "0").encode()
    if isinstance(x, bytes):
        return b"(" + re.sub(rb"[()\\\r]", lambda m: b"\\r" if m[0] == b"\r" else b"\\" + m[0], x) + b")"
    if isinstance(x, str):
        return b"/" + re.sub(rb"[^!-~]|[#()<>\[\]{}/%]", lambda m: b"#%02X" % m[0][0], str(x).encode("latin-1", "replace"))
    if isinstance(x, (list, tuple)):
        return b"[" + b" ".join(map(serialise, x)) + b"]"
    if isinstance(x, dict):
        return b"<<" + b"".join(serialise(Name(k)) + b" " + serialise(v) for k, v in x.items()) + b">>"
    if isinstance(x, Stream):
        return serialise({**x.info, "Length": len(x.raw)}) + b"\nstream\n" + x.raw + b"\nendstream"
    raise TypeError(f"{type(x).__name__} is no PDF object")


@dataclass
class Writer:
    """Objects numbered as they come, then the file."""

    objects: list[Any] = field(default_factory=list)

    def add(self, x: Any = None) -> Ref:
        self.objects.append(x)
        return Ref(len(self.objects), 0)

    def set(self, ref: Ref, x: Any) -> None:
        self.objects[ref.number - 1] = x

    def stream(self, data: bytes, **info: Any) -> Ref:
        """A stream, packed where that makes it smaller."""
        packed = zlib.compress(data, 6)
        if len(packed) < len(data):
            return self.add(Stream({**info, "Filter": Name("FlateDecode")}, packed))
        return self.add(Stream(info, data))

    def finish(self, root: Ref, info: Ref | None = None, *, security: Security | None = None, packed: bool = False, version: str = "1.7") -> bytes:
        """The file. ``packed`` puts objects into object streams, which a protected file does not get."""
        trailer: dict[str, Any] = {"Root": root} | ({"Info": info} if info else {})
        head = b"%PDF-" + version.encode() + b"\n%\xe2\xe3\xcf\xd3\n"
        if security:
            return self._plain(head, trailer, security)
        return self._packed(head, trailer) if packed else self._plain(head, trailer, None)

    def _plain(self, head: bytes, trailer: dict[str, Any], security: Security | None) -> bytes:
        out, offsets = bytearray(head), []
        objects = list(self.objects)
        if security:
            objects = [_protected(x, k + 1, security) for k, x in enumerate(objects)]
            objects.append(encryption(security))
            mark = hashlib.md5(bytes(security.key) + b"%d" % len(objects)).digest()
            trailer |= {"Encrypt": Ref(len(objects), 0), "ID": security.info.get("ID") or [mark, mark]}
        for k, x in enumerate(objects):
            offsets.append(len(out))
            out += b"%d 0 obj\n" % (k + 1) + serialise(x) + b"\nendobj\n"
        at = len(out)
        out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(offsets) + 1)
        out += b"".join(b"%010d 00000 n \n" % o for o in offsets)
        return bytes(out + b"trailer\n" + serialise({"Size": len(offsets) + 1, **trailer}) + b"\nstartxref\n%d\n%%%%EOF\n" % at)

    def _packed(self, head: bytes, trailer: dict[str, Any]) -> bytes:
        out = bytearray(head)
        rows: dict[int, tuple[int, int, int]] = {}
        loose = [k + 1 for k, x in enumerate(self.objects) if not isinstance(x, Stream)]
        last = len(self.objects)

        def place(number: int, x: Any) -> None:
            rows[number] = (1, len(out), 0)
            out.extend(b"%d 0 obj\n" % number + serialise(x) + b"\nendobj\n")

        for at in range(0, len(loose), PACKED):
            group, last = loose[at : at + PACKED], last + 1
            bodies = [serialise(self.objects[n - 1]) for n in group]
            places, position = [], 0
            for k, (n, body) in enumerate(zip(group, bodies)):
                rows[n] = (2, last, k)
                places.append(b"%d %d" % (n, position))
                position += len(body) + 1
            first = b" ".join(places) + b" "
            place(last, Stream({"Type": Name("ObjStm"), "N": len(group), "First": len(first), "Filter": Name("FlateDecode")}, zlib.compress(first + b"\n".join(bodies), 9)))
        for k, x in enumerate(self.objects):
            if isinstance(x, Stream):
                place(k + 1, x)
        last, at = last + 1, len(out)
        rows[last] = (1, at, 0)
        table = b"".join(bytes([kind]) + a.to_bytes(4, "big") + b.to_bytes(2, "big") for kind, a, b in (rows.get(n, (0, 0, 0)) for n in range(last + 1)))
        info = {"Type": Name("XRef"), "Size": last + 1, "W": [1, 4, 2], "Filter": Name("FlateDecode"), **trailer}
        out += b"%d 0 obj\n" % last + serialise(Stream(info, zlib.compress(table, 9))) + b"\nendobj\n"
        return bytes(out + b"startxref\n%d\n%%%%EOF\n" % at)


def encryption(security: Security) -> dict[str, Any]:
    """The encryption dictionary of a protection: as it was read, or that of a new one."""
    if "Filter" in security.info:
        return {k: Name(v) if isinstance(v, str) else v for k, v in security.info.items() if k != "ID"}
    own = {"StdCF": {"Type": Name("CryptFilter"), "CFM": Name("AESV3"), "AuthEvent": Name("DocOpen"), "Length": 32}}
    return {"Filter": Name("Standard"), "V": 5, "R": 6, "Length": 256, "CF": own, "StmF": Name("StdCF"), "StrF": Name("StdCF"), **security.info}


def _protected(x: Any, number: int, security: Security) -> Any:
    if isinstance(x, bytes):
        return security.encrypt(x, number, 0, stream=False)
    if isinstance(x, list):
        return [_protected(y, number, security) for y in x]
    if isinstance(x, dict):
        return {k: _protected(v, number, security) for k, v in x.items()}
    if isinstance(x, Stream):
        info = {k: _protected(v, number, security) for k, v in x.info.items()}
        plain = x.info.get("Type") == "Metadata" and not security.encrypt_metadata
        return Stream(info, x.raw if plain else security.encrypt(x.raw, number, 0, stream=True))
    return x


class Copier:
    """Copies what is reached from one file to a writer.

    References to pages that are not taken become null. A destination given by name is spelled out, since the names
    stay behind; one whose page is not taken goes.
    """

    def __init__(self, pdf: Pdf, out: Writer, cut: set[int] | None = None):
        self.pdf, self.out = pdf, out
        self.done: dict[int, Ref] = {}
        self.cut = cut or set()
        self._names: dict[bytes, Any] | None = None

    def value(self, x: Any) -> Any:
        """A copy of an object and of all it reaches."""
        todo: list[tuple[Ref, Any]] = []
        result = self._shallow(x, todo)
        while todo:
            ref, inner = todo.pop()
            self.out.set(ref, self._shallow(inner, todo))
        return result

    def _shallow(self, x: Any, todo: list) -> Any:
        if isinstance(x, Ref):
            if x.number in self.done:
                return self.done[x.number]
            if x.number in self.cut:
                return None
            inner = self.pdf.get(x)
            if inner is None:
                return None
            new = self.done[x.number] = self.out.add()
            todo.append((new, inner))
            return new
        if isinstance(x, list):
            return [self._shallow(y, todo) for y in x]
        if isinstance(x, dict):
            return {k: self._shallow(self._destination(x, k, y), todo) for k, y in x.items()}
        if isinstance(x, Stream):
            return Stream({k: self._shallow(y, todo) for k, y in x.info.items() if k != "Length"}, x.raw)
        return x

    def _destination(self, owner: dict[str, Any], key: str, x: Any) -> Any:
        goes = key == "Dest" or key == "D" and self.pdf.get(owner.get("S")) == "GoTo"
        target = self.pdf.get(x) if goes else None
        if not isinstance(target, (str, bytes)):
            return x
        if self._names is None:
            self._names = self.pdf.destinations()
        found = self.pdf.get(self._names.get(target if isinstance(target, bytes) else target.encode("latin-1")))
        found = self.pdf.get(found.get("D")) if isinstance(found, dict) else found
        return found if isinstance(found, list) else x


def save(pdf: Pdf, *, security: Security | None = None, packed: bool = False) -> tuple[bytes, int]:
    """A file as its objects are now, and how many objects nothing reached.

    A protected file stays protected in the way it was opened, unless ``security`` gives another.
    """
    out = Writer()
    copier = Copier(pdf, out)
    copier._destination = lambda owner, key, x: x  # the names are kept
    root = copier.value(pdf.trailer["Root"])
    info = copier.value(pdf.trailer["Info"]) if isinstance(pdf.get(pdf.trailer.get("Info")), dict) else None
    if info is not None and not isinstance(info, Ref):
        info = out.add(info)
    keep = security or pdf.security
    if keep and "Filter" in keep.info:
        keep.info["ID"] = pdf.get(pdf.trailer.get("ID"))
    known = set(pdf.entries) | set(pdf.cache)
    structure = sum(isinstance(x := pdf._quietly(n), Stream) and x.info.get("Type") in ("XRef", "ObjStm") for n in known)
    unused = max(0, len(known) - structure - (keep is not None) - len(copier.done))
    return out.finish(root, info, security=keep, packed=packed, version=max(pdf.version, "1.5") if not keep else "1.7"), unused


def standard_font(name: str = "Helvetica") -> dict[str, Any]:
    """A font that every reader has."""
    return {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name(name), "Encoding": Name("WinAnsiEncoding")}


def outline_tree(out: Writer, entries: list[tuple[int, str, Any]]) -> Ref:
    """The linked tree of outline entries (level, title, destination); a level that leaps is the child of what stands before it."""
    root = out.add()
    items = [(out.add(), level, title, target) for level, title, target in entries]
    parent: list[Ref] = []
    open_: list[tuple[int, Ref]] = []
    children: dict[Ref, list[Ref]] = {}
    for ref, level, _, _ in items:
        while open_ and open_[-1][0] >= level:
            open_.pop()
        up = open_[-1][1] if open_ else root
        parent.append(up)
        children.setdefault(up, []).append(ref)
        open_.append((level, ref))

    below: dict[Ref, int] = {}
    for (ref, *_), up in zip(reversed(items), reversed(parent)):
        below[up] = below.get(up, 0) + 1 + below.get(ref, 0)
    place = {ref: k for siblings in children.values() for k, ref in enumerate(siblings)}
    for (ref, _, title, target), up in zip(items, parent):
        siblings, k = children[up], place[ref]
        info: dict[str, Any] = {"Title": encode_text(title), "Parent": up} | ({"Dest": target} if target is not None else {})
        if k:
            info["Prev"] = siblings[k - 1]
        if k + 1 < len(siblings):
            info["Next"] = siblings[k + 1]
        if ref in children:
            info |= {"First": children[ref][0], "Last": children[ref][-1], "Count": below[ref]}
        out.set(ref, info)
    out.set(root, {"Type": Name("Outlines"), "First": children[root][0], "Last": children[root][-1], "Count": below[root]})
    return root


def text_width(text: str, size: float) -> float:
    """Width in Helvetica."""
    return sum(helvetica(b) for b in text.encode("cp1252", "replace")) * size / 1000


def text_at(text: str, x: float, y: float, size: float) -> bytes:
    """Operators that show one line of Helvetica; the origin is at the bottom left."""
    return b"BT /F0 %s Tf 1 0 0 1 %s %s Tm %s Tj ET\n" % (serialise(float(size)), serialise(float(x)), serialise(float(y)), serialise(text.encode("cp1252", "replace")))
