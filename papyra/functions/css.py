"""The part of CSS that says how text looks: colours, weight, slant, lines, size, alignment; sheets, selectors, cascade."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields, replace

# Colours that have names, as RRGGBB.
NAMED = {
    "black": "000000", "white": "ffffff", "red": "ff0000", "green": "008000", "blue": "0000ff", "yellow": "ffff00", "orange": "ffa500", "purple": "800080",
    "gray": "808080", "grey": "808080", "silver": "c0c0c0", "maroon": "800000", "navy": "000080", "teal": "008080", "olive": "808000", "lime": "00ff00",
    "aqua": "00ffff", "cyan": "00ffff", "fuchsia": "ff00ff", "magenta": "ff00ff", "pink": "ffc0cb", "brown": "a52a2a", "gold": "ffd700",
    "darkgray": "a9a9a9", "lightgray": "d3d3d3", "crimson": "dc143c",
}
# Sizes that have names, in sizes of body text.
SIZES = {"xx-small": 0.6, "x-small": 0.75, "small": 0.85, "smaller": 0.85, "medium": 1.0, "large": 1.2, "larger": 1.2, "x-large": 1.5, "xx-large": 2.0}

Color = tuple[int, int, int]


def color(value: str) -> Color | None:
    """A colour by name, ``#rgb``, ``#rrggbb``, either with opacity, or ``rgb()`` in numbers or shares."""
    v = value.strip().lower()
    v = "#" + NAMED[v] if v in NAMED else v
    if m := re.fullmatch(r"#([0-9a-f]{3})[0-9a-f]?", v):
        return tuple(17 * int(c, 16) for c in m[1])
    if m := re.fullmatch(r"#([0-9a-f]{6})(?:[0-9a-f]{2})?", v):
        return tuple(bytes.fromhex(m[1]))
    if m := re.fullmatch(r"rgba?\((.*?)\)*", v):
        parts = [p for p in re.split(r"[, /]+", m[1]) if p]
        try:
            numbers = [float(p[:-1]) * 2.55 if p.endswith("%") else float(p) for p in parts]
        except ValueError:
            return None
        if len(numbers) >= 3:
            return tuple(int(min(255.0, max(0.0, x)) + 0.5) for x in numbers[:3])
    return None


def size(value: str) -> tuple[float, bool] | None:
    """A font size: (points, False), or (sizes of body text, True). Pixels are three quarters of a point."""
    v = value.strip().lower()
    if v in SIZES:
        return SIZES[v], True
    m = re.fullmatch(r"(\d+\.?\d*|\.\d+)(pt|px|em|rem|%|)", v)
    if not m or float(m[1]) <= 0:
        return None
    n = float(m[1])
    return {"pt": (n, False), "px": (0.75 * n, False), "": (0.75 * n, False), "em": (n, True), "rem": (n, True), "%": (n / 100, True)}[m[2]]


@dataclass(frozen=True)
class Look:
    """What styling says of a text; None says nothing, and what is around decides."""

    color: Color | None = None
    highlight: Color | None = None
    fill: Color | None = None
    bold: bool | None = None
    italic: bool | None = None
    underline: bool | None = None
    strike: bool | None = None
    align: str | None = None
    size: tuple[float, bool] | None = None

    def over(self, base: Look) -> Look:
        """This look, and ``base`` where it says nothing."""
        return Look(*[getattr(base, f.name) if (own := getattr(self, f.name)) is None else own for f in fields(Look)])


def declared(text: str, block: bool) -> Look:
    """The look of declarations; a background fills a block and lies behind the words of anything else."""
    out = Look()
    for one in text.split(";"):
        name, _, value = one.partition(":")
        name, value = name.strip().lower(), value.replace("!important", "").strip()
        v = value.lower()
        new: dict = {}
        if name == "color":
            new = {"color": color(value)}
        elif name in ("background", "background-color"):
            found = color(value) or next((c for part in value.split() if (c := color(part))), None)
            new = {"fill" if block else "highlight": found}
        elif name == "font-weight":
            new = {"bold": True if v in ("bold", "bolder") else False if v in ("normal", "lighter") else int(v) >= 600 if v.isdigit() else None}
        elif name == "font-style":
            new = {"italic": {"italic": True, "oblique": True, "normal": False}.get(v)}
        elif name in ("text-decoration", "text-decoration-line"):
            new = {"underline": False, "strike": False} if "none" in v else {}
            new |= {k: True for k, word in (("underline", "underline"), ("strike", "line-through")) if word in v}
        elif name == "text-align":
            new = {"align": {"left": "left", "start": "left", "justify": "left", "center": "center", "right": "right", "end": "right"}.get(v)}
        elif name == "font-size":
            new = {"size": size(value)}
        out = replace(out, **{k: x for k, x in new.items() if x is not None})
    return out


@dataclass(frozen=True)
class Element:
    """An element as selectors see it."""

    tag: str
    classes: frozenset[str] = frozenset()
    id: str | None = None


def selector(text: str) -> list[tuple[str | None, str | None, str | None]] | None:
    """(tag, class, id) of the elements that a selector names, outermost first; None for a kind that is not read."""
    out = []
    for part in text.split():
        m = re.fullmatch(r"(\*|[A-Za-z0-9_-]+)?((?:[.#][A-Za-z0-9_-]+)*)", part)
        marks = re.findall(r"[.#][A-Za-z0-9_-]+", m[2]) if m else []
        if not m or sum(x[0] == "." for x in marks) > 1:
            return None
        named = {x[0]: x[1:] for x in marks}
        out.append((m[1].lower() if m[1] and m[1] != "*" else None, named.get("."), named.get("#")))
    return out or None


def _names(part: tuple[str | None, str | None, str | None], e: Element) -> bool:
    tag, cls, ident = part
    return (tag is None or tag == e.tag) and (cls is None or cls in e.classes) and (ident is None or ident == e.id)


def picks(parts: list[tuple[str | None, str | None, str | None]], e: Element, around: list[Element]) -> bool:
    """Whether a selector picks an element that stands inside ``around``, outermost first."""
    outer = iter(around)
    return _names(parts[-1], e) and all(any(_names(p, a) for a in outer) for p in parts[:-1])


def weight(parts: list[tuple[str | None, str | None, str | None]]) -> tuple[int, int, int]:
    """How narrowly a selector picks: ids, classes, tags."""
    return tuple(sum(p[k] is not None for p in parts) for k in (2, 1, 0))


class Sheet:
    """The rules of a document's style sheets."""

    def __init__(self) -> None:
        self.rules: list[tuple[list, str]] = []

    def add(self, text: str) -> None:
        """Take in a sheet; at-rules are left out with all they hold."""
        text = re.sub(r"/\*.*?(?:\*/|\Z)", "", text, flags=re.S)
        at = 0
        while (open_ := text.find("{", at)) >= 0:
            head = re.split(r"[};]", text[at:open_])[-1].strip()
            if head.startswith("@"):
                depth, at = 1, open_ + 1
                while depth and at < len(text):
                    depth += (text[at] == "{") - (text[at] == "}")
                    at += 1
                continue
            end = text.find("}", open_)
            end = len(text) if end < 0 else end
            self.rules += [(parts, text[open_ + 1 : end]) for s in head.split(",") if (parts := selector(s))]
            at = end + 1

    def look(self, e: Element, around: list[Element], block: bool) -> Look:
        """The look that the sheets give an element: narrower rules win, and of equals the later one."""
        out = Look()
        for _, text in sorted(((p, t) for p, t in self.rules if picks(p, e, around)), key=lambda r: weight(r[0])):
            out = declared(text, block).over(out)
        return out
