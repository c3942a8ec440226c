"""Markdown, and the HTML that it carries, as one stream of events, and the blocks that these make.

Both notations become the same events, start and end of an element and text, so one builder knows headings, emphasis,
lists, quotes, code, tables, links, images and looks, whichever way they were written.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from ..functions import css
from ..functions.css import Element, Look, Sheet
from ..functions.text import ENTITIES

VOID = {"br", "img", "hr", "meta", "link", "input", "col", "wbr", "source"}
BLOCK = set("p div h1 h2 h3 h4 h5 h6 td th tr table li ul ol blockquote section article header footer main body".split())
#: Elements whose text is no part of the document.
SKIPPED = {"script", "style", "title", "head"}
#: Elements that mean something here or change nothing; any other is counted as it opens.
KNOWN = BLOCK | VOID | SKIPPED | set(
    "b strong i em cite var code kbd tt samp a pre tbody thead tfoot span u font small big s del strike ins mark sup sub center html nav label abbr figure "
    "figcaption caption colgroup".split()
)
BOLD, ITALIC, MONO = {"b", "strong", "th"}, {"i", "em", "cite", "var"}, {"code", "kbd", "tt", "samp"}
#: What an element that opens ends first, and what it does not reach beyond.
IMPLIED = {"li": ({"li"}, {"ul", "ol"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "p": ({"p"}, BLOCK - {"p"})}

Event = tuple[str, str, dict[str, str]]


@dataclass
class Span:
    """Text of one style; a line feed is a hard break."""

    text: str
    bold: bool = False
    italic: bool = False
    mono: bool = False
    link: str | None = None
    look: Look = field(default_factory=Look)


@dataclass
class Block:
    """``text`` (level 0 to 6), ``code``, ``rule``, ``list`` (items of blocks), ``quote``, ``table`` (rows of cells), ``image``."""

    kind: str
    spans: list[Span] = field(default_factory=list)
    level: int = 0
    text: str = ""
    first: int | None = None
    parts: list = field(default_factory=list)


# --- HTML ----------------------------------------------------------------------------------------------------------


def decode(text: str) -> str:
    """The references that are known, decoded once from left to right; names of up to ten characters."""

    def one(m: re.Match) -> str:
        name = m[1]
        if name in ENTITIES:
            return " " if name == "nbsp" else ENTITIES[name]
        if name.startswith("#"):
            try:
                n = int(name[2:], 16) if name[1:2] in ("x", "X") else int(name[1:])
                return chr(n) if not 0xD800 <= n <= 0xDFFF else m[0]
            except (ValueError, OverflowError):
                return m[0]
        return m[0]

    return re.sub(r"&([^&;]{0,10});", one, text)


_ATTRIBUTE = re.compile(r"(?:^|\s)([A-Za-z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|(\S+))")


def attributes(inside: str) -> dict[str, str]:
    """Attributes of the inside of a tag; the first of a name counts."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(inside):
        out.setdefault(m[1].lower(), decode(next((g for g in m.groups()[1:] if g is not None), "")))
    return out


def html_events(fragment: str) -> Iterator[Event]:
    """Events of a piece of HTML: comments are passed over, ``<`` before a letter or a slash opens a tag up to the next ``>``."""
    for m in re.finditer(r"<!--.*?(?:-->|\Z)|<(/?[A-Za-z/][^>]*)>|([^<]+|<)", fragment, re.S):
        if m[2] is not None:
            yield "text", m[2], {}
        elif m[1] is not None:
            inside = m[1]
            name = re.match(r"[A-Za-z0-9]*", inside.lstrip("/"))[0].lower()
            if inside.startswith("/"):
                yield "end", name, {}
            else:
                yield "start", name, attributes(inside[len(name) :].rstrip("/"))
                if inside.endswith("/") and name not in VOID:
                    yield "end", name, {}


# --- Markdown ------------------------------------------------------------------------------------------------------

_BULLET = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])( +|$)")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})[^`]*$")
_HEADING = re.compile(r" {0,3}(#{1,6})(?:\s+(.*?))?(?:\s+#+)?\s*$")
_RULE = re.compile(r" {0,3}(?:(?:\*\s*){3,}|(?:-\s*){3,}|(?:_\s*){3,})$")
_DELIMITERS = re.compile(r"\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*$")
_HTML = re.compile(r" {0,3}<(?:!--|/?([A-Za-z][A-Za-z0-9]*)(?=[\s/>]|$))")


def _inside(name: str, events: Iterator[Event]) -> Iterator[Event]:
    yield "start", name, {}
    yield from events
    yield "end", name, {}


def _cells(line: str) -> list[str]:
    parts = re.split(r"(?<!\\)\|", line.strip())
    parts = parts[1:] if parts and not parts[0].strip() else parts
    parts = parts[:-1] if parts and not parts[-1].strip() else parts
    return [p.strip().replace("\\|", "|") for p in parts]


def markdown_events(lines: list[str]) -> Iterator[Event]:
    """Events of lines of Markdown: headings, rules, code, quotes, lists, tables, HTML, paragraphs."""
    k = 0
    while k < len(lines):
        line = lines[k]
        if not line.strip():
            k += 1
        elif m := _FENCE.match(line):
            close = next((j for j in range(k + 1, len(lines)) if re.fullmatch(rf" {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}\s*", lines[j])), len(lines))
            yield from _inside("pre", iter([("verbatim", "\n".join(lines[k + 1 : close]), {})]))
            k = close + 1
        elif line.startswith("    "):
            stop = k
            while stop < len(lines) and (lines[stop].startswith("    ") or not lines[stop].strip()):
                stop += 1
            yield from _inside("pre", iter([("verbatim", "\n".join(x[4:] for x in lines[k:stop]).rstrip("\n"), {})]))
            k = stop
        elif m := _HEADING.match(line):
            yield from _inside(f"h{len(m[1])}", inline_events(m[2] or ""))
            k += 1
        elif _RULE.match(line):
            yield "start", "hr", {}
            k += 1
        elif line.lstrip().startswith(">") and len(line) - len(line.lstrip()) < 4:
            stop = k
            while stop < len(lines) and lines[stop].strip():
                stop += 1
            yield from _inside("blockquote", markdown_events([re.sub(r"^ {0,3}> ?", "", x) for x in lines[k:stop]]))
            k = stop
        elif m := _BULLET.match(line):
            k = yield from _list(lines, k)
        elif k + 1 < len(lines) and "|" in line and "-" in lines[k + 1] and _DELIMITERS.match(lines[k + 1]) and len(_cells(lines[k + 1])) == len(_cells(line)):
            k = yield from _table(lines, k)
        elif (m := _HTML.match(line)) and (m[1] is None or m[1].lower() in KNOWN - {"b", "i", "a", "em", "strong", "code", "span", "u", "s", "mark", "br", "img"}):
            stop = k
            opened = (m[1] or "").lower()
            if opened in ("script", "style", "pre"):
                stop = next((j for j in range(k, len(lines)) if f"</{opened}" in lines[j].lower()), len(lines) - 1) + 1
            while stop < len(lines) and lines[stop].strip():
                stop += 1
            yield from html_events("\n".join(lines[k:stop]))
            k = stop
        else:
            stop = k + 1
            underline = re.compile(r" {0,3}(=+|-+)\s*$")
            while stop < len(lines) and lines[stop].strip() and not underline.match(lines[stop]) and not any(p.match(lines[stop]) for p in (_FENCE, _HEADING, _RULE, _BULLET)) and not lines[stop].lstrip().startswith(">"):
                stop += 1
            if stop < len(lines) and underline.match(lines[stop]):
                yield from _inside("h1" if "=" in lines[stop] else "h2", inline_events("\n".join(x.strip() for x in lines[k:stop])))
                stop += 1
            else:
                text = "\n".join(x.lstrip() for x in lines[k:stop])
                yield from _inside("p", inline_events(text))
            k = stop


def _list(lines: list[str], k: int) -> Iterator[Event]:
    first = _BULLET.match(lines[k])
    ordered = first[2][0].isdigit()
    yield "start", "ol" if ordered else "ul", {"start": first[2][:-1]} if ordered else {}
    loose = False
    while k < len(lines) and (m := _BULLET.match(lines[k])) and m[2][0].isdigit() == ordered and (ordered or m[2] == first[2]) and not _RULE.match(lines[k]):
        indent = len(m[0]) if m[3] else len(m[1]) + len(m[2]) + 1
        indent = min(indent, len(m[1]) + len(m[2]) + 4)
        own, k = [lines[k][indent:]], k + 1
        while k < len(lines):
            line = lines[k]
            if not line.strip():
                if k + 1 >= len(lines) or len(lines[k + 1]) - len(lines[k + 1].lstrip()) < min(indent, 2) or not lines[k + 1].strip():
                    break
                loose = True
                own.append("")
            elif len(line) - len(line.lstrip()) >= min(indent, 2):
                own.append(line[min(indent, len(line) - len(line.lstrip())) :])
            elif _BULLET.match(line) or not own[-1].strip() or _HEADING.match(line) or _FENCE.match(line):
                break
            else:
                own.append(line.lstrip())
            k += 1
        yield "start", "li", {}
        yield from markdown_events(own)
        yield "end", "li", {}
        while k < len(lines) and not lines[k].strip() and k + 1 < len(lines) and _BULLET.match(lines[k + 1]):
            k += 1
    yield "end", "ol" if ordered else "ul", {"loose": str(loose)}
    return k


def _table(lines: list[str], k: int) -> Iterator[Event]:
    yield "start", "table", {}
    columns = len(_cells(lines[k]))
    for n, j in enumerate([k, *range(k + 2, len(lines))]):
        if n and (not lines[j].strip() or "|" not in lines[j] and columns > 1):
            break
        yield "start", "tr", {}
        for cell in (_cells(lines[j]) + [""] * columns)[:columns]:
            yield from _inside("td" if n else "th", inline_events(cell))
        yield "end", "tr", {}
        last = j
    yield "end", "table", {}
    return max(last, k + 1) + 1


_INLINE = re.compile(
    r"(?P<escape>\\[!-/:-@\[-`{-~])|(?P<hard>\\\n| {2,}\n)|(?P<ticks>`+)|(?P<auto><(?:https?|mailto):[^\s<>]*>)|(?P<tag><!--.*?-->|</?[A-Za-z][^<>]*>)"
    r"|(?P<image>!\[)|(?P<open>\[)|(?P<close>\]\((?:<(?P<angled>[^<>\n]*)>|(?P<bare>[^\s()]*(?:\([^\s()]*\)[^\s()]*)*))(?:\s+(?:\"[^\"]*\"|'[^']*'))?\s*\))"
    r"|(?P<mark>\*{1,3}|(?<!\w)_{1,3}(?=\S)|_{1,3}(?!\w)|~~)|(?P<soft>\n)",
    re.S,
)


def inline_events(text: str) -> Iterator[Event]:
    """Events of the text of a paragraph: emphasis, code, links, images, breaks, HTML."""
    out: list[Event] = []
    open_: list[tuple[str, int]] = []
    at = 0

    def put(plain: str) -> None:
        if plain:
            out.append(("text", html.unescape(plain) if "&" in plain else plain, {"plain": "1"}))

    while m := _INLINE.search(text, at):
        put(text[at : m.start()])
        at = m.end()
        kind = m.lastgroup if m.lastgroup not in ("angled", "bare") else "close"
        if kind == "escape":
            out.append(("text", m[0][1:], {"plain": "1"}))
        elif kind == "hard":
            out.append(("start", "br", {}))
        elif kind == "soft":
            out.append(("text", " ", {"plain": "1"}))
        elif kind == "ticks":
            end = re.compile(rf"(?<!`)`{{{len(m[0])}}}(?!`)").search(text, at)
            if end:
                code = text[at : end.start()].replace("\n", " ")
                code = code[1:-1] if len(code) > 1 and code[0] == code[-1] == " " and code.strip() else code
                out += _inside("code", iter([("text", code, {"plain": "1"})]))
                at = end.end()
            else:
                put(m[0])
        elif kind == "auto":
            out += [("start", "a", {"href": m[0][1:-1]}), ("text", m[0][1:-1], {"plain": "1"}), ("end", "a", {})]
        elif kind == "tag":
            out += html_events(m[0])
        elif kind in ("image", "open"):
            open_.append(("![" if kind == "image" else "[", len(out)))
            out.append(("text", m[0], {"plain": "1"}))
        elif kind == "close":
            found = next((j for j in range(len(open_) - 1, -1, -1) if open_[j][0] in ("[", "![")), None)
            target = m["angled"] if m["angled"] is not None else m["bare"] or ""
            if found is None:
                put(m[0])
            elif open_[found][0] == "![":
                start = open_[found][1]
                alt = "".join(e[1] for e in out[start + 1 :] if e[0] == "text")
                out[start:] = [("start", "img", {"src": target, "alt": alt})]
                del open_[found:]
            else:
                out[open_[found][1]] = ("start", "a", {"href": target})
                out.append(("end", "a", {}))
                del open_[found]
        else:
            _mark(m, text, out, open_)
    put(text[at:])
    yield from out


def _mark(m: re.Match, text: str, out: list[Event], open_: list[tuple[str, int]]) -> None:
    """A run of emphasis marks: it closes what is open with the same marks if it follows text, else it may open."""
    run = m[0]
    tags = {1: ["em"], 2: ["strong"], 3: ["strong", "em"]}[len(run)] if run[0] != "~" else ["del"]
    follows, leads = text[m.start() - 1 : m.start()].strip() != "" if m.start() else False, text[m.end() : m.end() + 1].strip() != ""
    found = next((j for j in range(len(open_) - 1, -1, -1) if open_[j][0] == run), None)
    if follows and found is not None:
        at = open_[found][1]
        out[at : at + 1] = [("start", t, {}) for t in tags]
        out.extend(("end", t, {}) for t in reversed(tags))
        del open_[found:]
    else:
        if leads:
            open_.append((run, len(out)))
        out.append(("text", run, {"plain": "1"}))


# --- blocks --------------------------------------------------------------------------------------------------------


@dataclass
class _Open:
    element: Element
    look: Look
    attributes: dict[str, str]
    #: Where finished blocks go, for elements that hold blocks.
    blocks: list[Block] | None = None
    block: Block | None = None


class Builder:
    """Blocks from events."""

    def __init__(self) -> None:
        self.sheet, self.styles, self.skipping = Sheet(), None, None
        self.unknown = 0
        self.open: list[_Open] = []
        self.top: list[Block] = []
        self.spans: list[Span] = []
        self.level = 0

    def run(self, events: Iterator[Event]) -> list[Block]:
        for kind, value, more in events:
            if kind == "start":
                self.start(value, more)
            elif kind == "end":
                self.end(value)
            elif kind == "verbatim":
                self._current().append(Block("code", text=value))
            else:
                self.text(value, bool(more))
        self.flush()
        while self.open:
            self._pop()
        return self.top

    def _current(self) -> list[Block]:
        return next((o.blocks for o in reversed(self.open) if o.blocks is not None), self.top)

    def flush(self) -> None:
        """End the text that is being gathered."""
        if any(s.text.strip() for s in self.spans):
            self.spans[0].text = self.spans[0].text.lstrip(" ")
            self.spans[-1].text = self.spans[-1].text.rstrip(" \n")
            self._current().append(Block("text", [s for s in self.spans if s.text], self.level))
        self.spans, self.level = [], 0

    def text(self, text: str, plain: bool) -> None:
        if self.styles is not None:
            self.styles += text
            return
        if self.skipping or self._dropped():
            return
        if any(o.element.tag == "pre" for o in self.open):
            pre = next(o for o in reversed(self.open) if o.element.tag == "pre")
            pre.attributes["text"] = pre.attributes.get("text", "") + (text if plain else decode(text))
            return
        flat = re.sub(r"[ \t\r\n\f]+", " ", text if plain else decode(text))
        before = self.spans[-1].text if self.spans else "\n"
        if before.endswith((" ", "\n")):
            flat = flat.lstrip(" ")
        if flat:
            self.spans.append(self._span(flat))

    def _dropped(self) -> bool:
        """Between the cells of a table nothing is said."""
        inside = [o.element.tag for o in self.open]
        return bool(inside) and inside[-1] in ("table", "tr", "tbody", "thead", "tfoot")

    def _span(self, text: str) -> Span:
        tags = [o.element.tag for o in self.open]
        look = self.open[-1].look if self.open else Look()
        has = lambda names: any(t in names for t in tags)
        link = next((o.attributes.get("href") for o in reversed(self.open) if o.element.tag == "a"), None)
        bold = has(BOLD) if look.bold is None else look.bold
        italic = has(ITALIC) if look.italic is None else look.italic
        return Span(text, bold, italic, has(MONO), link, look)

    def _look(self, e: Element, more: dict[str, str]) -> Look:
        block = e.tag in BLOCK
        own = {
            "u": Look(underline=True), "ins": Look(underline=True), "s": Look(strike=True), "del": Look(strike=True), "strike": Look(strike=True),
            "mark": Look(highlight=(255, 255, 0)), "center": Look(align="center"), "small": Look(size=(0.85, True)), "big": Look(size=(1.2, True)),
        }.get(e.tag, Look())
        around = [o.element for o in self.open]
        align = more.get("align", "").lower()
        asked = Look(color=css.color(more.get("color", "")), fill=css.color(more.get("bgcolor", "")), align=align if align in ("left", "center", "right") else None)
        own = css.declared(more.get("style", ""), block).over(asked).over(self.sheet.look(e, around, block)).over(own)
        if e.tag in BOLD and own.bold is None:
            own = Look(bold=True).over(own)
        if e.tag in ITALIC and own.italic is None:
            own = Look(italic=True).over(own)
        return own.over(self.open[-1].look if self.open else Look())

    def start(self, tag: str, more: dict[str, str]) -> None:
        if tag == "style" and self.styles is None:
            self.styles = ""
            return
        if self.styles is not None or self.skipping:
            return
        if tag in SKIPPED:
            self.skipping = tag
            return
        if tag not in KNOWN:
            self.unknown += 1
        if tag in IMPLIED:
            self._close(*IMPLIED[tag])
        e = Element(tag, frozenset(more.get("class", "").split()), more.get("id"))
        if tag == "br":
            if self.spans:
                self.spans.append(self._span(" " if any(o.element.tag in ("td", "th") for o in self.open) else "\n"))
            return
        if tag == "img":
            held = self.spans, self.level
            if not any(o.element.tag in ("td", "th") for o in self.open):
                self.flush()
                self._current().append(Block("image", text=more.get("src", "")))
                self.level = held[1]
            return
        if tag == "hr":
            self.flush()
            self._current().append(Block("rule"))
            return
        if tag in VOID:
            return
        if tag in BLOCK or tag == "pre":
            self.flush()
        o = _Open(e, self._look(e, more), dict(more))
        if tag in ("ul", "ol"):
            number = more.get("start", "1")
            o.block = Block("list", first=(int(number) if number.isdigit() else 1) if tag == "ol" else None)
            o.blocks = []
        elif tag == "blockquote":
            o.block, o.blocks = Block("quote"), []
        elif tag == "table":
            o.block, o.blocks = Block("table"), []
        elif tag in ("li", "td", "th"):
            o.blocks = []
        self.open.append(o)
        if re.fullmatch("h[1-6]", tag):
            self.level = int(tag[1])
        elif tag == "tr":
            table = next((x.block for x in reversed(self.open) if x.block is not None and x.block.kind == "table"), None)
            if table is not None:
                table.parts.append([])

    def end(self, tag: str) -> None:
        if tag == "style":
            if self.styles is not None:
                self.sheet.add(self.styles)
            self.styles = None
            return
        if self.styles is not None:
            return
        if self.skipping:
            self.skipping = None if tag == self.skipping else self.skipping
            return
        if tag in BLOCK:
            self.flush()
        self._close({tag}, set())

    def _close(self, names: set[str], stops: set[str]) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            tag = self.open[k].element.tag
            if tag in names:
                if names & BLOCK or "pre" in names:
                    self.flush()
                while len(self.open) > k:
                    self._pop()
                return
            if tag in stops:
                return

    def _pop(self) -> None:
        o = self.open[-1]
        tag = o.element.tag
        if tag in BLOCK:
            self.flush()
        self.open.pop()
        if tag == "pre":
            if "text" in o.attributes:
                self._current().append(Block("code", text=o.attributes["text"].strip("\n")))
        elif tag == "li":
            owner = next((x for x in reversed(self.open) if x.block is not None and x.block.kind == "list"), None)
            if owner is not None:
                owner.block.parts.append(o.blocks)
            else:
                self._current().extend(o.blocks)
        elif tag in ("td", "th"):
            table = next((x.block for x in reversed(self.open) if x.block is not None and x.block.kind == "table"), None)
            spans = []
            for b in o.blocks:
                spans += [Span(" ")] * bool(spans) + b.spans
            if table is not None and table.parts:
                table.parts[-1].append((spans, o.look))
            else:
                self._current().extend(o.blocks)
        elif o.block is not None:
            if o.block.kind == "table":
                o.block.parts = [row for row in o.block.parts if row]
            if o.block.kind == "quote":
                o.block.parts = o.blocks
            elif o.block.kind == "list" and o.blocks:
                o.block.parts.append(o.blocks)
            if o.block.parts:
                self._current().append(o.block)


def document(source: str) -> tuple[list[Block], int]:
    """The blocks of Markdown with HTML in it, and how many tags meant nothing here."""
    builder = Builder()
    lines = source.replace("\r\n", "\n").replace("\r", "\n").expandtabs(4).split("\n")
    return builder.run(markdown_events(lines)), builder.unknown


def html_document(source: str) -> tuple[list[Block], int]:
    """The same for a page of HTML."""
    builder = Builder()
    return builder.run(html_events(source)), builder.unknown


def to_markdown(blocks: list[Block], indent: str = "") -> str:
    """Blocks as plain Markdown; looks are lost."""
    out = []
    for b in blocks:
        if b.kind == "text":
            out.append("#" * b.level + " " * bool(b.level) + _inline_markdown(b.spans).replace("\n", "\\\n"))
        elif b.kind == "code":
            out.append("```\n" + b.text + "\n```")
        elif b.kind == "rule":
            out.append("---")
        elif b.kind == "image":
            out.append(f"![]({b.text})")
        elif b.kind == "quote":
            out.append("\n".join("> " + line if line else ">" for line in to_markdown(b.parts).split("\n")))
        elif b.kind == "list":
            items = []
            for k, item in enumerate(b.parts):
                mark = "- " if b.first is None else f"{b.first + k}. "
                body = to_markdown(item).split("\n")
                items.append(mark + "\n".join([body[0], *(" " * len(mark) + x if x else "" for x in body[1:])]))
            out.append("\n".join(items))
        elif b.kind == "table":
            columns = max(map(len, b.parts))
            rows = [[_inline_markdown(s).replace("|", "\\|").replace("\n", " ") for s, _ in row] + [""] * (columns - len(row)) for row in b.parts]
            lines = ["| " + " | ".join(r) + " |" for r in rows]
            out.append("\n".join([lines[0], "|" + " --- |" * columns, *lines[1:]]))
    return "\n\n".join(out)


def _inline_markdown(spans: list[Span]) -> str:
    out = []
    for s in spans:
        text, marks = s.text, ("`" if s.mono else "") + ("**" if s.bold else "") + ("*" if s.italic else "")
        bare = text.strip()
        if bare and marks and not s.link:
            text = text.replace(bare, marks + bare + marks[::-1], 1)
        out.append(f"[{text}]({s.link})" if s.link is not None else text)
    return "".join(out)
