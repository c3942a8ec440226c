"""Main text of HTML pages: what a host repeats over its pages goes, what is unique stays.

Each page is parsed into blocks. Scripts, menus, footers and the like go by their elements, roles and class names;
where a page has a main or article element, only text in these is looked at. On what is left the host decides: the
token streams of all its pages make one text, whose suffixes are sorted as far as their first ``LEAST`` tokens. A
prefix that stands on many distinct pages of the host is boilerplate, the tokens that such prefixes cover are removed,
and the unique runs stay.

The suffix array is distributed. The suffixes of every place are in it: a run of ``LEAST`` tokens is met wherever in its
block it stands. A suffix ends with its block, since the words before or after a menu are the page's own, and a block
of fewer than ``LEAST`` tokens is met as a whole. Suffixes are dealt by host and prefix, pages never are: a host with a
third of all pages spreads over tasks by its number of pages, its repeated prefixes are counted where they are made
first, and no page is compared with a part of its host only. So results depend neither on partitions nor on the size
of anything held. Prefixes travel as sorted differences of 56-bit hashes, which host and tokens make together.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import lean, materialise, release, slices

#: Tokens by which suffixes are sorted, and the number of neighbours of which one is in the array: 1 takes them all.
LEAST = 8
SPARSE = 1
#: Distinct pages, and share of the host's pages, on which a run must stand to be boilerplate: outside of main and
#: article elements, and inside, where the page itself says that the text is its own.
PAGES, SHARE = 3, 0.3
OWN_PAGES, OWN_SHARE = 5, 0.5
#: Share of a block that must be covered for all of it to go; of other blocks the covered tokens go.
COVERED = 0.5
#: Suffixes that a task holds before it hands on their counts.
HELD_SUFFIXES = 2_000_000
#: Pages of a host whose prefixes are counted together: a larger host is dealt by ranges of its prefixes.
HOST_PAGES = 256
#: Bits of a prefix's hash.
KEY_BITS = 56
#: Boilerplate prefixes that are broadcast, at most: 9 bytes each. Beyond that they are joined.
BROADCAST_PREFIXES = 2_000_000

# Fixed values of HTML.
_RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp", "noscript", "template", "svg", "math"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table "
    "tbody td tfoot th thead tr ul".split()
)
_CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
_SCOPE = {"ul", "ol", "dl", "table", "div", "article", "section", "main", "body", "td", "th", "nav", "aside", "footer", "header", "form", "blockquote"}

# Elements, roles and words of class names that mark boilerplate.
_SKIP_TAGS = {"nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "head", "object", "canvas", "audio", "video"}
_SKIP_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form", "menu", "menubar", "toolbar"}
_SKIP_WORDS = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "copyright disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notification overlay "
    "pager pagination popup promo promotion promoted recommended related replies respond share sharing sidebar signup "
    "social sponsor sponsored subscribe subscription toolbar topbar widget".split()
)
# Inside main and article elements, class names or ids that stand alone and mark an element of another use.
_SKIP_IN_MAIN = {
    "ad", "ads", "advert", "advertisement", "breadcrumb", "breadcrumbs", "comment", "comments", "cookie-banner", "cookie-notice", "newsletter",
    "pagination", "promo", "related", "related-articles", "related-posts", "replies", "respond", "share", "share-buttons", "sharing", "sidebar",
    "social", "social-share", "sponsored", "subscribe",
}

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>\x00]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([A-Za-z][^\s/>\x00]*)([^>]*)>"
    r"|<[!?/][^>]*>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)


def _skipped(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether an element is boilerplate by its name, role, class, id or hidden state."""
    if tag in _SKIP_TAGS or tag == "header" and not in_article:
        return True
    if not attributes or attributes.isspace():
        return False
    at = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    if "hidden" in at or at.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", at.get("style", ""), re.I):
        return True
    if at.get("role", "").lower() in _SKIP_ROLES:
        return True
    if tag in ("html", "body"):
        return False
    given = [at.get("class", ""), at.get("id", "")]
    if in_article or tag in ("article", "main"):
        return any(x.strip().lower() in _SKIP_IN_MAIN for x in given)
    names = set(re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", " ".join(given)).lower()))
    return bool(names & _SKIP_WORDS)


#: Where a block stands: boilerplate by its place, elsewhere in the body, in main, in an article.
SKIPPED, BODY, MAIN, ARTICLE = range(4)


def blocks(source: str) -> list[tuple[int, str]]:
    """(place, text) of every block with text, in page order; references decoded, white space collapsed."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []
    buffer: list[str] = []
    buffered = BODY

    def flush() -> None:
        if buffer and (text := " ".join("".join(buffer).split())):
            out.append((buffered, text))
        buffer.clear()

    def add(raw: str) -> None:
        nonlocal buffered
        place = stack[-1][1] if stack else BODY
        if place != buffered:
            flush()
            buffered = place
        buffer.append(html.unescape(raw) if "&" in raw else raw)

    def pop_to(k: int) -> None:
        if any(tag in _BLOCK for tag, _ in stack[k:]):
            flush()
        del stack[k:]

    at, end = 0, len(source)
    while at < end:
        m = _TOKEN.search(source, at)
        if m is None:
            add(source[at:])
            break
        if m.start() > at:
            add(source[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    pop_to(k)
                    break
            if tag in _BLOCK:
                flush()
            continue
        attributes = m[3] or m[6] or ""
        if tag in _RAW:
            if not attributes.endswith("/") or tag not in ("svg", "math"):
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, at)
                at = close.end() if close else end
            continue
        if tag in _BLOCK:
            flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    pop_to(k)
                    break
                if stack[k][0] in _SCOPE:
                    break
        if closes := _CLOSES.get(tag):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in closes:
                    pop_to(k)
                    if tag not in ("tr", "tbody", "tfoot"):
                        break
                elif stack[k][0] in _SCOPE and stack[k][0] not in ("td", "th"):
                    break
        if tag == "br":
            add(" ")
        if tag in _VOID:
            continue
        place = stack[-1][1] if stack else BODY
        if place != SKIPPED:
            if _skipped(tag, attributes, place >= MAIN):
                place = SKIPPED
            elif tag == "article":
                place = ARTICLE
            elif place < MAIN and (tag == "main" or re.search(r"role\s*=\s*[\"']?main\b|itemprop\s*=\s*[\"']?articleBody\b", attributes, re.I)):
                place = MAIN
        stack.append((tag, place))
    flush()
    return out


def own_blocks(source: str) -> tuple[list[str], bool]:
    """Blocks that may be the page's own text, and whether main or article elements say so."""
    found = blocks(source)
    marked = any(place >= MAIN for place, _ in found)
    least = MAIN if marked else BODY
    return [text for place, text in found if place >= least], marked


_U = np.uint64
_ODD = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def suffixes(texts: list[str], least: int = LEAST, sparse: int = SPARSE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes of a page's token stream that are in the array, and its short blocks.

    Places and prefix hashes of the former; number of the block and hash of the latter, blocks of fewer than
    ``least + sparse - 1`` tokens. A prefix lies in one block. With ``sparse`` 1 every place is in the array, else the one
    with the smallest hash of so many neighbours.
    """
    digest = xxhash.xxh3_64_intdigest
    split = [t.split() for t in texts]
    lengths = np.array([len(x) for x in split], np.int64)
    tokens = np.fromiter((digest(w) for ws in split for w in ws), _U, int(lengths.sum()))
    short = np.flatnonzero((lengths > 0) & (lengths < least + sparse - 1))
    whole = np.array([digest(" ".join(split[k]), 1) for k in short.tolist()], _U)
    n = len(tokens) - least + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, _U), short, whole
    prefix = np.zeros(n, _U)
    for k in range(least):
        prefix = _mix(prefix * _U(_ODD) + tokens[k : k + n])
    of = np.repeat(np.arange(len(texts)), lengths)
    reach = least + sparse - 1
    at = np.flatnonzero(of[: max(0, len(of) - reach + 1)] == of[reach - 1 :])
    if sparse > 1 and len(at):
        near = np.lib.stride_tricks.sliding_window_view(prefix, sparse)[at]
        at = np.unique(near.argmin(axis=1) + at)
    return at, prefix[at], short, whole


def _keyed(host: int, hashes: np.ndarray) -> np.ndarray:
    return (_mix(hashes ^ _mix(np.array([host & 0xFFFFFFFFFFFFFFFF], _U))) >> _U(64 - KEY_BITS)).view(np.int64)


def _packed(keys: np.ndarray, places: np.ndarray) -> bytes:
    """Sorted keys as bytes of their differences, and a number below 4096 for each; place by place, compressed."""
    steps = np.diff(keys, prepend=0).astype("<u8").view(np.uint8).reshape(-1, 8)[:, : KEY_BITS // 8]
    planes = np.concatenate([steps, places.astype("<u2").view(np.uint8).reshape(-1, 2)], axis=1)
    return len(keys).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(planes.T).tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, width = int.from_bytes(data[:8], "little"), KEY_BITS // 8
    planes = np.frombuffer(pa.decompress(data[8:], n * (width + 2), "zstd", asbytes=True), np.uint8).reshape(width + 2, n)
    steps = np.zeros((n, 8), np.uint8)
    steps[:, :width] = planes[:width].T
    return np.cumsum(steps.view("<u8").reshape(n).astype(np.int64)), np.ascontiguousarray(planes[width:].T).view("<u2").reshape(n)


def _summed(columns: list[np.ndarray]) -> list[np.ndarray]:
    """(key, n, a, b) with keys sorted and met once: numbers added, bitmaps united."""
    order = np.argsort(columns[0], kind="stable")
    keys, n, *bits = (c[order] for c in columns)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return [keys[first], np.add.reduceat(n, first), *(np.bitwise_or.reduceat(b, first) for b in bits)]


def cut(texts: list[str], boilerplate, least: int = LEAST, sparse: int = SPARSE) -> str:
    """The unique runs of a page's blocks. ``boilerplate`` tells of an array of hashes which are boilerplate."""
    at, prefix, short, whole = suffixes(texts, least, sparse)
    lengths = [len(t.split()) for t in texts]
    edge = np.zeros(sum(lengths) + 1, np.int64)
    hit = at[boilerplate(prefix)]
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + least, -1)
    mask = np.cumsum(edge)[:-1] > 0
    gone = set(short[boilerplate(whole)].tolist())
    out, start = [], 0
    for k, (text, n) in enumerate(zip(texts, lengths)):
        own = mask[start : start + n]
        start += n
        covered = int(own.sum())
        if k in gone or covered and covered >= COVERED * n:
            continue
        out.append(" ".join(w for w, x in zip(text.split(), own.tolist()) if not x) if covered else text)
    return "\n\n".join(out)


def _count(rows: DataFrame, hosts: DataFrame, least: int, sparse: int, pages: int) -> DataFrame:
    """(host, key, n, distinct): on how many pages of a host a prefix or short block stands, and on how many distinct
    ones, where both are ``pages`` or more. ``hosts`` has their numbers of pages: (of, all).

    Distinct pages are counted by two bitmaps of 64 places, each dealt by another hash of the text: never too many,
    too few only where bodies meet at a place in both. A bitmap has one size whatever the host's.
    """
    large = hosts.where(F.col("all") > HOST_PAGES).select("of", F.ceil(F.col("all") / HOST_PAGES).alias("parts"))
    parts = rows.sparkSession.sparkContext.broadcast({r["of"]: r["parts"] for r in large.collect()})
    names = ["host", "part", "single", "several"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0
        for batch in slices(batches, 256):
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                texts, _ = own_blocks(source or "")
                _, prefix, _, whole = suffixes(texts, least, sparse)
                keys = _keyed(host, np.unique(np.concatenate([prefix, whole])))
                body = xxhash.xxh3_64_intdigest("\n".join(texts))
                held.setdefault(host, []).append((keys, np.full(len(keys), body & 63 | (body >> 32 & 63) << 6, np.uint16)))
                size += len(keys)
            if size > HELD_SUFFIXES:
                yield from flush(held)
                held, size = {}, 0
        yield from flush(held)

    def flush(held: dict[int, list[tuple[np.ndarray, np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        for host, found in held.items():
            keys, places = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(keys, kind="stable")
            keys, places = keys[order], places[order]
            n = parts.value.get(host, 1)
            edges = np.searchsorted(keys, [-(-(k << KEY_BITS) // n) for k in range(1, n)]).tolist()
            out = []
            for k, (a, b) in enumerate(zip([0, *edges], [*edges, len(keys)])):
                own, at = keys[a:b], places[a:b]
                new = np.concatenate([[True], own[1:] != own[:-1], [True]]) if len(own) else np.zeros(1, bool)
                once = new[:-1] & new[1:]
                more = _summed(_opened(own[~once], at[~once])) if not once.all() else [np.zeros(0, np.int64)] * 4
                if len(own):
                    out.append((host, k, _packed(own[once], at[once]), np.concatenate(more).astype("<i8").tobytes()))
            if out:
                kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), kinds)], names=names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, size = None, [], 0
        for batch in batches:
            for host, part, single, several in zip(*(c.to_pylist() for c in batch.columns)):
                if (host, part) != last:
                    if held:
                        yield result(last[0], held)
                    last, held, size = (host, part), [], 0
                held += [_opened(*_unpacked(single)), list(np.frombuffer(several, "<i8").reshape(4, -1))]
                size += len(held[-2][0]) + len(held[-1][0])
                if size > HELD_SUFFIXES:
                    held = [_summed([np.concatenate(x) for x in zip(*held)])]
                    size = 0
        if held:
            yield result(last[0], held)

    def result(host: int, held: list[list[np.ndarray]]) -> pa.RecordBatch:
        keys, n, a, b = _summed([np.concatenate(x) for x in zip(*held)])
        often = n >= pages
        keys, n, a, b = keys[often], n[often], a[often], b[often]
        distinct = np.maximum(*(np.bitwise_count(x.view(np.uint64)).astype(np.int64) for x in (a, b)))
        kept = distinct >= pages
        columns = [np.full(int(kept.sum()), host), keys[kept], n[kept], distinct[kept]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["host", "key", "n", "distinct"])

    found = rows.where("host is not null").select("host", "html").mapInArrow(lean(emit), "host long, part int, single binary, several binary")
    dealt = found.repartition("host", "part").sortWithinPartitions("host", "part")
    return dealt.mapInArrow(lean(count), "host long, key long, n long, distinct long")


def _opened(keys: np.ndarray, places: np.ndarray) -> list[np.ndarray]:
    """(key, n, a, b) of keys that stand on one page each."""
    bits = (np.left_shift(_U(1), places.astype(_U) >> _U(at) & _U(63)).view(np.int64) for at in (0, 6))
    return [keys, np.ones(len(keys), np.int64), *bits]


def _boilerplate(rows: DataFrame, least: int, sparse: int, pages: tuple[int, float], own: tuple[int, float]) -> DataFrame:
    """(key, strong) of what is boilerplate outside of main and article elements, and where strong also inside."""
    hosts = rows.where("host is not null").groupBy(F.col("host").alias("of")).agg(F.count(F.lit(1)).alias("all"))
    counted = materialise(_count(rows, hosts, least, sparse, pages[0]), "repeated")
    found = counted.join(hosts.where(F.col("all") >= pages[0]), F.col("host") == F.col("of")).where(F.col("n") >= pages[1] * F.col("all"))
    strong = (F.col("distinct") >= own[0]) & (F.col("n") >= own[1] * F.col("all"))
    out = materialise(found.select("key", strong.alias("strong")), "boilerplate")
    release(counted)
    return out


def extract(
    pages: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least: int = LEAST,
    sparse: int = SPARSE,
    min_pages: tuple[int, float] = (PAGES, SHARE),
    own_pages: tuple[int, float] = (OWN_PAGES, OWN_SHARE),
    broadcast_prefixes: int = BROADCAST_PREFIXES,
) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    A run is boilerplate if it stands on ``min_pages`` (number, share) pages of its host or more, on ``own_pages``
    inside main and article elements. Pages of equal text, such as a page under two addresses or a repeated row, are
    one distinct page. Null html gives an empty text; a page with a null or odd url has no host, so nothing of it
    counts as repeated. Other columns are left out.
    """
    url = F.col(url_col).cast("string")
    name = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        url.alias("url"),
        F.col(html_col).cast("string").alias("html"),
        F.when(name != "", F.xxhash64(name)).alias("host"),
    )
    found = _boilerplate(rows, least, sparse, min_pages, own_pages)
    if found.count() <= broadcast_prefixes:
        table = found.toArrow().combine_chunks().sort_by("key")
        shared = rows.sparkSession.sparkContext.broadcast((table.column(0).to_numpy(), table.column(1).to_numpy()))
        hit = lambda: (*shared.value, None)
        release(found)
    else:
        rows, hit = _with_hits(rows, found, least, sparse), lambda: (None, None, 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, strong, column = hit()
        for batch in slices(batches, 256):
            texts = []
            own = batch.column(column).to_pylist() if column else [None] * batch.num_rows
            for source, host, listed in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), own):
                parts, marked = own_blocks(source or "")
                if column:
                    listed = sorted((x["key"], x["strong"]) for x in listed or [])
                    keys, strong = np.array([x[0] for x in listed], np.int64), np.array([x[1] for x in listed], bool)

                def known(hashes: np.ndarray) -> np.ndarray:
                    if host is None or not len(keys) or not len(hashes):
                        return np.zeros(len(hashes), bool)
                    wanted = _keyed(host, hashes)
                    where = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                    return (keys[where] == wanted) & (strong[where] | (not marked))

                texts.append(cut(parts, known, least, sparse))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return rows.mapInArrow(lean(run), "page_id long, url string, text string, n_chars long")


def _with_hits(rows: DataFrame, found: DataFrame, least: int, sparse: int) -> DataFrame:
    """``rows`` with the boilerplate that each page holds, by joins: the way where there is too much of it to broadcast.

    Rows are named by two hashes of all they hold; equal rows get the same list.
    """
    row = [F.xxhash64("page_id", "url", "html").alias("r1"), F.xxhash64(F.lit(1), "html", "url", "page_id").alias("r2")]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            for host, source, r1, r2 in zip(*(c.to_pylist() for c in batch.columns)):
                _, prefix, _, whole = suffixes(own_blocks(source or "")[0], least, sparse)
                keys = _keyed(host, np.unique(np.concatenate([prefix, whole])))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([r1] * len(keys), pa.int64()), pa.array([r2] * len(keys), pa.int64())], names=["of", "r1", "r2"])

    made = rows.where("host is not null").select("host", "html", *row).mapInArrow(lean(emit), "of long, r1 long, r2 long")
    hits = made.join(found, F.col("of") == F.col("key")).groupBy("r1", "r2").agg(F.collect_set(F.struct("key", "strong")).alias("hits"))
    return rows.select("*", *row).join(hits, ["r1", "r2"], "left").select("page_id", "url", "html", "host", "hits")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from ._common import table

    return extract(table(spark, sf_dir, "pages"))
