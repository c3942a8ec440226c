"""Inspecting PDF files: findings as expressions over the records of their dictionaries, reports, cleaning with proof.

What a file holds is read in one pass (``sources.files``); every rule here is a Catalyst expression, so all of them are
tried in one pass over the records, and only findings move.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import files as S
from ..sources import pdf_inspect
from ..sources.pdf import Name, Pdf, Ref, Stream
from ..sources.pdf_edit import Refused
from ..sources.pdf_writer import save
from .scan import MOST_SAMPLES, label, rank

# What each kind of finding means.
DESCRIPTIONS = {
    "javascript": "JavaScript that a viewer may run",
    "auto_action": "an action that runs without being clicked: on opening, on a page turn or on a form event",
    "launch": "an action that starts a program or opens a file with the system's handler",
    "submit_form": "an action that sends form data to an address",
    "import_data": "an action that loads form data from a file",
    "remote_goto": "an action that opens another file; a network path makes the viewer contact that host",
    "external_link": "links to addresses outside the document",
    "embedded_file": "a file carried inside the document",
    "xfa": "an XFA form, a second document format with its own scripting",
    "rich_media": "embedded media that a viewer plays: rich media, 3D, movie, sound or screen",
    "obfuscated_name": "names written with needless #xx escapes, which hides them from simple scanners",
    "filter_chain": "streams packed several times over, a way to hide content or to expand hugely",
    "decompression_bomb": "a stream that expands to an enormous size",
    "misplaced_image_filter": "image compression on a stream that is not an image, so a reader decodes a picture where it expects something else",
    "huge_image": "an image whose declared size is beyond anything displayable",
    "implausible_fax_parameters": "fax-coded image data with impossible dimensions",
    "cyclic_structure": "a page tree that refers back to itself",
    "header_not_at_start": "the PDF header is not at the start of the file, as in files built to be two formats at once",
    "trailing_data": "data after the end of the PDF",
    "shadowed_objects": "object numbers defined more than once in a single revision, so readers may disagree on the content",
    "hidden_text": "text that is extracted but that a person looking at the page does not see",
    "resource_exhaustion": "processing the file ran out of time, as files built for that do; a very heavy honest file does the same",
    "unparseable": "the file could not be opened as a PDF; only its bytes were inspected",
    "encrypted_unread": "the file is encrypted and was not opened; only names outside its encrypted and packed parts were inspected",
}

# What sanitising removes, by group, and the kinds that must be gone.
GROUPS = {
    "javascript": ("javascript",),
    "actions": ("auto_action", "launch", "submit_form", "import_data", "remote_goto"),
    "attachments": ("embedded_file",),
    "xfa": ("xfa",),
    "media": ("rich_media",),
}

_MEDIA_ACTIONS = ("Rendition", "Movie", "Sound", "RichMediaExecute", "GoTo3DView")
_MEDIA_SUBTYPES = ("3D", "Movie", "Sound", "Screen")
_PACKING = ("FlateDecode", "LZWDecode", "RunLengthDecode")
_PICTORIAL = ("JBIG2Decode", "CCITTFaxDecode", "DCTDecode", "JPXDecode")
#: The largest side and area of an image, and the bounds of fax parameters.
MOST_SIDE, MOST_AREA, MOST_COLUMNS, MOST_ROWS = 30_000.0, 4.0e8, 200_000.0, 2_000_000.0
#: Fixed values, in points and bytes: text too small to read, a header or an end out of place.
TOO_SMALL, HEADER_NEAR, TRAILING = 1.5, 1024, 1024


def dictionary_rules(c: Callable[[str], Column] = F.col) -> list[tuple[str, Column, Column, Column]]:
    """(kind, severity, condition, sample) over the records of dictionaries, whose fields ``c`` gives; a sample is JSON or null."""
    has = lambda key: F.array_contains(c("keys"), key)
    act = c("s")
    cut = lambda x, n=200: T.excerpt(x, n)
    json = lambda **parts: F.to_json(F.struct(*[v.alias(k) for k, v in parts.items()]))
    if_any = lambda x, **parts: F.when(x.isNotNull(), json(**parts))
    uri = F.lower(F.regexp_replace(c("uri"), r"(?U)^\s+", ""))
    is_uri = act == "URI"
    script_link = is_uri & uri.startswith("javascript:")
    file_link = is_uri & ~script_link & (uri.startswith("file:") | (T.is_remote(c("uri")) & ~F.contains(uri, F.lit("://"))))
    other_link = is_uri & ~script_link & ~file_link
    packed = F.size(F.filter(c("filters"), lambda f: f.isin(*_PACKING)))
    pictures = F.size(F.filter(c("filters"), lambda f: f.isin(*_PICTORIAL)))
    image = (c("subtype") == "Image") | (has("Width") & has("Height"))
    kind = T.file_type(F.coalesce(c("file_head"), F.lit(b"").cast("binary")), F.coalesce(c("file_name"), F.lit("")))
    w, h = F.coalesce(c("width"), F.lit(0.0)), F.coalesce(c("height"), F.lit(0.0))
    lit = F.lit
    return [
        ("javascript", lit("high"), (act == "JavaScript") | has("JS"), if_any(c("script"), script=cut(c("script")))),
        ("javascript", lit("high"), script_link, json(script=cut(c("uri")))),
        (
            "auto_action", F.when(c("opens").isin("JavaScript", "Launch"), "high").otherwise("medium"), c("opens").isNotNull() & (c("opens") != "GoTo"),
            json(when=lit("document opens"), action=c("opens")),
        ),
        ("auto_action", lit("medium"), has("AA"), json(when=lit("events"), events=c("events"))),
        ("launch", lit("high"), act == "Launch", json(target=cut(c("target")), program=cut(c("program")), parameters=cut(c("parameters")))),
        ("submit_form", lit("medium"), act == "SubmitForm", if_any(c("target"), target=cut(c("target")))),
        ("import_data", lit("medium"), act == "ImportData", if_any(c("target"), target=cut(c("target")))),
        (
            "remote_goto", F.when(F.coalesce(T.is_remote(c("target")), lit(False)), "high").otherwise("low"), act.isin("GoToR", "GoToE"),
            if_any(c("target"), target=cut(c("target"))),
        ),
        ("remote_goto", lit("high"), file_link, json(target=cut(c("uri")))),
        ("external_link", lit("info"), other_link, cut(T.host(c("uri")), 100)),
        ("rich_media", lit("medium"), act.isin(*_MEDIA_ACTIONS), json(action=act)),
        (
            "rich_media", F.when(c("subtype") == "RichMedia", "high").otherwise("medium"), has("Rect") & c("subtype").isin("RichMedia", *_MEDIA_SUBTYPES),
            json(annotation=c("subtype")),
        ),
        ("xfa", lit("medium"), has("XFA"), lit(None).cast("string")),
        ("embedded_file", kind["severity"], has("EF"), json(name=cut(c("file_name")), type=kind["type"], size_bytes=c("file_size"))),
        ("filter_chain", lit("medium"), (F.size(c("filters")) > 2) | (packed > 1), json(filters=F.size(c("filters")))),
        ("misplaced_image_filter", lit("medium"), (pictures > 0) & ~F.coalesce(image, lit(False)), lit(None).cast("string")),
        (
            "decompression_bomb", lit("high"), (c("expanded") > pdf_inspect.BOMB) & (c("expanded") / c("stored") > 100),
            json(stored_bytes=c("stored"), expands_beyond_bytes=lit(pdf_inspect.BOMB)),
        ),
        ("huge_image", lit("medium"), (c("subtype") == "Image") & ((w > MOST_SIDE) | (h > MOST_SIDE) | (w * h > MOST_AREA)), json(width=w, height=h)),
        (
            "implausible_fax_parameters", lit("medium"),
            F.array_contains(c("filters"), "CCITTFaxDecode") & (~c("fax_columns").between(1.0, MOST_COLUMNS) | ~c("fax_rows").between(0.0, MOST_ROWS)),
            json(columns=c("fax_columns"), rows=c("fax_rows")),
        ),
    ]


def _found(rules: list[tuple[str, Column, Column, Column]], obj: Column) -> Column:
    """All rules that hold, as an array of (kind, severity, obj, sample, times)."""
    each = [
        F.when(
            F.coalesce(condition, F.lit(False)),
            F.struct(F.lit(kind).alias("kind"), severity.alias("severity"), obj.cast("int").alias("obj"), sample.cast("string").alias("sample"), F.lit(1).cast("long").alias("times")),
        )
        for kind, severity, condition, sample in rules
    ]
    return F.filter(F.array(*each), lambda x: x.isNotNull())


def object_findings(files: DataFrame) -> DataFrame:
    """(doc_id, kind, severity, obj, sample, times) of what the objects hold, one row per occurrence."""
    records = S.parse(files, "dictionaries")
    return records.select("doc_id", F.explode(_found(dictionary_rules(), F.col("obj"))).alias("f")).select("doc_id", "f.*")


def _finding(kind: Column, severity: Column, sample: Column | None = None, times: Column | None = None) -> Column:
    """A finding that belongs to no object."""
    sample = F.lit(None) if sample is None else sample
    times = F.lit(1) if times is None else times
    return F.struct(
        kind.alias("kind"), severity.alias("severity"), F.lit(None).cast("int").alias("obj"), sample.cast("string").alias("sample"), times.cast("long").alias("times")
    )


def raw_findings() -> Column:
    """The findings of a row of the inspection table that its bytes alone give, or that it could not be opened."""
    raw = F.col("raw")
    json = lambda **parts: F.to_json(F.struct(*[v.alias(k) for k, v in parts.items()]))
    rules = [
        (
            "header_not_at_start", F.when(raw["header_offset"].between(1, HEADER_NEAR - 1), "low").otherwise("medium"), raw["header_offset"] != 0,
            F.when(raw["header_offset"] > 0, json(offset=raw["header_offset"])),
        ),
        ("trailing_data", F.lit("low"), raw["bytes_after_end"] > TRAILING, json(bytes=raw["bytes_after_end"])),
        ("shadowed_objects", F.lit("low"), (raw["redefined"] > 0) & (raw["revisions"] <= 1), json(objects=raw["redefined"])),
        ("cyclic_structure", F.lit("medium"), F.col("cyclic"), F.lit(None)),
        ("encrypted_unread", F.lit("info"), F.col("error").isNotNull() & F.coalesce("encrypted", F.lit(False)), F.lit(None)),
        ("resource_exhaustion", F.lit("medium"), F.col("error").startswith(S.OUT_OF_TIME), F.lit(None)),
        ("unparseable", F.lit("medium"), F.col("error").isNotNull() & ~F.coalesce("encrypted", F.lit(False)) & ~F.col("error").startswith(S.OUT_OF_TIME), F.lit(None)),
    ]
    telling = [n for n, _, _ in pdf_inspect.RAW_NAMES] + ["JS", "AA", "S", "URI", "Action", "Filter", "ObjStm"]
    escaped = F.transform(
        F.coalesce(raw["escaped"], F.array().cast("array<struct<written:string,means:string,times:int>>")),
        lambda e: _finding(
            F.lit("obfuscated_name"), F.when(e["means"].isin(*telling), "high").otherwise("low"),
            json(written=F.concat(F.lit("/"), e["written"]), means=F.concat(F.lit("/"), e["means"])), e["times"],
        ),
    )
    return F.concat(_found(rules, F.lit(None)), escaped)


def unread_names(found: Column) -> Column:
    """Telling names in the bytes that stand for nothing in the objects that could be read; ``found`` are those' findings."""
    kinds = F.create_map(*[F.lit(x) for n, kind, _ in pdf_inspect.RAW_NAMES for x in (n, kind)])
    severities = F.create_map(*[F.lit(x) for n, _, severity in pdf_inspect.RAW_NAMES for x in (n, "medium" if severity == "high" else severity)])
    met = F.flatten(F.transform("dictionaries", lambda d: F.array_union(d["keys"], d["names"])))
    named = F.array_union(F.transform(met, lambda n: kinds[n]), F.transform(found, lambda f: f["kind"]))
    entries = F.map_entries(F.coalesce(F.col("raw")["names"], F.create_map().cast("map<string,int>")))
    left = F.filter(entries, lambda e: ~F.coalesce(F.array_contains(named, kinds[e["key"]]), F.lit(False)))
    sample = lambda e: F.to_json(F.struct(F.concat(F.lit("/"), e["key"]).alias("name_in_bytes"), e["value"].alias("times")))
    return F.transform(left, lambda e: _finding(kinds[e["key"]], severities[e["key"]], sample(e)))


def _restated(stated: Column, drawn: Column) -> Column:
    """Whether a stated text has half of its letters or more not among those drawn, letter for letter."""
    spread = lambda x: F.regexp_replace(
        F.lower(F.replace(F.replace(F.replace(F.replace(F.replace(x, F.lit("ﬃ"), F.lit("ffi")), F.lit("ﬄ"), F.lit("ffl")), F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl")), F.lit("ﬀ"), F.lit("ff"))),
        r"[^\p{L}\p{N}]",
        "",
    )
    a, b = F.filter(F.split(spread(stated), ""), lambda x: x != ""), F.filter(F.split(spread(drawn), ""), lambda x: x != "")
    times = lambda xs, letter: F.size(F.filter(xs, lambda x: x == letter))
    shared = F.aggregate(F.array_distinct(a), F.lit(0), lambda acc, x: acc + F.least(times(a, x), times(b, x)))
    return (F.size(a) >= 3) & (F.size(b) > 0) & (shared * 2 < F.size(a))


def hidden_words(files: DataFrame) -> DataFrame:
    """Words that are extracted and not seen: (doc_id, page, seq, text, box, reason). What would take a picture of the
    page, no contrast and what lies under invisible text, is not judged in this build."""
    w = S.parse(files, "words")
    outside = (F.col("x1") <= 0) | (F.col("y1") <= 0) | (F.col("x0") >= F.col("page_width")) | (F.col("y0") >= F.col("page_height"))
    reason = (
        F.when(outside, "outside the page")
        .when(F.col("size") < TOO_SMALL, "too small to read")
        .when(F.col("invisible"), "invisible")
        .when(F.coalesce(_restated(F.col("text"), F.col("drawn")), F.lit(False)), "stated to read as something else than is drawn")
    )
    return w.withColumn("reason", reason).where("reason is not null").select("doc_id", "page", "seq", "text", "x0", "y0", "x1", "y1", "reason")


def hidden_text(files: DataFrame) -> DataFrame:
    """Per document: how many characters are hidden, on which pages, and up to twenty samples, one a page and reason."""
    words = hidden_words(files)
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), " ")
    parts = words.groupBy("doc_id", "page", "reason").agg(line.alias("text"))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "reason"))
    sample = F.struct("nth", F.to_json(F.struct("page", "reason", T.excerpt("text", 300).alias("text"))).alias("j"))
    return (
        parts.withColumn("nth", nth)
        .groupBy("doc_id")
        .agg(
            F.sum(F.length("text")).cast("long").alias("characters"), F.array_sort(F.collect_set("page")).alias("pages"), F.count(F.lit(1)).cast("long").alias("count"),
            F.transform(F.array_sort(F.collect_list(F.when(F.col("nth") <= MOST_SAMPLES, sample))), lambda x: x["j"]).alias("samples"),
        )
    )


def findings(files: DataFrame, *, skip_hidden_text: bool = False) -> DataFrame:
    """Everything found, one row per occurrence: (doc_id, kind, severity, obj, sample, times).

    A file is read once, and all rules are tried on its own row, so nothing is shuffled; hidden text reads it once more.
    """
    rows = S.parse(files, "inspection")
    objects = F.flatten(F.transform("dictionaries", lambda d: _found(dictionary_rules(lambda name: d[name]), d["obj"])))
    staged = rows.withColumn("objects", objects)
    every = F.concat("objects", raw_findings(), unread_names(F.col("objects")))
    out = staged.select("doc_id", F.explode(every).alias("f")).select("doc_id", "f.*")
    if skip_hidden_text:
        return out
    hidden = hidden_text(files).select("doc_id", F.lit("hidden_text").alias("kind"), F.lit("medium").alias("severity"), F.lit(None).cast("int").alias("obj"), F.explode("samples").alias("sample"))
    return out.unionByName(hidden.withColumn("times", F.lit(1).cast("long")))


def report(found: DataFrame) -> DataFrame:
    """Findings by document and kind, the most severe first: severity, what it means, count, and up to twenty different
    objects and samples, in order."""
    by = ["doc_id", "kind"]
    counted = found.groupBy(*by).agg(F.max(rank("severity")).alias("r"), F.sum("times").cast("long").alias("count"))

    def listed(name: str, out: str) -> DataFrame:
        distinct = found.where(F.col(name).isNotNull()).select(*by, name).distinct()
        nth = F.row_number().over(Window.partitionBy(*by).orderBy(name))
        kept = distinct.withColumn("nth", nth).where(F.col("nth") <= MOST_SAMPLES)
        return kept.groupBy(*by).agg(F.array_sort(F.collect_list(name)).alias(out))

    means = F.create_map(*[F.lit(x) for pair in DESCRIPTIONS.items() for x in pair])
    joined = counted.join(listed("obj", "objects"), by, "left").join(listed("sample", "samples"), by, "left")
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("r"), "kind"))
    none = F.array()
    return joined.select(
        "doc_id", order.alias("pos"), "kind", label(F.col("r")).alias("severity"), means[F.col("kind")].alias("description"), "count",
        F.coalesce("objects", none.cast("array<int>")).alias("objects"), F.coalesce("samples", none.cast("array<string>")).alias("samples"),
    )


def scanner_signature(line: Column | str) -> Column:
    """The name in a line of a virus scanner's output, ``path: Name FOUND``; null of any other line."""
    found = F.regexp_extract(T.col(line), r"^.*: (.+) FOUND\s*$", 1)
    return F.when(found != "", found)


# --- cleaning ------------------------------------------------------------------------------------------------------

# Keys that exist only to hold what a group covers.
_KEYS = {
    "JavaScript": "javascript", "AA": "actions", "XFA": "xfa", "EmbeddedFiles": "attachments", "EF": "attachments", "RF": "attachments", "AF": "attachments", "Collection": "attachments",
}


def group_of(pdf: Pdf, x: Any) -> str | None:
    """The group that an action or annotation is removed with."""
    if isinstance(x, Stream):
        x = x.info
    if not isinstance(x, dict):
        return None
    kind, subtype = pdf.get(x.get("S")), pdf.get(x.get("Subtype"))
    if kind == "JavaScript" or kind is None and "JS" in x:
        return "javascript"
    if kind in ("Launch", "SubmitForm", "ImportData", "GoToR", "GoToE"):
        return "actions"
    if kind in _MEDIA_ACTIONS:
        return "media"
    if kind == "URI":
        uri = pdf.get(x.get("URI"))
        uri = uri.decode("utf-8", "replace").lstrip().lower() if isinstance(uri, bytes) else ""
        if uri.startswith("javascript:"):
            return "javascript"
        remote = uri.startswith(("\\\\", "//"))
        return "actions" if uri.startswith("file:") or remote and "://" not in uri else None
    if "JS" in x:
        return "javascript"
    if "Rect" in x and subtype in ("RichMedia", *_MEDIA_SUBTYPES):
        return "media"
    return "attachments" if "Rect" in x and subtype == "FileAttachment" else None


def opens_harmlessly(pdf: Pdf, x: Any) -> bool:
    """Whether opening a document may go on doing this: a destination, or an action that only goes to one."""
    x = pdf.get(x)
    return pdf.get(x.get("S")) == "GoTo" if isinstance(x, dict) else isinstance(x, (list, str, bytes))


def sanitize(pdf: Pdf, *, keep: tuple[str, ...] = ()) -> tuple[bytes, dict[str, Any]]:
    """A file without scripts, actions, attachments, XFA and media. The result is inspected like any other file; what is
    still found of a removed group is an error, and nothing is handed on."""
    if unknown := set(keep) - set(GROUPS):
        raise Refused(f"unknown group {sorted(unknown)[0]}")
    remove = [g for g in GROUPS if g not in keep]
    if not remove:
        raise Refused("every group is kept, so there is nothing to remove")
    removed = dict.fromkeys(remove, 0)
    numbers = sorted(pdf.entries)
    marked = {n: g for n in numbers if (g := group_of(pdf, pdf._quietly(n)))}

    def unwanted(x: Any) -> str | None:
        g = marked.get(x.number) if isinstance(x, Ref) else group_of(pdf, x)
        return g if g in removed else None

    for number in numbers:
        todo = [pdf._quietly(number)]
        while todo:
            x = todo.pop()
            x = x.info if isinstance(x, Stream) else x
            if isinstance(x, list):
                for y in [y for y in x if unwanted(y)]:
                    removed[unwanted(y)] += 1
                    x.remove(y)
                todo += x
            elif isinstance(x, dict):
                for key in list(x):
                    g = _KEYS.get(key) if _KEYS.get(key) in removed else unwanted(x[key])
                    if key == "OpenAction" and "actions" in removed and not opens_harmlessly(pdf, x[key]):
                        g = "actions"
                    if g:
                        removed[g] += 1
                        del x[key]
                todo += x.values()
    form = pdf.get(pdf.catalog.get("AcroForm"))
    if "javascript" in removed and isinstance(form, dict):
        form.pop("CO", None)
    data, _ = save(pdf)
    left = sorted(kinds_left(Pdf(data, pdf.password), data) & {k for g in remove for k in GROUPS[g]})
    if left:
        raise Refused(f"the cleaned file would still contain {', '.join(left)}; nothing was written")
    return data, {"removed": removed, "kept": list(keep), "verified": True}


def kinds_left(pdf: Pdf, data: bytes) -> set[str]:
    """Kinds that a plain walk over records and bytes still finds: the second look, which shares no rule with the removal."""
    out = set()
    for r in pdf_inspect.dictionaries(pdf):
        s, uri = r["s"], (r.get("uri") or "").lstrip().lower()
        if s == "JavaScript" or "JS" in r["keys"] or uri.startswith("javascript:"):
            out.add("javascript")
        if r.get("opens") not in (None, "GoTo") or "AA" in r["keys"]:
            out.add("auto_action")
        kinds = {"Launch": "launch", "SubmitForm": "submit_form", "ImportData": "import_data", "GoToR": "remote_goto", "GoToE": "remote_goto"}
        out.add(kinds.get(s, ""))
        if uri.startswith("file:") or uri.startswith(("//", "\\\\")):
            out.add("remote_goto")
        if "XFA" in r["keys"]:
            out.add("xfa")
        if "EF" in r["keys"]:
            out.add("embedded_file")
        if s in _MEDIA_ACTIONS or "Rect" in r["keys"] and r["subtype"] in ("RichMedia", *_MEDIA_SUBTYPES):
            out.add("rich_media")
    out |= {kind for n, kind, _ in pdf_inspect.RAW_NAMES if n in pdf_inspect.raw_facts(data)["names"]}
    return out - {""}


__all__ = ["GROUPS", "Name", "findings", "hidden_text", "report", "sanitize"]
