"""Text expressions: white space, patterns, excerpts, entities, widths. All of them stay in Catalyst.

Lengths and offsets are code points.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as Unicode has it, in Java's syntax.
SPACE = r"(?U)\s+"


def col(c: Column | str) -> Column:
    """A column by name, or the column itself."""
    return F.col(c) if isinstance(c, str) else c


def strip(text: Column | str) -> Column:
    """Without white space at its ends, whatever kind of it."""
    return F.regexp_replace(col(text), r"(?U)^\s+|\s+$", "")


def flatten(text: Column | str) -> Column:
    """One line: every run of white space is one space, none at the ends."""
    return F.trim(F.regexp_replace(col(text), SPACE, " "))


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def tidy(text: Column | str) -> Column:
    """Lines with single spaces, none at their ends; one blank line between paragraphs, none at the ends."""
    out = F.regexp_replace(col(text), r"(?U)[\s&&[^\n]]+", " ")
    out = F.regexp_replace(out, " ?\n ?", "\n")
    out = F.regexp_replace(out, "\n{3,}", "\n\n")
    return F.regexp_replace(out, r"^[ \n]+|[ \n]+$", "")


def excerpt(text: Column | str, limit: int) -> Column:
    """The first ``limit`` characters with controls as spaces, and an ellipsis where something follows."""
    clean = F.regexp_replace(col(text), r"\p{Cc}", " ")
    return F.when(F.length(clean) > limit, F.concat(F.substring(clean, 1, limit), F.lit("…"))).otherwise(clean)


_UNSUPPORTED = re.compile(r"\(\?(?:[=!>]|<[=!])|\\[1-9]|\\k<|\\Z|\\G|(?<!\\)[*+?}]\+")


def pattern(query: str, *, regex: bool = False, case_sensitive: bool = False) -> str:
    """A Java pattern for a search query; a literal is quoted.

    Classes such as ``\\d`` and ``\\w`` are those of Unicode. Look-around, back references and possessive repeats are
    refused, so that results depend on no engine's extras.
    """
    if not query:
        raise ValueError("query is empty")
    if regex:
        if found := _UNSUPPORTED.search(query):
            raise ValueError(f"'{found[0]}' is not supported in patterns")
        re.compile(re.sub(r"\(\?<(\w+)>", r"(?P<\1>", query))
        body = f"(?:{query})"
    else:
        body = r"\Q" + query.replace("\\E", r"\E\\E\Q") + r"\E"
    flags = ("U" if regex else "") + ("" if case_sensitive else "iu")
    return (f"(?{flags})" if flags else "") + body


def any_pattern(texts: list[str], *, regex: bool = False, case_sensitive: bool = False) -> list[str]:
    """Patterns of the texts that are not empty; at least one must be left."""
    out = [pattern(t, regex=regex, case_sensitive=case_sensitive) for t in texts if t]
    if not out:
        raise ValueError("no text to look for")
    return out


def count_matches(text: Column | str, java: str) -> Column:
    """Non-overlapping matches; 0 for null."""
    return F.coalesce(F.regexp_count(col(text), F.lit(java)), F.lit(0)).cast("long")


def spans(text: Column | str, java: str, most: int | None = None) -> Column:
    """Matches as array<struct<start, match>>, start counted from 0; the first ``most`` where that is given.

    Starts are sums over the pieces between matches; only those asked for are ever summed.
    """
    t = col(text)
    hits = F.regexp_extract_all(t, F.lit(java), 0)
    hits = hits if most is None else F.slice(hits, 1, most)
    gaps = F.transform(F.split(t, java, -1 if most is None else most + 1), lambda x: F.length(x))
    pairs = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"), hits.alias("match"))
    none = F.array().cast("array<struct<start: int, match: string>>")
    start = F.struct(F.lit(0).alias("end"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["end"] + x["gap"]
        found = F.struct(at.alias("start"), x["match"].alias("match"))
        return F.struct((at + F.length(x["match"])).alias("end"), F.concat(acc["out"], F.array(found)).alias("out"))

    return F.when(t.isNull() | (F.size(hits) == 0), none).otherwise(F.aggregate(pairs, start, step, lambda a: a["out"]))


# The named character references that are decoded.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}


def decode_entities(text: Column | str) -> Column:
    """Named and numeric references decoded once, from left to right; anything else stays as it is.

    The text is cut at the references, so that what one decodes to is never read as part of another.
    """
    t = col(text)
    reference = "&(?:amp|lt|gt|quot|apos|nbsp|#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6});"
    names = F.create_map(*[F.lit(x) for k, v in ENTITIES.items() for x in (k, v)])

    def char(ref: Column) -> Column:
        body = F.substring(ref, F.lit(2), F.length(ref) - 2)
        number = F.when(body.rlike("^#[xX]"), F.conv(F.substring(body, 3, 6), 16, 10)).otherwise(F.substring(body, 2, 7)).cast("long")
        valid = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
        utf32 = F.unhex(F.lpad(F.hex(number), 8, "0"))
        return F.when(body.startswith("#"), F.when(valid, F.decode(utf32, "UTF-32")).otherwise(ref)).otherwise(names[body])

    refs = F.regexp_extract_all(t, F.lit(reference), 0)
    parts = F.split(t, reference, -1)
    joined = F.array_join(F.zip_with(parts, refs, lambda p, r: F.concat(F.coalesce(p, F.lit("")), F.when(r.isNull(), "").otherwise(char(r)))), "")
    return F.when(t.contains("&"), joined).otherwise(t)


# Words that mean yes, and no.
YES = ("true", "yes", "on", "1", "x", "checked")
NO = ("false", "no", "off", "0", "", "unchecked")


def truthy(value: Column | str) -> Column:
    """Whether a form value means yes or no; null where it says neither."""
    v = F.lower(strip(value))
    return F.when(v.isin(*YES), True).when(v.isin(*NO), False)


def host(url: Column | str) -> Column:
    """The host of an address in lower case: what follows the first ``://``, up to the path, query or fragment."""
    lower = F.lower(col(url))
    rest = F.when(F.instr(lower, "://") > 0, F.substring(lower, F.instr(lower, "://") + 3, F.length(lower))).otherwise(lower)
    return F.regexp_extract(rest, r"^[^/?#]*", 0)


def is_remote(target: Column | str) -> Column:
    """Whether a file target names another machine."""
    t = col(target)
    return t.startswith("\\\\") | t.startswith("//") | t.contains("://")


# Advance widths of Helvetica for the characters 32 to 126, in 1/1000 em.
HELVETICA = (
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278, 556, 556, 556,
    556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556, 1015, 667, 667, 722, 722, 667,
    611, 778, 722, 278, 500, 667, 556, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667,
    667, 611, 278, 278, 278, 469, 556, 333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500,
    222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584,
)
# The same of Helvetica-Bold.
HELVETICA_BOLD = (
    278, 333, 474, 556, 556, 889, 722, 238, 333, 333, 389, 584, 278, 333, 278, 278, 556, 556, 556,
    556, 556, 556, 556, 556, 556, 556, 333, 333, 584, 584, 584, 611, 975, 722, 722, 722, 722, 667,
    611, 778, 722, 278, 556, 722, 611, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667,
    667, 611, 333, 278, 333, 584, 556, 333, 556, 611, 556, 611, 556, 333, 611, 611, 278, 278, 556,
    278, 889, 611, 611, 611, 611, 389, 556, 333, 611, 556, 778, 556, 556, 500, 389, 280, 389, 584,
)
UNKNOWN_WIDTH = 556


def helvetica_units(text: Column | str) -> Column:
    """Width in Helvetica in 1/1000 em: per width class, the characters of that width are counted by what removing them shortens."""
    t = col(text)
    by_width: dict[int, str] = {}
    for k, width in enumerate(HELVETICA):
        by_width.setdefault(width, "")
        by_width[width] += chr(32 + k)
    total = F.length(t) * UNKNOWN_WIDTH
    for width, letters in by_width.items():
        if width != UNKNOWN_WIDTH:
            total = total + (F.length(t) - F.length(F.translate(t, letters, ""))) * (width - UNKNOWN_WIDTH)
    return total.cast("long")


def is_winansi(text: Column | str) -> Column:
    """Whether the standard fonts can show a text: printable ASCII and Latin-1 only."""
    return col(text).rlike("^[ -~ -ÿ]*$")


def pdf_literal(text: Column | str) -> Column:
    """A literal string of PDF syntax; parentheses and backslashes escaped. For printable ASCII."""
    return F.concat(F.lit("("), F.regexp_replace(col(text), r"([()\\])", r"\\$1"), F.lit(")"))


def file_type(head: Column, name: Column) -> Column:
    """What a file is, by its first bytes and then its extension: struct(type, severity)."""
    # First bytes, extensions, types and severities.
    magic = F.hex(F.substring(head, 1, 4))
    ext = F.when(F.instr(name, ".") > 0, F.lower(F.substring_index(name, ".", -1))).otherwise("")
    kind = lambda t, s: F.struct(F.lit(t).alias("type"), F.lit(s).alias("severity"))
    begins = lambda *heads: magic.rlike("^(?:" + "|".join(heads) + ")")
    zipped = (
        F.when(ext.isin("docm", "xlsm", "pptm", "dotm", "xltm"), kind("office document with macros", "high"))
        .when(ext.isin("docx", "xlsx", "pptx"), kind("office document", "low"))
        .when(ext.isin("jar", "apk"), kind("executable", "high"))
        .otherwise(kind("archive", "medium"))
    )
    return (
        F.when(begins("4D5A", "7F454C46", "FEEDFAC[EF]", "C[EF]FAEDFE", "CAFEBABE"), kind("executable", "high"))
        .when(begins("2321"), kind("script", "high"))
        .when(begins("25504446"), kind("pdf", "medium"))
        .when(begins("D0CF11E0"), kind("office document (old format)", "medium"))
        .when(begins("504B0304"), zipped)
        .when(begins("52617221", "377ABCAF", "1F8B"), kind("archive", "medium"))
        .when(ext.isin("exe", "dll", "scr", "com", "msi", "jar", "lnk", "hta"), kind("executable", "high"))
        .when(ext.isin("js", "jse", "vbs", "vbe", "wsf", "ps1", "bat", "cmd", "sh", "py"), kind("script", "high"))
        .when(ext.isin("html", "htm", "svg"), kind("web page", "medium"))
        .otherwise(kind("data", "low"))
    )


def parse_color(value: Column | str) -> Column:
    """RRGGBB as three numbers from 0 to 1; null for anything else."""
    v = col(value)
    part = lambda at: (F.conv(F.substring(v, at, 2), 16, 10).cast("double") / 255.0)
    return F.when(v.rlike("^[0-9A-Fa-f]{6}$"), F.array(part(1), part(3), part(5)))
