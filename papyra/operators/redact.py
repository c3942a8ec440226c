"""Finding, removing and replacing text on lines, with a second look at the result."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def targets(lines: DataFrame, texts: list[str], *, regex: bool = False, case_sensitive: bool = False) -> DataFrame:
    """Every match of every pattern on its line: (doc_id, page, line, pattern, start, match).

    Patterns are independent and overlaps stay. A phrase that runs over the end of a line is no match.
    """
    out = None
    for k, java in enumerate(T.any_pattern(texts, regex=regex, case_sensitive=case_sensitive)):
        rows = lines.where(F.col("text").rlike(java)).select(
            "doc_id", "page", "line", F.lit(k + 1).alias("pattern"), F.explode(T.spans("text", java)).alias("s")
        )
        rows = rows.select("doc_id", "page", "line", "pattern", F.col("s.start").cast("long").alias("start"), F.col("s.match").alias("match"))
        out = rows if out is None else out.unionByName(rows)
    return out


def count_targets(lines: DataFrame, texts: list[str], **how) -> DataFrame:
    """Annotations that marking every match would add: (doc_id, page, added)."""
    patterns = T.any_pattern(texts, **how)
    n = sum((T.count_matches("text", p) for p in patterns), F.lit(0).cast("long"))
    return lines.where(holds("text", patterns)).groupBy("doc_id", "page").agg(F.sum(n).cast("long").alias("added"))


def holds(text: Column | str, patterns: list[str]) -> Column:
    """Whether any of the patterns matches: one look for all of them, flags kept to each."""
    return F.coalesce(T.col(text).rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def struck(text: Column | str, patterns: list[str]) -> Column:
    """The text without the matches, pattern after pattern."""
    out = T.col(text)
    for java in patterns:
        out = F.regexp_replace(out, java, "")
    return out


def redact(lines: DataFrame, texts: list[str], *, regex: bool = False, case_sensitive: bool = False, verify: bool = True) -> DataFrame:
    """``lines`` with matches removed, and ``removed``, how many were.

    With ``verify`` every result is searched again; a line that still matches fails the query, so that nothing is
    written which still holds what was to go. A line that holds none of the texts is looked at once and passed on.
    """
    patterns = T.any_pattern(texts, regex=regex, case_sensitive=case_sensitive)
    removed = sum((T.count_matches("text", p) for p in patterns), F.lit(0).cast("long"))
    new = struck("text", patterns)
    if verify:
        # Bound once, so that the text is not struck again for the second look.
        left = lambda x: F.when(holds(x, patterns), F.raise_error(F.lit("text is left after redaction")).cast("string")).otherwise(x)
        new = F.element_at(F.transform(F.array(new), left), 1)
    found = T.fresh("__hit", lines)
    out = lines.withColumn(found, holds("text", patterns))
    out = out.withColumn("removed", F.when(F.col(found), removed).otherwise(F.lit(0).cast("long")))
    return out.withColumn("text", F.when(F.col(found), new).otherwise(F.col("text"))).drop(found)


def redact_fixpoint(lines: DataFrame, texts: list[str], *, rounds: int = 8, **how) -> DataFrame:
    """Redaction repeated while removing one match makes another, as in ``sesecretcret``; then verified.

    Rounds are steps of one fold, and a line in which nothing is left to find passes them by.
    """
    patterns = T.any_pattern(texts, **how)
    step = lambda acc, _: F.when(holds(acc, patterns), struck(acc, patterns)).otherwise(acc)
    check = lambda acc: F.when(holds(acc, patterns), F.raise_error(F.lit("text is left after redaction")).cast("string")).otherwise(acc)
    out = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.col("text"), step, check)
    return lines.withColumn("text", F.when(holds("text", patterns), out).otherwise(F.col("text")))


def java_replacement(template: str) -> str:
    """A replacement with ``$1``, ``${1}``, ``$name`` and ``$$`` in Java's terms.

    ``$`` takes the longest name of letters, digits and underscores: ``$1a`` is a group called ``1a``, which cannot
    be, and stands for nothing.
    """
    out = []
    for m in re.finditer(r"\$(?:\$|\{(\w+)\}|(\w+))|\\|\$|[^$\\]+", template):
        name = m[1] or m[2]
        if name and name.isdigit():
            # A digit that follows would be read as part of the group's number; an empty quote ends it.
            after = template[m.end() : m.end() + 1]
            out.append(f"${name}" + ("\\" if after.isdigit() else ""))
        elif name:
            out.append("" if name[0].isdigit() else "${" + name + "}")
        elif m[0] in ("$$", "$"):
            out.append(r"\$")
        elif m[0] == "\\":
            out.append(r"\\")
        else:
            out.append(m[0])
    return "".join(out)


def replace_text(
    lines: DataFrame, find: str, replacement: str, *, regex: bool = False, case_sensitive: bool = False
) -> DataFrame:
    """``lines`` with matches replaced, ``replacements`` counted, and ``width_change``: what the line grows by in
    Helvetica, in 1/1000 em. A replacement must not hold a line feed."""
    if "\n" in replacement:
        raise ValueError("the replacement must be one line")
    java = T.pattern(find, regex=regex, case_sensitive=case_sensitive)
    new = java_replacement(replacement) if regex else re.sub(r"([\\$])", r"\\\1", replacement)
    hit = T.fresh("__hit", lines)
    zero = F.lit(0).cast("long")
    count = T.count_matches("text", java)
    out = F.regexp_replace("text", java, new)
    if regex:
        change = T.helvetica_units(out) - T.helvetica_units("text")
    else:
        # All matches are replaced by one text: only what is taken out has to be measured.
        change = count * T.helvetica_units(F.lit(replacement)) - T.helvetica_units(F.array_join(F.regexp_extract_all("text", F.lit(java), 0), ""))
    marked = lines.withColumn(hit, holds("text", [java]))
    changed = marked.withColumn("replacements", F.when(F.col(hit), count).otherwise(zero)).withColumn("width_change", F.when(F.col(hit), change).otherwise(zero))
    return changed.withColumn("text", F.when(F.col(hit), out).otherwise(F.col("text"))).drop(hit)
