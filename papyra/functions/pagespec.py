"""The language of page selections: ``3``, ``2-5``, ``7-``, ``-4``, ``5-2``, ``last``, ``odd``, ``even``, ``all``, by commas.

A spec is read once, on the driver, into segments; how many pages a document has is known only to the data,
so the segments become arrays of page numbers by Catalyst expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import fresh

LAST = -1


@dataclass(frozen=True)
class Segment:
    """Pages from ``start`` to ``end``, both included and in that direction; LAST is the last page."""

    start: int
    end: int
    step: int = 1


def _bound(text: str, default: int) -> int:
    text = text.strip()
    if not text:
        return default
    if text == "last":
        return LAST
    if not text.isascii() or not text.isdigit():
        raise ValueError(f"invalid page '{text}'")
    if int(text) == 0:
        raise ValueError("page 0 out of range")
    return int(text)


def parse(spec: str) -> list[Segment]:
    """Segments in the order written; repeats stay. A lone ``-`` is every page."""
    out = []
    for part in (p.strip().lower() for p in spec.split(",")):
        if part == "all":
            out.append(Segment(1, LAST))
        elif part in ("odd", "even"):
            out.append(Segment(1 if part == "odd" else 2, LAST, 2))
        elif "-" in part:
            a, _, b = part.partition("-")
            out.append(Segment(_bound(a, 1), _bound(b, LAST)))
        elif part:
            page = _bound(part, 0)
            out.append(Segment(page, page))
    if not out:
        raise ValueError(f"page spec '{spec}' selects no pages")
    return out


def select_pages(spec: str | None, total: Column) -> Column:
    """Selected page numbers, in order, for a document of ``total`` pages; fails the query on pages out of range."""
    parts = []
    for s in parse("all" if spec is None else spec):
        start, end = (total if x == LAST else F.lit(x) for x in (s.start, s.end))
        least = F.greatest(start, end) if s.step == 1 else F.lit(1)
        bad = F.raise_error(F.concat(F.lit(f"page out of range in '{spec}': the document has "), total.cast("string")))
        none = F.array().cast("array<int>")
        if s.step == 2:
            pages = F.when(start <= end, F.sequence(start.cast("int"), F.greatest(end, start).cast("int"), F.lit(2))).otherwise(none)
        else:
            pages = F.sequence(start.cast("int"), end.cast("int"))
        parts.append(F.when(total < 1, bad.cast("array<int>")).when(least > total, bad.cast("array<int>")).otherwise(pages))
    return F.concat(*parts)


def page_numbers(spec: str | None, total: int) -> list[int]:
    """Selected page numbers, in order, of one document of ``total`` pages."""
    out: list[int] = []
    for s in parse("all" if spec is None else spec):
        start, end = (total if x == LAST else x for x in (s.start, s.end))
        if total < 1 or (s.step == 1 and max(start, end) > total):
            raise ValueError(f"page out of range in '{spec or 'all'}': the document has {total}")
        out += range(start, end + 1, s.step) if start <= end or s.step == 2 else range(start, end - 1, -1)
    return out


def apply_spec(pages: DataFrame, spec: str | None, *, doc: str = "doc_id", page: str = "page") -> DataFrame:
    """``pages`` picked by a spec, with ``pos``, the place in the selection, from 1. Repeated pages repeat.

    The selection is worked out per document from its number of pages and joined back on document and page.
    """
    if spec is None:
        return pages.withColumn("pos", F.col(page).cast("int"))
    own, total, at, number = (fresh(n, pages) for n in ("__doc", "__total", "__at", "__page"))
    totals = pages.groupBy(F.col(doc).alias(own)).agg(F.max(page).cast("int").alias(total))
    picked = totals.select(own, F.posexplode(select_pages(spec, F.col(total))).alias(at, number))
    joined = pages.join(picked, (F.col(doc) == F.col(own)) & (F.col(page) == F.col(number)))
    return joined.withColumn("pos", (F.col(at) + 1).cast("int")).drop(own, at, number)
