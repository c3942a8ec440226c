"""Reading: text within a budget, where to resume, search, facts about documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.pagespec import apply_spec


def _budgeted(pages: DataFrame, max_chars: int | None, from_char: int, spec: str | None) -> tuple[DataFrame, Column]:
    picked = apply_spec(pages, spec)
    skip = F.when(F.col("pos") == 1, from_char).otherwise(0)
    size = F.greatest(F.coalesce(F.length(T.strip("text")), F.lit(0)) - skip, F.lit(0)).cast("long")
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    sized = picked.withColumn("__skip", skip).withColumn("__size", size)
    prev = F.coalesce(F.sum("__size").over(before), F.lit(0)).cast("long")
    budget = F.lit(2**62 if max_chars is None else max_chars).cast("long")
    return sized.withColumn("__prev", prev), budget


def read_text(pages: DataFrame, *, max_chars: int | None = None, from_char: int = 0, spec: str | None = None) -> DataFrame:
    """Pages (doc_id, pos, page, text, truncated) up to ``max_chars`` characters a document.

    ``pages`` has doc_id, page, text; a null text is an unreadable page and costs nothing. ``from_char`` skips
    into the first page only. The budget is a running sum over the pages of a document.
    """
    rows, budget = _budgeted(pages, max_chars, from_char, spec)
    left = budget - F.col("__prev")
    shown = F.substring(T.strip("text"), F.col("__skip") + F.lit(1), F.least(left, F.lit(2**31 - 1)).cast("int"))
    return rows.where(F.col("__prev") < budget).select(
        "doc_id", "pos", "page", shown.alias("text"), (F.col("__size") > left).alias("truncated")
    )


def resume_at(pages: DataFrame, *, max_chars: int, from_char: int = 0, spec: str | None = None) -> DataFrame:
    """Where reading goes on: (doc_id, pos, page, char) of the first page that the budget does not cover.

    A budget used up at the end of a page resumes at the start of the next; a document read to its end has no row.
    """
    rows, budget = _budgeted(pages, max_chars, from_char, spec)
    left = F.greatest(budget - F.col("__prev"), F.lit(0))
    open_ = rows.where((F.col("__prev") >= budget) | (F.col("__size") > left))
    place = F.struct("pos", "page", (F.col("__skip") + F.when(F.col("__prev") >= budget, 0).otherwise(left)).cast("long").alias("char"))
    return open_.groupBy("doc_id").agg(F.min(place).alias("p")).select("doc_id", "p.pos", "p.page", "p.char")


def raw_text(pages: DataFrame) -> DataFrame:
    """Texts of a document joined by form feeds."""
    order = F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"])
    return pages.groupBy("doc_id").agg(F.array_join(order, "\n\f\n").alias("text"))


def search(
    pages: DataFrame,
    query: str,
    *,
    regex: bool = False,
    case_sensitive: bool = False,
    spec: str | None = None,
    context: int = 80,
    max_results: int = 50,
) -> DataFrame:
    """The first ``max_results`` matches of every document: doc_id, n, page, match, snippet, total_matches.

    Pages are flattened to one line first, so a phrase matches across line breaks. A page lists at most
    ``max_results`` matches itself; only counts cross the shuffle by document before the list is cut.
    """
    java = T.pattern(query, regex=regex, case_sensitive=case_sensitive)
    flat = apply_spec(pages, spec).withColumn("__flat", T.flatten("text"))
    start = lambda x: F.greatest(x["start"] - context, F.lit(0))
    snippet = lambda x: F.substring(
        F.col("__flat"), start(x) + 1, x["start"] + F.length(x["match"]) + context - start(x)
    )
    listed = F.transform(
        F.col("__spans"), lambda x, i: F.struct(i.alias("i"), x["match"].alias("match"), snippet(x).alias("snippet"))
    )
    found = (
        flat.withColumn("__count", T.count_matches("__flat", java))
        .where("__count > 0")
        .withColumn("__spans", T.spans("__flat", java, max_results))
        .select("doc_id", "pos", "page", "__count", listed.alias("__listed"))
    )
    per_doc = Window.partitionBy("doc_id")
    before = per_doc.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    ranked = found.select(
        "doc_id",
        "page",
        F.sum("__count").over(per_doc).cast("long").alias("total_matches"),
        F.coalesce(F.sum("__count").over(before), F.lit(0)).alias("__before"),
        "__listed",
    )
    return (
        ranked.where(F.col("__before") < max_results)
        .select("doc_id", "page", "total_matches", "__before", F.explode("__listed").alias("m"))
        .withColumn("n", (F.col("__before") + F.col("m.i") + 1).cast("long"))
        .where(F.col("n") <= max_results)
        .select("doc_id", "n", "page", F.col("m.match").alias("match"), F.col("m.snippet").alias("snippet"), "total_matches")
    )


def search_totals(pages: DataFrame, query: str, *, regex: bool = False, case_sensitive: bool = False) -> DataFrame:
    """Matches per document, those with none left out."""
    java = T.pattern(query, regex=regex, case_sensitive=case_sensitive)
    counted = pages.select("doc_id", T.count_matches(T.flatten("text"), java).alias("n"))
    return counted.groupBy("doc_id").agg(F.sum("n").cast("long").alias("total_matches")).where("total_matches > 0")


def info(pages: DataFrame, *, width: Column, height: Column) -> DataFrame:
    """Facts per document: pages, characters, the first page's size, whether all pages have it."""
    sized = pages.select("doc_id", "page", "text", width.alias("w"), height.alias("h"))
    first = F.min_by(F.struct("w", "h"), "page")
    return sized.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("pages"),
        F.sum(F.length("text")).cast("long").alias("chars"),
        first["w"].alias("width"),
        first["h"].alias("height"),
        (F.count_distinct("w", "h") <= 1).alias("uniform_page_size"),
    )


def outline_pages(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """Outline entries (doc_id, seq, level, title, target) with the page number of their target, null where there is none."""
    doc, obj, page = (T.fresh(n, entries) for n in ("__doc", "__obj", "__page"))
    numbers = pages.select(F.col("doc_id").alias(doc), F.col("obj").alias(obj), F.col("page").alias(page))
    return entries.join(numbers, (F.col("doc_id") == F.col(doc)) & (F.col("target") == F.col(obj)), "left").select(
        "doc_id", "seq", "level", "title", F.col(page).alias("page")
    )
