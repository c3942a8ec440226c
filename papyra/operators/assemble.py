"""Putting pages together and taking them apart: pages, split, merge, outlines."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.pagespec import apply_spec, parse
from ..functions.text import fresh


def keep_pages(pages: DataFrame, spec: str) -> DataFrame:
    """The selected pages in the order of the spec: ``page`` is the new number, ``source_page`` the old one."""
    return apply_spec(pages, spec).withColumn("source_page", F.col("page")).withColumn("page", F.col("pos")).drop("pos")


def delete_pages(pages: DataFrame, spec: str) -> DataFrame:
    """All but the selected pages, numbered anew; a document of which nothing would be left fails."""
    mark = fresh("__gone", pages)
    gone = apply_spec(pages.select("doc_id", "page"), spec).select("doc_id", "page").distinct().withColumn(mark, F.lit(True))
    marked = pages.join(gone, ["doc_id", "page"], "left")
    left = F.count(F.when(F.col(mark).isNull(), 1)).over(Window.partitionBy("doc_id"))
    stays = F.when(left == 0, F.raise_error(F.lit("this would delete every page")).cast("boolean")).otherwise(F.col(mark).isNull())
    kept = marked.withColumn(mark, stays).where(mark).drop(mark)
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("page"))
    return kept.withColumn("source_page", F.col("page")).withColumn("page", number)


def _parts(numbered: DataFrame, stem: Column) -> DataFrame:
    parts = numbered.groupBy("doc_id", "part").agg(F.array_sort(F.collect_list(F.struct("pos", "page"))).alias("p"))
    return parts.select(
        "doc_id",
        F.col("part").cast("long").alias("part"),
        F.concat(stem, F.lit("-"), F.lpad(F.col("part").cast("string"), 4, "0"), F.lit(".pdf")).alias("file"),
        F.transform("p", lambda x: x["page"]).alias("source_pages"),
    )


def split_every(pages: DataFrame, every: int = 1, *, stem: Column | None = None) -> DataFrame:
    """Parts of ``every`` pages, the last maybe shorter: (doc_id, part, file, source_pages)."""
    if every < 1:
        raise ValueError("every must be at least 1")
    numbered = pages.select("doc_id", "page", F.col("page").alias("pos"), (F.floor((F.col("page") - 1) / every) + 1).alias("part"))
    return _parts(numbered, F.col("doc_id").cast("string") if stem is None else stem)


def split_ranges(pages: DataFrame, ranges: list[str], *, stem: Column | None = None) -> DataFrame:
    """One part for each page spec."""
    for spec in ranges:
        parse(spec)
    parts = [apply_spec(pages.select("doc_id", "page"), spec).withColumn("part", F.lit(k + 1)) for k, spec in enumerate(ranges)]
    both = parts[0]
    for more in parts[1:]:
        both = both.unionByName(more)
    return _parts(both, F.col("doc_id").cast("string") if stem is None else stem)


def merge_offsets(inputs: DataFrame) -> DataFrame:
    """(merge_id, pos, pages) with ``offset``: the pages of the inputs before it."""
    before = Window.partitionBy("merge_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return inputs.withColumn("offset", F.coalesce(F.sum("pages").over(before), F.lit(0)).cast("long"))


def merge(pages: DataFrame, order: DataFrame) -> DataFrame:
    """Pages of all inputs under their new document: ``order`` gives (merge_id, pos, doc_id). Only counts are windowed."""
    counts = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"))
    placed = merge_offsets(order.join(counts, "doc_id"))
    joined = pages.join(placed.select("merge_id", "doc_id", "offset"), "doc_id")
    return joined.withColumn("source_page", F.col("page")).withColumn("page", (F.col("page") + F.col("offset")).cast("int")).drop("offset")


def merge_fields(fields: DataFrame) -> DataFrame:
    """Field names in a merged document: (merge_id, pos, name) with ``merged_name``.

    The first input that has a form keeps its names; those of later inputs go under ``doc{pos}``.
    """
    first = F.min("pos").over(Window.partitionBy("merge_id"))
    renamed = F.concat(F.lit("doc"), F.col("pos").cast("string"), F.lit("."), F.col("name"))
    return fields.withColumn("merged_name", F.when(F.col("pos") == first, F.col("name")).otherwise(renamed))


def renest(entries: DataFrame) -> DataFrame:
    """Outline entries (doc_id, seq, level, ...) with ``new_level`` by nesting.

    An entry's parent is the nearest one before it with a smaller level, however deep. The entries of a document pass
    by in order, and only the levels that are still open are held.
    """
    name = fresh("new_level", entries.drop("new_level"))
    entries = entries.drop("new_level")
    at = [entries.columns.index(c) for c in ("doc_id", "level")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, open_ = None, []
        for batch in batches:
            out = []
            for d, level in zip(batch.column(at[0]).to_pylist(), batch.column(at[1]).to_pylist()):
                if d != doc:
                    doc, open_ = d, []
                while open_ and (level is None or open_[-1] >= level):
                    open_.pop()
                open_.append(1 if level is None else level)
                out.append(len(open_))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*batch.schema.names, name])

    ordered = entries.repartition("doc_id").sortWithinPartitions("doc_id", "seq")
    return ordered.mapInArrow(run, T.StructType([*entries.schema.fields, T.StructField(name, T.LongType())]))


def surviving_outline(entries: DataFrame, kept: DataFrame) -> DataFrame:
    """Outline entries whose target page survives, nested anew. ``kept`` has doc_id, page."""
    return renest(entries.join(kept.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_semi"))


def flatten_tree(nodes: DataFrame) -> DataFrame:
    """Trees (doc_id, id, parent, pos, title) as outline entries in reading order: (doc_id, seq, level, title, id).

    A document's tree is the unit that one task walks, iteratively and however deep. Children stand by ``pos``, then
    id. What no root leads to, such as a loop, is left out; a node that two lead to counts once.
    """
    rows = nodes.select("doc_id", F.col("id").cast("string").alias("id"), F.col("parent").cast("string").alias("parent"), F.col("pos").cast("long").alias("pos"), F.col("title").cast("string").alias("title"))
    kind = nodes.schema["doc_id"].dataType.simpleString()

    def walk(table: pa.Table) -> pa.Table:
        doc = table.column("doc_id")[0]
        children: dict[str | None, list[tuple]] = {}
        columns = [table.column(c).to_pylist() for c in ("parent", "pos", "id", "title")]
        for parent, pos, ident, title in sorted(zip(*columns), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "")):
            children.setdefault(parent, []).append((ident, title))
        out, todo, seen = [], [(1, *x) for x in reversed(children.get(None, []))], set()
        while todo:
            level, ident, title = todo.pop()
            if ident in seen:
                continue
            seen.add(ident)
            out.append((level, title, ident))
            todo += [(level + 1, *x) for x in reversed(children.get(ident, []))]
        levels, titles, idents = zip(*out) if out else ((), (), ())
        return pa.table(
            {
                "doc_id": pa.array([doc.as_py()] * len(out), doc.type), "seq": pa.array(range(1, len(out) + 1), pa.int64()), "level": pa.array(levels, pa.int64()),
                "title": pa.array(titles, pa.string()), "id": pa.array(idents, pa.string()),
            }
        )

    return rows.groupBy("doc_id").applyInArrow(walk, f"doc_id {kind}, seq long, level long, title string, id string")
