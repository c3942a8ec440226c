"""Geometry of a page: lines, segments, grids, tables from alignment, formatters.

Words are rows (doc_id, page, seq, text, x0, y0, x1, y1, size). What depends on the order of words is a fold over the
sorted words of one page; a page is the unit that is never split.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import fresh, strip


#: Fixed values, in font sizes: how far apart the centres of words on one line may be, and how wide the gap
#: between two cells is at least.
LINE_CENTRE = 0.5
CELL_GAP = 0.9


def line_numbers(words: DataFrame) -> DataFrame:
    """(doc_id, page, line, text, x0, y0, x1, y1, size) per word, lines from the top.

    A word joins the last line if its centre lies close enough to that of the line's *first* word. Words pass by sorted
    by page and centre, equal centres by ``seq``; only the first word of the line is remembered, and nothing is gathered.
    """
    kinds = {f.name: f.dataType for f in words.schema.fields}
    out = ("doc_id", "page", "text", "x0", "y0", "x1", "y1", "size")
    centre = ((F.col("y0") + F.col("y1")) / 2).cast("double").alias("centre")
    rows = words.select(*out, centre, F.col("size").cast("double").alias("own"), F.col("seq"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, anchor, size, line = None, 0.0, 0.0, 0
        for batch in batches:
            numbers = []
            for doc, page, c, s in zip(*(batch.column(k).to_pylist() for k in (0, 1, 8, 9))):
                if (doc, page) != place:
                    place, line, anchor, size = (doc, page), 1, c, s
                elif not abs(anchor - c) < LINE_CENTRE * min(size, s):
                    line, anchor, size = line + 1, c, s
                numbers.append(line)
            columns = batch.columns
            yield pa.RecordBatch.from_arrays([*columns[:2], pa.array(numbers, pa.int32()), *columns[2:8]], names=["doc_id", "page", "line", *out[2:]])

    schema = T.StructType([T.StructField(c, kinds.get(c, T.IntegerType())) for c in ("doc_id", "page", "line", *out[2:])])
    ordered = rows.repartition("doc_id", "page").sortWithinPartitions("doc_id", "page", "centre", "seq")
    return ordered.mapInArrow(run, schema)


def lines(words: DataFrame) -> DataFrame:
    """Lines with their text from left to right and their box, in tenths of a point."""
    placed = line_numbers(words)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda x: x["text"]), " ")
    tenth = lambda c: F.round(c, 1)
    return placed.groupBy("doc_id", "page", "line").agg(
        text.alias("text"), tenth(F.min("x0")).alias("x0"), tenth(F.min("y0")).alias("y0"), tenth(F.max("x1")).alias("x1"), tenth(F.max("y1")).alias("y1")
    )


def segments(words: DataFrame) -> DataFrame:
    """Words of each line merged into cells where the gap is narrow: (doc_id, page, line, cell, text, x0, x1)."""
    along = Window.partitionBy("doc_id", "page", "line").orderBy("x0", "x1", "text")
    gap = F.col("x0") - F.lag("x1").over(along)
    starts = F.when(gap < CELL_GAP * F.lag("size").over(along), 0).otherwise(1)
    placed = line_numbers(words).withColumn("__new", starts).withColumn("cell", F.sum("__new").over(along))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "x1", "text"))), lambda x: x["text"]), " ")
    return placed.groupBy("doc_id", "page", "line", "cell").agg(text.alias("text"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))


def cluster(values: Column, tolerance: float) -> Column:
    """Means of clusters of a sorted array of numbers: a number joins while it is within tolerance of the running mean."""
    none = F.array().cast("array<struct<m: double, n: bigint>>")

    def step(acc: Column, v: Column) -> Column:
        last = F.element_at(acc, -1)
        joins = (F.size(acc) > 0) & F.coalesce(v - F.try_element_at(acc, F.lit(-1))["m"] <= tolerance, F.lit(False))
        grown = F.struct(((last["m"] * last["n"] + v) / (last["n"] + 1)).alias("m"), (last["n"] + 1).alias("n"))
        fresh = F.struct(v.cast("double").alias("m"), F.lit(1).cast("long").alias("n"))
        return F.when(joins, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(fresh)))

    return F.transform(F.aggregate(values, none, step), lambda x: x["m"])


def cells_of_grid(words: DataFrame, edges: DataFrame) -> DataFrame:
    """Words in the half-open cells of ruled grids: ``edges`` has doc_id, page, xs, ys (sorted arrays).

    The cell is found inside the row by counting edges at or below the centre; nothing is joined but the page.
    """
    doc, page, xs, ys = (fresh(n, words) for n in ("__doc", "__page", "__xs", "__ys"))
    grid = edges.select(F.col("doc_id").alias(doc), F.col("page").alias(page), F.col("xs").alias(xs), F.col("ys").alias(ys))
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    below = lambda xs, c: F.size(F.filter(xs, lambda x: x <= c))
    joined = words.join(grid, (F.col("doc_id") == F.col(doc)) & (F.col("page") == F.col(page)))
    placed = joined.withColumn("column", below(xs, cx)).withColumn("row", below(ys, cy))
    inside = F.col("column").between(1, F.size(xs) - 1) & F.col("row").between(1, F.size(ys) - 1)
    return placed.where(inside).drop(doc, page, xs, ys)


def markdown_row(cells: Column) -> Column:
    """A table row in Markdown; the bar is escaped."""
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))


def csv_row(cells: Column) -> Column:
    """A table row in CSV; quoted where a comma, quote or line break asks for it."""

    def quoted(c: Column) -> Column:
        c = F.coalesce(c, F.lit(""))
        return F.when(c.rlike('[,"\n\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)

    return F.array_join(F.transform(cells, quoted), ",")


def tsv_lines(rows: DataFrame) -> DataFrame:
    """Lines of an OCR table (doc_id, pos, level, left, top, width, height, text): level 4 opens a line, level 5 adds a word.

    Blank words are left out, and so are lines without words.
    """
    order = Window.partitionBy("doc_id").orderBy("pos")
    numbered = rows.withColumn("line", F.sum(F.when(F.col("level") == 4, 1).otherwise(0)).over(order))
    words = numbered.where((F.col("level") == 5) & (strip("text") != "") & (F.col("line") > 0))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: strip(x["text"])), " ")
    return words.groupBy("doc_id", "line").agg(
        text.alias("text"),
        F.min("left").alias("x0"),
        F.min("top").alias("y0"),
        F.max(F.col("left") + F.col("width")).alias("x1"),
        F.max(F.col("top") + F.col("height")).alias("y1"),
    )


def recognised_text(lines: DataFrame) -> DataFrame:
    """Text of recognised lines (doc_id, page, line, paragraph, text): a blank line where the paragraph changes."""
    order = Window.partitionBy("doc_id", "page").orderBy("line")
    before = F.lag("paragraph").over(order)
    lead = F.when(F.lag("line").over(order).isNull(), "").when(before.eqNullSafe(F.col("paragraph")), "\n").otherwise("\n\n")
    led = lines.select("doc_id", "page", "line", F.concat(lead, F.coalesce("text", F.lit(""))).alias("__led"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("line", "__led"))), lambda x: x["__led"])
    return led.groupBy("doc_id", "page").agg(F.array_join(parts, "").alias("text"))
