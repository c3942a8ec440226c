"""Images: the first page that shows each, and file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_owner(drawn: DataFrame) -> DataFrame:
    """Of (doc_id, page, draw_pos, key) the first place of every key, numbered within its page.

    The minimum is combined before it moves, so an image on every page is one row a task.
    """
    first = drawn.groupBy("doc_id", "key").agg(F.min(F.struct("page", "draw_pos")).alias("p"))
    nth = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("draw_pos", "key"))
    return first.select("doc_id", "key", "p.page", "p.draw_pos").withColumn("n", nth)


def page_file(page: Column) -> Column:
    """Name of a rendered page."""
    return F.format_string("page-%04d.png", page.cast("long"))


def image_file(page: Column, n: Column, kind: Column) -> Column:
    """Name of an exported image."""
    return F.format_string("page-%04d-img-%02d.%s", page.cast("long"), n.cast("long"), kind)


def image_kind(head: Column) -> Column:
    """png, jpg or jp2 by the first bytes; null for others."""
    magic = F.hex(F.substring(head, 1, 12))
    return (
        F.when(magic.startswith("89504E470D0A1A0A"), "png")
        .when(magic.startswith("FFD8FF"), "jpg")
        .when(magic.startswith("0000000C6A502020") | magic.startswith("FF4FFF51"), "jp2")
    )
