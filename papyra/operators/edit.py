"""Editing the model of a document: rotation, metadata, stamps, sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.pagespec import apply_spec

META_KEYS = ("title", "author", "subject", "keywords", "creator")
#: The largest edge and area of a raster, in pixels.
MOST_EDGE, MOST_AREA = 16_000, 64_000_000


def rotate(pages: DataFrame, angle: int, spec: str | None = None) -> DataFrame:
    """Pages with ``rotation`` turned by ``angle`` for every time the spec names them."""
    if angle % 90:
        raise ValueError("angle must be a multiple of 90")
    n = T.fresh("__times", pages)
    times = apply_spec(pages.select("doc_id", "page"), spec).groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias(n))
    turned = F.pmod(F.col("rotation") + F.coalesce(n, F.lit(0)) * angle, F.lit(360))
    return pages.join(times, ["doc_id", "page"], "left").withColumn("rotation", turned.cast("int")).drop(n)


def visual_size(width: Column, height: Column, rotation: Column) -> tuple[Column, Column]:
    """Width and height as a reader sees them."""
    turned = F.pmod(rotation, F.lit(180)) == 90
    return F.when(turned, height).otherwise(width), F.when(turned, width).otherwise(height)


def raster_size(width: Column, height: Column, dpi: float = 150.0) -> tuple[Column, Column]:
    """Pixels of a page rendered at ``dpi``, less where an edge or the area would be beyond bounds; at least 1."""
    scale = F.least(F.lit(dpi / 72.0), MOST_EDGE / F.greatest(width, height), F.sqrt(MOST_AREA / (width * height)))
    return tuple(F.greatest(F.floor(x * scale), F.lit(1)).cast("int") for x in (width, height))


def set_meta(docs: DataFrame, changes: dict[str, str], *, meta_col: str = "metadata") -> DataFrame:
    """The metadata map with the given keys set; an empty value removes a key. Returns ``changed`` as well."""
    if unknown := set(changes) - set(META_KEYS):
        raise ValueError(f"unknown key {sorted(unknown)[0]}")
    if not changes:
        raise ValueError("nothing to set")
    kept = F.map_filter(meta_col, lambda k, v: ~k.isin(list(changes)))
    new = [F.lit(x) for k, v in changes.items() if v for x in (k, v)]
    out = F.map_concat(kept, F.create_map(*new)) if new else kept
    return docs.withColumn(meta_col, out).withColumn("changed", F.array(*[F.lit(k) for k in sorted(changes)]))


def stamp_text(template: str, page: Column, pages: Column) -> Column:
    """A stamp's text for one page; ``{pages}`` before ``{page}``, so that neither is cut out of the other."""
    total = F.replace(F.lit(template), F.lit("{pages}"), pages.cast("string"))
    return F.replace(total, F.lit("{page}"), page.cast("string"))


def overlapping_words(stamps: DataFrame, words: DataFrame, *, slack: float = 0.5) -> DataFrame:
    """(doc_id, page, words_under_it): words that a stamp's box lies over. Joined by page, then by range."""
    stamps = stamps.select("doc_id", "page", "x0", "y0", "x1", "y1")
    w = words.select(F.col("doc_id").alias("d"), F.col("page").alias("p"), *[F.col(c).alias(f"w_{c}") for c in ("x0", "y0", "x1", "y1")])
    over = (
        (F.col("doc_id") == F.col("d"))
        & (F.col("page") == F.col("p"))
        & (F.col("x0") < F.col("w_x1"))
        & (F.col("w_x0") < F.col("x1"))
        & (F.col("y0") < F.col("w_y1") - slack)
        & (F.col("w_y0") + slack < F.col("y1"))
    )
    return stamps.join(w, over, "left").groupBy("doc_id", "page").agg(F.count("d").alias("words_under_it"))


def compress_report(before: Column, after: Column) -> Column:
    """struct(rewritten, size_after, saved_percent): a larger result is not taken."""
    kept = F.least(before, after)
    saved = F.when(before > 0, F.round(100.0 * (before - kept) / before, 1)).otherwise(0.0)
    return F.struct((after < before).alias("rewritten"), kept.alias("size_after"), saved.alias("saved_percent"))
