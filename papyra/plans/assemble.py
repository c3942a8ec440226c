"""Queries of the operators on pages, outlines and the model of a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assemble, edit
from ..sources.corpus import conversation_pages, document_pages, table


def _long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def pages_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last page, then the first two, of conversations with two pages or more."""
    pages = conversation_pages(spark, sf_dir)
    two = pages.where("page = 2").select("doc_id")
    out = assemble.keep_pages(pages.join(two, "doc_id", "left_semi"), "last,1-2")
    return _long(out, "page", "source_page").select("doc_id", "page", "source_page", "text")


def pages_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations without their second page, where there is one, numbered anew."""
    pages = conversation_pages(spark, sf_dir)
    two = pages.where("page = 2").select("doc_id")
    out = assemble.delete_pages(pages.join(two, "doc_id", "left_semi"), "2")
    return _long(out, "page", "source_page").select("doc_id", "page", "source_page", "text")


def split_every(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of ten lines to a page in parts of three pages."""
    out = assemble.split_every(document_pages(spark, sf_dir).select("doc_id", "page"), 3)
    return out.select("doc_id", "part", "file", F.array_join(F.col("source_pages").cast("array<string>"), ",").alias("source_pages"))


def split_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations of three pages or more as their first page and the rest backwards."""
    pages = conversation_pages(spark, sf_dir)
    three = pages.where("page = 3").select("doc_id")
    out = assemble.split_ranges(pages.join(three, "doc_id", "left_semi"), ["1", "last-2"])
    return out.select("doc_id", "part", "file", F.array_join(F.col("source_pages").cast("array<string>"), ",").alias("source_pages"))


def merge_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten conversations at a time as one document."""
    pages = conversation_pages(spark, sf_dir).select("doc_id", "page")
    order = pages.select("doc_id").distinct().select(
        "doc_id", F.floor(F.col("doc_id") / 10).cast("long").alias("merge_id"), F.col("doc_id").alias("pos")
    )
    return _long(assemble.merge(pages, order), "page", "source_page").select("merge_id", "doc_id", "source_page", "page")


def merge_field_namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as fields of the forms of their nations, merged by region; nations with an odd key have no form."""
    nation = table(spark, sf_dir, "nation").select(
        F.col("n_regionkey").cast("long").alias("merge_id"), F.col("n_nationkey").cast("long").alias("pos")
    )
    fields = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("k"), F.col("s_name").alias("name"))
    rows = nation.where("pos % 2 = 0").join(fields, F.col("pos") == F.col("k")).drop("k")
    return assemble.merge_fields(rows)


def outline_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every region a document: its nations and their suppliers as an outline in reading order."""
    doc = F.col("r_regionkey").cast("long").alias("doc_id")
    region = table(spark, sf_dir, "region").select(
        doc, F.concat(F.lit("r"), F.col("r_regionkey")).alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_regionkey").cast("long").alias("pos"), F.col("r_name").alias("title")
    )
    home = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").cast("long").alias("doc_id"))
    nation = table(spark, sf_dir, "nation").select(
        F.col("n_regionkey").cast("long").alias("doc_id"), F.concat(F.lit("n"), F.col("n_nationkey")).alias("id"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("parent"), F.col("n_nationkey").cast("long").alias("pos"), F.col("n_name").alias("title")
    )
    supplier = table(spark, sf_dir, "supplier").join(home, F.col("s_nationkey") == F.col("k")).select(
        "doc_id", F.concat(F.lit("s"), F.col("s_suppkey")).alias("id"), F.concat(F.lit("n"), F.col("s_nationkey")).alias("parent"), F.col("s_suppkey").alias("pos"), F.col("s_name").alias("title")
    )
    return assemble.flatten_tree(region.unionByName(nation).unionByName(supplier))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as outline entries: the part key modulo four gives the level, the supplier the page."""
    lines = table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("seq")
    )
    return lines.agg(
        (F.pmod(F.min("l_partkey"), F.lit(4)) + 1).cast("long").alias("level"),
        F.pmod(F.min("l_suppkey"), F.lit(5)).cast("long").alias("page"),
    )


def outline_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outline entries whose page is kept, nested anew. Page 0 of every document goes."""
    entries = _entries(spark, sf_dir)
    kept = entries.select("doc_id", "page").where("page <> 0").distinct()
    return assemble.surviving_outline(entries, kept).select("doc_id", "seq", "level", "page", "new_level")


def rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and odd pages turned: page 1 twice."""
    pages = conversation_pages(spark, sf_dir).withColumn("rotation", F.lit(180))
    out = edit.rotate(pages.select("doc_id", "page", "rotation"), 90, "1,odd")
    return _long(out, "page", "rotation").select("doc_id", "page", "rotation")


def page_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visual sizes and raster sizes of parts as pages, 10 times as large as they are."""
    part = table(spark, sf_dir, "part")
    width, height = (F.col("p_size") * 10.0).cast("double"), F.col("p_retailprice")
    w, h = edit.visual_size(width, height, F.pmod(F.col("p_partkey"), F.lit(4)) * 90)
    pw, ph = edit.raster_size(w, h, 150.0)
    return part.select("p_partkey", w.alias("width"), h.alias("height"), pw.cast("long").alias("pixels_x"), ph.cast("long").alias("pixels_y"))


def set_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' metadata with a title set and the subject removed."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.create_map(F.lit("author"), "source", F.lit("subject"), "lang").alias("metadata")
    )
    out = edit.set_meta(docs, {"title": "Sample", "subject": ""})
    return out.select("doc_id", F.col("metadata")["title"].alias("title"), F.col("metadata")["author"].alias("author"), F.col("metadata")["subject"].alias("subject"), F.array_join("changed", ",").alias("changed"))


def stamp_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page numbers as they would be stamped."""
    pages = conversation_pages(spark, sf_dir).select("doc_id", "page")
    totals = pages.groupBy("doc_id").agg(F.max("page").alias("pages"))
    out = pages.join(totals, "doc_id")
    return out.select("doc_id", F.col("page").cast("long").alias("page"), edit.stamp_text("Page {page} of {pages}", F.col("page"), F.col("pages")).alias("stamp"))


def stamp_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as words on the pages of their orders, under a stamp in the middle."""
    words = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"),
        (F.col("l_quantity") * 10).alias("x0"), (F.col("l_linenumber") * 12.0).alias("y0"),
        (F.col("l_quantity") * 10 + 30).alias("x1"), (F.col("l_linenumber") * 12.0 + 10).alias("y1"),
    )
    stamps = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.lit(100.0).alias("x0"), F.lit(20.0).alias("y0"), F.lit(300.0).alias("x1"), F.lit(50.0).alias("y1")
    )
    return edit.overlapping_words(stamps, words).select("doc_id", "words_under_it")


def compress_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, as if recompressing halved them and added up to 1800 bytes; some grow."""
    docs = table(spark, sf_dir, "documents")
    before = F.octet_length("text").cast("double")
    after = (F.pmod(F.col("doc_id"), F.lit(7)) * 300 + F.length("text") / 2).cast("double")
    r = edit.compress_report(before, after)
    return docs.select("doc_id", r["rewritten"].alias("rewritten"), r["size_after"].alias("size_after"), r["saved_percent"].alias("saved_percent"))


QUERIES = {
    f.__name__: f
    for f in (
        pages_keep, pages_delete, split_every, split_ranges, merge_offset, merge_field_namespace, outline_tree, outline_orphans,
        rotate, page_sizes, set_meta, stamp_template, stamp_overlap, compress_report,
    )
}

_PAGES = "SELECT conv_id AS doc_id, turn + 1 AS page, text FROM conversations"
_NUMBERED = """
SELECT doc_id, CAST(unnest(generate_series(1, CAST(ceil(len(string_split(text, chr(10))) / 10.0) AS BIGINT))) AS BIGINT) AS page FROM documents"""

SQL = {
    "pages_keep": f"""
WITH p AS ({_PAGES}), t AS (SELECT doc_id, max(page) AS n FROM p GROUP BY doc_id HAVING max(page) >= 2),
k AS (SELECT doc_id, unnest([n, 1, 2]) AS source_page, unnest([1, 2, 3]) AS page FROM t)
SELECT k.doc_id, CAST(k.page AS BIGINT) AS page, CAST(k.source_page AS BIGINT) AS source_page, text FROM k JOIN p ON p.doc_id = k.doc_id AND p.page = k.source_page""",
    "pages_delete": f"""
WITH p AS ({_PAGES})
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS page, CAST(page AS BIGINT) AS source_page, text
FROM p WHERE page <> 2 AND doc_id IN (SELECT doc_id FROM p WHERE page = 2)""",
    "split_every": f"""
WITH p AS ({_NUMBERED})
SELECT doc_id, (page - 1) // 3 + 1 AS part, doc_id || '-' || lpad(CAST((page - 1) // 3 + 1 AS VARCHAR), 4, '0') || '.pdf' AS file,
       string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) AS source_pages FROM p GROUP BY ALL""",
    "split_ranges": f"""
WITH p AS ({_PAGES}), t AS (SELECT doc_id, max(page) AS n FROM p GROUP BY doc_id HAVING max(page) >= 3)
SELECT doc_id, CAST(1 AS BIGINT) AS part, doc_id || '-0001.pdf' AS file, '1' AS source_pages FROM t
UNION ALL SELECT doc_id, 2, doc_id || '-0002.pdf', array_to_string(list_reverse(generate_series(2, n)), ',') FROM t""",
    "merge_offset": f"""
WITH p AS ({_PAGES}), c AS (SELECT doc_id, doc_id // 10 AS merge_id, count(*) AS n FROM p GROUP BY doc_id),
o AS (SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY merge_id ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM c)
SELECT merge_id, p.doc_id, CAST(p.page AS BIGINT) AS source_page, CAST(p.page + off AS BIGINT) AS page FROM p JOIN o ON o.doc_id = p.doc_id""",
    "merge_field_namespace": """
WITH f AS (SELECT CAST(n_regionkey AS BIGINT) AS merge_id, CAST(n_nationkey AS BIGINT) AS pos, s_name AS name
           FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE n_nationkey % 2 = 0)
SELECT merge_id, pos, name, CASE WHEN pos = min(pos) OVER (PARTITION BY merge_id) THEN name ELSE 'doc' || pos || '.' || name END AS merged_name FROM f""",
    "outline_tree": """
WITH a AS (
  SELECT 'r' || r_regionkey AS id, r_name AS title, 1 AS level, [r_regionkey, -1, -1] AS path FROM region
  UNION ALL SELECT 'n' || n_nationkey, n_name, 2, [n_regionkey, n_nationkey, -1] FROM nation
  UNION ALL SELECT 's' || s_suppkey, s_name, 3, [n_regionkey, n_nationkey, s_suppkey] FROM supplier JOIN nation ON n_nationkey = s_nationkey)
SELECT CAST(path[1] AS BIGINT) AS doc_id, row_number() OVER (PARTITION BY path[1] ORDER BY path) AS seq, CAST(level AS BIGINT) AS level, title, id FROM a""",
    "outline_orphans": """
WITH RECURSIVE e AS (
  SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS seq, min(l_partkey) % 4 + 1 AS level, min(l_suppkey) % 5 AS page
  FROM lineitem GROUP BY ALL HAVING min(l_suppkey) % 5 <> 0),
p AS (SELECT a.doc_id, a.seq, max(b.seq) AS parent FROM e a LEFT JOIN e b ON b.doc_id = a.doc_id AND b.seq < a.seq AND b.level < a.level GROUP BY a.doc_id, a.seq),
d AS (SELECT doc_id, seq, 1 AS depth FROM p WHERE parent IS NULL
      UNION ALL SELECT p.doc_id, p.seq, d.depth + 1 FROM p JOIN d ON d.doc_id = p.doc_id AND d.seq = p.parent)
SELECT e.doc_id, e.seq, CAST(e.level AS BIGINT) AS level, CAST(e.page AS BIGINT) AS page, CAST(d.depth AS BIGINT) AS new_level
FROM e JOIN d ON d.doc_id = e.doc_id AND d.seq = e.seq""",
    "rotate": f"""
SELECT doc_id, CAST(page AS BIGINT) AS page, CAST((180 + 90 * (CASE WHEN page = 1 THEN 2 WHEN page % 2 = 1 THEN 1 ELSE 0 END)) % 360 AS BIGINT) AS rotation FROM ({_PAGES})""",
    "page_sizes": """
WITH v AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 1 THEN p_retailprice ELSE p_size * 10.0::DOUBLE END AS width,
                  CASE WHEN p_partkey % 2 = 1 THEN p_size * 10.0::DOUBLE ELSE p_retailprice END AS height FROM part),
s AS (SELECT *, least(150.0::DOUBLE / 72.0::DOUBLE, 16000 / greatest(width, height), sqrt(64000000 / (width * height))) AS k FROM v)
SELECT p_partkey, width, height, CAST(greatest(floor(width * k), 1) AS BIGINT) AS pixels_x, CAST(greatest(floor(height * k), 1) AS BIGINT) AS pixels_y FROM s""",
    "set_meta": "SELECT doc_id, 'Sample' AS title, source AS author, CAST(NULL AS VARCHAR) AS subject, 'subject,title' AS changed FROM documents",
    "stamp_template": f"""
SELECT doc_id, CAST(page AS BIGINT) AS page, 'Page ' || page || ' of ' || max(page) OVER (PARTITION BY doc_id) AS stamp FROM ({_PAGES})""",
    "stamp_overlap": """
SELECT o_orderkey AS doc_id, count(l_orderkey) AS words_under_it FROM orders LEFT JOIN lineitem
  ON l_orderkey = o_orderkey AND 100 < l_quantity * 10 + 30 AND l_quantity * 10 < 300 AND 20 < l_linenumber * 12.0 + 10 - 0.5 AND l_linenumber * 12.0 + 0.5 < 50
GROUP BY o_orderkey""",
    "compress_report": """
WITH s AS (SELECT doc_id, strlen(text)::DOUBLE AS b, (doc_id % 7 * 300 + length(text) / 2)::DOUBLE AS a FROM documents)
SELECT doc_id, a < b AS rewritten, least(a, b) AS size_after, CASE WHEN b > 0 THEN round(100.0::DOUBLE * (b - least(a, b)) / b, 1) ELSE 0.0::DOUBLE END AS saved_percent FROM s""",
}
