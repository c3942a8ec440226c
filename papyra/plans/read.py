"""Queries of the reading operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.pagespec import apply_spec, select_pages
from ..operators import read
from ..sources.corpus import conversation_pages, document_pages, table

BUDGET = 500


def text_tidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tidied texts of the documents, roughened first: the tables hold no doubled white space."""
    rough = F.replace("text", F.lit(". "), F.lit(".  \n \t\n\n  "))
    return table(spark, sf_dir, "documents").select("doc_id", T.tidy(F.concat(F.lit(" \n\n"), rough)).alias("text"))


def text_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as one line each."""
    rough = F.replace("text", F.lit(". "), F.lit(". \n\t "))
    return table(spark, sf_dir, "documents").select("doc_id", T.flatten(rough).alias("text"))


def text_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 500 characters of every conversation, by pages."""
    out = read.read_text(conversation_pages(spark, sf_dir), max_chars=BUDGET)
    return out.select("doc_id", F.col("page").cast("long").alias("page"), "text", "truncated")


def text_from_char(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, entered 40 characters into the first page."""
    out = read.read_text(conversation_pages(spark, sf_dir), max_chars=BUDGET, from_char=40)
    return out.select("doc_id", F.col("page").cast("long").alias("page"), "text", "truncated")


def text_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where reading goes on after 500 characters."""
    out = read.resume_at(conversation_pages(spark, sf_dir), max_chars=BUDGET)
    return out.select("doc_id", F.col("page").cast("long").alias("page"), "char")


def text_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with their pages joined by form feeds."""
    return read.raw_text(conversation_pages(spark, sf_dir))


def search_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which a literal occurs, case ignored, and how often."""
    return read.search_totals(document_pages(spark, sf_dir), "ÉT")


def search_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for a pattern."""
    return read.search_totals(document_pages(spark, sf_dir), r"[a-z]+ion[., ]", regex=True, case_sensitive=True)


def search_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches with 20 characters around them."""
    out = read.search(conversation_pages(spark, sf_dir), "the", context=20, max_results=1000)
    return out.select("doc_id", "n", F.col("page").cast("long").alias("page"), "match", "snippet")


def search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five matches of every conversation, and how many there are."""
    out = read.search(conversation_pages(spark, sf_dir), "on", case_sensitive=True, max_results=5)
    return out.select("doc_id", "n", F.col("page").cast("long").alias("page"), "match", "total_matches")


def pagespec_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages 3, 1, 3 and the last down to 2 of conversations with three pages or more."""
    pages = conversation_pages(spark, sf_dir)
    long_enough = pages.groupBy("doc_id").agg(F.max("page").alias("n")).where("n >= 3").select("doc_id")
    out = apply_spec(pages.join(long_enough, "doc_id", "left_semi"), "3,1,3,last-2")
    return out.select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("page").cast("long").alias("page"), "text")


def pagespec_odd_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd, then even pages of every conversation, as one string."""
    totals = conversation_pages(spark, sf_dir).groupBy("doc_id").agg(F.max("page").cast("int").alias("n"))
    return totals.select("doc_id", F.array_join(select_pages("odd, even", F.col("n")).cast("array<string>"), ",").alias("pages"))


def info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts about conversations; a page's size comes from its role."""
    pages = conversation_pages(spark, sf_dir)
    width = F.when(F.col("role") == "system", 842.0).otherwise(595.0)
    return read.info(pages, width=width, height=F.lit(842.0)).select(
        "doc_id", F.col("pages").cast("long").alias("pages"), "chars", "width", "height", "uniform_page_size"
    )


def entity_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of pages with their references decoded; some are added, among them one that must not decode twice."""
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    more = F.concat(title, F.lit(" &amp;lt; &#233;&#xE9; &nope; &copy &lt;b&gt;"))
    return table(spark, sf_dir, "pages").select("page_id", T.decode_entities(more).alias("title"))


def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 40 characters of documents, controls as spaces."""
    return table(spark, sf_dir, "documents").select("doc_id", T.excerpt("text", 40).alias("excerpt"))


QUERIES = {
    f.__name__: f
    for f in (
        text_tidy, text_flatten, text_budget, text_from_char, text_resume, text_raw, search_literal, search_regex,
        search_snippets, search_topk, pagespec_select, pagespec_odd_even, info, entity_decode, excerpts,
    )
}

_PAGES = "SELECT conv_id AS doc_id, turn + 1 AS page, role, text FROM conversations"
_FLAT = r"trim(regexp_replace(text, '[\s\x{00A0}]+', ' ', 'g'))"

_BUDGET = f"""
WITH p AS ({_PAGES}),
s AS (SELECT doc_id, page, trim(text, ' ') AS t, CASE WHEN row_number() OVER (PARTITION BY doc_id ORDER BY page) = 1 THEN {{skip}} ELSE 0 END AS skip FROM p),
z AS (SELECT *, greatest(length(t) - skip, 0) AS n FROM s),
w AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev FROM z)
"""

SQL = {
    "text_tidy": r"""
SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(
    ' ' || chr(10) || chr(10) || replace(text, '. ', '.  ' || chr(10) || ' ' || chr(9) || chr(10) || chr(10) || '  '),
    '[^\S\n]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS text
FROM documents""",
    "text_flatten": r"SELECT doc_id, trim(regexp_replace(replace(text, '. ', '. ' || chr(10) || chr(9) || ' '), '\s+', ' ', 'g')) AS text FROM documents",
    "text_budget": _BUDGET.format(skip=0)
    + f"""SELECT doc_id, CAST(page AS BIGINT) AS page, substr(t, skip + 1, CAST(least({BUDGET} - prev, 1000000) AS BIGINT)) AS text,
       n > {BUDGET} - prev AS truncated FROM w WHERE prev < {BUDGET}""",
    "text_from_char": _BUDGET.format(skip=40)
    + f"""SELECT doc_id, CAST(page AS BIGINT) AS page, substr(t, skip + 1, CAST(least({BUDGET} - prev, 1000000) AS BIGINT)) AS text,
       n > {BUDGET} - prev AS truncated FROM w WHERE prev < {BUDGET}""",
    "text_resume": _BUDGET.format(skip=0)
    + f"""SELECT doc_id, CAST(page AS BIGINT) AS page, CAST(CASE WHEN prev >= {BUDGET} THEN 0 ELSE {BUDGET} - prev END AS BIGINT) AS char
FROM w WHERE prev >= {BUDGET} OR n > {BUDGET} - prev QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY page) = 1""",
    "text_raw": f"SELECT doc_id, string_agg(text, chr(10) || chr(12) || chr(10) ORDER BY page) AS text FROM ({_PAGES}) GROUP BY doc_id",
    "search_literal": r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
p AS (SELECT doc_id, (k - 1) // 10 AS page, string_agg(t, ' ' ORDER BY k) AS t FROM l GROUP BY ALL)
SELECT doc_id, CAST(sum(len(regexp_extract_all(t, '(?i)ÉT'))) AS BIGINT) AS total_matches FROM p GROUP BY doc_id HAVING sum(len(regexp_extract_all(t, '(?i)ÉT'))) > 0""",
    "search_regex": r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
p AS (SELECT doc_id, (k - 1) // 10 AS page, string_agg(t, ' ' ORDER BY k) AS t FROM l GROUP BY ALL)
SELECT doc_id, CAST(sum(len(regexp_extract_all(t, '[a-z]+ion[., ]'))) AS BIGINT) AS total_matches FROM p GROUP BY doc_id HAVING sum(len(regexp_extract_all(t, '[a-z]+ion[., ]'))) > 0""",
    "search_snippets": r"""
WITH p AS (SELECT conv_id AS doc_id, turn + 1 AS page, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations),
m AS (SELECT doc_id, page, t, string_split_regex(t, '(?i)the') AS g, regexp_extract_all(t, '(?i)the') AS h FROM p),
e AS (SELECT doc_id, page, t, unnest(h) AS hit, unnest(g[1:len(h)]) AS gap, generate_subscripts(h, 1) AS i FROM m WHERE len(h) > 0),
s AS (SELECT *, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, page ORDER BY i) AS BIGINT) AS stop FROM e),
r AS (SELECT *, stop - length(hit) AS start, row_number() OVER (PARTITION BY doc_id ORDER BY page, i) AS n FROM s)
SELECT doc_id, CAST(n AS BIGINT) AS n, CAST(page AS BIGINT) AS page, hit AS "match",
       substr(t, greatest(start - 20, 0) + 1, stop + 20 - greatest(start - 20, 0)) AS snippet FROM r WHERE n <= 1000""",
    "search_topk": r"""
WITH p AS (SELECT conv_id AS doc_id, turn + 1 AS page, regexp_extract_all(trim(regexp_replace(text, '\s+', ' ', 'g')), 'on') AS h FROM conversations),
e AS (SELECT doc_id, page, unnest(h) AS hit, generate_subscripts(h, 1) AS i FROM p WHERE len(h) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, i) AS n, count(*) OVER (PARTITION BY doc_id) AS total FROM e)
SELECT doc_id, CAST(n AS BIGINT) AS n, CAST(page AS BIGINT) AS page, hit AS "match", CAST(total AS BIGINT) AS total_matches FROM r WHERE n <= 5""",
    "pagespec_select": """
WITH p AS (SELECT conv_id AS doc_id, turn + 1 AS page, text FROM conversations),
t AS (SELECT doc_id, max(page) AS n FROM p GROUP BY doc_id HAVING max(page) >= 3),
k AS (SELECT doc_id, unnest(list_concat([3, 1, 3], list_reverse(generate_series(2, n)))) AS page,
             generate_subscripts(list_concat([3, 1, 3], list_reverse(generate_series(2, n))), 1) AS pos FROM t)
SELECT k.doc_id, CAST(pos AS BIGINT) AS pos, CAST(k.page AS BIGINT) AS page, text FROM k JOIN p ON p.doc_id = k.doc_id AND p.page = k.page""",
    "pagespec_odd_even": """
WITH t AS (SELECT conv_id AS doc_id, max(turn) + 1 AS n FROM conversations GROUP BY conv_id)
SELECT doc_id, array_to_string(list_concat(generate_series(1, n, 2), generate_series(2, n, 2)), ',') AS pages FROM t""",
    "info": f"""
WITH p AS (SELECT *, CASE WHEN role = 'system' THEN 842.0 ELSE 595.0 END AS w FROM ({_PAGES}))
SELECT doc_id, count(*) AS pages, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(arg_min(w, page) AS DOUBLE) AS width,
       CAST(842.0 AS DOUBLE) AS height, count(DISTINCT w) <= 1 AS uniform_page_size FROM p GROUP BY doc_id""",
    "entity_decode": """
SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(
    regexp_extract(html, '<title>([^<]*)</title>', 1) || ' &amp;lt; &#233;&#xE9; &nope; &copy &lt;b&gt;',
    '&quot;', '"'), '&apos;', ''''), '&nbsp;', chr(160)), '&#233;', 'é'), '&#xE9;', 'é'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS title
FROM pages""",
    "excerpts": r"""
SELECT doc_id, CASE WHEN length(text) > 40 THEN substr(regexp_replace(text, '[\x00-\x1f\x7f]', ' ', 'g'), 1, 40) || '…'
                    ELSE regexp_replace(text, '[\x00-\x1f\x7f]', ' ', 'g') END AS excerpt FROM documents""",
}
