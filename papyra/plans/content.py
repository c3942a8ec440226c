"""Queries of the operators on content: redaction, replacing, scanning, forms, images, signatures, layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import forms, images, layout, redact, scan, sign
from ..sources.corpus import document_lines, table

#: E-mail addresses, IPv4 addresses, long card-like numbers.
PERSONAL = [r"[a-z0-9._]+@[a-z0-9.-]+[a-z]", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", r"[0-9]{13,16}"]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = document_lines(spark, sf_dir)
    return lines.withColumn("page", (F.floor((F.col("line") - 1) / 10) + 1).cast("long")).withColumn("line", F.col("line").cast("long"))


def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that hold personal data, without it, and how much was removed; every result is searched again."""
    out = redact.redact(_lines(spark, sf_dir), PERSONAL, regex=True, case_sensitive=True)
    return out.where("removed > 0").select("doc_id", "line", "text", "removed")


def redact_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches before and after redaction, by document."""
    lines = _lines(spark, sf_dir)
    out = redact.redact(lines, PERSONAL, regex=True, case_sensitive=True)
    after = sum((T.count_matches("text", p) for p in T.any_pattern(PERSONAL, regex=True, case_sensitive=True)), F.lit(0).cast("long"))
    rows = out.groupBy("doc_id").agg(F.sum("removed").cast("long").alias("before"), F.sum(after).cast("long").alias("after"))
    return rows.where("before > 0")


def redact_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place that redaction would take."""
    out = redact.targets(_lines(spark, sf_dir), PERSONAL, regex=True, case_sensitive=True)
    return out.select("doc_id", "line", F.col("pattern").cast("long").alias("pattern"), "start", "match")


def replace_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with 'license' set anew, case ignored."""
    out = redact.replace_text(_lines(spark, sf_dir), "license", "$LICENCE\\1")
    return out.where("replacements > 0").select("doc_id", "line", "text", "replacements")


def replace_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses with the parts around the at sign exchanged."""
    out = redact.replace_text(_lines(spark, sf_dir), r"([a-z0-9._]+)@([a-z0-9.-]+[a-z])", "$2 at ${1}", regex=True, case_sensitive=True)
    return out.where("replacements > 0").select("doc_id", "line", "text", "replacements")


def replace_width_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much wider lines get in Helvetica, in 1/1000 em."""
    out = redact.replace_text(_lines(spark, sf_dir), "the", "WHICH", case_sensitive=True)
    return out.where("replacements > 0").select("doc_id", "line", "replacements", "width_change")


def annotate_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highlights that marking two words would add, by page."""
    return redact.count_targets(_lines(spark, sf_dir), ["loser", "license"])


def scan_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pages hold that a scan reports, by kind, with samples."""
    out = scan.report(scan.html_findings(table(spark, sf_dir, "pages")))
    return out.select("kind", "severity", "count", F.array_join("samples", "\n").alias("samples"))


def scan_page_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for every page."""
    out = scan.report(scan.html_findings(table(spark, sf_dir, "pages")), "doc_id")
    return out.select("doc_id", "kind", "severity", "count")


def scan_external_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of the pages' addresses, and how often each occurs."""
    hosts = table(spark, sf_dir, "pages").select(T.host("url").alias("host"), T.is_remote("url").alias("remote"))
    return hosts.groupBy("host", "remote").agg(F.count(F.lit(1)).alias("n"))


def scan_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' verdicts, where a toxic label is a high finding and low quality a low one."""
    labels = table(spark, sf_dir, "labels")
    toxic = labels.where("toxic = 1").select("doc_id", F.lit("toxic").alias("kind"), F.lit("high").alias("severity"))
    poor = labels.where("quality = 0").select("doc_id", F.lit("poor").alias("kind"), F.lit("low").alias("severity"))
    return scan.verdict(table(spark, sf_dir, "documents"), toxic.unionByName(poor))


def sanitize_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without scripts, handlers, embedded content and comments, checked, and what was removed."""
    out = scan.sanitize(table(spark, sf_dir, "pages"))
    return out.select(
        "page_id", F.length("html").cast("long").alias("n_chars"), F.md5("html").alias("html_md5"), *[F.col("removed")[g].alias(g) for g in scan.REMOVALS]
    )


def restated_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items against the whole documents of the same number: shared letters."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("stated"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("drawn"))
    return scan.restated(items.join(docs, "item_id"), key="item_id", stated="stated", drawn="drawn")


def file_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of attachments made up from parts: some first bytes, some extensions."""
    part = table(spark, sf_dir, "part").select("p_partkey")
    heads = ["4D5A9000", "7F454C46", "25504446", "504B0304", "D0CF11E0", "23212F62", "1F8B0800", "00000000", "CFFAEDFE", "52617221"]
    names = ["a.docx", "b.docm", "c.jar", "d.zip", "e.exe", "f.py", "g.HTML", "h", "i.tar.gz"]
    head = F.unhex(F.element_at(F.array(*map(F.lit, heads)), (F.pmod("p_partkey", F.lit(10)) + 1).cast("int")))
    name = F.element_at(F.array(*map(F.lit, names)), (F.pmod("p_partkey", F.lit(9)) + 1).cast("int"))
    kind = T.file_type(head, name)
    return part.select("p_partkey", kind["type"].alias("type"), kind["severity"].alias("severity"))


def forms_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as fields, their orders as widgets, the first by date showing the page."""
    fields = table(spark, sf_dir, "customer").select(F.lit(1).alias("doc_id"), F.col("c_custkey").alias("name"))
    widgets = table(spark, sf_dir, "orders").select(
        F.lit(1).alias("doc_id"), F.col("o_custkey").alias("name"), F.col("o_orderkey").alias("pos"), F.pmod("o_orderkey", F.lit(97)).alias("page")
    )
    return forms.list_fields(fields, widgets).select("name", "page")


def fill_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filling in customers' segments, names and yes or no, with some values that cannot be."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    kind = F.element_at(F.array(F.lit("text"), F.lit("checkbox"), F.lit("choice"), F.lit("signature")), (F.pmod(k, F.lit(4)) + 1).cast("int"))
    options = F.when(F.pmod(k, F.lit(4)) == 1, F.array(F.lit("Yes"))).when(F.pmod(k, F.lit(4)) == 2, F.array(F.lit("BUILDING"), F.lit("MACHINERY"))).otherwise(F.array().cast("array<string>"))
    fields = c.select(F.lit(1).alias("doc_id"), k.alias("name"), kind.alias("type"), options.alias("options"), (F.pmod(k, F.lit(11)) == 0).alias("read_only")).where("name % 13 <> 0")
    answers = F.element_at(F.array(F.lit(" TRUE"), F.lit("off"), F.lit("Yes"), F.lit("maybe")), (F.pmod(k, F.lit(16)) / 4 + 1).cast("int"))
    value = F.when(F.pmod(k, F.lit(4)) == 1, answers).otherwise(F.col("c_mktsegment"))
    values = c.select(F.lit(1).alias("doc_id"), k.alias("name"), value.alias("value"))
    return forms.plan_fill(fields, values).select("name", "value", "new_value", "error")


def truthy_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order priorities and states read as yes or no."""
    words = ["x", "Yes ", "OFF", "", "maybe", "1", "unchecked"]
    value = F.element_at(F.array(*map(F.lit, words)), (F.pmod("o_orderkey", F.lit(7)) + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.truthy(value).alias("answer"))


def images_first_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as images on the pages of their orders: the first page of each, and its file name."""
    drawn = table(spark, sf_dir, "lineitem").select(
        F.lit(1).alias("doc_id"), F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("draw_pos"), F.col("l_partkey").alias("key")
    )
    out = images.first_owner(drawn)
    return out.select("key", "page", images.image_file(F.col("page"), F.col("n"), F.lit("png")).alias("file"))


def signature_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their first ten bytes and the rest after a gap signed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    size = F.octet_length("content").cast("long")
    ranged = docs.withColumns(
        {"a": F.lit(0).cast("long"), "b": F.least(F.lit(10), size).cast("long"), "c": F.least(F.lit(30), size).cast("long")}
    ).withColumn("d", F.when(F.pmod("doc_id", F.lit(3)) == 0, F.greatest(size - F.col("c") - 5, F.lit(0))).otherwise(size - F.col("c")))
    return sign.check_ranges(ranged).select("doc_id", "range_sound", "covers_whole", "digest")


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as words: an order is a page, the quantity the place along, the line number the place down."""
    height = F.col("l_linenumber") * 4.0 + F.pmod("l_suppkey", F.lit(3))
    x0 = F.col("l_quantity") * 10 + F.col("l_linenumber") / 8.0
    return table(spark, sf_dir, "lineitem").select(
        F.floor(F.col("l_orderkey") / 4).cast("long").alias("doc_id"),
        F.lit(1).cast("long").alias("page"),
        (F.col("l_partkey") * 100000 + F.col("l_orderkey")).alias("seq"),
        F.concat(F.lit("w"), F.col("l_partkey")).alias("text"),
        x0.alias("x0"),
        height.alias("y0"),
        (x0 + 20).alias("x1"),
        (height + 10).alias("y1"),
        F.lit(10.0).alias("size"),
    )


def layout_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of such pages with their boxes; words stand closer than lines are apart, so the first of a line decides."""
    out = layout.lines(_words(spark, sf_dir))
    return out.select("doc_id", F.col("line").cast("long").alias("line"), F.length("text").cast("long").alias("n_chars"), "x0", "y0", "x1", "y1")


def layout_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the lines."""
    out = layout.segments(_words(spark, sf_dir))
    return out.select("doc_id", F.col("line").cast("long").alias("line"), F.col("cell").cast("long").alias("cell"), "x0", "x1")


def cluster_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retail prices of each size of parts, merged where they are within two of the running mean."""
    sorted_prices = F.array_sort(F.collect_list("p_retailprice"))
    grouped = table(spark, sf_dir, "part").groupBy("p_size").agg(sorted_prices.alias("v"))
    return grouped.select(F.col("p_size").cast("long").alias("p_size"), F.posexplode(layout.cluster(F.col("v"), 2.0)).alias("k", "mean")).select(
        "p_size", F.col("k").cast("long").alias("k"), F.round("mean", 6).alias("mean")
    )


def ruled_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items in a grid over quantity and discount, suppliers' nations as pages: words in each cell."""
    words = table(spark, sf_dir, "lineitem").select(
        F.lit("items").alias("doc_id"), F.pmod("l_suppkey", F.lit(25)).cast("int").alias("page"), F.col("l_quantity").alias("x0"), F.col("l_quantity").alias("x1"),
        F.col("l_discount").alias("y0"), F.col("l_discount").alias("y1"),
    )
    edges = table(spark, sf_dir, "nation").select(
        F.lit("items").alias("doc_id"), F.col("n_nationkey").cast("int").alias("page"),
        F.array(*[F.lit(float(x)) for x in (5, 10, 20, 40, 50)]).alias("xs"), F.array(*[F.lit(y) for y in (0.0, 0.02, 0.05, 0.1)]).alias("ys"),
    )
    counted = layout.cells_of_grid(words, edges).groupBy("page", "row", "column").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("page").cast("long").alias("page"), F.col("row").cast("long").alias("row"), F.col("column").cast("long").alias("column"), "n")


def table_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as table rows in Markdown, some with bars in them."""
    cells = F.array(F.col("n_name"), F.concat(F.lit("a|b"), F.col("n_regionkey")), F.lit(None).cast("string"))
    return table(spark, sf_dir, "nation").select("n_nationkey", layout.markdown_row(cells).alias("line"))


def table_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as table rows in CSV, some quoted."""
    cells = F.array(F.col("n_name"), F.concat(F.lit('say "'), F.col("n_regionkey"), F.lit('", so')), F.lit(None).cast("string"), F.lit("x\ny"))
    return table(spark, sf_dir, "nation").select("n_nationkey", layout.csv_row(cells).alias("line"))


def ocr_tsv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as the rows of an OCR table: every third opens a line, some words are blank."""
    k = F.col("l_linenumber") + F.pmod("l_orderkey", F.lit(3))
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"),
        (F.col("l_linenumber") * 10_000_000 + F.col("l_partkey") * 1000 + F.col("l_suppkey") % 1000).cast("long").alias("pos"),
        F.when(F.pmod(k, F.lit(3)) == 0, 4).otherwise(5).alias("level"),
        F.when(F.pmod("l_partkey", F.lit(5)) == 0, F.lit("  ")).otherwise(F.concat(F.lit(" w"), F.col("l_partkey"))).alias("text"),
        F.col("l_quantity").cast("long").alias("left"),
        F.col("l_linenumber").cast("long").alias("top"),
        F.lit(7).cast("long").alias("width"),
        F.lit(3).cast("long").alias("height"),
    )
    out = layout.tsv_lines(rows)
    return out.select("doc_id", F.col("line").cast("long").alias("line"), "text", "x0", "y0", "x1", "y1")


def pdf_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts as PDF strings, and whether the standard fonts can show the documents of their number."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("("), F.col("p_name"), F.lit(")\\")).alias("s"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("p_partkey"), T.is_winansi(F.replace("text", F.lit("\n"), F.lit(" "))).alias("winansi"))
    return part.join(docs, "p_partkey").select("p_partkey", T.pdf_literal("s").alias("literal"), "winansi")


def progress_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a step as progress: how many are done, of how many."""
    from pyspark.sql import Window

    step = Window.partitionBy("event_type", "user_id")
    done = F.row_number().over(step.orderBy("ts", "event_id")).cast("long")
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("step"), done.alias("done"), F.count(F.lit(1)).over(step).alias("total"))


QUERIES = {
    f.__name__: f
    for f in (
        redact_text, redact_verified, redact_targets, replace_literal, replace_capture, replace_width_change, annotate_targets,
        scan_findings, scan_page_report, scan_external_hosts, scan_verdict, sanitize_pages, restated_overlap, file_types,
        forms_list, fill_validate, truthy_values, images_first_owner, signature_digest, layout_lines, layout_segments, cluster_1d,
        ruled_cells, table_markdown, table_csv, ocr_tsv_lines, pdf_strings, progress_events,
    )
}

_LINES = """
SELECT doc_id, unnest(string_split(text, chr(10))) AS text, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS BIGINT) AS line FROM documents"""
_REMOVED = " + ".join(f"len(regexp_extract_all(text, '{p}'))" for p in PERSONAL)
_STRUCK = "text"
for _p in PERSONAL:
    _STRUCK = f"regexp_replace({_STRUCK}, '{_p}', '', 'g')"


def _widths(column: str) -> str:
    by_width: dict[int, str] = {}
    for k, width in enumerate(T.HELVETICA):
        by_width[width] = by_width.get(width, "") + chr(32 + k)
    parts = [f"length({column}) * {T.UNKNOWN_WIDTH}"]
    for width, letters in by_width.items():
        if width != T.UNKNOWN_WIDTH:
            quoted = letters.replace("'", "''")
            parts.append(f"(length({column}) - length(translate({column}, '{quoted}', ''))) * {width - T.UNKNOWN_WIDTH}")
    return " + ".join(parts)


_FINDINGS = "\nUNION ALL\n".join(
    f"SELECT page_id AS doc_id, '{kind}' AS kind, {scan.SEVERITIES.index(severity) + 1} AS r, trim(unnest(regexp_extract_all(html, '{java.replace(chr(39), chr(39) * 2)}', {group})), ' ') AS s FROM pages"
    for kind, severity, java, group in scan.HTML_RULES
)
_LABEL = "CASE max(r) WHEN 1 THEN 'info' WHEN 2 THEN 'low' WHEN 3 THEN 'medium' WHEN 4 THEN 'high' END"
_EXCERPT = r"CASE WHEN length(s) > 200 THEN substr(regexp_replace(s, '[\x00-\x1f\x7f]', ' ', 'g'), 1, 200) || '…' ELSE regexp_replace(s, '[\x00-\x1f\x7f]', ' ', 'g') END"
_WORDS = """
SELECT l_orderkey // 4 AS doc_id, l_partkey * 100000 + l_orderkey AS seq, 'w' || l_partkey AS text, l_quantity * 10 + l_linenumber / 8.0::DOUBLE AS x0,
       l_linenumber * 4.0::DOUBLE + l_suppkey % 3 AS y0 FROM lineitem"""

#: Words by lines, one after the other from the top: the first word of a line is what the next ones are measured against.
_WORD_LINES = f"""WITH RECURSIVE v AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY y0, seq) AS i FROM ({_WORDS})),
f AS (SELECT doc_id, i, y0 AS anchor, 1 AS line FROM v WHERE i = 1
  UNION ALL
  SELECT v.doc_id, v.i, CASE WHEN abs(f.anchor - v.y0) < 5 THEN f.anchor ELSE v.y0 END, CASE WHEN abs(f.anchor - v.y0) < 5 THEN f.line ELSE f.line + 1 END
  FROM f JOIN v ON v.doc_id = f.doc_id AND v.i = f.i + 1),
l AS (SELECT v.*, f.line FROM v JOIN f ON v.doc_id = f.doc_id AND v.i = f.i)"""

SQL = {
    "redact_text": f"WITH l AS ({_LINES}) SELECT doc_id, line, {_STRUCK} AS text, CAST({_REMOVED} AS BIGINT) AS removed FROM l WHERE {_REMOVED} > 0",
    "redact_verified": f"""
WITH l AS ({_LINES}), a AS (SELECT doc_id, {_REMOVED} AS n, {_STRUCK} AS text FROM l)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS before, CAST(sum({_REMOVED}) AS BIGINT) AS after FROM a GROUP BY doc_id HAVING sum(n) > 0""",
    "redact_targets": "WITH l AS (" + _LINES + "), m AS ("
    + " UNION ALL ".join(f"SELECT doc_id, line, {k + 1} AS pattern, string_split_regex(text, '{p}') AS g, regexp_extract_all(text, '{p}') AS h FROM l" for k, p in enumerate(PERSONAL))
    + """), e AS (SELECT doc_id, line, pattern, unnest(h) AS hit, unnest(g[1:len(h)]) AS gap, generate_subscripts(h, 1) AS i FROM m WHERE len(h) > 0)
SELECT doc_id, line, CAST(pattern AS BIGINT) AS pattern,
       CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, line, pattern ORDER BY i) - length(hit) AS BIGINT) AS start, hit AS "match" FROM e""",
    "replace_literal": f"""
WITH l AS ({_LINES}) SELECT doc_id, line, regexp_replace(text, '(?i)license', '$LICENCE\\\\1', 'g') AS text,
       CAST(len(regexp_extract_all(text, '(?i)license')) AS BIGINT) AS replacements FROM l WHERE regexp_matches(text, '(?i)license')""",
    "replace_capture": f"""
WITH l AS ({_LINES}) SELECT doc_id, line, regexp_replace(text, '([a-z0-9._]+)@([a-z0-9.-]+[a-z])', '\\2 at \\1', 'g') AS text,
       CAST(len(regexp_extract_all(text, '([a-z0-9._]+)@([a-z0-9.-]+[a-z])')) AS BIGINT) AS replacements
FROM l WHERE regexp_matches(text, '([a-z0-9._]+)@([a-z0-9.-]+[a-z])')""",
    "replace_width_change": f"""
WITH l AS ({_LINES}), r AS (SELECT doc_id, line, text, replace(text, 'the', 'WHICH') AS new, len(regexp_extract_all(text, 'the')) AS n FROM l WHERE contains(text, 'the'))
SELECT doc_id, line, CAST(n AS BIGINT) AS replacements, CAST(({_widths("new")}) - ({_widths("text")}) AS BIGINT) AS width_change FROM r""",
    "annotate_targets": f"""
WITH l AS ({_LINES}), c AS (SELECT doc_id, (line - 1) // 10 + 1 AS page, len(regexp_extract_all(text, '(?i)loser')) + len(regexp_extract_all(text, '(?i)license')) AS n FROM l)
SELECT doc_id, page, CAST(sum(n) AS BIGINT) AS added FROM c GROUP BY ALL HAVING sum(n) > 0""",
    "scan_findings": f"""
WITH f AS ({_FINDINGS}), x AS (SELECT kind, r, {_EXCERPT} AS s FROM f),
d AS (SELECT DISTINCT kind, s FROM x), k AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY s) AS n FROM d),
j AS (SELECT kind, string_agg(s, chr(10) ORDER BY s) AS samples FROM k WHERE n <= 20 GROUP BY kind)
SELECT x.kind, {_LABEL} AS severity, count(*) AS count, any_value(samples) AS samples FROM x JOIN j ON j.kind = x.kind GROUP BY x.kind""",
    "scan_page_report": f"WITH f AS ({_FINDINGS}) SELECT doc_id, kind, {_LABEL} AS severity, count(*) AS count FROM f GROUP BY ALL",
    "scan_external_hosts": """
WITH u AS (SELECT lower(url) AS u, url FROM pages),
h AS (SELECT regexp_extract(CASE WHEN contains(u, '://') THEN substr(u, position('://' IN u) + 3) ELSE u END, '^[^/?#]*') AS host,
             starts_with(url, '\\\\') OR starts_with(url, '//') OR contains(url, '://') AS remote FROM u)
SELECT host, remote, count(*) AS n FROM h GROUP BY ALL""",
    "scan_verdict": """
WITH f AS (SELECT doc_id, 4 AS r FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 2 FROM labels WHERE quality = 0),
g AS (SELECT doc_id, max(r) AS r, count(*) AS n FROM f GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN n > 0 THEN 'findings' ELSE 'nothing found' END AS verdict, CASE r WHEN 4 THEN 'high' WHEN 2 THEN 'low' END AS highest_severity,
       CAST(coalesce(n, 0) AS BIGINT) AS findings FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id""",
    "sanitize_pages": r"""
WITH a AS (SELECT page_id, html, len(regexp_extract_all(html, '(?is)<script\b[^>]*>.*?</script\s*>')) AS n1,
                  regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>', '', 'g') AS h1 FROM pages),
b AS (SELECT *, len(regexp_extract_all(h1, '(?s)<!--.*?-->')) AS n2, regexp_replace(h1, '(?s)<!--.*?-->', '', 'g') AS h2 FROM a)
SELECT page_id, CAST(length(h2) AS BIGINT) AS n_chars, md5(h2) AS html_md5, CAST(n1 AS BIGINT) AS javascript, CAST(0 AS BIGINT) AS actions,
       CAST(0 AS BIGINT) AS attachments, CAST(n2 AS BIGINT) AS hidden FROM b""",
    "restated_overlap": r"""
WITH p AS (SELECT item_id, regexp_replace(lower(b.text), '[^\p{L}\p{N}]', '', 'g') AS s, regexp_replace(lower(d.text), '[^\p{L}\p{N}]', '', 'g') AS t
           FROM benchmark b JOIN documents d ON d.doc_id = b.item_id),
s AS (SELECT item_id, unnest(string_split(s, '')) AS c FROM p), t AS (SELECT item_id, unnest(string_split(t, '')) AS c FROM p),
sc AS (SELECT item_id, c, count(*) AS n FROM s WHERE c <> '' GROUP BY ALL), tc AS (SELECT item_id, c, count(*) AS m FROM t WHERE c <> '' GROUP BY ALL)
SELECT sc.item_id, CAST(sum(n) AS BIGINT) AS n_stated, CAST(sum(least(n, coalesce(m, 0))) AS BIGINT) AS n_shared,
       sum(n) >= 3 AND sum(least(n, coalesce(m, 0))) * 2 < sum(n) AS restated
FROM sc LEFT JOIN tc ON tc.item_id = sc.item_id AND tc.c = sc.c GROUP BY sc.item_id""",
    "file_types": """
WITH p AS (SELECT p_partkey, ['4D5A9000', '7F454C46', '25504446', '504B0304', 'D0CF11E0', '23212F62', '1F8B0800', '00000000', 'CFFAEDFE', '52617221'][p_partkey % 10 + 1] AS h,
                  ['docx', 'docm', 'jar', 'zip', 'exe', 'py', 'html', '', 'gz'][p_partkey % 9 + 1] AS x FROM part),
k AS (SELECT p_partkey, CASE
  WHEN h IN ('4D5A9000', '7F454C46', 'CFFAEDFE') THEN 'executable/high' WHEN h = '23212F62' THEN 'script/high' WHEN h = '25504446' THEN 'pdf/medium'
  WHEN h = 'D0CF11E0' THEN 'office document (old format)/medium'
  WHEN h = '504B0304' THEN CASE x WHEN 'docm' THEN 'office document with macros/high' WHEN 'docx' THEN 'office document/low' WHEN 'jar' THEN 'executable/high' ELSE 'archive/medium' END
  WHEN h IN ('1F8B0800', '52617221') THEN 'archive/medium'
  WHEN x IN ('exe', 'jar') THEN 'executable/high' WHEN x = 'py' THEN 'script/high' WHEN x = 'html' THEN 'web page/medium' ELSE 'data/low' END AS t FROM p)
SELECT p_partkey, split_part(t, '/', 1) AS type, split_part(t, '/', 2) AS severity FROM k""",
    "forms_list": """
SELECT c_custkey AS name, arg_min(o_orderkey % 97, o_orderkey) AS page FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""",
    "fill_validate": """
WITH v AS (SELECT c_custkey AS k, c_custkey % 4 AS t, CASE WHEN c_custkey % 4 = 1 THEN [' TRUE', 'off', 'Yes', 'maybe'][c_custkey % 16 // 4 + 1] ELSE c_mktsegment END AS value FROM customer),
n AS (SELECT *, CASE t WHEN 0 THEN value WHEN 1 THEN CASE value WHEN 'Yes' THEN 'Yes' WHEN ' TRUE' THEN 'Yes' WHEN 'off' THEN 'Off' END
                       WHEN 2 THEN CASE WHEN value IN ('BUILDING', 'MACHINERY') THEN value END END AS new FROM v),
e AS (SELECT *, CASE WHEN k % 13 = 0 THEN 'no field ' || k WHEN k % 11 = 0 THEN k || ' is read-only' WHEN t = 3 THEN k || ' cannot be filled in'
                     WHEN new IS NULL THEN k || ' takes one of: ' || CASE t WHEN 1 THEN 'Yes' WHEN 2 THEN 'BUILDING, MACHINERY' ELSE '' END END AS error FROM n)
SELECT k AS name, value, CASE WHEN error IS NULL THEN new END AS new_value, error FROM e""",
    "truthy_values": """
SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN false WHEN 5 THEN true WHEN 6 THEN false END AS answer FROM orders""",
    "images_first_owner": """
WITH f AS (SELECT l_partkey AS key, min((l_orderkey, l_linenumber)) AS p FROM lineitem GROUP BY l_partkey),
g AS (SELECT key, p[1] AS page, p[2] AS pos FROM f)
SELECT key, page, printf('page-%04d-img-%02d.png', page, row_number() OVER (PARTITION BY page ORDER BY pos, key)) AS file FROM g""",
    "signature_digest": """
WITH d AS (SELECT doc_id, encode(text) AS x, strlen(text) AS n FROM documents),
r AS (SELECT doc_id, x, n, least(10, n) AS b, least(30, n) AS c FROM d),
e AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN greatest(n - c - 5, 0) ELSE n - c END AS d FROM r)
SELECT doc_id, true AS range_sound, c + d = n AS covers_whole,
       sha256(unhex(substr(hex(x), 1, CAST(2 * b AS BIGINT)) || substr(hex(x), CAST(2 * c + 1 AS BIGINT), CAST(2 * d AS BIGINT)))) AS digest FROM e""",
    "layout_lines": f"""
{_WORD_LINES}
SELECT doc_id, CAST(line AS BIGINT) AS line, CAST(sum(length(text)) + count(*) - 1 AS BIGINT) AS n_chars, round(min(x0), 1) AS x0, round(min(y0), 1) AS y0,
       round(max(x0 + 20), 1) AS x1, round(max(y0 + 10), 1) AS y1 FROM l GROUP BY doc_id, line""",
    "layout_segments": f"""
{_WORD_LINES},
g AS (SELECT *, CASE WHEN x0 - lag(x0 + 20) OVER (PARTITION BY doc_id, line ORDER BY x0, text) < 9.0 THEN 0 ELSE 1 END AS fresh FROM l),
c AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, line ORDER BY x0, text ROWS UNBOUNDED PRECEDING) AS cell FROM g)
SELECT doc_id, CAST(line AS BIGINT) AS line, CAST(cell AS BIGINT) AS cell, min(x0) AS x0, max(x0 + 20) AS x1 FROM c GROUP BY doc_id, line, cell""",
    "cluster_1d": """
WITH RECURSIVE v AS (SELECT p_size, p_retailprice AS v, row_number() OVER (PARTITION BY p_size ORDER BY p_retailprice) AS i FROM part),
f AS (SELECT p_size, i, v AS m, 1 AS n, 0 AS k FROM v WHERE i = 1
  UNION ALL
  SELECT v.p_size, v.i, CASE WHEN v.v - f.m <= 2.0 THEN (f.m * f.n + v.v) / (f.n + 1) ELSE v.v END,
         CASE WHEN v.v - f.m <= 2.0 THEN f.n + 1 ELSE 1 END, CASE WHEN v.v - f.m <= 2.0 THEN f.k ELSE f.k + 1 END
  FROM f JOIN v ON v.p_size = f.p_size AND v.i = f.i + 1)
SELECT CAST(p_size AS BIGINT) AS p_size, CAST(k AS BIGINT) AS k, round(arg_max(m, i), 6) AS mean FROM f GROUP BY p_size, k""",
    "ruled_cells": """
WITH x AS (SELECT * FROM (VALUES (1, 5, 10), (2, 10, 20), (3, 20, 40), (4, 40, 50)) t(c, a, b)),
y AS (SELECT * FROM (VALUES (1, 0.0::DOUBLE, 0.02::DOUBLE), (2, 0.02::DOUBLE, 0.05::DOUBLE), (3, 0.05::DOUBLE, 0.1::DOUBLE)) t(r, a, b))
SELECT l_suppkey % 25 AS page, CAST(y.r AS BIGINT) AS row, CAST(x.c AS BIGINT) AS "column", count(*) AS n FROM lineitem
JOIN x ON l_quantity >= x.a AND l_quantity < x.b JOIN y ON l_discount >= y.a AND l_discount < y.b GROUP BY ALL""",
    "table_markdown": "SELECT n_nationkey, '| ' || n_name || ' | a\\|b' || n_regionkey || ' |  |' AS line FROM nation",
    "table_csv": """SELECT n_nationkey, n_name || ',"say ""' || n_regionkey || '"", so",,"x' || chr(10) || 'y"' AS line FROM nation""",
    "ocr_tsv_lines": """
WITH r AS (SELECT l_orderkey AS doc_id, l_linenumber * 10000000 + l_partkey * 1000 + l_suppkey % 1000 AS pos,
                  CASE WHEN (l_linenumber + l_orderkey % 3) % 3 = 0 THEN 4 ELSE 5 END AS level, CASE WHEN l_partkey % 5 = 0 THEN '  ' ELSE ' w' || l_partkey END AS text,
                  CAST(l_quantity AS BIGINT) AS x, CAST(l_linenumber AS BIGINT) AS y FROM lineitem),
n AS (SELECT *, sum(CASE WHEN level = 4 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS line FROM r)
SELECT doc_id, CAST(line AS BIGINT) AS line, string_agg(trim(text), ' ' ORDER BY pos, text) AS text, min(x) AS x0, min(y) AS y0, max(x + 7) AS x1, max(y + 3) AS y1
FROM n WHERE level = 5 AND trim(text) <> '' AND line > 0 GROUP BY doc_id, line""",
    "pdf_strings": r"""
SELECT p_partkey, '(' || regexp_replace('(' || p_name || ')\', '([()\\])', '\\\1', 'g') || ')' AS literal,
       regexp_full_match(replace(text, chr(10), ' '), '[ -~\x{A0}-\x{FF}]*') AS winansi FROM part JOIN documents ON doc_id = p_partkey""",
    "progress_events": """
SELECT event_id, event_type AS step, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS done,
       count(*) OVER (PARTITION BY event_type, user_id) AS total FROM events""",
}
