"""Queries over PDF files that are made from the given tables, read back, changed and read again.

The SQL never sees a file: it says from the tables alone what must come out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import commands as C
from ..operators import inspect, read
from ..sources import files as S
from ..sources.pdf_create import lines_file
from ..sources.corpus import table
from ..sources.pdf import Name, Ref, Stream
from ..sources.pdf_writer import Writer, encode_text, serialise, standard_font, text_width

WORDS_A_LINE = 12
HIDDEN = "hidden words"


def _made(rows: DataFrame, make: Callable[[dict[str, Any]], bytes]) -> DataFrame:
    """A file for each row: (doc_id, content).

    Rows are small beside the work that a file takes, so they are dealt to all cores and not by their bytes.
    """
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pydict({"doc_id": [str(row["doc_id"])], "content": [make(row)]})

    return rows.repartition(tasks, F.xxhash64("doc_id")).mapInArrow(run, "doc_id string, content binary")


def _lines(text: str | None) -> list[str]:
    words = (text or "").split()
    return [" ".join(words[k : k + WORDS_A_LINE]) for k in range(0, len(words), WORDS_A_LINE)] or [""]


def _talk(row: dict[str, Any], **more: Any) -> bytes:
    turns = row["turns"]
    pages = [_lines(t["text"]) for t in turns]
    return lines_file(pages, title=f"Conversation {row['doc_id']}", outline=[(1, t["role"], n) for n, t in enumerate(turns, 1)], **more)


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.struct("turn", "role", "text")
    return table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as files, a page for each turn, twelve words a line, roles as bookmarks."""
    return _made(_turns(spark, sf_dir), _talk)


def pdf_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of the files."""
    return C.info(talks(spark, sf_dir)).select("doc_id", "pages", "width", "height", "uniform_page_size", F.col("metadata")["title"].alias("title"), "outline_entries", "form_fields", "encrypted")


def pdf_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of every page."""
    return C.text(talks(spark, sf_dir)).select("doc_id", "page", "text", "truncated")


def pdf_text_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of the pages from the last to the first, 700 characters a file."""
    return C.text(talks(spark, sf_dir), pages="last-1", max_chars=700).select("doc_id", F.col("pos").cast("long").alias("pos"), "page", "text", "truncated")


def pdf_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of a phrase's beginning, across line breaks."""
    return read.search_totals(S.parse(talks(spark, sf_dir), "pages").select("doc_id", "page", "text"), "en ")


def pdf_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their places."""
    return C.layout(talks(spark, sf_dir)).select("doc_id", "page", F.col("line").cast("long").alias("line"), "text", "x0", "y0", "y1", "size", "font")


def pdf_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and their letters by page."""
    words = C.layout(talks(spark, sf_dir), level="words")
    return words.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n_words"), F.sum(F.length("text")).cast("long").alias("n_chars"), F.min("x0").alias("x0"))


def pdf_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookmarks."""
    return C.outline(talks(spark, sf_dir))


def pdf_pages_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last page, then the first, and the bookmarks that are left."""
    kept = C.pages(talks(spark, sf_dir), keep="last,1")
    marks = C.outline(kept).groupBy(F.col("doc_id").alias("d")).agg(F.count(F.lit(1)).alias("marks"))
    text = C.text(kept)
    return text.join(marks, F.col("doc_id") == F.col("d")).select("doc_id", "page", "text", "marks")


def pdf_pages_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files without their first page; one that would be empty has an error."""
    done = C.pages(talks(spark, sf_dir), delete="1")
    facts = C.info(done.where("content is not null")).select(F.col("doc_id").alias("d"), "pages")
    return done.join(facts, F.col("doc_id") == F.col("d"), "left").select("doc_id", "pages", "error")


def pdf_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of two pages."""
    parts = C.split(talks(spark, sf_dir), every=2)
    pages = C.info(parts.select(F.col("file").alias("doc_id"), "content")).select(F.col("doc_id").alias("f"), F.col("pages").alias("n"))
    return parts.join(pages, F.col("file") == F.col("f")).select("doc_id", F.col("part").cast("long").alias("part"), "file", F.array_join(F.col("source_pages").cast("array<string>"), ",").alias("source_pages"), "n")


def pdf_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten files at a time put together."""
    files = talks(spark, sf_dir).withColumn("pos", F.col("doc_id").cast("long")).withColumn("merge_id", F.floor(F.col("pos") / 10).cast("string"))
    return C.text(C.merge(files)).select("doc_id", "page", "text")


def pdf_rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages turned, one named twice, and their size as seen."""
    turned = C.rotate(talks(spark, sf_dir), angle=90, pages="1,1,last")
    return S.parse(turned, "pages").select("doc_id", "page", "rotation", "width")


def pdf_set_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new subject, no title."""
    done = C.set_meta(talks(spark, sf_dir), title="", subject="Zażółć gęślą")
    return C.info(done).select("doc_id", F.col("metadata")["title"].alias("title"), F.col("metadata")["subject"].alias("subject"))


def pdf_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page numbers at the foot of every page."""
    done = C.stamp(talks(spark, sf_dir), text="{page}/{pages}", position="footer")
    lines = C.layout(done)
    last = lines.groupBy("doc_id", "page").agg(F.max_by("text", "line").alias("stamp"), F.count(F.lit(1)).alias("n_lines"))
    return last


def pdf_annotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highlights over every occurrence of some letters, read back by page."""
    done = C.annotate(talks(spark, sf_dir), texts=("en",), case_sensitive=True, comment="found", author="tester")
    marks = C.annotations(done).where("type = 'highlight' and comment = 'found' and author = 'tester'")
    return marks.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("added"))


def pdf_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters taken out of all pages: how many matches, and how many are left."""
    done = C.redact(talks(spark, sf_dir), texts=("en",), case_sensitive=True).where("content is not null")
    left = S.parse(done, "words").groupBy(F.col("doc_id").alias("d")).agg(F.sum(F.regexp_count("text", F.lit("en"))).cast("long").alias("left"))
    matches = F.get_json_object("report", "$.text_matches").cast("long").alias("matches")
    return done.join(left, F.col("doc_id") == F.col("d"), "left").select("doc_id", matches, F.coalesce("left", F.lit(0)).cast("long").alias("left"))


def pdf_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters replaced by wider ones, in place."""
    done = C.replace(talks(spark, sf_dir), "en", "WM", case_sensitive=True).where("content is not null")
    return C.text(done).select("doc_id", "page", "text")


def pdf_compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether files get smaller, with the text they had."""
    done = C.compress(talks(spark, sf_dir))
    smaller = F.get_json_object("report", "$.rewritten").cast("boolean").alias("rewritten")
    facts = done.select("doc_id", smaller, F.get_json_object("report", "$.unused_objects_removed").cast("long").alias("unused"))
    chars = S.parse(done, "pages").groupBy(F.col("doc_id").alias("d")).agg(F.sum(F.length("text")).cast("long").alias("chars"))
    return facts.join(chars, F.col("doc_id") == F.col("d")).drop("d")


def pdf_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose end is cut off are rebuilt and read the same."""
    cut = talks(spark, sf_dir).withColumn("content", F.expr("substring(content, 1, octet_length(content) - 60)"))
    return C.info(cut).select("doc_id", "repaired", "pages", "outline_entries")


def pdf_hidden_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invisible words on the pages of one side of a conversation; pages are as wide as their lines, so no others leave the page."""

    def make(row: dict[str, Any]) -> bytes:
        extra = b"BT 3 Tr /F1 10 Tf 1 0 0 1 72 30 Tm %s Tj ET\n" % serialise(HIDDEN.encode())
        return _talk(row, drawing={n: extra for n, t in enumerate(row["turns"], 1) if t["role"] == "user"}, widen=True)

    found = inspect.hidden_text(_made(_turns(spark, sf_dir), make))
    return found.select("doc_id", "characters", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"))


# --- links, forms, images, active content --------------------------------------------------------------------------


def pdf_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as files with a link to their address."""
    make = lambda row: lines_file([["link"]], links=[(1, [72.0, 72.0, 200.0, 84.0], row["url"])])
    files = _made(table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url"), make)
    return C.annotations(files).select("doc_id", "page", "type", F.array_join(F.col("rect").cast("array<string>"), ",").alias("rect"), "url")


def _form(row: dict[str, Any]) -> bytes:
    """A nation's file: a text field for each customer, and one check box."""
    out = Writer()
    root, tree, page = out.add(), out.add(), out.add()
    font = out.add(standard_font())
    fields = []
    for k, c in enumerate(row["customers"] or []):
        box = [72.0, 700.0 - 20 * (k % 30), 300.0, 715.0 - 20 * (k % 30)]
        fields.append(out.add({"Type": Name("Annot"), "Subtype": Name("Widget"), "FT": Name("Tx"), "T": b"c%d" % c["key"], "V": encode_text(c["name"]), "Rect": box, "Ff": c["key"] % 2}))
    look = {"N": {"Yes": out.add(Stream({"Subtype": Name("Form")}, b"")), "Off": out.add(Stream({"Subtype": Name("Form")}, b""))}}
    fields.append(out.add({"Type": Name("Annot"), "Subtype": Name("Widget"), "FT": Name("Btn"), "T": b"agree", "AP": look, "Rect": [400, 700, 412, 712]}))
    out.set(page, {"Type": Name("Page"), "Parent": tree, "MediaBox": [0, 0, 612, 792], "Annots": list(fields), "Resources": {}})
    out.set(tree, {"Type": Name("Pages"), "Kids": [page], "Count": 1})
    out.set(root, {"Type": Name("Catalog"), "Pages": tree, "AcroForm": {"Fields": fields, "DR": {"Font": {"Helv": font}}}})
    return out.finish(root)


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with their customers: (doc_id, name, customers)."""
    customer = F.struct(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    own = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.array_sort(F.collect_list(customer)).alias("customers"))
    return table(spark, sf_dir, "nation").join(own, F.col("n_nationkey") == F.col("k"), "left").select(F.col("n_nationkey").alias("doc_id"), F.col("n_name").alias("name"), "customers")


def _with_orphans(row: dict[str, Any]) -> bytes:
    """A nation's file with objects that nothing refers to: the number of its customers modulo seven, each a link to the next."""
    out = Writer()
    root, tree = out.add(), out.add()
    orphans = [out.add() for _ in range(len(row["customers"] or []) % 7)]
    for k, ref in enumerate(orphans):
        out.set(ref, {"Next": orphans[(k + 1) % len(orphans)], "Up": tree})
    out.set(tree, {"Type": Name("Pages"), "Kids": [out.add({"Type": Name("Page"), "Parent": tree, "MediaBox": [0, 0, 9, 9]})], "Count": 1})
    out.set(root, {"Type": Name("Catalog"), "Pages": tree})
    return out.finish(root)


def pdf_unused_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects that nothing leads to, and what writing the file anew says it left out."""
    files = _made(nations(spark, sf_dir), _with_orphans)
    unused = S.parse(files, "reached").groupBy("doc_id").agg(F.sum((~F.col("reached")).cast("long")).alias("unused"))
    report = F.get_json_object("report", "$.unused_objects_removed").cast("long").alias("removed")
    done = C.compress(files).select(F.col("doc_id").alias("d"), report)
    return unused.join(done, F.col("doc_id") == F.col("d")).drop("d")


def pdf_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of the files."""
    rows = C.forms(_made(nations(spark, sf_dir), _form))
    return rows.select("doc_id", "name", "type", "value", F.array_join("options", ",").alias("options"), "read_only", "page")


def pdf_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The check box of every file checked by a word that means yes."""
    done = C.fill(_made(nations(spark, sf_dir), _form), {"agree": " On\t"})
    return C.forms(done).where("name = 'agree'").select("doc_id", "value")


def _pictures(row: dict[str, Any]) -> bytes:
    """A page for every twenty customers; each draws the picture of its segment."""
    out = Writer()
    root, tree = out.add(), out.add()
    made: dict[str, Ref] = {}
    pages = []
    customers = row["customers"] or []
    for at in range(0, max(1, len(customers)), 20):
        names, ops = {}, b""
        for k, c in enumerate(customers[at : at + 20]):
            if c["segment"] not in made:
                width = len(c["segment"])
                info = {"Type": Name("XObject"), "Subtype": Name("Image"), "Width": width, "Height": 2, "ColorSpace": Name("DeviceGray"), "BitsPerComponent": 8}
                made[c["segment"]] = out.add(Stream(info, bytes(2 * width)))
            names[f"Im{k}"] = made[c["segment"]]
            ops += b"q 10 0 0 10 72 %d cm /Im%d Do Q\n" % (700 - 20 * k, k)
        pages.append(out.add({"Type": Name("Page"), "Parent": tree, "MediaBox": [0, 0, 612, 792], "Resources": {"XObject": names}, "Contents": out.stream(ops)}))
    out.set(tree, {"Type": Name("Pages"), "Kids": pages, "Count": len(pages)})
    out.set(root, {"Type": Name("Catalog"), "Pages": tree})
    return out.finish(root)


def pdf_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures once, under the first page that draws them."""
    rows = C.images(_made(nations(spark, sf_dir), _pictures))
    png = F.hex(F.substring("content", 1, 4)).alias("head")
    return rows.select("doc_id", "page", "file", "width", "height", png)


def _active(row: dict[str, Any]) -> bytes:
    """A web page's file: a script that runs on opening, an attachment, and a link to the page's address."""
    out = Writer()
    root, tree, page = out.add(), out.add(), out.add()
    script = out.add({"S": Name("JavaScript"), "JS": encode_text(f"open({row['doc_id']})")})
    held = out.add(Stream({"Type": Name("EmbeddedFile")}, (row["html"] or "").encode("utf-8")))
    spec = out.add({"Type": Name("Filespec"), "F": b"page.html", "EF": {"F": held}})
    link = out.add({"Type": Name("Annot"), "Subtype": Name("Link"), "Rect": [72, 72, 100, 84], "A": {"S": Name("URI"), "URI": (row["url"] or "").encode("latin-1", "replace")}})
    out.set(page, {"Type": Name("Page"), "Parent": tree, "MediaBox": [0, 0, 612, 792], "Annots": [link], "Resources": {}})
    out.set(tree, {"Type": Name("Pages"), "Kids": [page], "Count": 1})
    out.set(root, {"Type": Name("Catalog"), "Pages": tree, "OpenAction": script, "Names": {"EmbeddedFiles": {"Names": [b"page.html", spec]}}})
    return out.finish(root)


def _web(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url", "html"), _active)


def pdf_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a scan finds, by kind, the most severe first."""
    found = C.scan(_web(spark, sf_dir), skip_hidden_text=True)
    return found.select("doc_id", F.col("pos").cast("long").alias("pos"), "kind", "severity", "count", F.array_join("samples", ";").alias("samples"))


def pdf_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on files with active content."""
    return C.verdict(_web(spark, sf_dir), skip_hidden_text=True)


def pdf_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What cleaning takes out, and what a scan still finds."""
    done = C.sanitize(_web(spark, sf_dir))
    left = inspect.findings(done, skip_hidden_text=True).groupBy(F.col("doc_id").alias("d")).agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("left"))
    count = lambda g: F.get_json_object("report", f"$.removed.{g}").cast("long").alias(g)
    return done.join(left, F.col("doc_id") == F.col("d"), "left").select("doc_id", *[count(g) for g in inspect.GROUPS], "left")


# --- tables, Markdown, protection ----------------------------------------------------------------------------------


def pdf_tables_ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions' nations as a Markdown table, set, and found again by its lines."""
    nation = F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    own = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("k")).agg(F.array_sort(F.collect_list(nation)).alias("n"))
    row = F.transform("n", lambda x: F.concat(F.lit("| "), x["key"].cast("string"), F.lit(" | "), x["name"], F.lit(" |")))
    text = F.concat(F.lit("# "), "r_name", F.lit("\n\n| Key | Nation |\n| --- | --- |\n"), F.array_join(row, "\n"))
    sources = table(spark, sf_dir, "region").join(own, F.col("r_regionkey") == F.col("k")).select(F.col("r_regionkey").alias("doc_id"), text.alias("markdown"))
    found = C.tables(C.create(sources), format="csv")
    return found.select("doc_id", "page", "rows", "columns", "detected_by", "csv")


def pdf_tables_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations' suppliers with their balances set against the right, found by alignment."""

    def make(row: dict[str, Any]) -> bytes:
        ops = b""
        height = 800.0 + 14 * len(row["s"])
        for k, s in enumerate(row["s"]):
            y = height - 100 - 14 * k
            for x, text in ((72.0, s["name"]), (400 - text_width(s["balance"], 10), s["balance"])):
                ops += b"BT /F1 10 Tf 1 0 0 1 %.3f %.3f Tm %s Tj ET\n" % (x, y, serialise(text.encode()))
        out = Writer()
        root, tree, page = out.add(), out.add(), out.add()
        out.set(page, {"Type": Name("Page"), "Parent": tree, "MediaBox": [0, 0, 612, height], "Resources": {"Font": {"F1": standard_font()}}, "Contents": out.stream(ops)})
        out.set(tree, {"Type": Name("Pages"), "Kids": [page], "Count": 1})
        out.set(root, {"Type": Name("Catalog"), "Pages": tree})
        return out.finish(root)

    supplier = F.struct("s_suppkey", F.col("s_name").alias("name"), F.format_string("%.2f", F.col("s_acctbal").cast("double")).alias("balance"))
    rows = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("doc_id")).agg(F.array_sort(F.collect_list(supplier)).alias("s"))
    found = C.tables(_made(rows, make), format="csv")
    return found.select("doc_id", "page", "rows", "columns", "detected_by", "csv")


def pdf_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages' headings and emphasis set from their HTML: title, bookmarks, and what was not understood."""
    head = F.regexp_extract("html", "(?s)<h1>.*?</h1>", 0)
    sources = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.concat(head, F.lit("\n\n<p>Set <b>bold</b> and <blink>odd</blink>.</p>")).alias("markdown"))
    done = C.create(sources)
    marks = C.outline(done).select(F.col("doc_id").alias("d"), "title", "page")
    ignored = F.get_json_object("report", "$.html_fragments_ignored").cast("long").alias("ignored")
    return done.join(marks, F.col("doc_id") == F.col("d"), "left").select("doc_id", "title", "page", ignored, "error")


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("doc_id"), "r_name"), lambda row: lines_file([[row["r_name"]]]))


def pdf_encrypt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files protected, refused without the password, read with it, and with the protection taken off."""
    locked = C.encrypt(_regions(spark, sf_dir), owner_password="owner", user_password="user").select("doc_id", "content")
    refused = C.info(locked).select("doc_id", "error")
    with_password = C.text(locked.withColumn("password", F.lit("user"))).select(F.col("doc_id").alias("a"), F.col("text").alias("with_password"))
    opened = C.decrypt(locked.withColumn("password", F.lit("owner"))).select("doc_id", "content")
    after = C.text(opened).select(F.col("doc_id").alias("b"), F.col("text").alias("decrypted"))
    return refused.join(with_password, F.col("doc_id") == F.col("a")).join(after, F.col("doc_id") == F.col("b")).select("doc_id", "error", "with_password", "decrypted")


def pdf_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files signed twice and checked; the first signature no longer covers the whole file."""
    from ..sources.pdf_sign import Certificate, PrivateKey

    root, own, other = (PrivateKey.make() for _ in range(3))
    top = Certificate.make("Root", root, authority=True)
    first, second = Certificate.make("Ada", own, issuer=(top, root)), Certificate.make("Bob", other)
    once = C.sign(_regions(spark, sf_dir), cert=first.pem(), key=own.pem(), reason="Approval").select("doc_id", "content")
    twice = C.sign(once, cert=second.pem(), key=other.pem()).select("doc_id", "content")
    found = C.signatures(twice, trust=top.pem())
    return found.select("doc_id", "n", "field", "signer", "valid", "covers_whole_document", "trusted")


QUERIES = {
    f.__name__: f
    for f in (
        pdf_info, pdf_text, pdf_text_budget, pdf_search, pdf_layout, pdf_words, pdf_outline, pdf_pages_keep, pdf_pages_delete, pdf_split, pdf_merge, pdf_rotate, pdf_set_meta,
        pdf_stamp, pdf_annotate, pdf_redact, pdf_replace, pdf_compress, pdf_repaired, pdf_hidden_text, pdf_annotations, pdf_forms, pdf_fill, pdf_unused_objects, pdf_images, pdf_scan, pdf_verdict,
        pdf_sanitize, pdf_tables_ruled, pdf_tables_aligned, pdf_create, pdf_encrypt, pdf_signatures,
    )
}

#: Turns as pages: words, lines of twelve words, their number, the page's text.
_TURNS = r"""WITH w AS (SELECT conv_id, turn, role, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') AS ws,
                  count(*) OVER (PARTITION BY conv_id) AS n_pages FROM conversations),
l AS (SELECT conv_id, role, n_pages, ws, CAST(turn + 1 AS INTEGER) AS page,
             list_transform(range(0, CAST(ceil(len(ws) / 12.0) AS BIGINT)), lambda i: array_to_string(ws[i * 12 + 1 : i * 12 + 12], ' ')) AS ls FROM w),
t AS (SELECT conv_id, CAST(conv_id AS VARCHAR) AS doc_id, role, page, CAST(n_pages AS INTEGER) AS n_pages, ws, ls, array_to_string(ls, chr(10)) AS text,
             CAST(greatest(792.0, 144.0 + 12.0 * greatest(len(ls), 1)) AS DOUBLE) AS height FROM l)
"""

SQL = {
    "pdf_info": _TURNS + r"""SELECT doc_id, CAST(count(*) AS INTEGER) AS pages, CAST(612.0 AS DOUBLE) AS width, min_by(height, page) AS height, count(DISTINCT height) = 1 AS uniform_page_size,
'Conversation ' || doc_id AS title, CAST(count(*) AS INTEGER) AS outline_entries, CAST(0 AS INTEGER) AS form_fields, false AS encrypted FROM t GROUP BY doc_id""",
    "pdf_text": _TURNS + "SELECT doc_id, page, text, false AS truncated FROM t",
    "pdf_text_budget": _TURNS + r""", o AS (SELECT doc_id, page, text, length(text) AS n, n_pages - page + 1 AS pos FROM t),
p AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o)
SELECT doc_id, CAST(pos AS BIGINT) AS pos, page, substr(text, 1, CAST(700 - before AS BIGINT)) AS text, n > 700 - before AS truncated FROM p WHERE before < 700""",
    "pdf_search": _TURNS + r"""SELECT * FROM (SELECT doc_id, CAST(sum(len(regexp_extract_all(lower(array_to_string(ws, ' ')), 'en '))) AS BIGINT) AS total_matches FROM t GROUP BY doc_id) WHERE total_matches > 0""",
    "pdf_layout": _TURNS + r"""SELECT doc_id, page, CAST(k AS BIGINT) AS line, line_text AS text, CAST(72.0 AS DOUBLE) AS x0, CAST(60 + 12 * k AS DOUBLE) AS y0, CAST(70 + 12 * k AS DOUBLE) AS y1,
CAST(10.0 AS DOUBLE) AS size, 'Helvetica' AS font FROM (SELECT doc_id, page, unnest(ls) AS line_text, generate_subscripts(ls, 1) AS k FROM t)""",
    "pdf_words": _TURNS + r"""SELECT doc_id, page, CAST(len(ws) AS BIGINT) AS n_words, CAST(list_sum(list_transform(ws, lambda x: length(x))) AS BIGINT) AS n_chars, CAST(72.0 AS DOUBLE) AS x0 FROM t WHERE len(ws) > 0""",
    "pdf_outline": _TURNS + "SELECT doc_id, page AS seq, CAST(1 AS INTEGER) AS level, role AS title, page FROM t",
    "pdf_pages_keep": _TURNS + r"""SELECT doc_id, CAST(1 AS INTEGER) AS page, text, CAST(CASE WHEN n_pages = 1 THEN 1 ELSE 2 END AS BIGINT) AS marks FROM t WHERE page = n_pages
UNION ALL SELECT doc_id, 2, text, CASE WHEN n_pages = 1 THEN 1 ELSE 2 END FROM t WHERE page = 1""",
    "pdf_pages_delete": _TURNS + r"""SELECT DISTINCT doc_id, CASE WHEN n_pages > 1 THEN CAST(n_pages - 1 AS INTEGER) END AS pages,
CASE WHEN n_pages = 1 THEN 'this would delete every page' END AS error FROM t""",
    "pdf_split": _TURNS + r"""SELECT doc_id, CAST((page - 1) // 2 + 1 AS BIGINT) AS part, doc_id || '-' || lpad(CAST((page - 1) // 2 + 1 AS VARCHAR), 4, '0') || '.pdf' AS file,
string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) AS source_pages, CAST(count(*) AS INTEGER) AS n FROM t GROUP BY doc_id, (page - 1) // 2""",
    "pdf_merge": _TURNS + r"""SELECT CAST(conv_id // 10 AS VARCHAR) AS doc_id, CAST(row_number() OVER (PARTITION BY conv_id // 10 ORDER BY conv_id, page) AS INTEGER) AS page, text FROM t""",
    "pdf_rotate": _TURNS + r"""SELECT doc_id, page, rotation, CASE WHEN rotation % 180 = 90 THEN height ELSE 612.0 END AS width FROM (
SELECT doc_id, page, height, CAST((CASE WHEN page = 1 THEN 180 ELSE 0 END + CASE WHEN page = n_pages THEN 90 ELSE 0 END) % 360 AS INTEGER) AS rotation FROM t)""",
    "pdf_set_meta": "SELECT DISTINCT CAST(conv_id AS VARCHAR) AS doc_id, CAST(NULL AS VARCHAR) AS title, 'Zażółć gęślą' AS subject FROM conversations",
    "pdf_stamp": _TURNS + r"""SELECT doc_id, page, page || '/' || n_pages AS stamp, CAST(len(ls) + 1 AS BIGINT) AS n_lines FROM t""",
    "pdf_annotate": _TURNS + r"""SELECT * FROM (SELECT doc_id, page, CAST(len(regexp_extract_all(text, 'en')) AS BIGINT) AS added FROM t) WHERE added > 0""",
    "pdf_redact": _TURNS + r"""SELECT * FROM (SELECT doc_id, CAST(sum(len(regexp_extract_all(text, 'en'))) AS BIGINT) AS matches, CAST(0 AS BIGINT) AS left FROM t GROUP BY doc_id) WHERE matches > 0""",
    "pdf_replace": _TURNS + r"""SELECT doc_id, page, replace(text, 'en', 'WM') AS text FROM t WHERE doc_id IN (SELECT doc_id FROM t WHERE contains(text, 'en'))""",
    "pdf_compress": _TURNS + r"""SELECT doc_id, true AS rewritten, CAST(0 AS BIGINT) AS unused, CAST(sum(length(text)) AS BIGINT) AS chars FROM t GROUP BY doc_id""",
    "pdf_repaired": _TURNS + r"""SELECT doc_id, true AS repaired, CAST(count(*) AS INTEGER) AS pages, CAST(count(*) AS INTEGER) AS outline_entries FROM t GROUP BY doc_id""",
    "pdf_hidden_text": _TURNS + r"""SELECT doc_id, CAST(12 * count(*) AS BIGINT) AS characters, string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) AS pages FROM t WHERE role = 'user' GROUP BY doc_id""",
    "pdf_annotations": "SELECT CAST(page_id AS VARCHAR) AS doc_id, CAST(1 AS INTEGER) AS page, 'link' AS type, '72.0,72.0,200.0,84.0' AS rect, url FROM pages",
    "pdf_forms": r"""SELECT CAST(c_nationkey AS VARCHAR) AS doc_id, 'c' || c_custkey AS name, 'text' AS type, c_name AS value, '' AS options, c_custkey % 2 = 1 AS read_only, CAST(1 AS INTEGER) AS page FROM customer
UNION ALL SELECT CAST(n_nationkey AS VARCHAR), 'agree', 'checkbox', NULL, 'Yes', false, 1 FROM nation""",
    "pdf_fill": "SELECT CAST(n_nationkey AS VARCHAR) AS doc_id, 'Yes' AS value FROM nation",
    "pdf_unused_objects": r"""SELECT CAST(n_nationkey AS VARCHAR) AS doc_id, CAST(count(c_custkey) % 7 AS BIGINT) AS unused, CAST(count(c_custkey) % 7 AS BIGINT) AS removed
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey""",
    "pdf_images": r"""WITH c AS (SELECT c_nationkey, c_mktsegment AS s, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS k FROM customer),
f AS (SELECT c_nationkey, s, min(k) AS k FROM c GROUP BY c_nationkey, s),
n AS (SELECT *, CAST(k // 20 + 1 AS INTEGER) AS page, row_number() OVER (PARTITION BY c_nationkey, k // 20 ORDER BY k) AS n FROM f)
SELECT CAST(c_nationkey AS VARCHAR) AS doc_id, page, 'page-' || lpad(CAST(page AS VARCHAR), 4, '0') || '-img-' || lpad(CAST(n AS VARCHAR), 2, '0') || '.png' AS file,
CAST(length(s) AS INTEGER) AS width, CAST(2 AS INTEGER) AS height, '89504E47' AS head FROM n""",
    "pdf_scan": r"""WITH h AS (SELECT page_id, CAST(page_id AS VARCHAR) AS doc_id, html, regexp_extract(regexp_replace(lower(url), '^.*?://', ''), '^[^/?#]*') AS host FROM pages)
SELECT doc_id, CAST(1 AS BIGINT) AS pos, 'auto_action' AS kind, 'high' AS severity, CAST(1 AS BIGINT) AS count, '{"when":"document opens","action":"JavaScript"}' AS samples FROM h
UNION ALL SELECT doc_id, 2, 'javascript', 'high', 1, '{"script":"open(' || doc_id || ')"}' FROM h
UNION ALL SELECT doc_id, 3, 'embedded_file', 'medium', 1, '{"name":"page.html","type":"web page","size_bytes":' || strlen(html) || '}' FROM h
UNION ALL SELECT doc_id, 4, 'external_link', 'info', 1, host FROM h""",
    "pdf_verdict": "SELECT CAST(page_id AS VARCHAR) AS doc_id, 'findings' AS verdict, 'high' AS highest_severity, CAST(4 AS BIGINT) AS findings FROM pages",
    "pdf_sanitize": r"""SELECT CAST(page_id AS VARCHAR) AS doc_id, CAST(0 AS BIGINT) AS javascript, CAST(1 AS BIGINT) AS actions, CAST(2 AS BIGINT) AS attachments, CAST(0 AS BIGINT) AS xfa, CAST(0 AS BIGINT) AS media,
'external_link' AS left FROM pages""",
    "pdf_tables_ruled": r"""SELECT CAST(n_regionkey AS VARCHAR) AS doc_id, CAST(1 AS INTEGER) AS page, CAST(count(*) + 1 AS INTEGER) AS rows, CAST(2 AS INTEGER) AS columns, 'lines' AS detected_by,
'Key,Nation' || chr(10) || string_agg(n_nationkey || ',' || n_name, chr(10) ORDER BY n_nationkey) AS csv FROM nation GROUP BY n_regionkey""",
    "pdf_tables_aligned": r"""SELECT CAST(s_nationkey AS VARCHAR) AS doc_id, CAST(1 AS INTEGER) AS page, CAST(count(*) AS INTEGER) AS rows, CAST(2 AS INTEGER) AS columns, 'alignment' AS detected_by,
string_agg(s_name || ',' || printf('%.2f', CAST(s_acctbal AS DOUBLE)), chr(10) ORDER BY s_suppkey) AS csv FROM supplier GROUP BY s_nationkey HAVING count(*) >= 2""",
    "pdf_create": r"""WITH h AS (SELECT page_id, regexp_extract(html, '<h1>(.*?)</h1>', 1, 's') AS h FROM pages)
SELECT CAST(page_id AS VARCHAR) AS doc_id, trim(regexp_replace(replace(replace(replace(replace(h, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[ \t\r\n\f]+', ' ', 'g')) AS title,
CAST(1 AS INTEGER) AS page, CAST(1 AS BIGINT) AS ignored, CAST(NULL AS VARCHAR) AS error FROM h""",
    "pdf_encrypt": "SELECT CAST(r_regionkey AS VARCHAR) AS doc_id, 'encrypted: pass a password' AS error, r_name AS with_password, r_name AS decrypted FROM region",
    "pdf_signatures": r"""SELECT CAST(r_regionkey AS VARCHAR) AS doc_id, CAST(n AS INTEGER) AS n, 'Signature' || n AS field, CASE n WHEN 1 THEN 'Ada' ELSE 'Bob' END AS signer, true AS valid, n = 2 AS covers_whole_document,
n = 1 AS trusted FROM region, range(1, 3) r(n)""",
}
