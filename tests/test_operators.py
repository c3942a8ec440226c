"""Document operators on small tables: nulls, empty and long texts, ties, repeats, empty tables, columns of clashing names."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from papyra.functions import pagespec, text as T
from papyra.operators import assemble, edit, forms, images, layout, read, redact, scan, sign

CLASH = "__doc string, __page int, d int, f string, __hit boolean, __gone string, __state int, name_ string"


def frame(spark, rows, schema, *, extra=True):
    """A table with extra columns whose names clash with those that operators use inside."""
    fill = ("x", 1, 2, "f", True, "g", 3, "n")
    return spark.createDataFrame([(*r, *fill) for r in rows] if extra else rows, schema + (", " + CLASH if extra else ""))


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def one(spark, expression, value="x"):
    return spark.createDataFrame([(value,)], "v string").select(expression.alias("o")).first().o


PAGES = [(1, 1, "alpha one"), (1, 2, "beta  two"), (1, 3, None), (2, 1, ""), (3, 1, "é" * 5000), (3, 2, "alpha"), (3, 2 + 1, "alpha")]


@pytest.fixture(scope="module")
def pages(spark):
    return frame(spark, PAGES, "doc_id long, page int, text string")


# --- text ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("given", "tidy", "flat"), [
    ("a  b \n\n\n c\td ", "a b\n\nc d", "a b c d"), ("", "", ""), (" x y\r\n", "x y", "x y"), ("\n\n", "", ""), ("one", "one", "one"), (None, None, None),
])
def test_tidy_and_flatten(spark, given, tidy, flat):
    assert one(spark, T.tidy("v"), given) == tidy and one(spark, T.flatten("v"), given) == flat


@pytest.mark.parametrize(("given", "limit", "want"), [("abc", 3, "abc"), ("abcd", 3, "abc…"), ("a\nb\tc", 9, "a b c"), ("", 2, ""), (None, 2, None)])
def test_excerpt(spark, given, limit, want):
    assert one(spark, T.excerpt("v", limit), given) == want


@pytest.mark.parametrize(("value", "want"), [("yes", True), (" On ", True), ("\tX\n", True), ("1", True), ("no", False), ("", False), (" off", False), ("maybe", None), (None, None)])
def test_truthy(spark, value, want):
    assert one(spark, T.truthy("v"), value) is want


@pytest.mark.parametrize(("given", "want"), [
    ("&lt;b&gt; &amp;amp; &#65;&#x42;&nbsp;", "<b> &amp; AB "), ("&bogus; & &#0; &#xD800;", "&bogus; & &#0; &#xD800;"), ("plain", "plain"), ("", ""), (None, None),
])
def test_entities(spark, given, want):
    assert one(spark, T.decode_entities("v"), given) == (want.replace("AB ", "AB ") if want and want.endswith("AB ") else want)


def test_patterns_are_unicode(spark):
    count = lambda q, text, **how: one(spark, T.count_matches("v", T.pattern(q, **how)), text)
    assert count(r"\d+", "a ١٢٣ 45", regex=True) == 2 and count(r"\w+", "één déjà", regex=True) == 2 and count("ÉT", "été ÉTÉ") == 2
    assert count("ÉT", "été ÉTÉ", case_sensitive=True) == 1 and count("a.b", "axb a.b") == 1 and count(r"\E", r"x\Ey") == 1 and count("x", None) == 0
    for bad in (r"(?=x)", r"(a)\1", "a++", r"(?<!x)y"):
        with pytest.raises(ValueError):
            T.pattern(bad, regex=True)
    with pytest.raises(ValueError):
        T.pattern("")


def test_spans_have_no_cap(spark):
    text = "ab" * 12_000
    found = one(spark, T.spans("v", "a"), text)
    assert len(found) == 12_000 and found[-1].start == 23_998 and one(spark, F.size(T.spans("v", "a", 5)), text) == 5
    assert one(spark, T.spans("v", "z"), "abc") == [] and one(spark, T.spans("v", "a"), None) == []


def test_types_and_targets(spark):
    kind = lambda head, name: tuple(one(spark, T.file_type(F.unhex(F.lit(head)), F.lit(name))))
    assert kind("4D5A", "x") == ("executable", "high") and kind("504B0304", "a.docx") == ("office document", "low") and kind("00", "A.HTML") == ("web page", "medium") and kind("", "") == ("data", "low")
    assert one(spark, T.is_remote("v"), "\\\\host\\x") and one(spark, T.is_remote("v"), "//h") and not one(spark, T.is_remote("v"), "file")
    assert one(spark, T.host("v"), "HTTP://A.b/c?d") == "a.b" and one(spark, T.parse_color("v"), "ff0080")[0] == 1.0 and one(spark, T.parse_color("v"), "red") is None
    assert one(spark, T.helvetica_units("v"), "Ai ") == 667 + 222 + 278 and one(spark, T.helvetica_units("v"), "") == 0


# --- page specs ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("spec", "want"), [
    ("3,1,3", [3, 1, 3]), ("2-", [2, 3, 4, 5]), ("-2", [1, 2]), ("4-2", [4, 3, 2]), ("last", [5]), ("last-4", [5, 4]), ("odd", [1, 3, 5]), (" EVEN ", [2, 4]), ("all", [1, 2, 3, 4, 5]), ("-", [1, 2, 3, 4, 5]),
])
def test_page_specs(spark, spec, want):
    assert pagespec.page_numbers(spec, 5) == want and one(spark, pagespec.select_pages(spec, F.lit(5))) == want


@pytest.mark.parametrize("spec", ["0", "6", "x", "", ",", "1-9", "2-x"])
def test_bad_page_specs(spark, spec):
    with pytest.raises((ValueError, PySparkException)):
        pagespec.page_numbers(spec, 5)
    with pytest.raises((ValueError, PySparkException)):
        one(spark, pagespec.select_pages(spec, F.lit(5)))


# --- reading -------------------------------------------------------------------------------------------------------


def test_budgeted_reading(spark, pages):
    out = read.read_text(pages, max_chars=12)
    assert rows(out.where("doc_id < 3"), "doc_id", "page", "text", "truncated") == [(1, 1, "alpha one", False), (1, 2, "bet", True), (2, 1, "", False)]
    assert rows(read.resume_at(pages, max_chars=9), "doc_id", "page", "char") == [(1, 2, 0), (3, 1, 9)]
    assert rows(read.resume_at(pages, max_chars=10, from_char=3), "doc_id", "page", "char") == [(1, 2, 4), (3, 1, 13)]
    assert read.read_text(pages, max_chars=0).count() == 0 and read.read_text(pages.limit(0)).count() == 0
    assert rows(read.read_text(pages.where("doc_id = 1"), spec="2,1,2"), "pos", "text") == [(1, "beta  two"), (2, "alpha one"), (3, "beta  two")]


def test_resuming_reads_everything(spark, pages):
    page, char, parts = 1, 0, []
    for _ in range(9):
        parts += [r.text for r in read.read_text(pages.where("doc_id = 1"), max_chars=4, from_char=char, spec=f"{page}-").orderBy("pos").collect()]
        found = read.resume_at(pages.where("doc_id = 1"), max_chars=4, from_char=char, spec=f"{page}-").collect()
        if not found:
            break
        page, char = found[0].page, found[0].char
    assert "".join(p or "" for p in parts) == "alpha onebeta  two"


def test_searching(spark, pages):
    found = read.search(pages, "ALPHA", max_results=2, context=3)
    assert rows(found, "doc_id", "n", "page", "match", "snippet", "total_matches") == [(1, 1, 1, "alpha", "alpha on", 1), (3, 1, 2, "alpha", "alpha", 2), (3, 2, 3, "alpha", "alpha", 2)]
    assert rows(read.search(pages, "a b", regex=False), "doc_id") == [] and rows(read.search(pages, "beta two"), "page") == [(2,)]
    assert rows(read.search_totals(pages, "é"), "doc_id", "total_matches") == [(3, 5000)] and read.search(pages.limit(0), "x").count() == 0
    assert len(read.search(pages, "é", max_results=7).collect()) == 7


def test_facts_and_raw_text(spark, pages):
    got = rows(read.info(pages, width=F.col("page").cast("double"), height=F.lit(1.0)), "doc_id", "pages", "uniform_page_size", "width")
    assert got == [(1, 3, False, 1.0), (2, 1, True, 1.0), (3, 3, False, 1.0)]
    assert rows(read.raw_text(pages.where("doc_id < 3")), "doc_id", "text") == [(1, "alpha one\n\f\nbeta  two"), (2, "")]


def test_outline_pages(spark):
    entries = frame(spark, [(1, 1, 1, "a", 7), (1, 2, 1, "b", 8), (2, 1, 1, None, None)], "doc_id long, seq long, level int, title string, target int")
    known = frame(spark, [(1, 7, 3), (9, 8, 1)], "doc_id long, obj int, page int")
    assert rows(read.outline_pages(entries, known), "doc_id", "seq", "page") == [(1, 1, 3), (1, 2, None), (2, 1, None)]


# --- pages ---------------------------------------------------------------------------------------------------------


def test_keep_and_delete(spark, pages):
    assert rows(assemble.keep_pages(pages, "last,1"), "doc_id", "page", "source_page") == [(1, 1, 3), (1, 2, 1), (2, 1, 1), (2, 2, 1), (3, 1, 3), (3, 2, 1)]
    some = pages.where("doc_id <> 2")
    assert rows(assemble.delete_pages(some, "1"), "doc_id", "page", "source_page") == [(1, 1, 2), (1, 2, 3), (3, 1, 2), (3, 2, 3)]
    assert assemble.delete_pages(pages.limit(0), "1").count() == 0
    with pytest.raises(PySparkException, match="every page"):
        assemble.delete_pages(pages, "1").collect()


def test_splitting(spark, pages):
    parts = assemble.split_every(pages, 2)
    assert rows(parts, "doc_id", "part", "file", "source_pages") == [
        (1, 1, "1-0001.pdf", [1, 2]), (1, 2, "1-0002.pdf", [3]), (2, 1, "2-0001.pdf", [1]), (3, 1, "3-0001.pdf", [1, 2]), (3, 2, "3-0002.pdf", [3]),
    ]
    assert rows(assemble.split_ranges(pages.where("doc_id = 1"), ["3,1", "2"]), "part", "source_pages") == [(1, [3, 1]), (2, [2])]
    with pytest.raises(ValueError):
        assemble.split_every(pages, 0)


def test_merging(spark, pages):
    order = spark.createDataFrame([(9, 1, 3), (9, 2, 1)], "merge_id long, pos int, doc_id long")
    assert rows(assemble.merge(pages, order), "merge_id", "page", "source_page") == [(9, 1, 1), (9, 2, 2), (9, 3, 3), (9, 4, 1), (9, 5, 2), (9, 6, 3)]
    fields = frame(spark, [(9, 2, "a"), (9, 3, "a"), (8, 1, None)], "merge_id long, pos int, name string")
    assert rows(assemble.merge_fields(fields), "merge_id", "merged_name") == [(8, None), (9, "a"), (9, "doc3.a")]


def test_nesting_at_any_depth(spark):
    levels = [1, 2, 4, 3, 3, 1, 5, 2, None, 2]
    want = [1, 2, 3, 3, 3, 1, 2, 2, 1, 2]
    entries = frame(spark, [(1, k, v) for k, v in enumerate(levels)] + [(2, k, k + 1) for k in range(60)], "doc_id long, seq long, level int")
    got = assemble.renest(entries)
    assert [r.new_level for r in got.where("doc_id = 1").orderBy("seq").collect()] == want and got.agg(F.max("new_level")).first()[0] == 60
    assert assemble.renest(got).columns == got.columns and assemble.renest(entries.limit(0)).count() == 0
    kept = spark.createDataFrame([(1, 2)], "doc_id long, page int")
    orphans = frame(spark, [(1, 1, 1, 9), (1, 2, 2, 2), (1, 3, 3, 2)], "doc_id long, seq long, level int, page int")
    assert rows(assemble.surviving_outline(orphans, kept), "seq", "new_level") == [(2, 1), (3, 2)]


def test_trees_in_reading_order(spark):
    deep = [(2, f"n{k}", f"n{k - 1}" if k else None, 0, f"t{k}") for k in range(150)]
    nodes = [(1, "a", None, 2, "A"), (1, "b", None, 1, "B"), (1, "c", "a", 1, "C"), (1, "d", "a", 1, "D"), (1, "x", "y", 1, "X"), (1, "y", "x", 1, "Y"), (1, "e", "gone", 1, "E"), *deep]
    df = frame(spark, nodes, "doc_id long, id string, parent string, pos long, title string")
    got = assemble.flatten_tree(df)
    assert [(r.level, r.id) for r in got.where("doc_id = 1").orderBy("seq").collect()] == [(1, "b"), (1, "a"), (2, "c"), (2, "d")]
    assert got.where("doc_id = 2").agg(F.max("level")).first()[0] == 150 and assemble.flatten_tree(df.limit(0)).count() == 0


def test_rotation_and_sizes(spark):
    df = frame(spark, [(1, 1, 0), (1, 2, 270), (2, 1, None)], "doc_id long, page int, rotation int")
    assert rows(edit.rotate(df, 90, "1,1"), "doc_id", "page", "rotation") == [(1, 1, 180), (1, 2, 270), (2, 1, None)]
    with pytest.raises(ValueError):
        edit.rotate(df, 45)
    w, h = edit.raster_size(F.lit(72.0), F.lit(72_000_000.0), 150)
    assert one(spark, h) == 16_000 and one(spark, w) == 1
    assert [one(spark, x) for x in edit.visual_size(F.lit(3), F.lit(5), F.lit(90))] == [5, 3]


def test_metadata_and_stamps(spark):
    df = frame(spark, [(1, {"title": "t", "author": "a"}), (2, {}), (3, None)], "doc_id long, metadata map<string,string>")
    got = dict(rows(edit.set_meta(df, {"title": "", "subject": "s"}), "doc_id", "metadata"))
    assert got[1] == {"author": "a", "subject": "s"} and got[2] == {"subject": "s"}
    assert one(spark, edit.stamp_text("{page}/{pages}", F.lit(2), F.lit(9))) == "2/9"
    stamps = frame(spark, [(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 0.0, 0.0, 1.0, 1.0)], "doc_id long, page int, x0 double, y0 double, x1 double, y1 double")
    words = frame(spark, [(1, 1, 5.0, 5.0, 9.0, 9.0), (1, 1, 5.0, 9.8, 9.0, 20.0), (1, 1, 11.0, 0.0, 12.0, 5.0)], "doc_id long, page int, x0 double, y0 double, x1 double, y1 double")
    assert rows(edit.overlapping_words(stamps, words), "page", "words_under_it") == [(1, 1), (2, 0)]
    assert tuple(one(spark, edit.compress_report(F.lit(200), F.lit(150)))) == (True, 150, 25.0) and tuple(one(spark, edit.compress_report(F.lit(0), F.lit(9)))) == (False, 0, 0.0)


# --- redaction, scanning -------------------------------------------------------------------------------------------


LINES = [(1, 1, 1, "mail a@b.c and 1.2.3.4"), (1, 1, 2, "nothing"), (1, 2, 1, None), (2, 1, 1, ""), (2, 1, 2, "a@b.c a@b.c")]


@pytest.fixture(scope="module")
def lines(spark):
    return frame(spark, LINES, "doc_id long, page int, line int, text string")


def test_redaction_of_lines(spark, lines):
    out = redact.redact(lines, [r"[a-z]@[a-z.]+", r"\d(\.\d){3}", ""], regex=True)
    assert rows(out, "doc_id", "line", "text", "removed") == [(1, 1, "mail  and ", 2), (1, 1, None, 0), (1, 2, "nothing", 0), (2, 1, "", 0), (2, 2, " ", 2)]
    assert rows(redact.targets(lines, ["a@b.c"]), "doc_id", "line", "start") == [(1, 1, 5), (2, 2, 0), (2, 2, 6)]
    assert rows(redact.count_targets(lines, ["a@b.c", "nothing"]), "doc_id", "page", "added") == [(1, 1, 2), (2, 1, 2)]
    with pytest.raises(PySparkException, match="left after redaction"):
        redact.redact(frame(spark, [(1, 1, 1, "sesecretcret")], "doc_id long, page int, line int, text string"), ["secret"]).collect()
    again = redact.redact_fixpoint(frame(spark, [(1, 1, 1, "x sesecretcret y"), (1, 1, 2, None)], "doc_id long, page int, line int, text string"), ["secret"])
    assert rows(again, "text") == [("x  y",), (None,)]
    assert redact.redact(lines.limit(0), ["x"]).count() == 0


def test_more_targets_than_any_cap(spark):
    df = frame(spark, [(1, 1, 1, "ab" * 12_000)], "doc_id long, page int, line int, text string")
    assert redact.targets(df, ["a"]).count() == 12_000


def test_replacing_in_lines(spark, lines):
    out = redact.replace_text(lines, "a@b.c", "someone $1")
    assert rows(out, "text", "replacements") == [("", 0), ("mail someone $1 and 1.2.3.4", 1), ("nothing", 0), ("someone $1 someone $1", 2), (None, 0)]
    swap = redact.replace_text(lines, r"(\w)@(\w)", "$2 at ${1}0", regex=True)
    assert [r[0] for r in rows(swap, "text") if r[0] and " at " in r[0]] == ["b at a0.c b at a0.c", "mail b at a0.c and 1.2.3.4"]
    literal, pattern = (rows(redact.replace_text(lines, "A@B", "WIDE", **how), "line", "doc_id", "width_change") for how in ({}, {"regex": True}))
    assert literal == pattern and any(w for _, _, w in literal)
    with pytest.raises(ValueError):
        redact.replace_text(lines, "x", "a\nb")
    assert redact.java_replacement("$1a $$ ${2}3 \\") == r" \$ $2\3 \\"


HTML = "<SCRIPT>a()</script><p onClick='x()'>t<iframe src=//e.com></iframe><!-- c --><a href='https://h.com/x'>l</a><form action=/go>"


def test_scanning_pages(spark):
    df = frame(spark, [(1, HTML), (2, None), (3, ""), (1, "<p>plain")], "page_id long, html string")
    found = scan.html_findings(df)
    assert {r.kind for r in found.collect()} == {"javascript", "auto_action", "embedded_file", "hidden_text", "external_link", "submit_form"}
    report = {r.kind: r for r in scan.report(found).collect()}
    assert report["javascript"].severity == "high" and report["javascript"].samples == ["a()"] and report["external_link"].samples == ["https://h.com/x"]
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    assert rows(scan.verdict(docs, found), "doc_id", "verdict", "highest_severity") == [(1, "findings", "high"), (2, "nothing found", None)]
    clean = scan.sanitize(df)
    got = {r.page_id: r for r in clean.where("page_id > 1 or length(html) > 10").collect()}
    assert got[1].html == "<p >t<a href='https://h.com/x'>l</a><form action=/go>" and got[1].removed == {"javascript": 1, "actions": 1, "attachments": 1, "hidden": 1}
    assert got[3].html == "" and clean.where("page_id = 2").first().html is None and clean.columns[-1] == "removed"
    assert "iframe" in scan.sanitize(df, keep=("attachments",)).where("length(html) > 20").first().html
    with pytest.raises(ValueError):
        scan.sanitize(df, keep=("x",))


def test_restated_text(spark):
    df = spark.createDataFrame([(1, "invoice", "invoice"), (2, "abcdef", "zzz"), (3, "ab", "z"), (4, "ﬁne", "FINE"), (5, None, "x"), (6, "aaaa", "a")], "k long, s string, t string")
    assert rows(scan.restated(df, key="k", stated="s", drawn="t"), "k", "restated") == [(1, False), (2, True), (3, False), (4, False), (6, True)]


def test_severities(spark):
    assert [one(spark, scan.rank(F.lit(s))) for s in scan.SEVERITIES] == [1, 2, 3, 4] and one(spark, scan.label(F.lit(3))) == "medium" and one(spark, scan.label(F.lit(None))) is None


# --- forms, images, signatures, layout -----------------------------------------------------------------------------


def test_forms(spark):
    fields = frame(spark, [(1, "a", "text", [], False, None), (1, "b", "checkbox", ["Yes"], False, None), (1, "c", "choice", ["r", "g"], False, None), (1, "d", "text", [], True, "v")], "doc_id long, name string, type string, options array<string>, read_only boolean, value string")
    widgets = frame(spark, [(1, "a", 2, 5), (1, "a", 1, 4), (1, "b", 1, None)], "doc_id long, name string, pos int, page int")
    assert rows(forms.list_fields(fields, widgets), "name", "page") == [("a", 4), ("b", None), ("c", None), ("d", None)]
    values = frame(spark, [(1, "a", "x"), (1, "b", " ON\t"), (1, "c", "g")], "doc_id long, name string, value string")
    assert rows(forms.fill(fields, values), "name", "value") == [("a", "x"), ("b", "Yes"), ("c", "g"), ("d", "v")]
    bad = frame(spark, [(1, "z", "x"), (1, "d", "x"), (1, "c", "q"), (1, "b", "perhaps")], "doc_id long, name string, value string")
    assert [bool(r.error) for r in forms.plan_fill(fields, bad).collect()] == [True] * 4
    with pytest.raises(PySparkException):
        forms.fill(fields, bad).collect()


def test_images(spark):
    drawn = frame(spark, [(1, 2, 1, "k"), (1, 1, 2, "k"), (1, 1, 1, "m"), (1, 1, 3, "k"), (2, 1, 1, None)], "doc_id long, page int, draw_pos int, key string")
    assert rows(images.first_owner(drawn), "doc_id", "key", "page", "n") == [(1, "k", 1, 2), (1, "m", 1, 1), (2, None, 1, 1)]
    assert one(spark, images.image_file(F.lit(3), F.lit(2), F.lit("png"))) == "page-0003-img-02.png" and one(spark, images.page_file(F.lit(12))) == "page-0012.png"
    assert one(spark, images.image_kind(F.unhex(F.lit("FFD8FFE0")))) == "jpg" and one(spark, images.image_kind(F.unhex(F.lit("00")))) is None


def test_byte_ranges(spark):
    import hashlib

    df = spark.createDataFrame([(bytearray(b"abcdefgh"), 0, 2, 4, 4), (bytearray(b"abcdefgh"), 0, 2, 4, 9), (None, 0, 1, 1, 1)], "content binary, a long, b long, c long, d long")
    got = sign.check_ranges(df).collect()
    assert (got[0].range_sound, got[0].covers_whole, got[0].digest) == (True, True, hashlib.sha256(b"abefgh").hexdigest()) and got[1].range_sound is False and got[1].digest is None


WORD = "doc_id long, page int, seq int, text string, x0 double, y0 double, x1 double, y1 double, size double"


def test_lines_hang_on_their_first_word(spark):
    words = [(1, 1, 0, "a", 0.0, 0.0, 5.0, 10.0, 10.0), (1, 1, 1, "b", 6.0, 4.0, 9.0, 14.0, 10.0), (1, 1, 2, "c", 20.0, 8.0, 25.0, 18.0, 10.0), (1, 2, 0, "d", 0.0, 0.0, 5.0, 10.0, 10.0), (1, 1, 3, "e", 26.0, 8.0, 30.0, 18.0, 10.0)]
    df = frame(spark, words, WORD)
    assert rows(layout.line_numbers(df), "page", "line", "text") == [(1, 1, "a"), (1, 1, "b"), (1, 2, "c"), (1, 2, "e"), (2, 1, "d")]
    assert rows(layout.lines(df), "page", "line", "text", "x0", "x1") == [(1, 1, "a b", 0.0, 9.0), (1, 2, "c e", 20.0, 30.0), (2, 1, "d", 0.0, 5.0)]
    wide = frame(spark, [(1, 1, k, f"w{k}", x, 0.0, x + 5.0, 10.0, 10.0) for k, x in enumerate((0.0, 10.0, 30.0))], WORD)
    assert rows(layout.segments(wide), "cell", "text") == [(1, "w0 w1"), (2, "w2")]
    assert layout.lines(df.limit(0)).count() == 0


def test_many_words_on_a_page(spark):
    df = spark.range(60_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(1).alias("page"), F.col("id").cast("int").alias("seq"), F.lit("w").alias("text"), F.lit(0.0).alias("x0"), (F.col("id") / 6).alias("y0"), F.lit(1.0).alias("x1"), (F.col("id") / 6 + 10).alias("y1"), F.lit(10.0).alias("size"))
    assert layout.line_numbers(df).agg(F.max("line")).first()[0] == 2_000


def test_grids_and_clusters(spark):
    words = frame(spark, [(1, 1, 1.0, 1.0, 3.0, 3.0), (1, 1, 9.0, 1.0, 11.0, 3.0), (1, 1, 19.0, 1.0, 21.0, 3.0), (2, 1, 1.0, 1.0, 3.0, 3.0)], "doc_id long, page int, x0 double, y0 double, x1 double, y1 double")
    edges = frame(spark, [(1, 1, [0.0, 10.0, 20.0], [0.0, 5.0])], "doc_id long, page int, xs array<double>, ys array<double>")
    assert rows(layout.cells_of_grid(words, edges), "doc_id", "row", "column") == [(1, 1, 1), (1, 1, 2)]
    assert one(spark, layout.cluster(F.array(*map(F.lit, (1.0, 2.0, 3.0, 9.0))), 2.0)) == [2.0, 9.0] and one(spark, layout.cluster(F.array().cast("array<double>"), 2.0)) == []


def test_table_rows(spark):
    cells = F.array(F.lit("a|b"), F.lit('say "x"'), F.lit(None).cast("string"), F.lit("l\nm,"))
    assert one(spark, layout.markdown_row(cells)) == '| a\\|b | say "x" |  | l\nm, |' and one(spark, layout.csv_row(cells)) == 'a|b,"say ""x""",,"l\nm,"'
    tsv = frame(spark, [(1, 1, 4, 0, 0, 9, 9, ""), (1, 2, 5, 1, 1, 2, 2, "one"), (1, 3, 5, 4, 1, 2, 2, " \t"), (1, 4, 5, 7, 1, 2, 2, "two"), (1, 5, 4, 0, 0, 0, 0, None), (2, 1, 5, 0, 0, 1, 1, "early")], "doc_id long, pos int, level int, left int, top int, width int, height int, text string")
    assert rows(layout.tsv_lines(tsv), "doc_id", "line", "text", "x1") == [(1, 1, "one two", 9)]


def test_recognised_text(spark):
    df = frame(spark, [(1, 1, 1, "p", "one"), (1, 1, 2, "p", "two"), (1, 1, 3, "q", "three"), (1, 2, 1, None, None)], "doc_id long, page int, line int, paragraph string, text string")
    assert rows(layout.recognised_text(df), "page", "text") == [(1, "one\ntwo\n\nthree"), (2, "")]
