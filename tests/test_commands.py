"""Commands, the service and the streams over files of several kinds."""

import json

import pytest
from pyspark.sql import functions as F

from papyra import commands as C, service
from papyra.operators import inspect
from papyra.sources import files as S, pdf_edit as E
from papyra.sources.pdf import Pdf, Unsupported
from papyra.streaming import ingest

from .pdfs import form, sample
from .test_pdf_files import hostile


@pytest.fixture(scope="module")
def files(spark):
    locked = E.encrypt(Pdf(sample(1)), owner_password="own", user_password="user")
    rows = [("a", sample(3), None), ("b", form(), None), ("bad", b"no file", None), ("empty", None, None), ("locked", locked, None), ("open", locked, "user"), ("evil", hostile(), None)]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id string, content binary, password string, page string, error int")


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_info_says_why_a_file_cannot_be_read(files):
    got = {r.doc_id: r for r in C.info(files).collect()}
    assert got["a"].pages == 3 and got["a"].metadata["title"] == "Sample" and got["b"].form_fields == 4 and got["open"].encrypted and got["open"].pages == 1
    assert (got["bad"].error, got["empty"].error, got["locked"].error) == ("not a valid PDF", "not a valid PDF", "encrypted: pass a password") and got["locked"].encrypted


def test_every_table_is_read(files):
    for table in S.TABLES:
        df = S.parse(files, table)
        assert df.columns[0] == "doc_id" and df.count() >= 0
        assert S.parse(files.limit(0), table).count() == 0
    assert {r.doc_id for r in S.parse(files, "pages").collect()} == {"a", "b", "open", "evil"}


def test_reading_commands(files):
    assert rows(C.text(files.where("doc_id = 'a'"), pages="3,1", max_chars=10), "pos", "page", "text", "truncated") == [(1, 3, "Page 3 of ", True)]
    assert rows(C.resume(files.where("doc_id = 'a'"), max_chars=10), "page", "char") == [(1, 10)]
    assert rows(C.search(files, "ALPHA-2"), "doc_id", "page", "match") == [("a", 2, "alpha-2")]
    assert len(C.layout(files.where("doc_id = 'a'"), level="words", pages="2").collect()) == 7 and C.outline(files).count() == 1
    assert rows(C.forms(files), "name", "type")[0] == ("agree", "checkbox") and C.annotations(files, pages="1").where("doc_id = 'evil'").count() == 3
    assert rows(C.render_sizes(files.where("doc_id = 'a'"), dpi=72, pages="2"), "file", "width", "height") == [("page-0002.png", 612, 792)]
    assert rows(C.images(files), "doc_id", "file", "width") == [("b", "page-0001-img-01.png", 2)] and C.raw_text(files.where("doc_id = 'a'")).first().text.count("\f") == 2
    assert C.unreadable_pages(files).count() == 0 and C.tables(files, format="markdown").count() == 0
    for wrong in (lambda: C.layout(files, level="x"), lambda: C.tables(files, format="x"), lambda: C.split(files, every=1, ranges=["1"]), lambda: C.pages(files), lambda: C.rotate(files, angle=7), lambda: C.set_meta(files, x="y")):
        with pytest.raises(ValueError):
            wrong()
    for missing in (lambda: C.render(files), lambda: C.ocr(files), C.ocr_langs, lambda: C.ocr_install("eng")):
        with pytest.raises(Unsupported):
            missing()


def test_scanning(files):
    got = {(r.doc_id, r.kind): r for r in C.scan(files).collect()}
    assert {k for d, k in got if d == "evil"} == {"javascript", "auto_action", "launch", "embedded_file", "xfa", "external_link", "rich_media"}
    assert got["evil", "external_link"].samples == ["example.com"] and got["evil", "javascript"].severity == "high" and got["evil", "launch"].samples == ['{"target":"cmd.exe"}']
    assert ("bad", "unparseable") in got and ("locked", "encrypted_unread") in got and not [k for d, k in got if d in ("a", "b")]
    found = {r.doc_id: (r.verdict, r.highest_severity) for r in C.verdict(files).collect()}
    assert found["evil"] == ("findings", "high") and found["a"] == ("nothing found", None) and found["locked"] == ("findings", "info")


def test_hidden_words(spark):
    from .pdfs import build

    page = "BT /F1 12 Tf 72 700 Td (Seen) Tj 3 Tr 0 -50 Td (Unseen text) Tj 0 Tr ET BT /F1 1 Tf 72 500 Td (tiny) Tj ET BT /F1 12 Tf 900 500 Td (outside) Tj ET /S << /ActualText (holiday) >> BDC BT /F1 12 Tf 72 400 Td (invoice) Tj ET EMC"
    files = spark.createDataFrame([("x", build([page]))], "doc_id string, content binary")
    got = {r.reason: r.text for r in inspect.hidden_words(files).where("text <> 'Unseen'").collect()}
    assert got == {"invisible": "text", "too small to read": "tiny", "outside the page": "outside", "stated to read as something else than is drawn": "holiday"}
    total = inspect.hidden_text(files).first()
    assert total.characters == len("Unseen text") + 4 + 7 + 7 and total.pages == [1] and total["count"] == 4


def test_words_of_long_lines_are_not_hidden(spark, tmp_path):
    import duckdb

    from papyra.plans import files as plans

    texts = ["WWWWWWWWWWWWWWWWWWWW " * 30, "some words", "@" * 700 + " end", "", None]
    rows = [(k, turn, ("user", "assistant")[turn % 2], text) for k in range(2) for turn, text in enumerate(texts[k:])]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
        want = con.execute(plans.SQL["pdf_hidden_text"]).fetchall()
    assert sorted(tuple(r) for r in plans.pdf_hidden_text(spark, str(tmp_path)).collect()) == sorted(want) and len(want) == 2


def test_rules_over_streams(spark):
    from papyra.sources.pdf import Name, Stream

    from .pdfs import build

    def extra(out, refs):
        image = {"Type": Name("XObject"), "Subtype": Name("Image"), "Width": 40_000, "Height": 2}
        streams = [
            Stream({"Filter": [Name("FlateDecode"), Name("FlateDecode")]}, b"x"), Stream({"Filter": Name("DCTDecode")}, b"x"), Stream(image, b"x"),
            Stream({**image, "Width": 5, "Filter": Name("CCITTFaxDecode"), "DecodeParms": {"Columns": 999_999_999}}, b"x"),
        ]
        return {"Odd": [out.add(s) for s in streams]}

    files = spark.createDataFrame([("x", build([""], extra) + b"y" * 2000), ("y", b"abc" + sample(1))], "doc_id string, content binary")
    found = {(r.doc_id, r.kind): r.severity for r in C.scan(files).collect()}
    assert found == {
        ("x", "filter_chain"): "medium", ("x", "misplaced_image_filter"): "medium", ("x", "huge_image"): "medium", ("x", "implausible_fax_parameters"): "medium", ("x", "trailing_data"): "low",
        ("y", "header_not_at_start"): "low",
    }


def test_changing_commands(spark, files, tmp_path):
    some = files.where("doc_id in ('a', 'b', 'bad', 'locked')")
    kept = {r.doc_id: r for r in C.pages(some, delete="1").collect()}
    assert kept["b"].error == "this would delete every page" and kept["bad"].error == "not a valid PDF" and len(Pdf(bytes(kept["a"].content)).pages()) == 2 and json.loads(kept["a"].report) == {"source_pages": 3}
    assert rows(C.split(some.where("doc_id = 'a'"), every=2), "part", "file", "source_pages") == [(1, "a-0001.pdf", [1, 2]), (2, "a-0002.pdf", [3])]
    both = files.where("doc_id in ('a', 'b')").withColumns({"merge_id": F.lit("m"), "pos": F.length("content")})
    merged = C.merge(both).first()
    assert json.loads(merged.report)["pages"] == 4 and len(Pdf(bytes(merged.content)).pages()) == 4
    for done in (C.rotate(some, angle=90), C.stamp(some, text="x", position="header"), C.compress(some), C.set_meta(some, title="t"), C.sanitize(some), C.redact(some, texts=("page",)), C.replace(some, "page", "leaf"), C.annotate(some, texts=("page",)), C.fill(some, {"agree": "yes"})):
        got = {r.doc_id: r.error for r in done.select("doc_id", "error").collect()}
        assert got["bad"] == "not a valid PDF" and got["locked"] == "encrypted: pass a password" and None in got.values()
    written = C.save(C.rotate(some, angle=90), f"file://{tmp_path}/out")
    assert rows(written, "file", "written") == [(f"{tmp_path}/out/a", True), (f"{tmp_path}/out/b", True)] and len(Pdf((tmp_path / "out" / "a").read_bytes()).pages()) == 3
    assert not list((tmp_path / "out").glob("*.tmp")) and rows(C.save(C.rotate(some, angle=90), f"file://{tmp_path}/dry", dry_run=True), "written") == [(False,), (False,)] and not (tmp_path / "dry").exists()


def test_names_stay_below_the_folder(spark, tmp_path):
    bad = spark.createDataFrame([("../x", b"1", None)], "doc_id string, content binary, error string")
    with pytest.raises(Exception, match="no name below the folder"):
        C.save(bad, f"file://{tmp_path}").collect()


def test_create_from_a_table(spark):
    sources = spark.createDataFrame([("a", "# T\n\ntext"), ("b", "![x](http://e.com/i.png)"), ("c", None)], "doc_id string, markdown string")
    got = {r.doc_id: r for r in C.create(sources).collect()}
    assert json.loads(got["a"].report)["title"] == "T" and "remote" in got["b"].error and json.loads(got["c"].report)["pages"] == 1


# --- service -------------------------------------------------------------------------------------------------------


def test_definitions():
    found = {d["name"]: d for d in service.definitions()}
    assert len(found) == 31 and found["pdf_set_meta"]["inputSchema"]["additionalProperties"] and found["pdf_search"]["inputSchema"]["required"] == ["input", "query"]
    assert found["pdf_rotate"]["inputSchema"]["properties"]["angle"] == {"type": "integer"} and found["pdf_info"]["description"]


def test_calls(spark, tmp_path):
    path = tmp_path / "a.pdf"
    path.write_bytes(sample(3))
    assert service.call(spark, "pdf_info", {"input": str(path)})["rows"][0]["pages"] == 3
    done = service.call(spark, "rotate", {"input": "a.pdf", "output": "b.pdf", "angle": 90}, root=str(tmp_path))
    assert done["files"][0]["written"] and Pdf((tmp_path / "b.pdf").read_bytes()).pages()[0].rotation == 90
    made = service.call(spark, "pdf_create", {"markdown": "# Hi", "output": str(tmp_path / "c.pdf")})
    assert json.loads(made["rows"][0]["report"])["title"] == "Hi" and (tmp_path / "c.pdf").exists()
    parts = service.call(spark, "split", {"input": str(path), "out_dir": str(tmp_path / "parts")})
    assert len(parts["files"]) == 3 and (tmp_path / "parts" / "a-0002.pdf").exists()
    both = service.call(spark, "merge", {"inputs": [str(path), str(path)], "output": str(tmp_path / "m.pdf")})
    assert json.loads(both["rows"][0]["report"])["pages"] == 6
    (tmp_path / "cut.pdf").write_bytes(sample(2)[:-60])
    assert len(service.call(spark, "info", {"input": str(tmp_path / "cut.pdf")})["repaired_inputs"]) == 1
    for tool, args in (("nothing", {}), ("info", {"input": str(path), "extra": 1}), ("info", {"input": "../etc/passwd"}), ("info", {"input": "/etc/passwd"}), ("info", {"input": "gone.pdf"})):
        with pytest.raises(ValueError):
            service.call(spark, tool, args, root=str(tmp_path))


def test_json_rpc(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(sample(2))
    ask = lambda **m: json.loads(service.handle(spark, json.dumps({"jsonrpc": "2.0", "id": 1, **m}), root=str(tmp_path)))
    assert ask(method="initialize")["result"]["serverInfo"]["name"] == "papyra" and ask(method="ping")["result"] == {} and len(ask(method="tools/list")["result"]["tools"]) == 31
    good = ask(method="tools/call", params={"name": "pdf_text", "arguments": {"input": "a.pdf"}})["result"]
    assert not good["isError"] and "alpha-2" in good["content"][0]["text"]
    assert ask(method="tools/call", params={"name": "pdf_render", "arguments": {"input": "a.pdf"}})["result"]["isError"]
    assert ask(method="nothing")["error"]["code"] == service.NO_METHOD and ask(method="tools/call", params={})["error"]["code"] == service.BAD_ARGUMENTS
    assert json.loads(service.handle(spark, "{"))["error"]["code"] == service.PARSE_ERROR and service.handle(spark, '{"method": "notifications/x"}') is None


def test_serving(spark):
    out = []
    service.serve(spark, ['{"id": 1, "method": "ping"}', "", '{"method": "note"}', "x"], out.append)
    assert [json.loads(x).get("id") for x in out] == [1, None] and out[0].endswith("\n")


# --- streams -------------------------------------------------------------------------------------------------------


def test_files_are_taken_in_as_they_arrive(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for n in (1, 2):
        (folder / f"{n}.pdf").write_bytes(sample(n))

    def run():
        arriving = ingest.arriving_files(spark, f"file://{folder}", files_per_batch=1)
        ingest.ingest(arriving, ["documents", "pages"], f"file://{tmp_path}/model", f"file://{tmp_path}/check").awaitTermination()
        return spark.read.parquet(f"file://{tmp_path}/model/pages")

    assert run().count() == 3
    (folder / "3.pdf").write_bytes(sample(3))
    assert run().count() == 6 and spark.read.parquet(f"file://{tmp_path}/model/documents").count() == 3
    done = spark.read.parquet(f"file://{tmp_path}/model/progress").groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.max("done").alias("d")).collect()
    assert sorted(map(tuple, done)) == [("documents", 3, 1), ("pages", 3, 2)]
    with pytest.raises(ValueError):
        ingest.stream_table(spark.range(1), "nothing")


def test_a_table_of_a_stream(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(sample(2))
    words = ingest.stream_table(ingest.arriving_files(spark, f"file://{tmp_path}"), "pages")
    query = words.writeStream.format("memory").queryName("arrived_pages").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("arrived_pages").count() == 2
    events = ingest.numbered(spark.createDataFrame([("s", 2), ("s", 1), ("t", 5)], "step string, at int"), step="step", order=["at"])
    assert rows(events, "step", "at", "done", "total") == [("s", 1, 1, 2), ("s", 2, 2, 2), ("t", 5, 1, 1)]


def test_a_file_that_takes_too_long(spark, files):
    slow = S.parse(files.where("doc_id = 'a'"), "documents", seconds=0.0001)
    assert slow.first().error.startswith(S.OUT_OF_TIME) and S.parse(files.where("doc_id = 'a'"), "pages", seconds=0.0001).count() == 0


def test_scanner_lines(spark):
    df = spark.createDataFrame([("/tmp/a: b.pdf: Eicar-Test FOUND",), ("/tmp/a: OK",), (None,)], "v string")
    assert [r[0] for r in df.select(inspect.scanner_signature("v")).collect()] == ["Eicar-Test", None, None]
