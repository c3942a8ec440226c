"""PDF files read, changed and read again; the cases follow what a user does with one file."""

import hashlib

import pytest

from papyra.operators import inspect as I
from papyra.sources import crypt, pdf_edit as E, pdf_inspect, pdf_redact as R, pdf_sign as S
from papyra.sources.crypt import Aes, Security, WrongPassword, rc4
from papyra.sources.markdown import document, html_document, to_markdown
from papyra.sources.pdf import Damaged, Name, Pdf, Ref, Stream, Unsupported
from papyra.sources.pdf_create import column_widths, create, lines_file
from papyra.sources.pdf_text import Font, interpret, line_text, reading_order, running_text
from papyra.sources.pdf_writer import Writer, save

from .pdfs import PIXELS, build, form, sample


def texts(data, password=""):
    pdf = Pdf(data, password)
    return [running_text(interpret(pdf, p).words) for p in pdf.pages()]


def words(data, page=1):
    pdf = Pdf(data)
    return interpret(pdf, pdf.pages()[page - 1]).words


# --- reading -------------------------------------------------------------------------------------------------------


def test_structure_and_metadata():
    pdf = Pdf(sample(5))
    assert len(pdf.pages()) == 5 and pdf.metadata() == {"title": "Sample", "author": "Ada"} and pdf.outline() == [(1, "Second chapter", 2)]
    assert not pdf.repaired and pdf.damage() is None and pdf.security is None and Pdf(sample(1)).outline() == []
    assert texts(sample(3))[2] == "Page 3 of the sample. Keyword alpha-3."


def test_cut_off_and_shifted_files_are_rebuilt():
    data = sample(3)
    for broken in (data[:-60], data.replace(b"startxref", b"startxxxx"), b"junk before\n" + data, data[:15] + b"%pad\n" * 9 + data[15:]):
        pdf = Pdf(broken)
        assert [running_text(interpret(pdf, p).words) for p in pdf.pages()] == texts(data)
    assert Pdf(data[:-60]).repaired and not Pdf(data).repaired
    for bad in (b"", b"garbage", b"%PDF-1.7\n%%EOF"):
        with pytest.raises(Damaged):
            Pdf(bad)


def test_damage_is_named():
    def lost(out, refs):
        out.objects[refs[0].number - 1]["Contents"] = Ref(999, 0)
        return {}

    assert Pdf(build(["", ""], lost)).damage() == "objects of page 1 are missing"
    data = sample(2)
    assert "of its 7 pages" in Pdf(data.replace(b"/Count 2", b"/Count 7")).damage()


def test_objects_in_streams_and_predictors():
    packed, _ = E.compress(Pdf(sample(40)))
    assert len(packed) < len(sample(40)) and texts(packed) == texts(sample(40)) and not Pdf(packed).repaired
    rows = bytes([2, 1, 2, 3, 2, 1, 1, 1])
    assert Pdf._predict(None, rows, {"Predictor": 12, "Columns": 3}) == bytes([1, 2, 3, 2, 3, 4])


def test_words_are_read_as_they_are_stated():
    content = "/Span << /ActualText (of) >> BDC BT /F1 12 Tf 72 700 Td (X) Tj (Y) Tj ET EMC BT /F1 12 Tf 200 700 Td (plain) Tj ET /Span << /ActualText () >> BDC BT /F1 12 Tf 300 700 Td (gone) Tj ET EMC"
    found = words(build([content]))
    assert [(w.text, w.drawn) for w in found] == [("of", "XY"), ("plain", None)] and found[0].x1 > 72 + 12 * 0.667


def test_letters_drawn_together_stay_a_word_and_raised_ones_too():
    found = words(build(["BT /F1 10 Tf 72 700 Td [(T) 120 (o)] TJ 3 Ts (2) Tj 0 Ts ( next) Tj ET"]))
    assert [w.text for w in found] == ["To2", "next"]
    turned = words(build(["BT /F1 10 Tf 0 1 -1 0 300 300 Tm (Upright text) Tj ET"]))
    assert [w.text for w in turned] == ["Upright", "text"] and turned[0].y1 > turned[0].y0 + 20


def test_text_from_the_right():
    assert reading_order(list("abc")) is None
    drawn = [c for c in "םולש"[::1]]
    order = reading_order(drawn)
    assert "".join(drawn[k] for k, _ in order) == "שלום" and all(t for _, t in order)
    mixed = list("abc ") + list("גב")
    assert "".join(mixed[k] for k, _ in reading_order(mixed)) == "abc בג"


def test_fonts_map_codes():
    cmap = b"1 begincodespacerange <00> <FF> endcodespacerange 2 beginbfchar <01> <0041> <02> <FB01> endbfchar 1 beginbfrange <10> <12> <0061> endbfrange"

    def more(out):
        font = {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("ABCDEF+Face-Bold"), "ToUnicode": out.add(Stream({}, cmap)), "FirstChar": 1, "Widths": [500] * 40}
        named = {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Other"), "Encoding": {"Differences": [1, Name("Aacute"), Name("fi"), Name("uni0416"), Name("odd.name")]}}
        return {"Font": {"F1": out.add(font), "F2": out.add(named)}}

    found = words(build([b"BT /F1 10 Tf 72 700 Td (\x01\x02\x10\x12) Tj /F2 10 Tf 0 -40 Td (\x01\x02\x03) Tj ET"], resources=more))
    assert [(w.text, w.font, w.bold) for w in found] == [("AﬁaC".replace("C", "c"), "Face-Bold", True), ("ÁﬁЖ", "Other", False)]


def test_paragraphs_and_lines():
    page = "BT /F1 10 Tf 72 700 Td (one two) Tj 0 -12 Td (three) Tj 0 -30 Td (four) Tj ET"
    assert texts(build([page])) == ["one two\nthree\n\nfour"]
    assert line_text(words(build([page]))[:2]) == "one two"


# --- pages ---------------------------------------------------------------------------------------------------------


def test_pages_kept_reordered_repeated_and_deleted():
    data = sample(5)
    kept = E.keep(Pdf(data), "3,1,3")
    assert [t[:6] for t in texts(kept)] == ["Page 3", "Page 1", "Page 3"] and Pdf(kept).metadata()["title"] == "Sample" and Pdf(kept).outline() == []
    assert Pdf(E.keep(Pdf(data), "2-4")).outline() == [(1, "Second chapter", 1)]
    assert [t[:6] for t in texts(E.delete(Pdf(data), "2-4"))] == ["Page 1", "Page 5"]
    for spec in ("1-5", "all"):
        with pytest.raises(E.Refused):
            E.delete(Pdf(data), spec)
    with pytest.raises(ValueError):
        E.keep(Pdf(data), "9")


def test_split_and_merge():
    data = sample(5)
    assert [p for p, _ in E.split(Pdf(data), 2)] == [[1, 2], [3, 4], [5]]
    assert [p for p, _ in E.split(Pdf(data), ranges=["1-2", "last"])] == [[1, 2], [5]]
    both = E.merge([Pdf(data), Pdf(sample(3))])
    assert [t[:6] for t in texts(both)] == [f"Page {n}" for n in (1, 2, 3, 4, 5, 1, 2, 3)]
    assert [(t, p) for _, t, p in Pdf(both).outline()] == [("Second chapter", 2), ("Second chapter", 7)]


def test_merge_keeps_fields_of_every_input():
    filled, _ = E.fill(Pdf(form()), {"name": "Ada"})
    found = [(f["name"], f["value"], f["page"]) for f in Pdf(E.merge([Pdf(sample(1)), Pdf(form()), Pdf(filled)])).fields()]
    assert len(found) == 8 and found[0] == ("name", None, 2) and found[4] == ("doc3.name", "Ada", 3)


def test_nesting_survives_and_orphans_move_up():
    def outline(out, refs):
        from papyra.sources.pdf_writer import outline_tree

        return {"Outlines": outline_tree(out, [(1, "A", [refs[0]]), (2, "B", [refs[1]]), (3, "C", [refs[2]]), (1, "D", [refs[3]])])}

    data = build(["", "", "", ""], outline)
    assert Pdf(data).outline() == [(1, "A", 1), (2, "B", 2), (3, "C", 3), (1, "D", 4)]
    assert Pdf(E.delete(Pdf(data), "2")).outline() == [(1, "A", 1), (2, "C", 2), (1, "D", 3)]


def test_links_by_name_land_where_they_did():
    def extra(out, refs):
        out.objects[refs[0].number - 1]["Annots"] = [out.add({"Type": Name("Annot"), "Subtype": Name("Link"), "Rect": [0, 0, 9, 9], "Dest": b"there"})]
        return {"Names": {"Dests": {"Names": [b"there", [refs[2], Name("Fit")]]}}}

    data = build(["", "", ""], extra)
    assert Pdf(data).annotations()[0]["target_page"] == 3
    assert Pdf(E.keep(Pdf(data), "3,1")).annotations()[0]["target_page"] == 1
    assert Pdf(E.keep(Pdf(data), "1,2")).annotations()[0]["target_page"] is None


def test_rotation_adds_up():
    once = E.rotate(Pdf(sample(3)), 90, "1,1,2")
    assert [p.rotation for p in Pdf(once).pages()] == [180, 90, 0]
    assert [p.rotation for p in Pdf(E.rotate(Pdf(once), -90)).pages()] == [90, 0, 270]
    with pytest.raises(E.Refused):
        E.rotate(Pdf(sample(1)), 45)
    turned = Pdf(E.rotate(Pdf(sample(1)), 90))
    layout = interpret(turned, turned.pages()[0])
    assert (layout.width, layout.height) == (792, 612)


def test_metadata():
    done = E.set_meta(Pdf(sample(1)), title="Zażółć gęślą", author="")
    assert Pdf(done).metadata() == {"title": "Zażółć gęślą"}
    for bad in ({}, {"colour": "x"}):
        with pytest.raises(E.Refused):
            E.set_meta(Pdf(sample(1)), **bad)


# --- stamps, marks, forms, images ----------------------------------------------------------------------------------


def test_stamps():
    data = sample(3)
    footer, report = E.stamp(Pdf(data), "{page}/{pages}", position="footer")
    assert "2/3" in texts(footer)[1] and report["stamped_pages"] == [1, 2, 3]
    mark, _ = E.stamp(Pdf(data), "DRAFT (v2)", spec="1")
    assert "DRAFT (v2)" in texts(mark)[0] and "DRAFT" not in texts(mark)[1]
    twice, _ = E.stamp(Pdf(mark), "1", position="footer", spec="1")
    resources = Pdf(twice).get(Pdf(twice).pages()[0].info["Resources"])
    states = [Pdf(twice).get(v)["ca"] for v in resources["ExtGState"].values()]
    assert sorted(states) == [0.25, 1] and len(resources["Font"]) >= 2 and "DRAFT" in texts(twice)[0]
    under, report = E.stamp(Pdf(data), "seen", below="keyword")
    [first] = [p for p in report["placed_by"] if p["page"] == 1]
    seen = next(w for w in words(under) if w.text == "seen")
    assert first["matches"] == 1 and abs(seen.x0 - 252.1) < 0.1 and seen.y0 > 75.6 and first["words_under_it"] == 0
    over, report = E.stamp(Pdf(data), "mmmmmmmmmmmm", x=100, y=58)
    assert [w for w in words(over) if w.text.startswith("mmm")]
    for bad in ({"text": "x", "opacity": 2}, {"text": "x", "image": b"y"}, {}, {"text": "a\nb"}, {"text": "x", "x": 1}, {"text": "x", "below": "no such"}, {"text": "x", "gap": 1.0}, {"text": "x", "color": "red"}):
        with pytest.raises(E.Refused):
            E.stamp(Pdf(data), **bad)
    with pytest.raises(Unsupported):
        E.stamp(Pdf(data), "日本")


def test_picture_stamps_keep_transparency():
    png = E.write_png(2, 1, 4, bytes([255, 0, 0, 255, 0, 255, 0, 0]))
    done, _ = E.stamp(Pdf(sample(1)), image=png, anchor="top-left", width=100)
    pdf = Pdf(done)
    [(_, image, box)] = interpret(pdf, pdf.pages()[0]).images
    assert [round(v) for v in box] == [24, 24, 124, 74] and pdf.decode(image) == bytes([255, 0, 0, 0, 255, 0]) and pdf.decode(pdf.get(image.info["SMask"])) == bytes([255, 0])
    assert E.read_png(png)[:2] == (2, 1) and E.read_png(E.write_png(1, 2, 1, bytes([7, 9])))[2] == bytes([7] * 3 + [9] * 3)


@pytest.mark.parametrize("kind", ["highlight", "underline", "strikeout", "box", "note", "link"])
def test_annotations(kind):
    done, report = E.annotate(Pdf(sample(2)), kind=kind, texts=("Keyword",), rects=("2:10,10,50,30",), comment="look", url="https://example.com/x", author="me")
    assert report["added"] == 3 and report["pages"] == [{"page": 1, "added": 1}, {"page": 2, "added": 2}]
    found = Pdf(done).annotations()
    assert len(found) == 3 and found[0]["comment"] == "look" and found[0]["author"] == "me" and (found[0]["url"] == "https://example.com/x") == (kind == "link")
    if kind in ("box", "highlight"):
        assert E._tenths(found[1]["rect"]) == [10, 10, 50, 30]
    assert texts(done) == texts(sample(2))


def test_annotate_refuses():
    for bad in ({}, {"texts": ("nowhere",)}, {"kind": "link", "texts": ("Page",)}, {"kind": "note", "texts": ("Page",)}, {"rects": ("1:5,5,5,9",)}, {"rects": ("7:1,1,2,2",)}, {"rects": ("x",)}):
        with pytest.raises(E.Refused):
            E.annotate(Pdf(sample(1)), **bad)


def test_forms_listed_and_filled():
    fields = Pdf(form()).fields()
    assert [(f["name"], f["type"], f["value"], f["options"], f["read_only"], f["page"]) for f in fields] == [
        ("name", "text", None, [], False, 1), ("agree", "checkbox", None, ["Yes"], False, 1), ("color", "choice", None, ["red", "green", "blue"], False, 1), ("notes", "text", None, [], False, 1),
    ]
    done, report = E.fill(Pdf(form()), {"name": "Ada Lovelace", "agree": "true", "color": "green", "notes": "one\ntwo"})
    assert [f["value"] for f in Pdf(done).fields()] == ["Ada Lovelace", "Yes", "green", "one\ntwo"] and b"(Ada Lovelace)" in done and report["filled"][1]["value"] == "Yes"
    off, _ = E.fill(Pdf(done), {"agree": "no"})
    assert Pdf(off).fields()[1]["value"] == "Off"
    for values, message in (({"nmae": "x"}, "available: name, agree, color, notes"), ({"color": "mauve"}, "options: red, green"), ({"agree": "maybe"}, "true or false"), ({}, "no field values")):
        with pytest.raises(E.Refused, match=message):
            E.fill(Pdf(form()), values)
    with pytest.raises(E.Refused, match="no form fields"):
        E.fill(Pdf(sample(1)), {"a": "b"})


def test_wrap_and_drawing():
    assert E.wrap("aa bb cc\ndd", 26, 10) == ["aa bb", "cc", "dd"] and E.wrap("wide", 1, 10) == ["wide"]


def test_images():
    [found] = E.images(Pdf(form()))
    assert (found["width"], found["height"], found["kind"]) == (2, 2, "png") and E.read_png(found["content"])[2] == PIXELS
    assert E.images(Pdf(form()), min_size=10) == []


def test_indexed_and_packed_samples():
    pdf = Pdf(sample(1))
    indexed = Stream({"Width": 3, "Height": 1, "BitsPerComponent": 2, "ColorSpace": [Name("Indexed"), Name("DeviceRGB"), 2, bytes([1, 2, 3, 4, 5, 6, 7, 8, 9])]}, bytes([0b00011000]))
    assert E.samples(pdf, indexed) == (3, 1, 3, bytes([1, 2, 3, 4, 5, 6, 7, 8, 9]))
    mask = Stream({"Width": 4, "Height": 1, "ImageMask": True}, bytes([0b10100000]))
    assert E.samples(pdf, mask) == (4, 1, 1, bytes([255, 0, 255, 0]))
    assert E.export_image(pdf, Stream({"Filter": Name("DCTDecode")}, b"\xff\xd8x"))[0] == "jpg"
    with pytest.raises(Unsupported):
        E.samples(pdf, Stream({"Width": 1, "Height": 1, "ColorSpace": Name("DeviceCMYK")}, b"1234"))


# --- redaction and replacing ---------------------------------------------------------------------------------------


def test_redaction_takes_text_out_and_keeps_the_rest_in_place():
    before = {w.text: w.x0 for w in words(sample(1))}
    done, report = R.redact(Pdf(sample(1)), texts=("the sample",))
    after = {w.text: w.x0 for w in words(done)}
    assert b"sample" not in done and set(before) - set(after) == {"the", "sample."} and after["."] > 0 and all(abs(after[w] - before[w]) < 0.01 for w in ("Page", "of", "Keyword"))
    assert report["text_matches"] == 1 and report["verified"] and report["pages"][0]["glyphs_removed"] == 9
    part, _ = R.redact(Pdf(sample(1)), texts=("word",))
    assert texts(part)[0].startswith("Page 1 of the sample. Key")


def test_redaction_by_area_with_pictures_drawings_and_marks():
    marked, _ = E.annotate(Pdf(form()), rects=("1:310,400,350,440",), kind="box")
    done, report = R.redact(Pdf(marked), rects=("1:300,392,350,492",))
    page = report["pages"][0]
    assert page["images_blanked"] == 1 and page["annotations_removed"] == 1
    pdf = Pdf(done)
    image = next(x for _, x, _ in interpret(pdf, pdf.pages()[0]).images)
    assert pdf.decode(image) == bytes([0, 0, 0, 0, 255, 0, 0, 0, 0, 255, 255, 255])
    drawn = "10 10 5 5 re f 200 200 300 300 re f BT /F1 12 Tf 72 700 Td (x) Tj ET"
    _, report = R.redact(Pdf(build([drawn])), rects=("1:0,770,40,790",))
    assert report["pages"][0]["paths_removed"] == 1


def test_redaction_reaches_into_forms_without_touching_other_pages():
    def more(out):
        body = Stream({"Type": Name("XObject"), "Subtype": Name("Form"), "BBox": [0, 0, 612, 792], "Resources": {}}, b"BT /F1 12 Tf 72 600 Td (secret words) Tj ET")
        return {"XObject": {"Fm": out.add(body)}}

    data = build(["/Fm Do", "/Fm Do"], resources=more)
    done, _ = R.redact(Pdf(data), texts=("secret",), spec="1")
    assert texts(done) == ["words", "secret words"]


def test_redaction_beside_the_pages():
    def extra(out, refs):
        from papyra.sources.pdf_writer import outline_tree

        return {"Metadata": out.add(Stream({"Type": Name("Metadata")}, b"<x>Keyword</x>")), "Outlines": outline_tree(out, [(1, "A Keyword here", [refs[0]])])}

    data = build(["BT /F1 12 Tf 72 700 Td (Keyword) Tj ET"], extra, info={"Title": b"The Keyword", "Author": b"Ada"})
    done, report = R.redact(Pdf(data), texts=("keyword",))
    assert Pdf(done).metadata() == {"title": "The ", "author": "Ada"} and Pdf(done).outline()[0][1] == "A  here" and "Metadata" not in Pdf(done).catalog
    assert report["beside_pages"] == {"metadata_fields_cleaned": ["Title"], "xmp_metadata_removed": True, "bookmarks_cleaned": 1, "attachments_holding_the_text": []}
    for bad in ({}, {"texts": ("nowhere at all",)}):
        with pytest.raises(E.Refused):
            R.redact(Pdf(data), **bad)


def test_inline_pictures_are_blanked():
    page = b"q 10 0 0 10 100 100 cm BI /W 2 /H 1 /CS /G /BPC 8 ID \xff\x80 EI Q BT /F1 12 Tf 72 700 Td (text) Tj ET"
    done, report = R.redact(Pdf(build([page])), rects=("1:100,682,105,692",))
    pdf = Pdf(done)
    layout = interpret(pdf, pdf.pages()[0])
    assert report["pages"][0]["images_blanked"] == 1 and pdf.decode(layout.images[0][1]) == bytes([0, 0x80]) and layout.words[0].text == "text"


def test_replace_moves_what_follows_along():
    before = {w.text: w.x0 for w in words(sample(1))}
    done, report = R.replace_text(Pdf(sample(1)), "sample", "much longer specimen")
    after = {w.text: w.x0 for w in words(done)}
    assert texts(done)[0] == "Page 1 of the much longer specimen. Keyword alpha-1." and after["Keyword"] > before["Keyword"] and after["Page"] == before["Page"]
    assert report["replacements"] == 1 and report["pages"][0]["in_original_font"] == 1 and report["pages"][0]["overflow_pt"] == 0
    swap, _ = R.replace_text(Pdf(sample(1)), r"(\w+) of the (\w+)", "$2 of ${1}", regex=True)
    assert texts(swap)[0] == "Page sample of 1. Keyword alpha-1."


def test_replace_draws_together_and_leaves_other_cells():
    cells = "BT /F1 10 Tf 1 0 0 1 72 700 Tm (Bolt) Tj 1 0 0 1 110 700 Tm (40) Tj ET"
    done, report = R.replace_text(Pdf(build([cells])), "Bolt", "Hexagon bolt")
    found = {w.text: w for w in words(done)}
    assert found["40"].x0 == 110 and report["pages"][0]["lines_narrowed"] == 1 and report["pages"][0]["overflow_pt"] > 0
    for find, new in (("", "x"), ("Bolt", "a\nb"), ("nowhere", "x")):
        with pytest.raises(E.Refused):
            R.replace_text(Pdf(build([cells])), find, new)


def test_replace_reaches_fields_and_comments():
    filled, _ = E.fill(Pdf(form()), {"name": "Ada form"})
    noted, _ = E.annotate(Pdf(filled), rects=("1:1,1,20,20",), kind="note", comment="a form note")
    done, report = R.replace_text(Pdf(noted), "form", "paper")
    assert report["form_fields"] == ["name"] and report["annotation_comments"] == 1 and report["replacements"] == 1
    assert Pdf(done).fields()[0]["value"] == "Ada paper" and Pdf(done).annotations()[0]["comment"] == "a paper note"


# --- protection ----------------------------------------------------------------------------------------------------


def test_ciphers():
    plain = bytes.fromhex("00112233445566778899aabbccddeeff")
    assert Aes(bytes(range(16))).encrypt(plain, bytes(16)).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    assert Aes(bytes(range(32))).encrypt(plain, bytes(16)).hex() == "8ea2b7ca516745bfeafc49904b496089"
    assert Aes(bytes(range(32))).decrypt(Aes(bytes(range(32))).encrypt(plain * 3, plain), plain) == plain * 3
    assert rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3" and crypt.unpad(crypt.pad(b"abc")) == b"abc"


def test_encrypt_and_decrypt():
    locked = E.encrypt(Pdf(sample(2)), owner_password="own", user_password="user", deny_print=True)
    assert b"alpha-1" not in locked
    for wrong in ("", "nope"):
        with pytest.raises(WrongPassword):
            Pdf(locked, wrong)
    assert texts(locked, "user") == texts(locked, "own") == texts(sample(2)) and Pdf(locked, "own").security.is_owner
    assert Pdf(locked, "user").security.info["P"] & crypt.PRINT == 0 and Pdf(locked, "user").metadata()["title"] == "Sample"
    opened = E.decrypt(Pdf(locked, "user"))
    assert Pdf(opened).security is None and texts(opened) == texts(sample(2))
    edited = E.rotate(Pdf(locked, "user"), 90)
    with pytest.raises(WrongPassword):
        Pdf(edited)
    assert Pdf(edited, "own").pages()[0].rotation == 90
    with pytest.raises(E.Refused):
        E.decrypt(Pdf(sample(1)))


def test_damaged_files_that_are_protected_are_rebuilt_and_stay_so():
    locked = E.encrypt(Pdf(sample(2)), owner_password="own", user_password="user")
    at = locked.rindex(b"trailer")
    for broken in (locked.replace(b"startxref", b"startxxxx"), locked[:at] + locked[at:].replace(b"trailer", b"trailxx"), locked[: locked.rindex(b"startxref")]):
        with pytest.raises(WrongPassword):
            Pdf(broken)
        pdf = Pdf(broken, "user")
        assert pdf.repaired and texts(broken, "user") == texts(sample(2)) and pdf.metadata()["title"] == "Sample"
        again = E.rotate(pdf, 90)
        with pytest.raises(WrongPassword):
            Pdf(again)
        assert texts(again, "own") == texts(sample(2))


@pytest.mark.parametrize(("version", "revision", "method", "length"), [(1, 2, "V2", 5), (2, 3, "V2", 16), (4, 4, "AESV2", 16)])
def test_older_protections_are_read(version, revision, method, length):
    """Files made here by the steps that the standard gives for the user's password."""
    import struct

    ident, owner, p = b"0123456789abcdef", bytes(range(32)), -44
    key = hashlib.md5(crypt.FILL + owner + struct.pack("<i", p) + ident).digest()
    for _ in range(50 if revision > 2 else 0):
        key = hashlib.md5(key[:length]).digest()
    key = key[:length]
    if revision == 2:
        user = rc4(key, crypt.FILL)
    else:
        user = rc4(key, hashlib.md5(crypt.FILL + ident).digest())
        for n in range(1, 20):
            user = rc4(bytes(b ^ n for b in key), user)
        user += bytes(16)
    info = {"Filter": "Standard", "V": version, "R": revision, "Length": 8 * length, "P": p, "O": owner, "U": user}
    if version == 4:
        info |= {"CF": {"StdCF": {"CFM": method}}, "StmF": "StdCF", "StrF": "StdCF"}
    security = Security.open(info, ident, "")
    stored = security.encrypt(b"some text", 7, 0, stream=True)
    assert stored != b"some text" and security.decrypt(stored, 7, 0, stream=True) == b"some text"
    with pytest.raises(WrongPassword):
        Security.open(info | {"U": bytes(32)}, ident, "")
    with pytest.raises(WrongPassword, match="crypt filter"):
        Security.open(info | {"V": 4, "R": 4, "StmF": "Gone", "StrF": "Gone", "CF": {}}, ident, "")


# --- signatures ----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def identities():
    root = S.PrivateKey.make("rsa", 1024)
    top = S.Certificate.make("Root", root, authority=True)
    own, other = S.PrivateKey.make(), S.PrivateKey.make("rsa", 1024)
    return top, (S.Certificate.make("Ada Signer", own, issuer=(top, root)), own), (S.Certificate.make("Bob", other), other)


def test_sign_and_verify(identities):
    top, (cert, key), (cert2, key2) = identities
    data = sample(2)
    signed, report = S.sign(Pdf(data), cert=cert.pem(), key=key.pem(), reason="Approval", location="Kraków")
    assert signed.startswith(data) and report["signer"] == "Ada Signer" and report["earlier_signatures"] == 0 and texts(signed) == texts(data)
    [s] = S.signatures(signed, trust=top.pem())
    assert s["valid"] and s["document_unchanged"] and s["signature_genuine"] and s["covers_whole_document"] and s["trusted"] and (s["field"], s["reason"], s["location"]) == ("Signature1", "Approval", "Kraków")
    forged = signed.replace(b"alpha-1", b"alpha-7", 1)
    [s] = S.signatures(forged)
    assert not s["valid"] and s["document_unchanged"] is False and s["signature_genuine"] is True
    twice, report = S.sign(Pdf(signed), cert=cert2.pem(), key=key2.pem(), visible="1:100,100,300,150")
    assert report["earlier_signatures"] == 1 and report["algorithm"].startswith("RSA")
    found = S.signatures(twice, trust=top.pem())
    assert [(x["signer"], x["valid"], x["covers_whole_document"], x["trusted"]) for x in found] == [("Ada Signer", True, False, True), ("Bob", True, True, False)]
    assert "nothing leads" in found[1]["trust"] and S.signatures(data) == []
    with pytest.raises(E.Refused, match="none of the certificates"):
        S.sign(Pdf(data), cert=cert.pem(), key=key2.pem())


def test_certificates_out_of_date_are_not_trusted(identities):
    import datetime as dt

    top, _, _ = identities
    key = S.PrivateKey.make()
    old = S.Certificate.make("Old", key, days=1, since=dt.datetime(2001, 1, 1, tzinfo=dt.timezone.utc))
    signed, _ = S.sign(Pdf(sample(1)), cert=old.pem(), key=key.pem())
    [s] = S.signatures(signed, trust=old.pem())
    assert s["valid"] and not s["trusted"] and "not in date" in s["trust"]


def test_odd_signatures():
    assert S.der_length(b"\x30\x82\x01\x00") == 260 and S.der_length(b"\x30") is None and S.der_length(b"\x30\x05") == 7
    assert S.verify(b"x" * 50, [0, 10, 20, 99], b"")["problem"] == "the byte range lies outside the file"
    assert S.verify(b"x" * 50, [0, 10, 20, 30], b"\x30\x03abc")["problem"] == "the signature is not a readable CMS structure"
    assert S.raw_signatures(b"/ByteRange [0 23 29 9] <4142> and more") == [([0, 23, 29, 9], b"AB")]
    point = S._times(S.N, S.G)
    assert point is None and S._times(1, S.G) == S.G


# --- inspection ----------------------------------------------------------------------------------------------------


def hostile():
    def extra(out, refs):
        script = out.add({"S": Name("JavaScript"), "JS": b"app.alert(1)"})
        held = out.add(Stream({"Type": Name("EmbeddedFile")}, b"MZ\x90\0"))
        out.objects[refs[0].number - 1]["Annots"] = [
            out.add({"Type": Name("Annot"), "Subtype": Name("Link"), "Rect": [0, 0, 9, 9], "A": {"S": Name("URI"), "URI": b"https://Example.com/x?y"}}),
            out.add({"Type": Name("Annot"), "Subtype": Name("Link"), "Rect": [0, 0, 9, 9], "A": {"S": Name("Launch"), "F": b"cmd.exe"}}),
            out.add({"Type": Name("Annot"), "Subtype": Name("Screen"), "Rect": [0, 0, 9, 9]}),
        ]
        return {"OpenAction": script, "AA": {"WC": script}, "Names": {"EmbeddedFiles": {"Names": [b"a", {"F": b"a.exe", "EF": {"F": held}}]}}, "AcroForm": {"XFA": out.add(Stream({}, b"<x/>")), "Fields": []}}

    return build(["BT /F1 12 Tf 72 700 Td (Hello) Tj ET"], extra)


def test_sanitize_removes_and_proves():
    done, report = I.sanitize(Pdf(hostile()))
    assert report["verified"] and report["removed"]["actions"] >= 3 and report["removed"]["attachments"] >= 1 and report["removed"]["xfa"] == 1 and report["removed"]["media"] == 1
    assert I.kinds_left(Pdf(done), done) == set() and texts(done) == ["Hello"] and Pdf(done).annotations()[0]["url"] == "https://Example.com/x?y"
    kept, report = I.sanitize(Pdf(hostile()), keep=("attachments", "xfa"))
    assert I.kinds_left(Pdf(kept), kept) == {"embedded_file", "xfa"} and report["kept"] == ["attachments", "xfa"]
    for bad in (("nothing",), tuple(I.GROUPS)):
        with pytest.raises(E.Refused):
            I.sanitize(Pdf(hostile()), keep=bad)


def test_facts_of_the_bytes():
    data = sample(1)
    facts = pdf_inspect.raw_facts(b"junk" + data + b"x" * 2000)
    assert facts["header_offset"] == 4 and facts["revisions"] == 1 and facts["bytes_after_end"] == 2001
    odd = pdf_inspect.raw_facts(data + b"\n1 0 obj\n<< /J#61vaScript 1 /#4Caunch 2 /A#20b 3 >>\nendobj\n")
    assert odd["redefined"] == 1 and odd["names"] == {"JavaScript": 1, "Launch": 1} and {e["means"] for e in odd["escaped"]} == {"JavaScript", "Launch"}
    assert pdf_inspect.raw_facts(b"stream\n/JavaScript endstream /Launch")["names"] == {"Launch": 1}
    locked = E.encrypt(Pdf(data), owner_password="o")
    assert pdf_inspect.trailer_has_encrypt(locked) and not pdf_inspect.trailer_has_encrypt(data) and pdf_inspect.stated_encryption(locked)
    assert pdf_inspect.info_reference(data) and pdf_inspect.expands(__import__("zlib").compress(bytes(5 << 20)), 1 << 20) > 1 << 20


def test_cycles():
    data = build(["", ""])
    assert not pdf_inspect.cyclic_pages(Pdf(data))
    pdf = Pdf(data)
    tree = pdf.get(pdf.catalog["Pages"])
    tree["Kids"].append(pdf.catalog["Pages"])
    assert pdf_inspect.cyclic_pages(pdf) and len(pdf.pages()) == 2


def test_only_what_is_reached_is_written():
    out = Writer()
    root, tree = out.add(), out.add()
    out.add(b"nobody refers to this")
    out.set(tree, {"Type": Name("Pages"), "Kids": [], "Count": 0})
    out.set(root, {"Type": Name("Catalog"), "Pages": tree})
    data, unused = save(Pdf(out.finish(root).replace(b"/Kids []", b"/Kids []")))
    assert unused == 1 and b"nobody" not in data


# --- making --------------------------------------------------------------------------------------------------------


def test_markdown_is_set():
    md = "# Quarterly report\n\nRevenue grew **12%** in *Q3*, see [the sheet](https://example.com/q3).\n\n- first point\n- second point\n\n| Item | Qty |\n| --- | --- |\n| Bolt M8 | 40 |\n\n```\nlet x = 1;\n```\n"
    from papyra.operators.tables import tables_on

    data, report = create(md)
    pdf = Pdf(data)
    layout = interpret(pdf, pdf.pages()[0])
    text = running_text(layout.words)
    assert report["pages"] == 1 and report["title"] == "Quarterly report" == pdf.metadata()["title"]
    for said in ("Revenue grew 12% in Q3, see the sheet.", "first point", "second point", "let x = 1;"):
        assert said in text
    assert [(t.method, t.rows) for t in tables_on(layout)] == [("lines", [["Item", "Qty"], ["Bolt M8", "40"]])]
    assert [a["url"] for a in pdf.annotations()] == ["https://example.com/q3"] * 2
    by_text = {w.text: w for w in layout.words}
    assert by_text["Quarterly"].size > 1.5 * by_text["Revenue"].size and by_text["12%"].bold and by_text["Q3,"].italic and by_text["first"].font == "Helvetica"


def test_long_text_breaks_pages_and_bad_input_is_refused():
    body = "# Long\n\n" + "".join(f"Paragraph number {k} with enough words to fill a line.\n\n" for k in range(1, 121))
    data, report = create(body, page_size="letter")
    assert report["pages"] >= 4 and Pdf(data).pages()[0].box == [0, 0, 612, 792] and "Paragraph number 120 " in " ".join(texts(data))
    for bad in ({"markdown": "![x](https://e.com/a.png)"}, {"markdown": "x", "font_size": 99.0}, {"markdown": "x", "margin": 300.0}, {"markdown": "![x](gone.png)"}):
        with pytest.raises(E.Refused):
            create(**bad)
    with pytest.raises(Unsupported):
        create("漢字")
    picture, _ = create("![x](a.png)", image_of=lambda s: E.write_png(3, 2, 3, bytes(18)))
    assert len(interpret(Pdf(picture), Pdf(picture).pages()[0]).images) == 1


def test_html_inside_markdown():
    md = '<h1>Offer</h1>\n<p>Dear <b>customer</b>, see <a href="https://e.com/t">the terms</a>.</p>\n\n<table>\n<tr><th>Part<th>Price\n<tr><td>Bolt</td><td>12</td></tr>\n</table>\n\n<ul><li>first<li>second</ul>\n\nPlain *Markdown*, with <blink>one</blink> odd tag &amp; more.'
    blocks, ignored = document(md)
    assert ignored == 1 and [b.kind for b in blocks] == ["text", "text", "table", "list", "text"]
    assert to_markdown(blocks) == "# Offer\n\nDear **customer**, see [the terms](https://e.com/t).\n\n| **Part** | **Price** |\n| --- | --- |\n| Bolt | 12 |\n\n- first\n- second\n\nPlain *Markdown*, with one odd tag & more."


@pytest.mark.parametrize(("source", "markdown"), [
    ("<p>a<p>b", "a\n\nb"), ("<script>x</script>y", "y"), ("<title>t</title><h2>h</h2>", "## h"), ("<pre>a\n  b</pre>", "```\na\n  b\n```"), ("a<br>b", "a\\\nb"),
    ("<blockquote><p>q</p></blockquote>", "> q"), ("<ol><li>a</li><li>b<ul><li>c</li></ul></li></ol>", "1. a\n2. b\n\n   - c"), ("x<!-- no -->y", "xy"), ("1 < 2 &lt; 3", "1 < 2 < 3"), ("", ""),
])
def test_html_as_markdown(source, markdown):
    assert to_markdown(html_document(source)[0]) == markdown


@pytest.mark.parametrize(("source", "kinds"), [
    ("Title\n===\n\ntext", ["text", "text"]), ("1. a\n2. b\n   - c", ["list"]), ("> q\n> r", ["quote"]), ("***\n", ["rule"]), ("    code\n", ["code"]), ("~~~\nx\n~~~", ["code"]),
    ("a \\* b\n\n`x*y`", ["text", "text"]), ("| a | b |\n|---|---|\n| 1 |", ["table"]), ("", []),
])
def test_markdown_blocks(source, kinds):
    assert [b.kind for b in document(source)[0]] == kinds


def test_looks_reach_the_page():
    page = "<style>h1 { color: #1a4d8f; text-align: center } .note { background: #fff3cd; font-size: 8pt } td.num { text-align: right }</style>\n\n<h1>Report</h1>\n\n<p class=\"note\">Figures are <u>open</u>.</p>\n\n<p style=\"text-align: right\">Signed <span style=\"color: red\">today</span></p>\n\nPlain <mark>marked</mark> text.\n"
    data, _ = create(page)
    content = Pdf(data).content(Pdf(data).pages()[0]).decode("latin-1")
    for paint in ("0.102 0.302 0.561 rg", "1.000 0.000 0.000 rg", "1.000 0.953 0.804 rg", "1.000 1.000 0.000 rg"):
        assert paint in content
    found = {w.text: w for w in words(data)}
    right = 595.28 - 56
    assert abs((found["Report"].x0 - 56) - (right - found["Report"].x1)) < 0.5 and abs(found["today"].x1 - right) < 0.5 and found["Figures"].size == 8 and found["Plain"].size == 11


def test_column_widths():
    assert column_widths([10, 20], [5, 5], 100) == [10, 20] and column_widths([80, 120], [20, 20], 100) == [20 + 60 / 160 * 60, 20 + 100 / 160 * 60]
    assert sum(column_widths([300, 300], [100, 300], 100)) == pytest.approx(100)


def test_lines_file_grows_with_its_lines():
    data = lines_file([[f"line {k}" for k in range(200)]], outline=[(1, "all", 1)], links=[(1, [72, 72, 100, 84], "https://e.com")])
    assert len(texts(data)[0].splitlines()) == 200 and Pdf(data).outline() == [(1, "all", 1)] and E._tenths(Pdf(data).annotations()[0]["rect"]) == [72, 72, 100, 84]


def test_font_encodes_what_it_has():
    font = Font(Pdf(sample(1)), {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica")})
    assert font.encode("Aé") == b"A\xe9" and font.encode("日") is None


def test_recognised_words_become_a_layer_that_is_not_seen():
    done = E.recognised(Pdf(sample(2)), {2: [("Scanned", [100, 200, 180, 214]), ("text", [185, 200, 215, 214])]})
    found = [w for w in words(done, 2) if w.invisible]
    assert [w.text for w in found] == ["Scanned", "text"] and [round(v) for v in (found[0].x0, found[0].y0, found[0].x1, found[0].y1)] == [100, 200, 180, 214]
    with pytest.raises(E.Refused):
        E.recognised(Pdf(sample(1)), {4: []})


def test_maps_and_covers():
    codes = {k: chr(0x400 + k) for k in range(1, 150)}
    font = Font(Pdf(sample(1)), {"ToUnicode": Stream({}, E.to_unicode(codes))})
    assert font.texts == codes and E.to_unicode(codes).count(b"beginbfchar") == 2
    assert E.cover(set("abcd"), {"x": set("ab"), "y": set("bcd"), "z": set()}) == ["y", "x"] and E.cover(set("a"), {}) == []
