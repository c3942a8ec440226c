"""PDF files for the tests, made in memory."""

from __future__ import annotations

from papyra.sources.pdf import Name, Ref, Stream
from papyra.sources.pdf_writer import Writer, standard_font


def build(contents, extra=None, info=None, page=None, resources=None):
    """A file with a page for each content stream. ``extra(writer, pages)`` gives more entries of the catalog,
    ``page(writer, number)`` more entries of a page. Box and resources stand on the tree node."""
    out = Writer()
    root, tree = out.add(), out.add()
    own = {"Font": {"F1": out.add(standard_font())}, **(resources(out) if resources else {})}
    pages = []
    for k, content in enumerate(contents):
        data = content if isinstance(content, bytes) else content.encode("latin-1")
        pages.append(out.add({"Type": Name("Page"), "Parent": tree, "Contents": out.add(Stream({}, data)), **(page(out, k + 1) if page else {})}))
    out.set(tree, {"Type": Name("Pages"), "Kids": pages, "Count": len(pages), "MediaBox": [0, 0, 612, 792], "Resources": own})
    out.set(root, {"Type": Name("Catalog"), "Pages": tree, **(extra(out, pages) if extra else {})})
    return out.finish(root, out.add(info or {"Title": b"Sample", "Author": b"Ada"}))


def sample(pages=5):
    """Pages reading "Page N of the sample. Keyword alpha-N.", with an outline entry for the second."""

    def outline(out, refs):
        if len(refs) < 2:
            return {}
        top = out.add()
        item = out.add({"Title": b"Second chapter", "Parent": top, "Dest": [refs[1], Name("Fit")]})
        out.set(top, {"Type": Name("Outlines"), "First": item, "Last": item, "Count": 1})
        return {"Outlines": top}

    return build([f"BT /F1 18 Tf 72 720 Td (Page {n} of the sample. Keyword alpha-{n}.) Tj ET" for n in range(1, pages + 1)], outline)


PIXELS = bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 255, 255, 255])


def form():
    """A page with a text field, a check box, a choice, a text field of several lines and an image of two by two pixels."""
    fields = []

    def page(out, n):
        def widget(y, **more):
            fields.append(out.add({"Type": Name("Annot"), "Subtype": Name("Widget"), "Rect": [72, y, 272, y + 20], **more}))
            return fields[-1]

        look = {"N": {"Yes": out.add(Stream({"Subtype": Name("Form")}, b"")), "Off": out.add(Stream({"Subtype": Name("Form")}, b""))}}
        return {
            "Annots": [
                widget(700, FT=Name("Tx"), T=b"name", DA=b"/Helv 12 Tf 0 g"),
                widget(660, FT=Name("Btn"), T=b"agree", AP=look, AS=Name("Off")),
                widget(620, FT=Name("Ch"), T=b"color", Opt=[b"red", b"green", [b"b", b"blue"]], Ff=1 << 17, DA=b"/Helv 12 Tf 0 g"),
                widget(500, FT=Name("Tx"), T=b"notes", Ff=1 << 12, DA=b"/Helv 10 Tf 0 g"),
            ],
            "Resources": {
                "Font": {"F1": out.add(standard_font())},
                "XObject": {
                    "Im1": out.add(
                        Stream({"Type": Name("XObject"), "Subtype": Name("Image"), "Width": 2, "Height": 2, "ColorSpace": Name("DeviceRGB"), "BitsPerComponent": 8}, PIXELS)
                    )
                },
            },
        }

    def extra(out, pages):
        return {"AcroForm": {"Fields": list(fields), "DR": {"Font": {"Helv": out.add(standard_font())}}}}

    return build(["q 100 0 0 100 300 300 cm /Im1 Do Q BT /F1 12 Tf 72 750 Td (A form) Tj ET"], extra, page=page)


def ref(n):
    return Ref(n, 0)
