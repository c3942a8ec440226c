"""PDF files as DataFrames: one table for each thing a file holds, read by one Arrow pass a table.

``files`` has doc_id (string), content (binary) and, optionally, password. What cannot be read is data and not an
error: the documents table says why, the others have no rows for that file, and a page that fails has its error in a
column. Only the asked table is made, and a file is never split; its bytes leave the JVM once.
"""

from __future__ import annotations

import re
import signal
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import pdf_edit, pdf_inspect
from .crypt import WrongPassword
from .pdf import Damaged, Pdf, Unsupported
from .pdf_text import interpret, line_text, lines_of, running_text

#: Rows that leave Python in one batch.
BATCH_ROWS = 4096
#: Seconds that one table of one file may take; a file that takes longer has that as its error.
SECONDS = 300.0
OUT_OF_TIME = "ran out of time"

_BOX = "x0 double, y0 double, x1 double, y1 double"


def read_files(spark: SparkSession, path: str, *, glob: str = "*.pdf") -> DataFrame:
    """Files below a path: doc_id is the address of the file."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return found.select(F.col("path").alias("doc_id"), "content")


def _documents(pdf: Pdf) -> Iterator[dict[str, Any]]:
    pages = pdf.pages()
    sizes = [interpret_size(p) for p in pages]
    yield {
        "size_bytes": len(pdf.data), "pdf_version": pdf.version, "pages": len(pages), "encrypted": pdf.security is not None, "repaired": pdf.repaired,
        "damage": pdf.damage(), "width": sizes[0][0] if sizes else None, "height": sizes[0][1] if sizes else None,
        "uniform_page_size": len(set(sizes)) <= 1, "metadata": pdf.metadata(), "outline_entries": len(pdf.outline()), "form_fields": len(pdf.fields()),
        "error": None,
    }


def interpret_size(page) -> tuple[float, float]:
    """Width and height of a page as a reader sees it."""
    w, h = page.box[2] - page.box[0], page.box[3] - page.box[1]
    return (h, w) if page.rotation % 180 else (w, h)


def _pages(pdf: Pdf) -> Iterator[dict[str, Any]]:
    for page in pdf.pages():
        w, h = interpret_size(page)
        row = {"page": page.number, "obj": page.ref.number if page.ref else None, "width": w, "height": h, "rotation": page.rotation, "text": None, "error": None}
        try:
            row["text"] = running_text(interpret(pdf, page).words)
        except (Damaged, Unsupported) as error:
            row["error"] = str(error)
        yield row


def _layouts(pdf: Pdf) -> Iterator[tuple[int, Any]]:
    for page in pdf.pages():
        try:
            yield page.number, interpret(pdf, page)
        except (Damaged, Unsupported):
            continue


def _words(pdf: Pdf) -> Iterator[dict[str, Any]]:
    for n, layout in _layouts(pdf):
        for k, w in enumerate(layout.words):
            yield {
                "page": n, "seq": k, "text": w.text, "read": line_text([w]), "x0": w.x0, "y0": w.y0, "x1": w.x1, "y1": w.y1, "size": w.size, "font": w.font,
                "bold": w.bold, "italic": w.italic, "invisible": w.invisible, "drawn": w.drawn, "page_width": layout.width, "page_height": layout.height,
            }


def _lines(pdf: Pdf) -> Iterator[dict[str, Any]]:
    for n, layout in _layouts(pdf):
        for k, line in enumerate(lines_of(layout.words)):
            box = [min(w.x0 for w in line), min(w.y0 for w in line), max(w.x1 for w in line), max(w.y1 for w in line)]
            x0, y0, x1, y1 = pdf_edit._tenths(box)
            first = line[0]
            yield {
                "page": n, "line": k + 1, "text": line_text(line), "x0": x0, "y0": y0, "x1": x1, "y1": y1, "size": pdf_edit._tenths([first.size])[0],
                "font": first.font, "bold": first.bold, "italic": first.italic,
            }


def _rules(pdf: Pdf) -> Iterator[dict[str, Any]]:
    for n, layout in _layouts(pdf):
        for flat, at, a, b in layout.rules:
            yield {"page": n, "horizontal": flat, "at": at, "from": a, "to": b}


def _tables(pdf: Pdf) -> Iterator[dict[str, Any]]:
    from ..operators.tables import tables_on

    for n, layout in _layouts(pdf):
        for k, t in enumerate(tables_on(layout)):
            x0, y0, x1, y1 = pdf_edit._tenths(t.box)
            yield {
                "page": n, "n": k + 1, "x0": x0, "y0": y0, "x1": x1, "y1": y1, "rows": len(t.rows), "columns": len(t.rows[0]), "detected_by": t.method, "cells": t.rows,
            }


def _outline(pdf: Pdf) -> Iterator[dict[str, Any]]:
    for k, (level, title, page) in enumerate(pdf.outline()):
        yield {"seq": k + 1, "level": level, "title": title, "page": page}


def _annotations(pdf: Pdf) -> Iterator[dict[str, Any]]:
    for k, a in enumerate(pdf.annotations()):
        yield a | {"seq": k + 1, "rect": pdf_edit._tenths(a["rect"]) if a["rect"] else None}


def _fields(pdf: Pdf) -> Iterator[dict[str, Any]]:
    for k, f in enumerate(pdf.fields()):
        yield f | {"seq": k + 1}


def _destinations(pdf: Pdf) -> Iterator[dict[str, Any]]:
    names = pdf.destinations()
    numbers = {p.ref: p.number for p in pdf.pages() if p.ref}
    for name, x in names.items():
        yield {"name": name.decode("latin-1"), "page": pdf.target_page(x, numbers, names)}


def _images(pdf: Pdf) -> Iterator[dict[str, Any]]:
    yield from pdf_edit.images(pdf)


def _drawn(pdf: Pdf) -> Iterator[dict[str, Any]]:
    for n, layout in _layouts(pdf):
        for k, (key, x, box) in enumerate(layout.images):
            size = [int(v) if isinstance(v := pdf.get(x.info.get(a, x.info.get(b))), (int, float)) else None for a, b in (("Width", "W"), ("Height", "H"))]
            yield {"page": n, "draw_pos": k + 1, "key": str(key.number) if key is not None and hasattr(key, "number") else None, "width": size[0], "height": size[1]}


def _raw(data: bytes) -> Iterator[dict[str, Any]]:
    facts = pdf_inspect.raw_facts(data)
    yield facts | {"size_bytes": len(data)}


def _dictionaries(pdf: Pdf) -> Iterator[dict[str, Any]]:
    yield from pdf_inspect.dictionaries(pdf)


def _references(pdf: Pdf) -> Iterator[dict[str, Any]]:
    for a, b in pdf_inspect.references(pdf):
        yield {"src": a, "dst": b}


def _objects(pdf: Pdf) -> Iterator[dict[str, Any]]:
    for number in sorted(pdf.entries):
        x = pdf._quietly(number)
        yield {"obj": number, "kind": type(x).__name__.lower() if x is not None else None, "packed": pdf.entries[number][0] == "packed"}


def _reached(pdf: Pdf) -> Iterator[dict[str, Any]]:
    """Which objects the trailer leads to: what nothing refers to any more is not written again."""
    edges: dict[int, list[int]] = {}
    for a, b in pdf_inspect.references(pdf):
        edges.setdefault(a, []).append(b)
    seen, todo = set(), [0]
    while todo:
        for b in edges.get(todo.pop(), ()):
            if b not in seen:
                seen.add(b)
                todo.append(b)
    for number in sorted(pdf.entries):
        yield {"obj": number, "reached": number in seen}


def _structure(pdf: Pdf) -> Iterator[dict[str, Any]]:
    yield {"cyclic": pdf_inspect.cyclic_pages(pdf), "objects": len(pdf.entries), "pages": len(pdf.pages()), "parsed": True}


_RAW = (
    "size_bytes long, header_offset long, revisions int, bytes_after_end long, redefined int, names map<string,int>, "
    "escaped array<struct<written:string,means:string,times:int>>, trailer_encrypt boolean"
)
_DICTIONARY = (
    "obj int, keys array<string>, names array<string>, s string, subtype string, script string, uri string, target string, program string, parameters string, "
    "opens string, events array<string>, file_name string, file_head binary, file_size long, filters array<string>, stored long, expanded long, "
    "width double, height double, fax_columns double, fax_rows double"
)


def _nested(columns: str) -> str:
    """Columns as the fields of a struct."""
    return ", ".join(re.sub(r"^(\w+) ", r"\1: ", c.strip()) for c in re.split(r",(?![^<]*>)", columns))


def _inspection(data: bytes, password: str | None) -> Iterator[dict[str, Any]]:
    """All that a scan asks of a file, in one row: facts of the bytes always, records of dictionaries where it opens."""
    row: dict[str, Any] = {"raw": next(_raw(data)), "error": None, "encrypted": None, "cyclic": False, "dictionaries": []}
    names = [f.split(" ")[0] for f in _DICTIONARY.split(", ")]
    try:
        pdf = open_pdf(data, password)
        row["encrypted"], row["cyclic"] = pdf.security is not None, pdf_inspect.cyclic_pages(pdf)
        row["dictionaries"] = [{n: r.get(n) for n in names} for r in pdf_inspect.dictionaries(pdf)]
    except WrongPassword as error:
        row |= {"error": str(error), "encrypted": True}
    except _OutOfTime:
        raise
    except Exception as error:  # whatever a hostile file brings about is a finding
        row["error"] = str(error) if isinstance(error, (Damaged, Unsupported)) else "not a valid PDF"
    yield row


#: Per table its columns and what makes its rows.
TABLES: dict[str, tuple[str, Callable[[Any], Iterator[dict[str, Any]]]]] = {
    "documents": (
        "size_bytes long, pdf_version string, pages int, encrypted boolean, repaired boolean, damage string, width double, height double, "
        "uniform_page_size boolean, metadata map<string,string>, outline_entries int, form_fields int, error string",
        _documents,
    ),
    "pages": ("page int, obj int, width double, height double, rotation int, text string, error string", _pages),
    "words": (
        f"page int, seq int, text string, read string, {_BOX}, size double, font string, bold boolean, italic boolean, invisible boolean, drawn string, "
        "page_width double, page_height double",
        _words,
    ),
    "lines": (f"page int, line int, text string, {_BOX}, size double, font string, bold boolean, italic boolean", _lines),
    "rules": ("page int, horizontal boolean, at double, from double, to double", _rules),
    "tables": (f"page int, n int, {_BOX}, rows int, columns int, detected_by string, cells array<array<string>>", _tables),
    "outline": ("seq int, level int, title string, page int", _outline),
    "annotations": ("seq int, page int, type string, rect array<double>, comment string, author string, url string, target_page int", _annotations),
    "fields": ("seq int, name string, type string, value string, options array<string>, read_only boolean, page int", _fields),
    "destinations": ("name string, page int", _destinations),
    "images": ("page int, n int, width int, height int, kind string, content binary, skipped string", _images),
    "drawn_images": ("page int, draw_pos int, key string, width int, height int", _drawn),
    "raw": (_RAW, _raw),
    "dictionaries": (_DICTIONARY, _dictionaries),
    "inspection": (f"error string, encrypted boolean, cyclic boolean, raw struct<{_nested(_RAW)}>, dictionaries array<struct<{_nested(_DICTIONARY)}>>", _inspection),
    "references": ("src int, dst int", _references),
    "objects": ("obj int, kind string, packed boolean", _objects),
    "reached": ("obj int, reached boolean", _reached),
    "structure": ("cyclic boolean, objects int, pages int, parsed boolean", _structure),
}


def open_pdf(data: bytes, password: str | None) -> Pdf:
    """A parsed file, or one of the errors that stand for a file which cannot be read."""
    try:
        return Pdf(data, password or "")
    except (WrongPassword, Damaged, Unsupported):
        raise
    except (ValueError, KeyError, IndexError, TypeError, AttributeError, RecursionError, OverflowError) as error:
        raise Damaged("not a valid PDF") from error


def _given(files: DataFrame) -> DataFrame:
    password = F.col("password").cast("string") if "password" in files.columns else F.lit(None).cast("string")
    return files.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("content"), password.alias("password"))


class _OutOfTime(Exception):
    """A file took longer than it may; not one of the errors that reading survives."""


@contextmanager
def deadline(seconds: float) -> Iterator[None]:
    """Inside, work that takes longer is broken off. Only where the interpreter can be interrupted, in its main thread."""
    if threading.current_thread() is not threading.main_thread():
        yield
        return

    def late(*_: Any) -> None:
        raise _OutOfTime(f"{OUT_OF_TIME} after {seconds:g} seconds")

    before = signal.signal(signal.SIGALRM, late)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def parse(files: DataFrame, table: str, *, seconds: float = SECONDS) -> DataFrame:
    """One of ``TABLES`` with doc_id. Null content is an empty file; other columns of ``files`` are left out.

    A file that takes longer than ``seconds`` gives no rows but the one of the documents table that says so."""
    columns, make = TABLES[table]
    schema = T.StructType.fromDDL("doc_id string, " + columns)
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])
    names = schema.names[1:]
    raw, whole = make is _raw, make is _inspection

    def rows(doc: str, data: bytes, password: str | None) -> Iterator[dict[str, Any]]:
        try:
            with deadline(seconds):
                found = list(make(data, password) if whole else make(data if raw else open_pdf(data, password)))
            yield from found
        except (_OutOfTime, WrongPassword, Damaged, Unsupported, ValueError, KeyError, IndexError, TypeError, AttributeError, RecursionError, OverflowError) as error:
            if whole:
                yield {"error": str(error), "dictionaries": []}
            if table == "documents":
                known = isinstance(error, (WrongPassword, Damaged, Unsupported, _OutOfTime))
                yield {"size_bytes": len(data), "encrypted": isinstance(error, WrongPassword) or None, "error": str(error) if known else "not a valid PDF"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict[str, Any]] = []
        for batch in batches:
            for k in range(batch.num_rows):
                doc, data, password = (batch.column(c)[k].as_py() for c in range(3))
                for row in rows(doc, data or b"", password):
                    out.append({"doc_id": doc, **{n: row.get(n) for n in names}})
                    if len(out) >= BATCH_ROWS:
                        yield pa.RecordBatch.from_pylist(out, arrow)
                        out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    return _given(files).mapInArrow(run, schema)


def edit(files: DataFrame, change: Callable[..., Any], **args: Any) -> DataFrame:
    """Every file changed by a function of ``pdf_edit`` or ``pdf_redact``: (doc_id, content, report, error).

    ``report`` is JSON. A file that cannot be read or changed has its reason in ``error`` and no content.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                doc, data, password = (batch.column(c)[k].as_py() for c in range(3))
                content = report = problem = None
                try:
                    with deadline(SECONDS):
                        found = change(open_pdf(data or b"", password), **args)
                    content, report = found if isinstance(found, tuple) else (found, {})
                    report = pdf_edit.report_json(report)
                except (_OutOfTime, ValueError, KeyError, IndexError, TypeError, AttributeError, RecursionError) as error:
                    problem = str(error) if isinstance(error, (ValueError, _OutOfTime)) else "the file cannot be changed"
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": [doc], "content": [content], "report": [report], "error": [problem]},
                    pa.schema([("doc_id", pa.string()), ("content", pa.binary()), ("report", pa.string()), ("error", pa.string())]),
                )

    return _given(files).mapInArrow(run, "doc_id string, content binary, report string, error string")


def write_files(files: DataFrame, folder: str, *, name: str = "doc_id", dry_run: bool = False) -> DataFrame:
    """Write (name, content) as files below ``folder``: (file, size_bytes, written).

    A file is written beside its place under a name of the attempt and then moved there, so that a reader never sees
    half of one and a repeated task leaves the same behind. A dry run only measures. Folders are made. Names must stay
    below ``folder``.
    """
    rows = files.select(F.col(name).cast("string").alias("name"), F.col("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs as pafs

        place, root = pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)
        for batch in batches:
            names, contents = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for n, data in zip(names, contents):
                parts = [p for p in (n or "").split("/") if p not in ("", ".")]
                if not parts or ".." in parts:
                    raise ValueError(f"'{n}' is no name below the folder")
                path = root.rstrip("/") + "/" + "/".join(parts)
                if not dry_run and data is not None:
                    place.create_dir(path.rpartition("/")[0], recursive=True)
                    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
                    with place.open_output_stream(temporary, compression=None) as out:
                        out.write(data)
                    place.move(temporary, path)
                yield pa.RecordBatch.from_pydict({"file": [path], "size_bytes": [len(data or b"")], "written": [not dry_run and data is not None]})

    return rows.mapInArrow(run, "file string, size_bytes long, written boolean")
