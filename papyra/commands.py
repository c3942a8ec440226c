"""The commands, one function each over a DataFrame of files (doc_id, content, optionally password).

Reading commands give the model tables of ``sources.files`` cut to what was asked; changing commands give (doc_id,
content, report, error), to be written with ``save``. Unknown arguments are errors. What needs an engine that this
build has not, raises ``Unsupported`` at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text as T
from .functions.pagespec import apply_spec, parse
from .operators import edit, images as image_names, inspect, layout as geometry, read
from .sources import files as S
from .sources import pdf_create, pdf_edit, pdf_redact, pdf_sign
from .sources.pdf import Unsupported


def _picked(rows: DataFrame, files: DataFrame, spec: str | None) -> DataFrame:
    """Rows of the pages that a spec names, once each; the spec counts the pages that a document has."""
    if spec is None:
        return rows
    pages = apply_spec(S.parse(files, "pages").select("doc_id", "page"), spec).select("doc_id", "page").distinct()
    return rows.join(pages, ["doc_id", "page"], "left_semi")


def info(files: DataFrame) -> DataFrame:
    """Facts of every file; ``error`` says why one cannot be read."""
    return S.parse(files, "documents")


def _text_pages(files: DataFrame) -> DataFrame:
    return S.parse(files, "pages").select("doc_id", "page", T.tidy("text").alias("text"), "error")


def text(files: DataFrame, *, pages: str | None = None, max_chars: int | None = None, from_char: int = 0) -> DataFrame:
    """Text of the pages within a budget of characters a document: (doc_id, pos, page, text, truncated)."""
    return read.read_text(_text_pages(files), max_chars=max_chars, from_char=from_char, spec=pages)


def resume(files: DataFrame, *, max_chars: int, pages: str | None = None, from_char: int = 0) -> DataFrame:
    """Where reading goes on: (doc_id, pos, page, char)."""
    return read.resume_at(_text_pages(files), max_chars=max_chars, from_char=from_char, spec=pages)


def raw_text(files: DataFrame) -> DataFrame:
    """Whole texts, pages joined by form feeds."""
    return read.raw_text(_text_pages(files))


def search(files: DataFrame, query: str, *, regex: bool = False, case_sensitive: bool = False, pages: str | None = None, context: int = 80, max_results: int = 50) -> DataFrame:
    """Matches with their page and surroundings."""
    return read.search(_text_pages(files), query, regex=regex, case_sensitive=case_sensitive, spec=pages, context=context, max_results=max_results)


def unreadable_pages(files: DataFrame) -> DataFrame:
    """(doc_id, page, error) of pages whose text cannot be read."""
    return S.parse(files, "pages").where("error is not null").select("doc_id", "page", "error")


def layout(files: DataFrame, *, level: str = "lines", pages: str | None = None) -> DataFrame:
    """Lines or words with their boxes, in points from the top left."""
    if level not in ("lines", "words"):
        raise ValueError("level must be lines or words")
    return _picked(S.parse(files, level), files, pages)


def tables(files: DataFrame, *, pages: str | None = None, format: str = "json") -> DataFrame:
    """Tables with their cells, or as Markdown or CSV."""
    if format not in ("json", "markdown", "csv"):
        raise ValueError("format must be json, markdown or csv")
    found = _picked(S.parse(files, "tables"), files, pages)
    if format == "csv":
        return found.withColumn("csv", F.array_join(F.transform("cells", geometry.csv_row), "\n")).drop("cells")
    if format == "markdown":
        rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.col("columns")))
        rows = F.transform("cells", geometry.markdown_row)
        return found.withColumn("markdown", F.array_join(F.concat(F.slice(rows, 1, 1), F.array(rule), F.slice(rows, 2, 1_000_000_000)), "\n")).drop("cells")
    return found


def outline(files: DataFrame) -> DataFrame:
    """Bookmarks in reading order with the pages they lead to."""
    return S.parse(files, "outline")


def annotations(files: DataFrame, *, pages: str | None = None) -> DataFrame:
    """Annotations but form fields and pop-ups."""
    return _picked(S.parse(files, "annotations"), files, pages)


def forms(files: DataFrame) -> DataFrame:
    """Form fields with values, options and the page of their first widget."""
    return S.parse(files, "fields")


def signatures(files: DataFrame, *, trust: bytes | None = None) -> DataFrame:
    """Every signature with what could be established: (doc_id, n, valid, signer, details as JSON)."""
    rows = files.select(F.col("doc_id").cast("string").alias("doc_id"), "content", (F.col("password") if "password" in files.columns else F.lit(None)).cast("string").alias("password"))
    kinds = pa.schema(
        [("doc_id", pa.string()), ("n", pa.int32()), ("field", pa.string()), ("signer", pa.string()), ("valid", pa.bool_()), ("document_unchanged", pa.bool_()),
         ("signature_genuine", pa.bool_()), ("covers_whole_document", pa.bool_()), ("trusted", pa.bool_()), ("signed_at", pa.string()), ("problem", pa.string()), ("details", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = pdf_sign.signatures(row["content"] or b"", row["password"] or "", trust)
                out = [{"doc_id": row["doc_id"], "n": k + 1, **{f: s.get(f) for f in kinds.names[2:-1]}, "details": pdf_edit.report_json(s)} for k, s in enumerate(found)]
                yield pa.RecordBatch.from_pylist(out, kinds)

    columns = "doc_id string, n int, field string, signer string, valid boolean, document_unchanged boolean, signature_genuine boolean, covers_whole_document boolean, trusted boolean, signed_at string, problem string, details string"
    return rows.mapInArrow(run, columns)


def images(files: DataFrame, *, pages: str | None = None, min_size: int = 1) -> DataFrame:
    """Every image once, under the first page that draws it, with its file: (doc_id, page, file, width, height, content, skipped)."""
    parse(pages or "all")
    rows = _with(files, lambda pdf: pdf_edit.images(pdf, pages, min_size), S.TABLES["images"][0])
    name = F.when(F.col("content").isNotNull(), image_names.image_file(F.col("page"), F.col("n"), F.col("kind")))
    return rows.select("doc_id", "page", name.alias("file"), "width", "height", "content", "skipped")


def _with(files: DataFrame, make: Callable[[Any], list[dict[str, Any]]], columns: str) -> DataFrame:
    """Rows that a function makes of every file that can be read."""
    from pyspark.sql import types as T_
    from pyspark.sql.pandas.types import to_arrow_type

    schema = T_.StructType.fromDDL("doc_id string, " + columns)
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                try:
                    found = make(S.open_pdf(row["content"] or b"", row["password"]))
                except ValueError:
                    found = []
                yield pa.RecordBatch.from_pylist([{"doc_id": row["doc_id"], **{n: x.get(n) for n in arrow.names[1:]}} for x in found], arrow)

    return S._given(files).mapInArrow(run, schema)


def scan(files: DataFrame, *, skip_hidden_text: bool = False) -> DataFrame:
    """What is found in every file, by kind, the most severe first. Nothing found is never called safe."""
    return inspect.report(inspect.findings(files, skip_hidden_text=skip_hidden_text))


def verdict(files: DataFrame, *, skip_hidden_text: bool = False) -> DataFrame:
    """(doc_id, verdict, highest_severity, findings) for every file."""
    from .operators.scan import verdict as judge

    return judge(files.select(F.col("doc_id").cast("string").alias("doc_id")), inspect.findings(files, skip_hidden_text=skip_hidden_text))


# --- changing ------------------------------------------------------------------------------------------------------


def create(sources: DataFrame, *, title: str | None = None, page_size: str = "a4", margin: float = 56.0, font_size: float = 11.0) -> DataFrame:
    """Files of Markdown: ``sources`` has doc_id and markdown, optionally title, and images as map<string,binary>."""
    columns = sources.columns
    rows = sources.select(
        F.col("doc_id").cast("string").alias("doc_id"), F.col("markdown").cast("string").alias("markdown"),
        (F.col("title").cast("string") if "title" in columns else F.lit(title).cast("string")).alias("title"),
        (F.col("images") if "images" in columns else F.lit(None).cast("map<string,binary>")).alias("images"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pictures = dict(row["images"] or [])
                content = report = error = None
                try:
                    content, found = pdf_create.create(row["markdown"] or "", title=row["title"], page_size=page_size, margin=margin, font_size=font_size, image_of=pictures.get)
                    report = pdf_edit.report_json(found)
                except ValueError as problem:
                    error = str(problem)
                yield pa.RecordBatch.from_pydict({"doc_id": [row["doc_id"]], "content": pa.array([content], pa.binary()), "report": pa.array([report], pa.string()), "error": pa.array([error], pa.string())})

    return rows.mapInArrow(run, "doc_id string, content binary, report string, error string")


def merge(files: DataFrame) -> DataFrame:
    """Files put together: ``files`` also has merge_id and pos; (doc_id, content, report, error) by merge_id.

    The files of one result are gathered, since it is one file; different results are made by different tasks.
    """
    given = files.select(F.col("merge_id").cast("string").alias("doc_id"), "pos", "content", (F.col("password") if "password" in files.columns else F.lit(None)).cast("string").alias("password"))
    grouped = given.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "content", "password"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                doc, parts = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                content = report = error = None
                try:
                    pdfs = [S.open_pdf(p["content"] or b"", p["password"]) for p in parts]
                    content = pdf_edit.merge(pdfs)
                    report = pdf_edit.report_json({"pages": sum(len(p.pages()) for p in pdfs), "inputs": [{"pos": p["pos"], "pages": len(x.pages())} for p, x in zip(parts, pdfs)]})
                except ValueError as problem:
                    error = str(problem)
                yield pa.RecordBatch.from_pydict({"doc_id": [doc], "content": pa.array([content], pa.binary()), "report": pa.array([report], pa.string()), "error": pa.array([error], pa.string())})

    return grouped.mapInArrow(run, "doc_id string, content binary, report string, error string")


def pages(files: DataFrame, *, keep: str | None = None, delete: str | None = None) -> DataFrame:
    """The pages of a spec in its order, or all but them."""
    if (keep is None) == (delete is None):
        raise ValueError("give either keep or delete")
    parse(keep or delete)
    return S.edit(files, _keep, spec=keep) if keep is not None else S.edit(files, _delete, spec=delete)


def _keep(pdf, spec: str) -> tuple[bytes, dict[str, Any]]:
    return pdf_edit.keep(pdf, spec), {"source_pages": len(pdf.pages())}


def _delete(pdf, spec: str) -> tuple[bytes, dict[str, Any]]:
    return pdf_edit.delete(pdf, spec), {"source_pages": len(pdf.pages())}


def split(files: DataFrame, *, every: int | None = None, ranges: list[str] | None = None) -> DataFrame:
    """Parts of every file: (doc_id, part, file, source_pages, content)."""
    if every is not None and ranges:
        raise ValueError("give either every or ranges")
    for r in ranges or []:
        parse(r)
    if every is not None and every < 1:
        raise ValueError("every must be at least 1")
    made = _with(files, lambda pdf: [{"part": k + 1, "source_pages": p, "content": c} for k, (p, c) in enumerate(pdf_edit.split(pdf, every or 1, ranges))], "part int, source_pages array<int>, content binary")
    stem = F.regexp_replace(F.substring_index("doc_id", "/", -1), r"\.pdf$", "")
    return made.select("doc_id", "part", F.format_string("%s-%04d.pdf", stem, F.col("part")).alias("file"), "source_pages", "content")


def rotate(files: DataFrame, *, angle: int, pages: str | None = None) -> DataFrame:
    """Pages turned clockwise by a multiple of 90 degrees."""
    if angle % 90:
        raise ValueError("angle must be a multiple of 90")
    return S.edit(files, pdf_edit.rotate, angle=angle, spec=pages)


def stamp(files: DataFrame, *, pages: str | None = None, **how: Any) -> DataFrame:
    """Text or a picture over pages; see ``pdf_edit.stamp``."""
    return S.edit(files, pdf_edit.stamp, spec=pages, **how)


def annotate(files: DataFrame, *, pages: str | None = None, **how: Any) -> DataFrame:
    """Marks over texts and areas; see ``pdf_edit.annotate``."""
    return S.edit(files, pdf_edit.annotate, spec=pages, **how)


def redact(files: DataFrame, *, texts: tuple[str, ...] = (), rects: tuple[str, ...] = (), regex: bool = False, case_sensitive: bool = False, pages: str | None = None) -> DataFrame:
    """Texts and areas taken out for good, with proof."""
    return S.edit(files, pdf_redact.redact, texts=tuple(texts), rects=tuple(rects), regex=regex, case_sensitive=case_sensitive, spec=pages)


def replace(files: DataFrame, find: str, with_: str, *, regex: bool = False, case_sensitive: bool = False, pages: str | None = None) -> DataFrame:
    """Text on the pages replaced in place."""
    return S.edit(files, pdf_redact.replace_text, find=find, new=with_, regex=regex, case_sensitive=case_sensitive, spec=pages)


def sanitize(files: DataFrame, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """Files without active content, with proof."""
    return S.edit(files, inspect.sanitize, keep=tuple(keep))


def set_meta(files: DataFrame, **changes: str) -> DataFrame:
    """Title, author, subject, keywords, creator; an empty text removes one."""
    if unknown := set(changes) - set(edit.META_KEYS):
        raise ValueError(f"unknown key {sorted(unknown)[0]}")
    return S.edit(files, pdf_edit.set_meta, **changes)


def compress(files: DataFrame) -> DataFrame:
    """Smaller files; one that gets no smaller stays as it is."""
    return S.edit(files, pdf_edit.compress)


def encrypt(files: DataFrame, *, owner_password: str, user_password: str = "", deny_print: bool = False, deny_copy: bool = False, deny_modify: bool = False) -> DataFrame:
    """Files protected with AES-256."""
    return S.edit(files, pdf_edit.encrypt, owner_password=owner_password, user_password=user_password, deny_print=deny_print, deny_copy=deny_copy, deny_modify=deny_modify)


def decrypt(files: DataFrame) -> DataFrame:
    """Files without protection; ``files`` gives the password."""
    return S.edit(files, pdf_edit.decrypt)


def sign(files: DataFrame, *, cert: bytes, key: bytes, **how: Any) -> DataFrame:
    """Files with a signature appended."""
    return S.edit(files, pdf_sign.sign, cert=cert, key=key, **how)


def fill(files: DataFrame, values: dict[str, str]) -> DataFrame:
    """Form values set and drawn."""
    return S.edit(files, pdf_edit.fill, values=dict(values))


def save(changed: DataFrame, folder: str, *, dry_run: bool = False) -> DataFrame:
    """Write what a changing command made below a folder, named by doc_id; a dry run only measures."""
    return S.write_files(changed.where("content is not null"), folder, dry_run=dry_run)


# --- what needs an engine ------------------------------------------------------------------------------------------


def render_sizes(files: DataFrame, *, dpi: float = 150.0, pages: str | None = None) -> DataFrame:
    """Names and sizes in pixels of the pictures that rendering would make."""
    rows = _picked(S.parse(files, "pages"), files, pages)
    w, h = edit.raster_size(F.col("width"), F.col("height"), dpi)
    return rows.select("doc_id", "page", image_names.page_file(F.col("page")).alias("file"), w.alias("width"), h.alias("height"))


def render(files: DataFrame, **_: Any) -> DataFrame:
    """Pictures of pages."""
    raise Unsupported("render needs a rasteriser, which is not available in this build; render_sizes gives names and sizes")


def ocr(files: DataFrame, **_: Any) -> DataFrame:
    """Text recognised in pictures of pages."""
    raise Unsupported("ocr needs a recognition engine, which is not available in this build")


def ocr_langs() -> DataFrame:
    """Languages that can be recognised."""
    raise Unsupported("ocr needs a recognition engine, which is not available in this build")


def ocr_install(lang: str) -> DataFrame:
    """Fetch a language."""
    raise Unsupported("languages are fetched from the network, which is not available in this build")


#: The commands by name.
COMMANDS: dict[str, Callable[..., DataFrame]] = {
    "info": info, "text": text, "search": search, "layout": layout, "tables": tables, "outline": outline, "annotations": annotations, "signatures": signatures,
    "render": render, "images": images, "ocr": ocr, "ocr-langs": ocr_langs, "ocr-install": ocr_install, "scan": scan, "create": create, "merge": merge, "pages": pages,
    "split": split, "rotate": rotate, "stamp": stamp, "annotate": annotate, "redact": redact, "replace": replace, "sanitize": sanitize, "set-meta": set_meta,
    "compress": compress, "encrypt": encrypt, "decrypt": decrypt, "sign": sign, "forms": forms, "fill": fill,
}

__all__ = ["COMMANDS", *(f.__name__ for f in COMMANDS.values())]
