"""Uploaded files to parsed documents and their sections. Errors are rows with a code, not exceptions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import errors
from lectern.functions import identity
from lectern.sources.pdf import BrokenPdf, page_texts
from lectern.sources.sections import markdown_sections, page_sections, plain_lines, text_sections

MAX_BYTES = 20 * 2**20
SECTIONS = "array<struct<section_no:int,char_start:int,char_end:int,section_path:array<string>,page_start:int,page_end:int,line_start:int,line_end:int>>"
PARSED = f"format string, title string, text string, sections {SECTIONS}, error_code string"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(filename, content) of the files under a path."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("filename"), "content")


def file_format(filename: Column, content: Column, max_bytes: int = MAX_BYTES) -> Column:
    """Struct of ``format`` and ``error_code``: size first, then blankness, then the magic of PDF, then the extension."""
    size, ending = F.length(content), identity.extension(filename)
    head = F.decode(F.substring(content, 1, 5), "ISO-8859-1")
    blank = F.trim(F.translate(F.decode(F.substring(content, 1, 4096), "ISO-8859-1"), "\t\r\n\x0b\x0c", "     ")) == ""
    code = (
        F.when(size > max_bytes, errors.FILE_TOO_LARGE)
        .when(content.isNull() | (size == 0) | ((size <= 4096) & blank), errors.EMPTY_DOCUMENT)
        .when(head == "%PDF-", None)
        .when(~ending.isin(".md", ".markdown", ".txt"), errors.UNSUPPORTED_FORMAT)
    )
    kind = F.when(head == "%PDF-", "pdf").when(ending.isin(".md", ".markdown"), "md").when(ending == ".txt", "txt")
    return F.struct(F.when(code.isNull(), kind).alias("format"), code.alias("error_code"))


def _rows(sections) -> list[dict]:
    return [
        {
            "section_no": n, "char_start": s.char_start, "char_end": s.char_end, "section_path": list(s.path),
            "page_start": s.page, "page_end": s.page, "line_start": s.line_start, "line_end": s.line_end,
        }
        for n, s in enumerate(sections)
    ]


def parse_text(text: str, kind: str, title: str) -> tuple[str, str, list[dict], str | None]:
    """(title, text, section rows, error code) of a text or Markdown document."""
    text = plain_lines(text)
    if kind == "md":
        title, found = markdown_sections(text, title)
    else:
        found = text_sections(text, title)
    return title, text, _rows(found), None if found else errors.EMPTY_DOCUMENT


def parse_files(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(doc_id, filename, format, title, text, sections, error_code) of (filename, content).

    Text must be UTF-8, with or without byte order mark. Of a PDF the text layer is read; pages that another reader has taken out
    come in through ``parse_pages``. Files are parsed where they are read.
    """
    checked = files.withColumn("checked", file_format(F.col("filename"), F.col("content"), max_bytes)).select(
        identity.default_doc_id(F.col("filename")).alias("doc_id"), "filename", identity.stem(F.col("filename")).alias("stem"),
        F.col("checked.format").alias("format"), F.col("checked.error_code").alias("error_code"),
        F.when(F.col("checked.format").isNotNull(), F.col("content")).alias("content"),
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples():
                title, text, found, code = None, None, None, r.error_code
                if code is None and r.format == "pdf":
                    try:
                        text, sections = page_sections(page_texts(bytes(r.content)), r.stem)
                        title, found, code = r.stem, _rows(sections), None if sections else errors.NO_TEXT_LAYER
                    except BrokenPdf:
                        code = errors.PARSE_ERROR
                elif code is None:
                    try:
                        title, text, found, code = parse_text(bytes(r.content).decode("utf-8-sig"), r.format, r.stem)
                    except UnicodeDecodeError:
                        code = errors.PARSE_ERROR
                out.append((r.doc_id, r.filename, r.format, title, text, found, code))
            yield pd.DataFrame(out, columns=["doc_id", "filename", "format", "title", "text", "sections", "error_code"])

    return checked.mapInPandas(run, f"doc_id string, filename string, {PARSED}")


def parse_texts(documents: DataFrame, key: str, text: str, kind: str, title: str) -> DataFrame:
    """(doc_id, format, title, text, sections, error_code) of texts that are already decoded; pages of a ``pdf`` are parted by form
    feeds, any other format than ``md`` and ``pdf`` is plain text. Null and blank texts are empty documents."""
    id_kind = documents.schema[key].dataType.simpleString()
    picked = documents.select(F.col(key).alias("doc_id"), F.col(kind).alias("format"), F.col(title).alias("title"), F.col(text).alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples():
                given, body, found, code = r.title or "", None, [], errors.EMPTY_DOCUMENT
                if isinstance(r.text, str) and r.text.strip():
                    if r.format == "pdf":
                        body, sections = page_sections(plain_lines(r.text).split("\x0c"), given)
                        found, code = _rows(sections), None if sections else errors.NO_TEXT_LAYER
                    else:
                        given, body, found, code = parse_text(r.text, r.format, given)
                out.append((r.doc_id, r.format, given, body, found, code))
            yield pd.DataFrame(out, columns=["doc_id", "format", "title", "text", "sections", "error_code"])

    return picked.mapInPandas(run, f"doc_id {id_kind}, {PARSED}")


def parse_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, format, title, text, sections, error_code) of (doc_id, title, page_no, text), one row per page of a PDF."""
    id_kind = pages.schema["doc_id"].dataType.simpleString()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("page_no")
        numbers = {int(n): t for n, t in zip(frame["page_no"], frame["text"])}
        title = frame["title"].iloc[0] or ""
        text, found = page_sections([numbers.get(n, "") for n in range(1, max(numbers, default=0) + 1)], title)
        code = None if found else errors.NO_TEXT_LAYER
        return pd.DataFrame(
            [(frame["doc_id"].iloc[0], "pdf", title, text, _rows(found), code)],
            columns=["doc_id", "format", "title", "text", "sections", "error_code"],
        )

    return pages.groupBy("doc_id").applyInPandas(run, f"doc_id {id_kind}, {PARSED}")


def section_rows(parsed: DataFrame) -> DataFrame:
    """One row per section of the documents parsed without error, with its body."""
    good = parsed.where(F.col("error_code").isNull()).select("doc_id", "text", F.inline("sections"))
    return good.withColumn("body", F.substring("text", F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))).drop("text")


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases from JSON lines: id, question, category, split, gold, absent, note."""
    schema = "id string, question string, category string, split string, gold array<struct<doc:string,must_contain:string>>, absent string, note string"
    return spark.read.schema(schema).json(path)
