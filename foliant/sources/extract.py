"""Content extraction: validation codes, plain text, DOCX, pluggable recognisers."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import paths as P
from foliant.functions.text import trim_ws

RESULT_SCHEMA = "text string, content_type string, pages_extracted int, error_code string, detail string"


def _checked(*cases: tuple[Column, Column | str, Column | str | None]) -> Column:
    """(content_type, error_code) of the first case that applies."""

    def as_column(value):
        return value if isinstance(value, Column) else F.lit(value)

    out = None
    for test, kind, code in cases:
        row = F.struct(
            as_column(kind).cast("string").alias("content_type"), as_column(code).cast("string").alias("error_code")
        )
        out = F.when(test, row) if out is None else out.when(test, row)
    return out


def _too_large(size: Column, max_mb: int | None) -> Column:
    return F.lit(False) if max_mb is None else size > P.mb_to_bytes(max_mb)


def check_extraction(path: Column, size: Column, exists: Column, max_mb: int | None = None) -> Column:
    """Checks in order: extension, existence, size, type; a null code means the file can be read."""
    ext = P.extension(path)
    return _checked(
        (ext == "", "unsupported", "unsupported_format"),
        (~exists, "unknown", "file_not_found"),
        (_too_large(size, max_mb), ext, "file_too_large"),
        (ext.isin(*P.RICH_EXTENSIONS), ext, None),
        (ext.isin(*P.TEXT_EXTENSIONS), "text", None),
        (F.lit(True), "unsupported", "unsupported_format"),
    )


def check_transcription(
    path: Column, size: Column, exists: Column, max_mb: int | None = None, max_minutes: int | None = None
) -> Column:
    kind = P.media_content_type(path)
    return _checked(
        (F.lit(max_minutes == 0), "unknown", "transcription_disabled"),
        (kind == "unsupported", kind, "unsupported_format"),
        (~exists, "unknown", "file_not_found"),
        (_too_large(size, max_mb), kind, "file_too_large"),
        (F.lit(True), kind, None),
    )


def check_ocr(path: Column, size: Column, exists: Column, max_mb: int | None = None) -> Column:
    kind = P.ocr_content_type(path)
    return _checked(
        (kind == "unsupported", kind, "unsupported_format"),
        (~exists, "unknown", "file_not_found"),
        (_too_large(size, max_mb), kind, "file_too_large"),
        (F.lit(True), kind, None),
    )


# --------------------------------------------------------------------------
# DOCX

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_INLINE = {f"{W}br": "\n", f"{W}tab": "\t"}


def paragraph_text(paragraph: ElementTree.Element) -> str:
    """What the runs of one paragraph say, in order."""
    pieces = (node.text or "" if node.tag == f"{W}t" else _INLINE.get(node.tag, "") for node in paragraph.iter())
    return "".join(pieces)


def document_text(xml: bytes) -> str:
    """The non-empty paragraphs of a word-processing document, a line each."""
    lines = (paragraph_text(p) for p in ElementTree.fromstring(xml).iter(f"{W}p"))
    return "\n".join(line for line in lines if line)


def docx_to_text(content: Column) -> Column:
    """(text, failure) of DOCX files; a file that cannot be read has no text, and says why."""

    @F.pandas_udf("struct<text:string,failure:string>")
    def read(files: pd.Series) -> pd.DataFrame:
        rows = []
        for blob in files:
            if blob is None:
                rows.append((None, None))
                continue
            try:
                with zipfile.ZipFile(io.BytesIO(bytes(blob))) as archive:
                    rows.append((document_text(archive.read("word/document.xml")), None))
            except Exception as failure:  # damaged, encrypted or of an unknown method: it concerns this file alone
                rows.append((None, f"{type(failure).__name__}: {failure}"))
        return pd.DataFrame(rows, columns=["text", "failure"])

    return read(content)


# --------------------------------------------------------------------------
# extraction of scanned files

# A recogniser maps (content, max_pages) to (text, pages, total_pages), or raises.
PageReader = Callable[[bytes, int | None], tuple[str, int, int]]


def extract_content(
    scanned: DataFrame, max_mb: int | None = None, max_pages: int | None = None, pdf_reader: PageReader | None = None
) -> DataFrame:
    """Scanned files (path, length, content) to (path, text, content_type, pages_extracted, error_code).

    Rejected files go their own way without ``content``; the filters on path
    and length reach a folder scan, so those files are never opened.  Without
    a ``pdf_reader`` PDFs give ``extraction_failed``.  There are no limits
    unless asked for.  ``detail`` keeps what a reader had to say when it failed.
    """
    check = check_extraction(F.col("path"), F.col("length"), F.lit(True), max_mb)
    rejected = (
        scanned.select("path", check.alias("c"))
        .filter(F.col("c.error_code").isNotNull())
        .select("path", F.lit("").alias("text"), "c.content_type", F.lit(0).alias("pages_extracted"), "c.error_code",
                F.lit(None).cast("string").alias("detail"))
    )
    kind = F.col("kind")
    accepted = scanned.filter(~_too_large(F.col("length"), max_mb) & check["error_code"].isNull())
    plain = F.when((kind == "text") & F.is_valid_utf8("content"), F.col("content").cast("string"))
    docx = docx_to_text(F.when(kind == "docx", F.col("content")))
    pdf = _read_pages(F.when(kind == "pdf", F.col("content")), pdf_reader, max_pages)
    texts = accepted.withColumn("kind", check["content_type"]).select(
        "path", "kind", plain.alias("plain"), docx.alias("docx"), pdf.alias("pdf")
    )
    text = F.coalesce("plain", "docx.text", "pdf.text")
    done = texts.select(
        "path",
        F.coalesce(text, F.lit("")).alias("text"),
        kind.alias("content_type"),
        F.coalesce("pdf.pages", F.lit(0)).alias("pages_extracted"),
        F.when(text.isNull(), "extraction_failed")
        .when(_too_many(F.col("pdf.total"), max_pages), "too_many_pages")
        .alias("error_code"),
        F.coalesce("pdf.failure", "docx.failure").alias("detail"),
    )
    return done.unionByName(rejected)


def extract_requested(requests: DataFrame, scanned: DataFrame, **options) -> DataFrame:
    """As above for requested paths; those the scan did not find report ``file_not_found``."""
    known = extract_content(scanned.join(requests.select("path"), "path", "left_semi"), **options)
    absent = requests.join(scanned.select("path"), "path", "left_anti")
    verdict = check_extraction(F.col("path"), F.lit(0), F.lit(False))
    missing = absent.select("path", verdict.alias("c")).select(
        "path", F.lit("").alias("text"), "c.content_type", F.lit(0).alias("pages_extracted"), "c.error_code",
        F.lit(None).cast("string").alias("detail"),
    )
    return known.unionByName(missing)


def _too_many(total: Column, max_pages: int | None) -> Column:
    return F.lit(False) if max_pages is None else total > max_pages


def _read_pages(content: Column, reader: PageReader | None, max_pages: int | None) -> Column:
    """Pages by a pluggable reader; its failures are results, with their message."""
    schema = "struct<text:string,pages:int,total:int,failure:string>"
    if reader is None:
        return F.lit(None).cast(schema)

    @F.pandas_udf(schema)
    def read(files: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in files:
            rows = []
            for blob in batch:
                if blob is None:
                    rows.append((None, None, None, None))
                    continue
                try:
                    rows.append((*reader(bytes(blob), max_pages), None))
                except Exception as failure:  # whatever a reader raises belongs to this file alone
                    rows.append((None, None, None, f"{type(failure).__name__}: {failure}"))
            out = pd.DataFrame(rows, columns=["text", "pages", "total", "failure"])
            yield out.astype({"pages": "Int32", "total": "Int32"})

    return read(content)


def recognise(
    scanned: DataFrame,
    checked: Column,
    reader: PageReader | None,
    limit: int | None,
    missing_code: str,
    most: int | None,
    over_code: str,
) -> DataFrame:
    """Run a pluggable recogniser over files that pass ``checked``.

    The reader is handed ``limit``; a file whose total, in the reader's unit,
    is above ``most`` reports ``over_code``.  Rejected files go their own way
    without ``content``.  Without a reader every accepted file reports
    ``missing_code``.
    """
    rejected = scanned.select("path", checked.alias("c")).filter(F.col("c.error_code").isNotNull())
    rejected = rejected.select(
        "path", F.lit("").alias("text"), "c.content_type", F.lit(0).alias("pages_processed"), "c.error_code",
        F.lit(None).cast("string").alias("detail"),
    )
    accepted = scanned.filter(checked["error_code"].isNull())
    read = _read_pages(F.col("content"), reader, limit)
    rows = accepted.select("path", checked["content_type"].alias("content_type"), read.alias("r"))
    done = rows.select(
        "path",
        F.coalesce("r.text", F.lit("")).alias("text"),
        "content_type",
        F.coalesce("r.pages", F.lit(0)).alias("pages_processed"),
        F.when(F.col("r.text").isNull(), missing_code)
        .when(_too_many(F.col("r.total"), most), over_code)
        .alias("error_code"),
        F.col("r.failure").alias("detail"),
    )
    return done.unionByName(rejected)


def ocr(scanned: DataFrame, reader: PageReader | None = None, max_mb: int | None = None, max_pages: int | None = None) -> DataFrame:
    """Recognised text with the fixed confidence of each kind of file."""
    check = check_ocr(F.col("path"), F.col("length"), F.lit(True), max_mb)
    done = recognise(scanned, check, reader, max_pages, "ocr_failed", max_pages, "too_many_pages")
    blank = F.col("error_code").isNull() & (trim_ws(F.col("text")) == "")
    return done.withColumn(
        "confidence",
        F.when(F.col("text") != "", F.when(F.col("content_type") == "image", 0.9).otherwise(0.85)),
    ).withColumn("error_code", F.when(blank, "empty_image").otherwise(F.col("error_code")))


def transcribe(
    scanned: DataFrame, reader: PageReader | None = None, max_mb: int | None = None, max_minutes: int | None = None
) -> DataFrame:
    """Transcripts by a pluggable reader: (content, minutes) to (text, seconds heard, seconds in all).

    Media longer than the limit report ``media_too_long``.
    """
    check = check_transcription(F.col("path"), F.col("length"), F.lit(True), max_mb, max_minutes)
    seconds = None if max_minutes is None else 60 * max_minutes
    done = recognise(scanned, check, reader, max_minutes, "not_implemented", seconds, "media_too_long")
    return done.withColumnRenamed("pages_processed", "duration_seconds")
