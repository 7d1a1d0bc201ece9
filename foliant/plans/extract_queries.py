"""Content extraction over files built from the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import jsonfmt
from foliant.plans import sqlparts as P
from foliant.plans.registry import query
from foliant.sources import extract
from foliant.sources import tables as S

def _scanned(spark, sf_dir) -> DataFrame:
    """Documents as plain-text files in a folder; the files of some sources have names of other types."""
    docs = S.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    kind = F.when(F.col("source") == "src1", ".png").when(F.col("source") == "src2", ".pdf").otherwise(".txt")
    return docs.select(
        F.concat(F.lit("/scan/"), F.col("doc_id").cast("string"), kind).alias("path"),
        F.octet_length("text").cast("long").alias("length"),
        F.encode("text", "UTF-8").alias("content"),
    )


@query(
    "extract_content",
    """SELECT '/scan/' || doc_id || CASE source WHEN 'src1' THEN '.png' WHEN 'src2' THEN '.pdf' ELSE '.txt' END AS path,
      CASE source WHEN 'src1' THEN 'unsupported' WHEN 'src2' THEN 'pdf' ELSE 'text' END AS content_type,
      md5(CASE WHEN source IN ('src1', 'src2') THEN '' ELSE text END) AS text_md5,
      CASE source WHEN 'src1' THEN 'unsupported_format' WHEN 'src2' THEN 'extraction_failed' END AS error_code
    FROM documents""",
)
def extract_content(spark, sf_dir):
    done = extract.extract_content(_scanned(spark, sf_dir))
    return done.select("path", "content_type", F.md5("text").alias("text_md5"), "error_code")


@query(
    "extraction_json",
    f"""SELECT doc_id, md5('{{"text":' || {P.json_string("text")} || ',"content_type":"image","pages_processed":1,"confidence":'
      || CASE WHEN text = '' THEN 'null' ELSE '0.9000' END || ',"error_code":null}}') AS json_md5 FROM documents""",
)
def extraction_json(spark, sf_dir):
    """Recognition results of image files as JSON; the reader gives the document's text."""
    docs = S.table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("/scan/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("path"),
        F.octet_length("text").cast("long").alias("length"), F.encode("text", "UTF-8").alias("content"),
    )
    read = extract.ocr(docs, lambda content, pages: (content.decode(), 1, 1))
    encoded = jsonfmt.extraction_json(*[F.col(c) for c in ("text", "content_type", "pages_processed", "confidence", "error_code")])
    number = F.regexp_extract("path", "([0-9]+)[.]png$", 1).cast("long")
    return read.select(number.alias("doc_id"), F.md5(encoded).alias("json_md5"))
