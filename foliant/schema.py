"""Schemas of the stored relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILES = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("file_path", T.StringType(), False),
        T.StructField("file_name", T.StringType(), False),
        T.StructField("description", T.StringType()),
        T.StructField("text_content", T.StringType()),
        T.StructField("transcript_text", T.StringType()),
        T.StructField("tags", T.StringType()),
        T.StructField("needs_review", T.IntegerType(), False),
        T.StructField("indexed_at", T.LongType(), False),
    ]
)

# The two tables below are keyed by (file_id, chunk_index) instead of a
# surrogate chunk id, so that they co-locate when bucketed by file_id.
CHUNKS = T.StructType(
    [
        T.StructField("file_id", T.LongType(), False),
        T.StructField("chunk_index", T.IntegerType(), False),
        T.StructField("chunk_text", T.StringType()),
        T.StructField("chunk_offset", T.LongType()),
    ]
)

EMBEDDINGS = T.StructType(
    [
        T.StructField("file_id", T.LongType(), False),
        T.StructField("chunk_index", T.IntegerType(), False),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)

POSTINGS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("col", T.IntegerType(), False),
        T.StructField("pos", T.IntegerType(), False),
        T.StructField("token", T.StringType(), False),
    ]
)

_DEFAULTS = {
    "description": "",
    "text_content": "",
    "transcript_text": "",
    "tags": "",
    "needs_review": 0,
}


def migrate_files(df: DataFrame) -> DataFrame:
    """Bring an older ``files`` snapshot to the current columns, in order."""
    out = []
    for field in FILES.fields:
        if field.name in df.columns:
            out.append(F.col(field.name).cast(field.dataType).alias(field.name))
        elif field.name in _DEFAULTS:
            out.append(F.lit(_DEFAULTS[field.name]).cast(field.dataType).alias(field.name))
        else:
            raise ValueError(f"files snapshot lacks required column {field.name}")
    return df.select(*out)
