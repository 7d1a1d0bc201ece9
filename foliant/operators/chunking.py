"""Cutting texts into overlapping chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_SIZE = 500
DEFAULT_OVERLAP = 50

# Chunks per block: running offsets restart in every block.
_BLOCK = 128


def _overlapping(text: Column, size: int, step: int) -> Column:
    """Pieces of ``size`` characters, one every ``step``, in a single pass.

    The look-ahead captures a piece while only one step of it is consumed.
    """
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{size}}})).{{1,{step}}}"), 1)


def _with_offsets(pieces: Column, step: int, start: Column) -> Column:
    """Pair each piece with the byte offset it starts at."""
    empty = F.array().cast("array<struct<text:string,offset:bigint>>")

    def append(acc: Column, piece: Column) -> Column:
        entry = F.struct(piece.alias("text"), acc["offset"].alias("offset"))
        following = acc["offset"] + F.octet_length(F.substring(piece, 1, step))
        return F.struct(following.alias("offset"), F.array_append(acc["done"], entry).alias("done"))

    first = F.struct(start.cast("long").alias("offset"), empty.alias("done"))
    return F.aggregate(pieces, first, append, lambda acc: acc["done"])


def chunk_array(text: Column, size: int = DEFAULT_SIZE, overlap: int = DEFAULT_OVERLAP) -> Column:
    """Array of (chunk_index, chunk_text, chunk_offset) with byte offsets.

    The work stays linear in the text.  Taking ``substring`` from the start
    for every chunk would read a long text over and over, and appending to one
    long array would copy it over and over; hence the two levels: blocks of
    chunks, then chunks within a block.  Lambdas use their own variables only,
    since anything captured is evaluated again for every element.
    """
    size = max(size, 1)
    step = size - min(max(overlap, 0), size - 1)
    blocks = _with_offsets(
        _overlapping(text, step * (_BLOCK - 1) + size, step * _BLOCK), step * _BLOCK, F.lit(0)
    )

    def within(block: Column, k: Column) -> Column:
        pieces = F.slice(_overlapping(block["text"], size, step), 1, _BLOCK)
        return F.transform(
            _with_offsets(pieces, step, block["offset"]),
            lambda c, i: F.struct(
                (k * _BLOCK + i).cast("int").alias("chunk_index"),
                c["text"].alias("chunk_text"),
                c["offset"].alias("chunk_offset"),
            ),
        )

    return F.flatten(F.transform(blocks, within))


def chunk_array_clamped(text: Column, size: int = DEFAULT_SIZE, overlap: int = DEFAULT_OVERLAP) -> Column:
    """Variant that first clamps the size to the text length and counts offsets in characters.

    A text shorter than ``size`` thus falls into many overlapping shards.
    Characters outside the basic plane count once here.
    """
    n = F.char_length(text)
    clamped = F.least(F.greatest(F.lit(size), F.lit(1)), n)
    step = clamped - F.greatest(F.lit(0), F.least(F.lit(overlap), clamped - 1))
    # Long texts all share one fixed step and take the linear path.
    long_form = F.transform(
        chunk_array(text, size, overlap),
        lambda c: F.struct(
            c["chunk_index"].alias("chunk_index"),
            c["chunk_text"].alias("chunk_text"),
            (c["chunk_index"].cast("long") * (max(size, 1) - min(max(overlap, 0), max(size, 1) - 1))).alias("chunk_offset"),
        ),
    )
    short_form = F.transform(
        F.sequence(F.lit(0), (F.ceil(n / step) - 1).cast("int")),
        lambda i: F.struct(
            i.alias("chunk_index"),
            F.substring(text, i * step + 1, clamped).alias("chunk_text"),
            (i * step).cast("long").alias("chunk_offset"),
        ),
    )
    return F.when(n >= size, long_form).when(n > 0, short_form)


def chunk_files(
    files: DataFrame,
    text: str = "text_content",
    size: int = DEFAULT_SIZE,
    overlap: int = DEFAULT_OVERLAP,
    clamped: bool = False,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``chunks`` relation of a ``files`` relation; empty texts give no chunk."""
    build = chunk_array_clamped if clamped else chunk_array
    return files.select(F.col("id").alias("file_id"), *keep, F.inline(build(F.col(text), size, overlap)))
