"""Quality rules: word and symbol counts, and compression bands.

The compression verdict looks at zstandard ratios (raw bytes / compressed
bytes) of the whole text and of its consecutive fixed chunks, which cover every
byte: a last piece shorter than a chunk can be judged by goes with the chunk
before it, and a text as short as that is one chunk under the limits of whole
texts of its length.  Repetitive text
compresses too well, noise hardly at all; short texts carry frame overhead and
little context, so the limits depend on the length.  A null text has no words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.arrays import SPACED, Words, mix, sliced, span_hashes, text_bytes

SYMBOLS = np.array([chr(b) in "#*$%&|<>" for b in range(256)])
LEAST_WORDS = 50
REPEATED_PERCENT = 50


@dataclass(frozen=True)
class Band:
    """Limits of the ratio for texts of at least ``from_bytes`` bytes."""

    from_bytes: int
    low: float
    high: float


#: Whole texts.  Prose of natural languages reaches ratios of about 1.5 (short) to 4 (long).
WHOLE = (Band(0, 0.0, 3.0), Band(256, 1.1, 3.0), Band(1024, 1.25, 3.5), Band(4096, 1.35, 4.0), Band(32768, 1.4, 5.0))
#: Chunks of 4 KiB: the share of chunks out of the band decides.
CHUNK_BYTES = 4096
CHUNK = Band(1024, 1.2, 3.5)
CHUNK_SHARE = 0.5
LEVEL = 3

BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
COLUMNS = BASE + ", ratio double, bad_chunks long, n_chunks long, base_failed boolean, kept boolean"


def band_of(bands: tuple[Band, ...], size: int) -> Band:
    return next(b for b in reversed(bands) if size >= b.from_bytes)


def chunk_borders(start: int, end: int) -> list[tuple[int, int]]:
    """Consecutive chunks of a text; a tail too short to be judged is part of the last."""
    cuts = list(range(start, end, CHUNK_BYTES))
    if len(cuts) > 1 and end - cuts[-1] < CHUNK.from_bytes:
        cuts.pop()
    return list(zip(cuts, [*cuts[1:], end], strict=True))


def repeated_words(words: Words) -> np.ndarray:
    """Per text: words covered by windows of 3 words that occur twice or more in the text."""
    h, owner = words.hashes, words.owner()
    out = np.zeros(len(words.offsets) - 1, dtype=np.int64)
    if len(h) < 3:
        return out
    inside = owner[2:] == owner[:-2]
    window = mix(mix(mix(h[:-2]) * np.uint64(3) + h[1:-1]) * np.uint64(3) + h[2:])
    window = mix(window + owner[:-2].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    at = np.flatnonzero(inside)
    _, inverse, count = np.unique(window[at], return_inverse=True, return_counts=True)
    at = at[count[inverse] > 1]
    hit = np.zeros(len(h), dtype=bool)
    for i in range(3):
        hit[at + i] = True
    np.add.at(out, owner[hit], 1)
    return out


def repeated_lines(data: np.ndarray, words: Words) -> np.ndarray:
    """Per text: lines with a word that equal an earlier line of it."""
    offsets = words.offsets
    n = len(offsets) - 1
    out = np.zeros(n, dtype=np.int64)
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    starts = starts[starts < len(data)]
    if not len(starts):
        return out
    ends = np.append(starts[1:], len(data))
    ends = ends - (data[ends - 1] == 0x0A)
    worded = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends = starts[worded], ends[worded]
    if not len(starts):
        return out
    doc = np.searchsorted(offsets, starts, side="right") - 1
    key = mix(span_hashes(data, starts, ends, fold=False) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(key, return_index=True)
    again = np.ones(len(key), dtype=bool)
    again[first] = False
    np.add.at(out, doc[again], 1)
    return out


def measure(column: pa.Array, compressor) -> list[np.ndarray]:
    data, offsets = text_bytes(column)
    words = Words(data, offsets, SPACED, fold=False)
    n = len(offsets) - 1
    leads = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(((data & 0xC0) != 0x80) & SPACED[data], out=leads[1:])
    symbols = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(SYMBOLS[data], out=symbols[1:])
    per_text = lambda sums: sums[offsets[1:]] - sums[offsets[:-1]]
    counts, repeats = words.counts.astype(np.int64), repeated_words(words)
    failed = (counts < LEAST_WORDS) | (100 * repeats > REPEATED_PERCENT * counts)
    ratio, bad, chunks, kept = np.ones(n), np.zeros(n, np.int64), np.zeros(n, np.int64), ~failed
    raw = memoryview(np.ascontiguousarray(data))
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if a == b:
            continue
        ratio[i] = (b - a) / len(compressor.compress(raw[a:b]))
        band = band_of(WHOLE, b - a)
        for at, end in chunk_borders(a, b):
            limits = CHUNK if end - at >= CHUNK.from_bytes else band
            own = (end - at) / len(compressor.compress(raw[at:end]))
            bad[i] += not limits.low <= own <= limits.high
            chunks[i] += 1
        kept[i] &= band.low <= ratio[i] <= band.high and bad[i] <= CHUNK_SHARE * chunks[i]
    return [counts, per_text(leads), per_text(symbols), repeated_lines(data, words), repeats, ratio, bad, chunks, failed, kept]


def assessed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, the counts of ``BASE``, the compression figures, ``base_failed`` and ``kept``."""

    def run(batches):
        import zstandard

        compressor = zstandard.ZstdCompressor(level=LEVEL)
        names = ["doc_id", *(c.split()[0] for c in COLUMNS.split(", "))]
        for batch in sliced(batches, "text"):
            made = measure(batch.column("text"), compressor)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x) for x in made)], names=names)

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, f"doc_id long, {COLUMNS}")


def kept_rows(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text passes the rules."""

    def run(batches):
        import zstandard

        compressor = zstandard.ZstdCompressor(level=LEVEL)
        for batch in sliced(batches, text_col):
            yield batch.filter(pa.array(measure(batch.column(text_col), compressor)[-1]))

    return docs.mapInArrow(run, docs.schema)
