"""Vectorised word access for Arrow batches of texts.

Word classes are sets of ASCII bytes; every byte from 0x80 on belongs to a word,
so words of UTF-8 texts can be cut and hashed on their bytes alone.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
CHUNK_BYTES = 1 << 20
_LIBC = ctypes.CDLL(None)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scramble of 64-bit values (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_class(is_word) -> np.ndarray:
    """Table of 256 flags: which bytes belong to words."""
    return np.array([b >= 0x80 or is_word(b) for b in range(256)], dtype=bool)


#: Words of the contract `[^\x20\x09-\x0D]+`.
SPACED = byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Words of the contract `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after lower-casing A-Z.
ALNUM = byte_class(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or 0x41 <= b <= 0x5A)


@lru_cache(maxsize=2)
def _byte_values(fold: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
    if fold:
        values[0x41:0x5B] = values[0x61:0x7B]
    return values


_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least ``n`` of each."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, 2 * CHUNK_BYTES)
        base = 0xD1342543DE82EF95
        inverse = pow(base, -1, 1 << 64)
        for name, value in (("up", base), ("down", inverse)):
            table = np.full(size, np.uint64(value))
            table[0] = 1
            with np.errstate(over="ignore"):
                np.multiply.accumulate(table, out=table)
            _powers[name] = table
    return _powers["up"], _powers["down"]


class Words:
    """Words of a run of texts: byte spans, hashes and the word range of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, fold: bool, hashed: bool = True):
        self.data, self.offsets = data, offsets
        starts, ends = cut(data, offsets, kind)
        self.starts, self.ends = starts, ends
        #: texts[i] has the words first[i] to first[i + 1]
        self.first = np.searchsorted(starts, offsets)
        self.hashes = span_hashes(data, starts, ends, fold) if hashed else None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """Index of the text each word belongs to."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)


def cut(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the maximal runs of word bytes that lie within one text."""
    flags = np.zeros(len(data) + 2, dtype=bool)
    flags[1:-1] = kind[data]
    opens = flags[1:-1] & ~flags[:-2]
    closes = flags[1:-1] & ~flags[2:]
    full = offsets[:-1] < offsets[1:]
    first, last = offsets[:-1][full], offsets[1:][full] - 1
    opens[first] = flags[first + 1]
    closes[last] = flags[last + 1]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
    """64-bit hashes of disjoint ascending byte spans; equal bytes give equal hashes wherever they stand.

    Works through the bytes in chunks that end between spans, so that memory
    beside the result stays small for texts of any length.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    values = _byte_values(fold)
    i = 0
    while i < len(starts):
        low = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, low + CHUNK_BYTES, side="right")))
        high = ends[j - 1]
        up, down = _power_tables(int(high - low) + 1)
        sums = np.empty(high - low + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(values[data[low:high]] * up[: high - low], out=sums[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (len + 1, from 0) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def give_back() -> None:
    """Return free memory of this process to the system."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def sliced(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of a slice take ``limit`` bytes, or are one text.

    Workers outlive their tasks; at the end, memory that is free goes back.
    """
    try:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            _, offsets = text_bytes(batch.column(column))
            at = 0
            while at < n:
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
                yield batch.slice(at, min(to, n) - at)
                at = to
    finally:
        give_back()
