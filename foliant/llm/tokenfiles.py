"""Token ids in Arrow stream files of equal-length sequences.

Documents are put in ascending order of doc_id (ties by text, null ids first),
encoded, closed with an end id and packed without gaps into sequences of
``LENGTH`` ids.  A shard file holds fixed-size lists of ids and of mask bits, in
record batches of a fixed number of rows, so sequence i of a shard lies at a
place that follows from i alone and is read from a memory map without copying
or decoding.  Only the last sequence of a shard is padded; its mask is false
there.

Ids take 16 bits where the vocabulary allows, else 32.

Shards are the tasks of one range-partitioned job.  A task writes to a name of
its own and renames the finished file, so a repeated or speculative task leaves
one whole file.  The rows it returns say where each document lies within its
shard; they are kept as a table beside the files.
"""

from __future__ import annotations

import os
import uuid
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.llm.arrays import mix, sliced, span_hashes, text_bytes
from foliant.llm.common import shared_folder

LENGTH = 2048
#: Sequences per record batch.
ROWS = 64
END_ID = 2
#: Units whose ids a worker remembers; when there are more, it starts over.
REMEMBERED = 1_000_000

SPACE, DIGIT, LETTER, MARK, OTHER = range(5)


def _unit_kind(byte: int) -> int:
    if byte == 0x20 or 0x09 <= byte <= 0x0D:
        return SPACE
    if 0x30 <= byte <= 0x39:
        return DIGIT
    if 0x41 <= byte <= 0x5A or 0x61 <= byte <= 0x7A:
        return LETTER
    return MARK if 0x20 < byte < 0x7F and chr(byte) not in "'<|>" else OTHER


UNIT_KINDS = np.array([_unit_kind(b) for b in range(256)], dtype=np.uint8)


@lru_cache(maxsize=2)
def loaded(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordEncoder:
    """Ids of texts by a tokenizer that drops white space and case, each distinct unit encoded once.

    Such a tokenizer splits texts at white space, around digits and between a
    letter and the marks beside it, so the ids of a text are those of its units.
    A cut is made only where one side is white space, exactly one side is a
    digit, or an ASCII letter meets an ASCII mark.  Apostrophes, and the signs
    of special tokens, do not count as marks: their neighbours matter.
    Units are looked up by 64-bit hashes in which A-Z equal a-z; units with a
    sign of special tokens keep their case.
    """

    def __init__(self, path: str):
        self.tokenizer = loaded(path)
        small = self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16
        self.kind = np.dtype("<u2" if small else "<u4")
        self._reset()

    def _reset(self) -> None:
        self.place: dict[int, int] = {}
        self.flat = np.zeros(1 << 16, dtype=self.kind)
        self.start, self.length, self.used = np.zeros(1 << 14, dtype=np.int64), np.zeros(1 << 14, dtype=np.int64), 0

    def _learn(self, hashes: list[int], texts: list[str]) -> None:
        made = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.array([len(x) for x in made], dtype=np.int64)
        fresh = np.fromiter(chain.from_iterable(made), dtype=self.kind, count=int(lengths.sum()))
        n = len(self.place)
        while len(self.flat) < self.used + len(fresh):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.start) < n + len(made):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        self.flat[self.used : self.used + len(fresh)] = fresh
        self.start[n : n + len(made)] = self.used + np.cumsum(lengths) - lengths
        self.length[n : n + len(made)] = lengths
        self.used += len(fresh)
        self.place.update(zip(hashes, range(n, n + len(made)), strict=True))

    def encode(self, column: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and their offsets; ``end_id`` closes each text."""
        data, offsets = text_bytes(column)
        starts, ends = units(data, offsets)
        hashes = span_hashes(data, starts, ends, fold=True)
        signs = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum(data == ord("<"), out=signs[1:])
        signed = np.flatnonzero(signs[ends] > signs[starts])
        hashes[signed] = mix(span_hashes(data, starts[signed], ends[signed], fold=False) ^ np.uint64(0x5A5A5A5A))
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.place) > REMEMBERED:
            self._reset()
        keys = distinct.tolist()
        known = list(map(self.place.get, keys))
        missing = [i for i, x in enumerate(known) if x is None]
        if missing:
            at = first[missing]
            raw = data.tobytes()
            self._learn([keys[i] for i in missing], [raw[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            for i in missing:
                known[i] = self.place[keys[i]]
        entry = np.array(known, dtype=np.int64)[inverse] if len(known) else np.zeros(0, dtype=np.int64)
        sizes, origin = self.length[entry], self.start[entry]
        bounds = np.searchsorted(starts, offsets)
        total = np.zeros(len(entry) + 1, dtype=np.int64)
        np.cumsum(sizes, out=total[1:])
        out = self.flat[np.repeat(origin - total[:-1], sizes) + np.arange(total[-1])]
        text_ends = total[bounds]
        if end_id is not None:
            out = np.insert(out, text_ends[1:], self.kind.type(end_id))
            text_ends = text_ends + np.arange(len(text_ends))
        return out, text_ends


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the units of all texts."""
    kinds = UNIT_KINDS[data]
    if not len(data):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    left, right = kinds[:-1], kinds[1:]
    cut = np.ones(len(data), dtype=bool)
    cut[1:] = (
        (left == SPACE)
        | (right == SPACE)
        | ((left == DIGIT) != (right == DIGIT))
        | ((left == LETTER) & (right == MARK))
        | ((left == MARK) & (right == LETTER))
    )
    cut[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(data))
    real = kinds[starts] != SPACE
    return starts[real], ends[real]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder; it outlives a task when the worker does."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def sequence_schema(length: int, kind: np.dtype) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.bool_(), length))])


class ShardWriter:
    """Packs ids into fixed-size sequences of one Arrow file."""

    def __init__(self, sink, kind: np.dtype, length: int = LENGTH, rows: int = ROWS):
        self.length, self.block, self.kind = length, length * rows, kind
        self.schema = sequence_schema(length, kind)
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.held, self.size = [], 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= self.block:
            joined = np.concatenate(self.held)
            whole = len(joined) // self.block * self.block
            for at in range(0, whole, self.block):
                self._write(joined[at : at + self.block], self.block)
            self.held, self.size = [joined[whole:]], len(joined) - whole

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.writer.write_batch(pa.record_batch(columns, schema=self.schema))

    def close(self) -> None:
        if self.size:
            joined = np.concatenate(self.held)
            padded = np.zeros(-(-len(joined) // self.length) * self.length, dtype=self.kind)
            padded[: len(joined)] = joined
            self._write(padded, len(joined))
        self.writer.close()


class ShardReader:
    """Random access to a shard file; on a local path nothing but the asked pages is read."""

    def __init__(self, folder: str, shard: int, length: int = LENGTH, rows: int = ROWS):
        system, path = fs.FileSystem.from_uri(f"{folder}/{shard_name(shard)}")
        local = isinstance(system, fs.LocalFileSystem)
        self.source = pa.memory_map(path) if local else system.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.length, self.block, self.at, self.values = length, length * rows, -1, None

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence i."""
        rows = self.block // self.length
        batch = self.file.get_batch(i // rows)
        ids, mask = (batch.column(c)[i % rows].values for c in (0, 1))
        return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)

    def ids(self, start: int, count: int) -> list[np.ndarray]:
        """Runs of ids from place ``start`` of the shard, views of the file where it is mapped."""
        out = []
        while count > 0:
            if start // self.block != self.at:
                self.at = start // self.block
                self.values = self.file.get_batch(self.at).column(0).flatten().to_numpy()
            part = self.values[start % self.block : start % self.block + count]
            out.append(part)
            start, count = start + len(part), count - len(part)
        return out

    def close(self) -> None:
        self.source.close()


def shard_name(shard: int) -> str:
    return f"shard-{shard:06d}.arrow"


def as_uri(folder: str) -> str:
    return folder if ":" in folder.split("/")[0] else f"file://{os.path.abspath(folder)}"


def written(docs: DataFrame, path: str, folder: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shard files below ``folder``; returns (shard, doc_id, row, start, n_tokens) within shards."""
    folder = as_uri(folder)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = own.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        shard = TaskContext.get().partitionId()
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        draft = f"{base}/.{shard_name(shard)}-{uuid.uuid4().hex}"
        start, row, writer, own = 0, 0, None, encoder(path)
        for batch in sliced(batches, "text"):
            if writer is None:
                sink = system.open_output_stream(draft)
                writer = ShardWriter(sink, own.kind)
            ids, bounds = own.encode(batch.column("text"), end_id)
            writer.add(ids)
            counts, n = np.diff(bounds), batch.num_rows
            ends = start + np.cumsum(counts, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, shard)), batch.column("doc_id"), pa.array(np.arange(row, row + n)), pa.array(ends - counts), pa.array(counts, pa.int64())],
                names=["shard", "doc_id", "row", "start", "n_tokens"],
            )
            start, row = int(ends[-1]), row + n
        if writer is not None:
            writer.close()
            sink.close()
            system.move(draft, f"{base}/{shard_name(shard)}")

    rows = ordered.mapInArrow(run, "shard long, doc_id long, row long, start long, n_tokens long")
    index = f"{folder}/index"
    rows.write.parquet(index)
    return docs.sparkSession.read.schema(rows.schema).parquet(index)


def read_back(index: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start over all shards, n_tokens, ids_crc32."""
    folder = as_uri(folder)
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    # one row per shard: the running sum is over as many rows as there are files
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    # a run of rows of one shard is one task's work, so a large shard is read by several
    placed = (
        index.join(bases, "shard")
        .withColumn("run", F.floor(F.col("row") / 2000))
        .repartition("shard", "run")
        .sortWithinPartitions("shard", "row")
    )

    def run(batches):
        reader, now = None, None
        for batch in batches:
            shards, starts, counts = (batch.column(c).to_pylist() for c in ("shard", "start", "n_tokens"))
            sums = []
            for shard, start, count in zip(shards, starts, counts, strict=True):
                if shard != now:
                    if reader:
                        reader.close()
                    reader, now = ShardReader(folder, shard), shard
                crc = 0
                for part in reader.ids(start, count):
                    crc = zlib.crc32(part.astype("<u4"), crc)
                sums.append(crc)
            begin = np.array(starts, dtype=np.int64) + batch.column("base").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(begin), batch.column("n_tokens"), pa.array(sums, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )
        if reader:
            reader.close()

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def packed(docs: DataFrame, path: str) -> DataFrame:
    """Encode, write and read back; the files stay in a new folder of the shared one."""
    folder = shared_folder(docs.sparkSession, "tokens")
    return read_back(written(docs, path, folder), folder)
