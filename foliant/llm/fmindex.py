"""Benchmark decontamination with an FM-index per shard of the training texts.

A shard is a run of texts of bounded size within one task.  Its words become
symbols of the vocabulary of the test phrases; each run of other words, and the
gap between two texts, becomes one separator, which no phrase contains and
which sorts by its position.  The index over the symbols is

* a suffix array, built by packing several symbols into one sort key and then
  doubling the sorted length within the groups that are still tied,
* the Burrows-Wheeler transform in a wavelet matrix with running ranks,
* suffix positions kept at every ``SAMPLE``-th place and behind separators.

All phrases are searched backward at once, word by word; an occurrence is
located by stepping back to a kept position.  Occurrences are merged into
removal spans per text.

Test items are cut into blocks by tasks, each written as an Arrow file to the
shared folder and listed in a stored table.  Tasks that hold a shard read the
blocks one by one, so neither the driver nor a broadcast carries test items.
The files stay until the caller deletes the work folder.

Phrases: windows of ``WINDOW`` consecutive words of a test item, or the whole
item if it has fewer words but at least one.  Null or wordless texts and items
have no occurrences.  Items that repeat an id count as one item.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.arrays import ALNUM, Words, sliced, text_bytes
from foliant.llm.common import Scratch
from foliant.llm.tokenfiles import as_uri

WINDOW = 10
SAMPLE = 16
#: Text bytes of one shard.
SHARD_BYTES = 2 << 20
#: Bytes of test items of one block (or one item); a larger test set is searched block by block.
BLOCK_BYTES = 1 << 20
#: Bytes of blocks a task holds on to; others are read again for its next shard.
HELD_BYTES = 64 << 20


class Phrases:
    """One block of test items: vocabulary, distinct windows as rows of symbols, and their items."""

    def __init__(self, items: list[tuple[object, str | None]]):
        data, offsets = text_bytes(pa.array([text for _, text in items], pa.large_string()))
        words = Words(data, offsets, ALNUM, fold=True)
        self.vocabulary, symbols = np.unique(words.hashes, return_inverse=True)
        symbols = symbols.astype(np.int64) + 1
        windows: dict[tuple, set] = {}
        for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
            own = symbols[a:b].tolist()
            for k in range(max(1, len(own) - WINDOW + 1) if own else 0):
                windows.setdefault(tuple(own[k : k + WINDOW]), set()).add(items[i][0])
        rows = sorted(windows)
        self.lengths = np.array([len(r) for r in rows], dtype=np.int64)
        self.symbols = np.zeros((len(rows), WINDOW), dtype=np.int64)
        for i, row in enumerate(rows):
            self.symbols[i, : len(row)] = row
        self.items = [sorted(str(x) for x in windows[r] if x is not None) for r in rows]

    @property
    def nbytes(self) -> int:
        return self.vocabulary.nbytes + self.lengths.nbytes + self.symbols.nbytes

    def table(self) -> pa.Table:
        """The block as a table of one row."""
        columns = {
            "vocabulary": (self.vocabulary, pa.uint64()),
            "lengths": (self.lengths, pa.int64()),
            "symbols": (self.symbols.ravel(), pa.int64()),
        }
        rows = {name: pa.array([values], pa.list_(kind)) for name, (values, kind) in columns.items()}
        return pa.table({**rows, "items": pa.array([self.items], pa.list_(pa.list_(pa.string())))})

    @classmethod
    def of(cls, table: pa.Table) -> Phrases:
        made = cls.__new__(cls)
        values = {name: table.column(name).combine_chunks().flatten().to_numpy() for name in ("vocabulary", "lengths", "symbols")}
        made.vocabulary, made.lengths = values["vocabulary"], values["lengths"]
        made.symbols = values["symbols"].reshape(-1, WINDOW)
        made.items = table.column("items")[0].as_py()
        return made


class WaveletMatrix:
    """Ranks of symbols over a sequence, one bit level at a time."""

    def __init__(self, sequence: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma).bit_length())
        self.ranks, self.zeros = [], []
        now = sequence
        for level in range(self.bits - 1, -1, -1):
            ones = (now >> level & 1).astype(bool)
            rank = np.zeros(len(now) + 1, dtype=np.int32)
            np.cumsum(ones, out=rank[1:])
            self.ranks.append(rank)
            self.zeros.append(len(now) - int(rank[-1]))
            now = np.concatenate([now[~ones], now[ones]])

    def rank(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each end."""
        low, high = np.zeros(len(symbols), dtype=np.int64), ends.astype(np.int64)
        for level, rank, zeros in zip(range(self.bits - 1, -1, -1), self.ranks, self.zeros, strict=True):
            one = (symbols >> level & 1).astype(bool)
            a, b = rank[low].astype(np.int64), rank[high].astype(np.int64)
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return high - low

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols at the positions, and how often each stands before its position."""
        at, low = at.astype(np.int64), np.zeros(len(at), dtype=np.int64)
        symbols = np.zeros(len(at), dtype=np.int64)
        for rank, zeros in zip(self.ranks, self.zeros, strict=True):
            one = rank[at + 1] > rank[at]
            a, b = rank[low].astype(np.int64), rank[at].astype(np.int64)
            symbols = symbols << 1 | one
            low, at = np.where(one, zeros + a, low - a), np.where(one, zeros + b, at - b)
        return symbols, at - low


def suffix_array(text: np.ndarray, sigma: int) -> np.ndarray:
    """Sorted suffixes of symbols; symbol 0 ends a comparison, ties there go by position."""
    n = len(text)
    width = max(1, int(sigma).bit_length())
    packed = max(1, 62 // width)
    stop = np.flatnonzero(text == 0)
    # distance to the next separator: what lies behind one is not compared
    ahead = np.append(stop, n)[np.searchsorted(stop, np.arange(n))] - np.arange(n)
    padded = np.concatenate([text, np.zeros(packed, dtype=np.int64)])
    key = np.zeros(n, dtype=np.int64)
    for i in range(packed):
        key = key << width | np.where(i <= ahead, padded[i : i + n], 0)
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    done = ahead < packed
    length = packed
    while True:
        # suffixes that met a separator are unique by position; others share a rank with their ties
        fresh = np.ones(n, dtype=bool)
        fresh[1:] = (sorted_key[1:] != sorted_key[:-1]) | done[order[1:]]
        group = np.cumsum(fresh) - 1
        first = np.flatnonzero(fresh)
        tied = np.diff(np.append(first, n)) > 1
        if not tied.any():
            return order
        rank = np.empty(n, dtype=np.int64)
        rank[order] = first[group]
        slots = np.flatnonzero(tied[group])
        members = order[slots]
        after = members + length
        next_rank = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        head = first[group[slots]]
        again = np.lexsort((members, next_rank, head))
        order[slots] = members[again]
        sorted_key = rank[order]
        # within a tied group, neighbours with different next ranks part
        pair = np.zeros(n, dtype=np.int64)
        pair[slots] = next_rank[again]
        differs = np.zeros(n, dtype=np.int64)
        differs[1:] = pair[1:] != pair[:-1]
        sorted_key = np.cumsum(np.concatenate([[0], (sorted_key[1:] != sorted_key[:-1]) | (differs[1:] > 0)]))
        length *= 2
        done = ahead < length


class FMIndex:
    """Index over a sequence of symbols 0..sigma, in which 0 separates."""

    def __init__(self, text: np.ndarray, sigma: int):
        self.n = len(text)
        order = suffix_array(text, sigma)
        previous = np.where(order > 0, text[order - 1], 0)
        self.counts = np.zeros(sigma + 2, dtype=np.int64)
        np.cumsum(np.bincount(text, minlength=sigma + 1), out=self.counts[1:])
        self.tree = WaveletMatrix(previous, sigma)
        kept = (order % SAMPLE == 0) | (previous == 0)
        self.kept = kept
        self.kept_before = np.cumsum(kept) - kept
        self.positions = order[kept]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range of the suffixes that start with each phrase."""
        low = np.zeros(len(phrases), dtype=np.int64)
        high = np.full(len(phrases), self.n, dtype=np.int64)
        for step in range(phrases.shape[1]):
            alive = np.flatnonzero((step < lengths) & (low < high))
            if not len(alive):
                break
            symbol = phrases[alive, lengths[alive] - 1 - step]
            low[alive] = self.counts[symbol] + self.tree.rank(symbol, low[alive])
            high[alive] = self.counts[symbol] + self.tree.rank(symbol, high[alive])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by stepping back to kept ones."""
        rows = rows.astype(np.int64).copy()
        steps = np.zeros(len(rows), dtype=np.int64)
        open_ = np.flatnonzero(~self.kept[rows])
        while len(open_):
            symbol, before = self.tree.access(rows[open_])
            rows[open_] = self.counts[symbol] + before
            steps[open_] += 1
            open_ = open_[~self.kept[rows[open_]]]
        return self.positions[self.kept_before[rows]] + steps


def shard_hits(words: Words, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences of the phrases in a shard: first word, number of words, phrase."""
    none = np.zeros(0, dtype=np.int64)
    if not len(words.hashes) or not len(phrases.lengths):
        return none, none, none
    place = np.searchsorted(phrases.vocabulary, words.hashes)
    place = np.minimum(place, len(phrases.vocabulary) - 1)
    symbols = np.where(phrases.vocabulary[place] == words.hashes, place + 1, 0)
    # a separator before each text; runs of separators shrink to one
    before = np.zeros(len(symbols), dtype=bool)
    before[words.first[:-1][words.counts > 0]] = True
    slot = np.arange(len(symbols)) + np.cumsum(before)
    text = np.zeros(len(symbols) + int(before.sum()) + 1, dtype=np.int64)
    word = np.full(len(text), -1, dtype=np.int64)
    text[slot], word[slot] = symbols, np.arange(len(symbols))
    keep = np.ones(len(text), dtype=bool)
    keep[1:] = (text[1:] != 0) | (text[:-1] != 0)
    text, word = text[keep], word[keep]
    index = FMIndex(text, len(phrases.vocabulary))
    low, high = index.search(phrases.symbols, phrases.lengths)
    found = np.flatnonzero(high > low)
    amount = (high - low)[found]
    if not len(found):
        return none, none, none
    rows = np.repeat(low[found] - np.cumsum(amount) + amount, amount) + np.arange(amount.sum())
    which = np.repeat(found, amount)
    return word[index.locate(rows)], phrases.lengths[which], which


class Blocks:
    """The stored blocks of test items, as a task reads them."""

    def __init__(self, folder: str, directory: str):
        self.folder, self.directory = folder, directory
        self.names: list[str] | None = None
        self.held: dict[str, Phrases] = {}
        self.size = 0

    def __iter__(self) -> Iterator[Phrases]:
        import pyarrow.dataset as ds

        if self.names is None:
            system, base = fs.FileSystem.from_uri(as_uri(self.directory))
            self.names = sorted(ds.dataset(base, filesystem=system, format="parquet").to_table().column("name").to_pylist())
        for name in self.names:
            if name in self.held:
                yield self.held[name]
                continue
            system, base = fs.FileSystem.from_uri(self.folder)
            with system.open_input_file(f"{base}/{name}") as file:
                block = Phrases.of(pa.ipc.open_file(file).read_all())
            # blocks come round in one order: the first that fit stay, the others are read each time
            if self.size + block.nbytes <= HELD_BYTES:
                self.held[name], self.size = block, self.size + block.nbytes
            yield block


def blocks(items: DataFrame, id_col: str, text_col: str) -> Blocks:
    """Write the test items as blocks of at most ``BLOCK_BYTES`` (or one item) each."""
    scratch = Scratch(items.sparkSession, "phrases")
    folder, most = as_uri(f"{scratch.root}/blocks"), BLOCK_BYTES
    own = items.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    total = own.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("bytes")).first()

    def run(batches):
        system, base = fs.FileSystem.from_uri(folder)

        def written(held: list) -> pa.RecordBatch:
            system.create_dir(base, recursive=True)
            # a repeated task writes files of other names; those that count are the listed ones
            name, table = f"{uuid.uuid4().hex}.arrow", Phrases(held).table()
            with system.open_output_stream(f"{base}/{name}") as sink, pa.ipc.new_file(sink, table.schema) as writer:
                writer.write_table(table)
            return pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

        held, size = [], 0
        for batch in sliced(batches, "t"):
            for i, text in zip(batch.column("i").to_pylist(), batch.column("t").to_pylist(), strict=True):
                more = len((text or "").encode())
                if held and size + more > most:
                    yield written(held)
                    held, size = [], 0
                held.append((i, text))
                size += more
        if held:
            yield written(held)

    parts = max(1, min(total["n"], -(-total["bytes"] // most)))
    return Blocks(folder, scratch.stored(own.repartition(parts, "i", "t").mapInArrow(run, "name string"), "directory")[1])


class Shards:
    """Cuts batches into shards, indexes each and marks the words that phrases cover."""

    def __init__(self, phrases: Blocks, column: str):
        self.phrases, self.column = phrases, column

    def __call__(self, batches):
        for batch in sliced(batches, self.column, SHARD_BYTES):
            data, offsets = text_bytes(batch.column(self.column))
            words = Words(data, offsets, ALNUM, fold=True)
            depth = np.zeros(len(words.hashes) + 1, dtype=np.int64)
            items: dict[int, set[str]] = {}
            for phrases in self.phrases:
                at, length, which = shard_hits(words, phrases)
                np.add.at(depth, at, 1)
                np.add.at(depth, at + length, -1)
                owner = np.searchsorted(words.first, at, side="right") - 1
                for doc, phrase in np.unique(np.stack([owner, which], axis=1), axis=0).tolist() if len(at) else ():
                    items.setdefault(doc, set()).update(phrases.items[phrase])
            yield batch, data, offsets, words, np.cumsum(depth)[:-1] > 0, items


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: n_words, n_hit, n_items, items_sha256, contaminated and the removal spans.

    ``spans`` are byte ranges of the UTF-8 text, end exclusive, each from the
    first to the last word of a merged run of hit words.
    """
    shards = Shards(blocks(items, "item_id", "text"), "text")
    schema = (
        "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean,"
        " spans array<struct<start: long, end: long>>"
    )
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch, _, offsets, words, hit, items in shards(batches):
            n = batch.num_rows
            sums = np.zeros(len(hit) + 1, dtype=np.int64)
            np.cumsum(hit, out=sums[1:])
            n_hit = sums[words.first[1:]] - sums[words.first[:-1]]
            names = [sorted(items.get(i, ())) for i in range(n)]
            spans = [[{"start": a, "end": b} for a, b in removal_spans(words, hit, offsets, i)] if n_hit[i] else [] for i in range(n)]
            made = [
                batch.column("doc_id"),
                pa.array(words.counts.astype(np.int64)),
                pa.array(n_hit),
                pa.array([len(x) for x in names], pa.int64()),
                pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names], pa.string()),
                pa.array(n_hit > 0),
                pa.array(spans, span),
            ]
            yield pa.RecordBatch.from_arrays(
                made, names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"]
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def removal_spans(words: Words, hit: np.ndarray, offsets: np.ndarray, doc: int) -> list[tuple[int, int]]:
    """Byte spans, relative to the text, of its merged runs of hit words."""
    a, b = words.first[doc], words.first[doc + 1]
    own = np.concatenate([[False], hit[a:b], [False]]).astype(np.int8)
    edge = np.diff(own)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    base = offsets[doc]
    return list(zip((words.starts[a + starts] - base).tolist(), (words.ends[a + ends - 1] - base).tolist(), strict=True))


def cleaned(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the removal spans cut out of the text; other rows pass unchanged.

    A removed span leaves a line break, and ``n_chars``, where present, is
    counted anew.  Words on both sides of a cut can form a phrase again; the
    text is searched until none is left.
    """
    shards = Shards(blocks(items, "item_id", "text"), text_col)
    counts = "n_chars" in docs.columns

    def once(texts: list[str]) -> list[str]:
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], names=["t"])
        out = []
        for part, data, offsets, words, hit, _ in Shards(shards.phrases, "t")(iter([batch])):
            out += [cut_out(data, offsets, words, hit, i) for i in range(part.num_rows)]
        return out

    def run(batches):
        for batch, data, offsets, words, hit, _ in shards(batches):
            docs_hit = np.unique(np.searchsorted(words.first, np.flatnonzero(hit), side="right") - 1)
            if not len(docs_hit):
                yield batch
                continue
            texts = batch.column(text_col).to_pylist()
            made = [cut_out(data, offsets, words, hit, i) for i in docs_hit.tolist()]
            while (again := once(made)) != made:
                made = again
            for i, text in zip(docs_hit.tolist(), made, strict=True):
                texts[i] = text
            at = batch.schema.get_field_index(text_col)
            out = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            if counts:
                at = batch.schema.get_field_index("n_chars")
                numbers = batch.column("n_chars").to_pylist()
                for i in docs_hit.tolist():
                    numbers[i] = len(texts[i])
                out = out.set_column(at, batch.schema.field(at), pa.array(numbers, batch.schema.field(at).type))
            yield out

    return docs.mapInArrow(run, docs.schema)


def cut_out(data: np.ndarray, offsets: np.ndarray, words: Words, hit: np.ndarray, doc: int) -> str:
    base, end = int(offsets[doc]), int(offsets[doc + 1])
    raw = data[base:end].tobytes()
    parts, at = [], 0
    for a, b in removal_spans(words, hit, offsets, doc):
        parts.append(raw[at:a])
        at = b
    return b"\n".join([*parts, raw[at:]]).decode()
