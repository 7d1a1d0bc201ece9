"""Audit of how the sources of a language differ in their use of terms.

1. *Document frequencies.*  Each task counts in how many of its texts a term
   occurs; terms that enough texts of a language hold are kept.
2. *Vocabulary.*  The kept terms of a language, sorted by bytes, are cut into
   shards of consecutive terms.  Each shard becomes a minimal acyclic
   transducer: built from the sorted terms by joining equal endings as soon as
   a state can no longer change, with outputs on the arcs that add up to a
   term's ordinal (`Transducer.build`).  Shards lie as files in the shared
   folder; a task loads the ones its texts lead to.
3. *Recount.*  Texts stream through the transducers: all terms of a slice of
   text walk at once, a byte at a time, and come out as ordinals or not at
   all (`Transducer.walk`).  Counts are (lang, source, ordinal).
4. *Comparison.*  Smoothed shares in whole billionths; per group the terms it
   uses more than its language does, and per pair of sources the summed
   difference over all kept terms, block of ordinals by block.  Ordinals
   settle ties between terms.

Defined results: null text, language or source count as ``''``; an empty text
has no terms, and rows that repeat a doc_id are documents of their own.  A
language without kept terms still gives its pairs, with value 0.  An empty
table gives no rows.  Terms and texts may be of any length; other columns play
no part.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, OrderedDict
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.llm.arrays import byte_class, cut, sliced, text_bytes
from foliant.llm.common import Scratch, numbered, small
from foliant.llm.tokenfiles import as_uri

#: Documents of a language that must hold a term, the weight that smooths counts, the terms reported per group.
LEAST_DOCUMENTS = 30
SMOOTHING = 5
REPORTED = 50
SCALE = 1_000_000_000
#: Terms of a shard, and bytes of shards that a task keeps.
SHARD_TERMS = 1 << 12
HELD_BYTES = 64 << 20
#: Terms a task counts before it hands them on, and occurrences that it sums up at a time.
FLUSH_ROWS = 1 << 18
SUMMED = 1 << 20
#: Cells (sources x terms) of a block of the comparison.
CELLS = 1 << 15

#: Terms of the contract `[^\x00-\x40\x5B-\x60\x7B-\x7F]+`, A-Z lower-cased.
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
LETTERS = byte_class(lambda b: 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def parts_of(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, text) without nulls."""
    filled = {"lang": lang_col, "source": source_col, "text": text_col}
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for n, c in filled.items()])


# --------------------------------------------------------------------------
# vocabulary


def document_counts(parts: DataFrame) -> DataFrame:
    """(lang, term, docs): documents of the language that hold the term."""

    def run(batches):
        held: dict[str, Counter] = {}
        size = 0

        def rows():
            for lang, counts in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())],
                    names=["lang", "term", "docs"],
                )

        for batch in sliced(batches, "text"):
            data, offsets = text_bytes(batch.column("text"))
            raw = data.tobytes().translate(LOWER)
            for lang, a, b in zip(batch.column("lang").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                own = held.setdefault(lang, Counter())
                own.update(set(TERM.findall(raw, a, b)))
            size = sum(map(len, held.values()))
            if size > FLUSH_ROWS:
                yield from rows()
                held, size = {}, 0
        yield from rows()

    counted = parts.select("lang", "text").mapInArrow(run, "lang string, term binary, docs long")
    return counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"))


class Transducer:
    """Minimal acyclic automaton of sorted terms; outputs along a path add up to the term's place among them."""

    def __init__(self, root: int, keys: np.ndarray, targets: np.ndarray, outputs: np.ndarray, ends: np.ndarray):
        #: arcs, ascending by ``state * 256 + byte``; ``ends``: whether a term may end behind the arc
        self.root, self.keys, self.targets, self.outputs, self.ends = root, keys, targets, outputs, ends

    @classmethod
    def build(cls, terms: list[bytes]) -> Transducer:
        """Of distinct ascending terms, none of them empty."""
        known: dict[tuple, int] = {}
        sizes: list[int] = []
        finals: list[bool] = []
        arcs: list[tuple] = []
        # the path of the last term: per state whether it is final, and its finished arcs
        final, open_arcs, last = [False], [[]], b""

        def close(depth: int) -> None:
            while len(final) - 1 > depth:
                state = (final.pop(), tuple(open_arcs.pop()))
                number = known.get(state)
                if number is None:
                    number = known[state] = len(sizes)
                    sizes.append(state[0] + sum(sizes[to] for _, to in state[1]))
                    finals.append(state[0])
                    arcs.append(state[1])
                open_arcs[-1].append((last[len(final) - 1], number))

        for term in terms:
            common, most = 0, min(len(term), len(last))
            while common < most and term[common] == last[common]:
                common += 1
            close(common)
            final += [False] * (len(term) - common)
            open_arcs += [[] for _ in range(len(term) - common)]
            final[-1], last = True, term
        close(0)
        arcs.append(tuple(open_arcs[0]))
        finals.append(False)
        keys, targets, outputs, ends = [], [], [], []
        for state, own in enumerate(arcs):
            before = int(finals[state])
            for label, to in own:
                keys.append(state * 256 + label)
                targets.append(to)
                outputs.append(before)
                ends.append(finals[to])
                before += sizes[to]
        return cls(len(arcs) - 1, np.array(keys, np.int64), np.array(targets, np.int64), np.array(outputs, np.int64), np.array(ends, bool))

    @property
    def states(self) -> int:
        return self.root + 1

    @property
    def nbytes(self) -> int:
        return sum(a.nbytes for a in (self.keys, self.targets, self.outputs, self.ends))

    def walk(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Ordinals of the terms in byte spans, -1 where a span is no term."""
        found = np.full(len(starts), -1, dtype=np.int64)
        if not len(self.keys):
            return found
        who, at, stop = np.arange(len(starts)), starts.astype(np.int64), ends
        state, sums = np.full(len(starts), self.root, np.int64), np.zeros(len(starts), np.int64)
        while len(who):
            key = state * 256 + data[at]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = self.keys[arc] == key
            who, at, stop, arc = who[on], at[on] + 1, stop[on], arc[on]
            sums = sums[on] + self.outputs[arc]
            done = at == stop
            whole = done & self.ends[arc]
            found[who[whole]] = sums[whole]
            on = ~done
            who, at, stop, sums, state = who[on], at[on], stop[on], sums[on], self.targets[arc[on]]
        return found

    def table(self) -> pa.Table:
        return pa.table({"key": self.keys, "target": self.targets, "output": self.outputs, "ends": pa.array(self.ends)}).replace_schema_metadata(
            {"root": str(self.root)}
        )

    @classmethod
    def of(cls, table: pa.Table) -> Transducer:
        columns = (table.column(n).to_numpy() for n in ("key", "target", "output", "ends"))
        return cls(int(table.schema.metadata[b"root"]), *columns)


def shard_file(lang: str, shard: int) -> str:
    return f"{sha256(lang.encode()).hexdigest()}-{shard:06d}.arrow"


class Vocabulary:
    """Kept terms of all languages: stored tables, and transducers in a folder.

    ``terms`` has (lang, term, pos, total): ``pos`` is the ordinal.  ``shards``
    lists the files; it lies in ``directory``, where tasks look it up.
    """

    def __init__(self, terms: DataFrame, shards: DataFrame, directory: str, folder: str, shard_terms: int):
        self.terms, self.shards, self.directory, self.folder, self.shard_terms = terms, shards, directory, folder, shard_terms


def _writer(folder: str):
    def run(key, rows):
        lang, shard = (k.as_py() for k in key)
        terms = sorted(rows.column("term").to_pylist())
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        name = shard_file(lang, shard)
        # a repeated task writes the same bytes; a reader never sees half a file
        draft = f"{base}/.{name}-{np.random.default_rng().integers(1 << 62):x}"
        made = Transducer.build(terms)
        table = made.table()
        with system.open_output_stream(draft) as sink, pa.ipc.new_file(sink, table.schema) as writer:
            writer.write_table(table)
        system.move(draft, f"{base}/{name}")
        return pa.table(
            [pa.array([lang], pa.string()), pa.array([shard], pa.int64()), pa.array([terms[0]], pa.binary()), pa.array([len(terms)], pa.int64()), pa.array([made.states], pa.int64())],
            names=["lang", "shard", "low", "terms", "states"],
        )

    return run


def vocabulary(parts: DataFrame, scratch: Scratch, least: int = LEAST_DOCUMENTS, shard_terms: int = SHARD_TERMS) -> Vocabulary:
    """Find the kept terms, number them, and write their transducers."""
    kept = scratch.saved(document_counts(parts).filter(F.col("docs") >= least), "kept")
    terms = scratch.saved(numbered(kept, ["lang"], ["term"], scratch), "terms")
    folder = as_uri(f"{scratch.root}/transducers")
    cut_up = terms.select("lang", "term", F.call_function("div", "pos", F.lit(shard_terms).cast("long")).alias("shard"))
    made = cut_up.groupBy("lang", "shard").applyInArrow(_writer(folder), "lang string, shard long, low binary, terms long, states long")
    return Vocabulary(terms, *scratch.stored(made, "shards"), folder, shard_terms)


# --------------------------------------------------------------------------
# recount


class Shelf:
    """Transducers of a task: a directory per language, files loaded as texts lead to them."""

    def __init__(self, folder: str, directory: str, shard_terms: int):
        self.folder, self.directory, self.shard_terms = folder, directory, shard_terms
        self.lows: dict[str, list[bytes]] = {}
        self.held: OrderedDict[tuple[str, int], Transducer] = OrderedDict()

    def first_terms(self, lang: str) -> list[bytes]:
        """First term of each shard of a language."""
        import pyarrow.dataset as ds

        if lang not in self.lows:
            system, base = fs.FileSystem.from_uri(as_uri(self.directory))
            rows = ds.dataset(base, filesystem=system, format="parquet").to_table(columns=["shard", "low"], filter=ds.field("lang") == lang)
            self.lows[lang] = rows.sort_by("shard").column("low").to_pylist()
        return self.lows[lang]

    def load(self, lang: str, shard: int) -> Transducer:
        if (lang, shard) not in self.held:
            system, base = fs.FileSystem.from_uri(self.folder)
            with system.open_input_file(f"{base}/{shard_file(lang, shard)}") as file:
                self.held[lang, shard] = Transducer.of(pa.ipc.open_file(file).read_all())
            while len(self.held) > 1 and sum(t.nbytes for t in self.held.values()) > HELD_BYTES:
                self.held.popitem(last=False)
        self.held.move_to_end((lang, shard))
        return self.held[lang, shard]

    def ordinals(self, lang: str, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        lows = self.first_terms(lang)
        out = np.full(len(starts), -1, dtype=np.int64)
        shard = shards_of(lows, data, starts, ends)
        for one in np.unique(shard[shard >= 0]).tolist():
            here = np.flatnonzero(shard == one)
            place = self.load(lang, one).walk(data, starts[here], ends[here])
            out[here] = np.where(place >= 0, place + one * self.shard_terms, -1)
        return out


def shards_of(lows: list[bytes], data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The shard that could hold each span: the last whose first term is not above it, -1 if there is none."""
    if len(lows) < 2:
        return np.full(len(starts), len(lows) - 1, dtype=np.int64)
    heads = head_words(data, starts, ends)
    edges = np.frombuffer(b"".join(low[:8].ljust(8, b"\0") for low in lows), dtype=">u8").astype(np.uint64)
    out = np.searchsorted(edges, heads, side="right") - 1
    # where eight bytes do not decide, the whole term does
    for i in np.flatnonzero(np.searchsorted(edges, heads, side="left") - 1 != out).tolist():
        out[i] = bisect_right(lows, data[starts[i] : ends[i]].tobytes()) - 1
    return out


def head_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """First eight bytes of spans as numbers that sort like them, shorter spans filled with zeros."""
    out = np.zeros(len(starts), dtype=np.uint64)
    for k in range(8):
        at = starts + k
        inside = at < ends
        own = np.where(inside, data[np.where(inside, at, 0)], 0) if len(data) else np.zeros(len(starts), np.uint8)
        out = (out << np.uint64(8)) | own.astype(np.uint64)
    return out


def recounted(parts: DataFrame, words: Vocabulary) -> DataFrame:
    """(lang, source, ord, n): occurrences of kept terms."""
    folder, directory, shard_terms = words.folder, words.directory, words.shard_terms
    lower = np.frombuffer(LOWER, dtype=np.uint8)

    def run(batches):
        shelf = Shelf(folder, directory, shard_terms)
        names: dict[tuple[str, str], int] = {}
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        met: list[np.ndarray] = []

        def merged():
            fresh, often = np.unique(np.concatenate([keys[:0], *met]), return_counts=True)
            every, weight = np.concatenate([keys, fresh]), np.concatenate([counts, often])
            order = np.argsort(every, kind="stable")
            every, weight = every[order], weight[order]
            first = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, np.int64)
            return every[first], np.add.reduceat(weight, first) if len(first) else weight

        def rows():
            who = list(names)
            for g in np.unique(keys >> 40).tolist():
                here = keys >> 40 == g
                n = int(here.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([who[g][0]] * n, pa.string()), pa.array([who[g][1]] * n, pa.string()), pa.array(keys[here] & ((1 << 40) - 1)), pa.array(counts[here])],
                    names=["lang", "source", "ord", "n"],
                )

        for batch in sliced(batches, "text"):
            data, offsets = text_bytes(batch.column("text"))
            data = lower[data]
            starts, ends = cut(data, offsets, LETTERS)
            first = np.searchsorted(starts, offsets)
            langs = batch.column("lang").to_pylist()
            pairs = list(zip(langs, batch.column("source").to_pylist(), strict=True))
            group = np.array([names.setdefault(p, len(names)) for p in pairs], dtype=np.int64)
            owner = np.repeat(np.arange(len(pairs)), np.diff(first))
            spoken = np.unique(np.array(langs, dtype=object)).tolist()
            which = np.array([spoken.index(x) for x in langs])[owner]
            for i, lang in enumerate(spoken):
                here = np.flatnonzero(which == i)
                place = shelf.ordinals(lang, data, starts[here], ends[here])
                hit = place >= 0
                met.append((group[owner[here[hit]]] << 40) | place[hit])
            if sum(map(len, met)) > SUMMED:
                keys, counts = merged()
                met.clear()
            if len(keys) > 2 * SUMMED and not met:
                yield from rows()
                keys, counts, names = keys[:0], counts[:0], {}
        keys, counts = merged()
        yield from rows()

    made = parts.mapInArrow(run, "lang string, source string, ord long, n long")
    return made.groupBy("lang", "source", "ord").agg(F.sum("n").alias("n"))


# --------------------------------------------------------------------------
# comparison


def share(n: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (n + SMOOTHING) / (total + SMOOTHING * terms)), exact for counts of any size."""
    above = f"cast({SCALE} as decimal(10,0)) * cast({n} + {SMOOTHING} as decimal(20,0))"
    below = f"cast({total} + {SMOOTHING} * {terms} as decimal(20,0))"
    return F.expr(f"1 + ({above}) div {below}")


def groups_of(parts: DataFrame, words: Vocabulary, counts: DataFrame) -> DataFrame:
    """(lang, source, i, sources, terms, total, spoken): every occurring group, its number within the language, its totals."""
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = words.shards.groupBy("lang").agg(F.sum("terms").alias("terms"))
    own = Window.partitionBy("lang")
    return (
        parts.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("rows"))
        .join(totals, ["lang", "source"], "left")
        .join(sizes, "lang", "left")
        .select("lang", "source", F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("total", F.lit(0)).alias("total"))
        .withColumn("spoken", F.sum("total").over(own))
        .withColumn("sources", F.count(F.lit(1)).over(own))
        .withColumn("i", (F.row_number().over(own.orderBy("source")) - 1).cast("long"))
    )


def leading_terms(counts: DataFrame, groups: DataFrame, words: Vocabulary, reported: int = REPORTED) -> DataFrame:
    """Terms that a group uses more than its language, the strongest per group."""
    per_term = Window.partitionBy("lang", "ord")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ord")
    return (
        counts.withColumn("m", F.sum("n").over(per_term))
        .join(small(groups.select("lang", "source", "terms", "total", "spoken")), ["lang", "source"])
        .withColumn("value", share("n", "total", "terms") - share("m", "spoken", "terms"))
        .filter("value > 0")
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= reported)
        .join(words.terms.select("lang", F.col("pos").alias("ord"), "term"), ["lang", "ord"])
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value", "rank")
    )


def _differences(key, rows):
    """Differences of a block: rows without a place give each source's share of an absent term."""
    lang = key[0].as_py()
    i, at, p = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("i", "at", "p"))
    heads = at < 0
    order = np.argsort(i[heads])
    width = rows.column("width").to_numpy()[0]
    table = np.repeat(p[heads][order][:, None], width, axis=1)
    table[i[~heads], at[~heads]] = p[~heads]
    n = len(table)
    first, second, value = [], [], []
    for a in range(n - 1):
        first.append(np.full(n - 1 - a, a, np.int64))
        second.append(np.arange(a + 1, n, dtype=np.int64))
        value.append(np.abs(table[a + 1 :] - table[a]).sum(axis=1, dtype=np.int64))
    if n < 2:
        first = second = value = [np.zeros(0, np.int64)]
    made = [np.concatenate(x) for x in (first, second, value)]
    return pa.table([pa.array([lang] * len(made[0]), pa.string()), *map(pa.array, made)], names=["lang", "a", "b", "value"])


def source_pairs(counts: DataFrame, groups: DataFrame, cells: int = CELLS) -> DataFrame:
    """Each source of a language beside each other one, by their summed difference over all kept terms.

    The result lists pairs of sources; terms are gone through in blocks of
    ordinals, of which each task compares whole rows of shares.
    """
    sized = groups.withColumn("span", F.greatest(F.lit(1).cast("long"), F.call_function("div", F.lit(cells).cast("long"), "sources")))
    sized = sized.withColumn("blocks", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("terms") / F.col("span")).cast("long")))
    width = F.least("span", F.col("terms") - F.col("block") * F.col("span"))
    heads = (
        sized.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .withColumn("n", F.lit(0).cast("long"))
        .withColumn("at", F.lit(-1).cast("long"))
        .withColumn("p", F.when(F.col("terms") > 0, share("n", "total", "terms")).otherwise(F.lit(0)))
    )
    cells_of = (
        counts.join(small(sized), ["lang", "source"])
        .withColumn("block", F.call_function("div", "ord", "span"))
        .withColumn("at", F.col("ord") % F.col("span"))
        .withColumn("p", share("n", "total", "terms"))
    )
    columns = ["lang", "block", "i", "at", "p", width.alias("width")]
    blocks = heads.select(*columns).unionByName(cells_of.select(*columns)).groupBy("lang", "block")
    sums = blocks.applyInArrow(_differences, "lang string, a long, b long, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = sums.select("lang", "value", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("of"))
    name = groups.select("lang", "i", "source")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return (
        both.select("lang", "value", F.col("of.a").alias("i"), F.col("of.b").alias("other"))
        .join(small(name), ["lang", "i"])
        .join(small(name.select("lang", F.col("i").alias("other"), F.col("source").alias("item"))), ["lang", "other"])
        .select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    )


def audited(
    docs: DataFrame, least: int = LEAST_DOCUMENTS, reported: int = REPORTED, shard_terms: int = SHARD_TERMS, cells: int = CELLS
) -> DataFrame:
    """Per language and source, the other sources by difference and the terms it leads in: lang, source, part, item, value, rank."""
    scratch = Scratch(docs.sparkSession, "divergence")
    parts = parts_of(docs)
    words = vocabulary(parts, scratch, least, shard_terms)
    counts = scratch.saved(recounted(parts, words), "counts")
    groups = scratch.saved(groups_of(parts, words, counts), "groups")
    return source_pairs(counts, groups, cells).unionByName(leading_terms(counts, groups, words, reported))
