"""N-gram Jaccard join by PartEnum signatures.

A document's set holds hashes of its distinct n-word shingles.  Sets are put in
size bands; two sets similar enough lie in the same or in neighbouring bands,
so band j has one signature instance for the pairs whose smaller set lies in it.
In an instance at most K elements tell a linked pair apart.

* K small: the domain is hashed into K + 2 partitions and every choice of two of
  them is a signature.  K differences spoil at most K partitions, so two remain.
* K larger: the domain is hashed into P > K + 1 partitions, each alone a
  signature.  P - K partitions stay equal, so each side may leave out its
  P - K - 1 weakest ones (fewest elements): the strongest equal partition ranks
  above P - K - 1 others on both sides.  That keeps K + 1 signatures and drops
  the empty partitions, which would pair unrelated documents.

Sets that share a signature are candidates.  They are compared with a few pivots
per signature, by sketches and where these allow a link on whole texts, and
verified links merge components.  Most
signatures then have all their members in one component, which settles them.
In the others, all pairs of members from different components are compared,
block by block within tasks.  So no link between components is lost, and the
pairs of a large group of near copies are never listed.

Rows with null or blank texts have an empty set and link with nothing.  Rows
that share a doc_id count as one document: their sets fall into one component.
A null doc_id links with nothing and is its own (null) component.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.llm.arrays import SPACED, Words, give_back, mix, sliced, text_bytes
from foliant.llm.common import Bitmap, Scratch, bitmap_of, fresh, maybe_in, saved

ENUMERATED_K = 3
SPREAD = 1.3
#: Members verified against one pivot in one task.
CHUNK = 200
#: Pivots per signature, round by round.
STARS = (1, 4)
#: Signatures counted in one task, and the most such tasks.
PART_ROWS, MAX_PARTS = 500_000, 50_000
#: Blocks of signatures for each such task, signatures sent at once, and the bytes that tell one from others of its block.
PART_BLOCKS, SENT, TAIL = 2, 500_000, 5
#: Shingles of the members that one task holds when it compares components.
BLOCK = 4_000_000
MAX_SIZE = 1 << 40


@dataclass(frozen=True)
class Similarity:
    """Shingle length, and the least Jaccard similarity as a fraction."""

    words: int = 5
    num: int = 4
    den: int = 5

    def holds(self, common: int, size_a: int, size_b: int) -> bool:
        return self.den * common >= self.num * (size_a + size_b - common)


@lru_cache(maxsize=8)
def bands(sim: Similarity) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest set size of each band; a band's sizes are similar enough to one another."""
    low, high = [1], []
    while low[-1] < MAX_SIZE:
        high.append(low[-1] * sim.den // sim.num)
        low.append(high[-1] + 1)
    return np.array(low[:-1], dtype=np.int64), np.array(high, dtype=np.int64)


def shingle_sets(column: pa.Array, sim: Similarity) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and their offsets.

    A text with fewer words than a shingle has its whole sequence as one.
    """
    data, offsets = text_bytes(column)
    words = Words(data, offsets, SPACED, fold=True)
    h, first, counts = words.hashes, words.first, words.counts
    n = sim.words
    if len(h) >= n:
        rolled = np.zeros(len(h) - n + 1, dtype=np.uint64)
        for i in range(n):
            rolled = mix(rolled * np.uint64(3) + h[i : len(h) - n + 1 + i])
    else:
        rolled = np.zeros(0, dtype=np.uint64)
    sets = []
    for at, count in zip(first.tolist(), counts.tolist(), strict=False):
        if count >= n:
            sets.append(np.unique(rolled[at : at + count - n + 1]))
        elif count:
            short = np.array([count], dtype=np.uint64)
            for i in range(at, at + count):
                short = mix(short * np.uint64(3) + h[i : i + 1])
            sets.append(short)
        else:
            sets.append(np.zeros(0, dtype=np.uint64))
    ends = np.zeros(len(sets) + 1, dtype=np.int64)
    np.cumsum([len(s) for s in sets], out=ends[1:])
    return (np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)), ends


def digests(values: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums over each set."""
    out = []
    for salt in (0x51, 0xA7):
        sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(mix(values ^ np.uint64(salt * 0x0101010101010101)), out=sums[1:])
        out.append((sums[ends[1:]] - sums[ends[:-1]]).view(np.int64))
    return out[0], out[1]


def signatures(values: np.ndarray, ends: np.ndarray, sim: Similarity) -> tuple[np.ndarray, np.ndarray]:
    """PartEnum signatures of all sets, and their offsets."""
    sizes = np.diff(ends)
    low, high = bands(sim)
    band = np.searchsorted(low, sizes, side="right") - 1
    gap, both = sim.den - sim.num, sim.den + sim.num
    made_sig, made_doc = [], []
    for lower in (0, 1):
        instance = band - lower
        ok = (sizes > 0) & (instance >= 0)
        top = high[np.maximum(instance, 0)]
        if lower:
            ok &= sizes * sim.num <= top * sim.den
            own = (top + sizes) * gap // both
        else:
            own = sizes * gap // sim.num
        most = top * gap // sim.num
        own = np.minimum(own, most)
        few = most <= ENUMERATED_K
        parts = np.where(few, most + 2, np.ceil(SPREAD * (most + 1)).astype(np.int64))
        docs = np.flatnonzero(ok)
        if not len(docs):
            continue
        base = np.zeros(len(docs) + 1, dtype=np.int64)
        np.cumsum(parts[docs], out=base[1:])
        place = np.concatenate([np.arange(a, b) for a, b in zip(ends[docs], ends[docs + 1], strict=True)]) if len(docs) < len(sizes) else np.arange(ends[-1])
        v = values[place]
        reps = sizes[docs]
        slot = (v >> np.uint64(32)) * np.repeat(parts[docs], reps).astype(np.uint64) >> np.uint64(32)
        slot = slot.astype(np.int64) + np.repeat(base[:-1], reps)
        sums = np.zeros(base[-1], dtype=np.uint64)
        np.add.at(sums, slot, mix(v ^ np.uint64(0x5DEECE66D)))
        counts = np.bincount(slot, minlength=base[-1])
        doc = np.repeat(np.arange(len(docs)), parts[docs])
        part = np.arange(base[-1]) - base[doc]
        seed = (instance[docs] + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        # single partitions, the strongest first
        many = ~few[docs]
        picked = np.flatnonzero(many[doc])
        if len(picked):
            d = doc[picked]
            rank = (d.astype(np.uint64) << np.uint64(44)) | ((np.uint64(255) - np.minimum(counts[picked], 255).astype(np.uint64)) << np.uint64(36)) | (mix(sums[picked]) >> np.uint64(28))
            order = np.argsort(rank, kind="stable")
            picked, d = picked[order], d[order]
            at = np.arange(len(d)) - np.searchsorted(d, d, side="left")
            keep = at <= own[docs][d]
            picked, d = picked[keep], d[keep]
            made_sig.append(mix(sums[picked] + seed[d] + part[picked].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))
            made_doc.append(docs[d])
        # pairs of partitions
        for k in range(ENUMERATED_K + 1):
            d = np.flatnonzero(few[docs] & (most[docs] == k))
            for i in range(k + 2):
                for j in range(i + 1, k + 2):
                    pair = mix(sums[base[d] + i] + np.uint64(i + 1)) * np.uint64(3) + mix(sums[base[d] + j] + np.uint64(j + 1))
                    made_sig.append(mix(pair + seed[d] + np.uint64(i * 64 + j)))
                    made_doc.append(docs[d])
    sig = np.concatenate(made_sig) if made_sig else np.zeros(0, dtype=np.uint64)
    doc = np.concatenate(made_doc) if made_doc else np.zeros(0, dtype=np.int64)
    order = np.argsort(doc, kind="stable")
    out = np.zeros(len(sizes) + 1, dtype=np.int64)
    np.cumsum(np.bincount(doc, minlength=len(sizes)), out=out[1:])
    return sig[order].view(np.int64), out


def marks_of(ids: np.ndarray, n: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    """64-bit mark of a row by its id and set."""
    own = mix(ids.view(np.uint64))
    for part in (n, d1, d2):
        own = mix(own ^ np.ascontiguousarray(part).view(np.uint64))
    return own.view(np.int64)


def marked(copies: DataFrame, held: Bitmap | None = None) -> DataFrame:
    """(id, mark) out of (id, n, d1, d2); with a bitmap, of the marks that may be in it."""

    def run(batches):
        for batch in batches:
            own = marks_of(*(batch.column(c).to_numpy() for c in ("id", "n", "d1", "d2")))
            rows = pa.RecordBatch.from_arrays([batch.column("id"), pa.array(own)], names=["id", "mark"])
            yield rows if held is None else rows.filter(pa.array(held.may_hold(own)))

    return copies.select("id", "n", "d1", "d2").mapInArrow(run, "id long, mark long")


@dataclass(frozen=True)
class Copies:
    """Bitmaps that tell copies by their marks.

    ``maybe`` holds the marks of all copies, ``unsure`` those of all other rows
    that are in ``maybe`` nevertheless.  A mark in the first alone is a copy's.
    The second goes by other bits, or each of its rows would hide a copy.
    """

    maybe: Bitmap
    unsure: Bitmap

    def surely(self, marks: np.ndarray) -> np.ndarray:
        """Which rows are copies; a few copies are not told."""
        return self.maybe.may_hold(marks) & ~self.unsure.may_hold(marks >> 32)


def copies_of(known: DataFrame, marks: DataFrame, scratch: Scratch) -> Copies:
    """Bitmaps out of all rows (doc_id, n, d1, d2) and the stored (id, mark) of copies."""
    maybe = bitmap_of(marks, "mark", hashed=True)
    rows = marked(known.withColumnRenamed("doc_id", "id"), maybe)
    unsure = scratch.saved(rows.join(marks, ["id", "mark"], "left_anti").select(F.shiftright("mark", 32).alias("high")), "unsure")
    return Copies(maybe, bitmap_of(unsure, "high", hashed=True))


def without(values: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sets and offsets without the sets that are gone."""
    sizes = np.diff(ends)
    kept = np.zeros(len(sizes) - int(gone.sum()) + 1, dtype=np.int64)
    np.cumsum(sizes[~gone], out=kept[1:])
    return values[np.repeat(~gone, sizes)], kept


def features(docs: DataFrame, sim: Similarity) -> DataFrame:
    """(doc_id, n, d1, d2) of each row."""

    def build(batches):
        for batch in sliced(batches, "text"):
            values, ends = shingle_sets(batch.column("text"), sim)
            made = [batch.column("doc_id"), pa.array(np.diff(ends)), *(pa.array(x) for x in digests(values, ends))]
            yield pa.RecordBatch.from_arrays(made, names=["doc_id", "n", "d1", "d2"])

    return docs.select("doc_id", "text").mapInArrow(build, "doc_id long, n long, d1 long, d2 long")


def originals(batches, sim: Similarity, copies: Copies):
    """For each slice: ids, marks and sets of the rows that are not surely copies."""
    for batch in sliced(batches, "text"):
        values, ends = shingle_sets(batch.column("text"), sim)
        ids = batch.column("doc_id").to_numpy()
        marks = marks_of(ids, np.diff(ends), *digests(values, ends))
        gone = copies.surely(marks)
        yield ids[~gone], marks[~gone], *without(values, ends, gone)


def signed(docs: DataFrame, sim: Similarity, copies: Copies, blocks: int, wanted: Bitmap) -> DataFrame:
    """(doc_id, n, mark, sigs) of the rows that are not surely copies.

    Signatures that are surely not ``wanted`` are left out.  Rows that may be
    copies have their mark, others have none.
    """

    def build(batches):
        for ids, marks, values, ends in originals(batches, sim, copies):
            sig, out = signatures(values, ends, sim)
            sig = keyed(sig, blocks)
            keep = wanted.may_hold(sig)
            out = np.concatenate(([0], np.cumsum(keep)))[out]
            sigs = pa.ListArray.from_arrays(pa.array(out.astype(np.int32)), pa.array(sig[keep]))
            made = [pa.array(ids), pa.array(np.diff(ends)), pa.array(marks, mask=~copies.maybe.may_hold(marks)), sigs]
            yield pa.RecordBatch.from_arrays(made, names=["doc_id", "n", "mark", "sigs"])

    return docs.select("doc_id", "text").mapInArrow(build, "doc_id long, n long, mark long, sigs array<long>")


def keyed(sig: np.ndarray, blocks: int) -> np.ndarray:
    """Signatures cut to a block number and ``TAIL`` bytes; the few that fall together only add candidates."""
    sig = sig.view(np.uint64)
    block = (sig >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)
    return (block << np.uint64(8 * TAIL) | sig & np.uint64((1 << 8 * TAIL) - 1)).view(np.int64)


def packed(keys: np.ndarray) -> pa.RecordBatch:
    """(block, tails): keys by block, those found twice or more listed twice."""
    keys = np.sort(keys)
    more = np.flatnonzero(keys[2:] == keys[:-2]) + 2
    if len(more):
        keys = np.delete(keys, more)
    blocks, first = np.unique(keys >> 8 * TAIL, return_index=True)
    tails = np.ascontiguousarray(keys.astype("<i8", copy=False).view(np.uint8).reshape(-1, 8)[:, :TAIL])
    ends = (np.append(first, len(keys)) * TAIL).astype(np.int32)
    rows = pa.Array.from_buffers(pa.binary(), len(blocks), [None, pa.py_buffer(ends), pa.py_buffer(tails)])
    return pa.RecordBatch.from_arrays([pa.array(blocks), rows], names=["block", "tails"])


def repeated(block: int, tails: list[bytes]) -> pa.RecordBatch:
    """(sig): keys of one block that are listed twice or more."""
    raw = np.frombuffer(b"".join(tails), dtype=np.uint8).reshape(-1, TAIL)
    keys = np.zeros((len(raw), 8), dtype=np.uint8)
    keys[:, :TAIL] = raw
    keys = np.sort(keys.view("<i8").ravel())
    twice = np.unique(keys[1:][keys[1:] == keys[:-1]])
    return pa.RecordBatch.from_arrays([pa.array(twice + (block << 8 * TAIL))], names=["sig"])


def shared_signatures(docs: DataFrame, sim: Similarity, parts: int, copies: Copies) -> DataFrame:
    """(sig) of all signatures with two members or more, copies apart.

    Tasks gather signatures and send them as one array for each block of the
    hash range, without what the block tells: nearly all are distinct and do
    not compress.  A signature of very many documents is sent twice at a time.
    """
    blocks = parts * PART_BLOCKS

    def send(batches):
        held, size = [], 0
        for _, _, values, ends in originals(batches, sim, copies):
            held.append(keyed(signatures(values, ends, sim)[0], blocks))
            size += len(held[-1])
            if size >= SENT:
                yield packed(np.concatenate(held))
                held, size = [], 0
        if size:
            yield packed(np.concatenate(held))
        held = []
        give_back()

    def count(batches):
        block, tails = None, []
        for batch in batches:
            for now, own in zip(batch.column("block").to_pylist(), batch.column("tails").to_pylist(), strict=True):
                if now != block and tails:
                    yield repeated(block, tails)
                    tails = []
                block = now
                tails.append(own)
        if tails:
            yield repeated(block, tails)
        tails = []
        give_back()

    sent = docs.select("doc_id", "text").mapInArrow(send, "block long, tails binary")
    return sent.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(count, "sig long")


def components(docs: DataFrame, sim: Similarity, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sets = saved(features(docs, sim), "sets")
    scratch = Scratch(docs.sparkSession, "links")
    labels = saved(link_labels(docs, sets, sim, scratch), "labels")
    scratch.discard()
    return sets.join(labels, sets.doc_id == labels.id, "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "doc_id").alias("component_id")
    )


def link_labels(docs: DataFrame, sets: DataFrame, sim: Similarity, scratch: Scratch) -> DataFrame:
    """(id, label) of documents whose component's smallest id is another's."""
    known = sets.filter(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    # exact copies: one class per set, all other copies leave the candidate search
    # (aggregates are stored before they are joined: Spark can then split the hot keys of the join)
    classes = scratch.saved(
        known.groupBy("d1", "d2", "n")
        .agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1"),
        "classes",
    )
    copies = scratch.saved(
        known.join(classes, ["d1", "d2", "n"])
        .filter(F.col("doc_id") != F.col("class_id"))
        .select(F.col("doc_id").alias("id"), "class_id", "d1", "d2", "n")
        .distinct(),
        "copies",
    )
    # one id with several sets belongs to several classes: those are links too
    links = copies.select(F.col("id").alias("a"), F.col("class_id").alias("b"))
    labels = contract(links, None, scratch)

    known_docs = docs.filter(F.col("doc_id").isNotNull())
    # a copy leaves by its text, before signatures are counted: other texts of its id stay.  Very
    # few rows are not told from copies; these carry a mark that is decided by a join of their members alone
    marks = scratch.saved(marked(copies).distinct(), "marks")
    told = copies_of(known, marks, scratch)
    shingles = sets.agg(F.sum("n")).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MAX_PARTS, shingles // (2 * PART_ROWS)))
    shared = scratch.saved(shared_signatures(known_docs, sim, parts, told), "shared")
    scratch.settle()
    # most signatures have one member: a bitmap keeps them out of the join
    rows = signed(known_docs, sim, told, parts * PART_BLOCKS, bitmap_of(shared, "sig", hashed=True))
    rows = rows.select(F.col("doc_id").alias("id"), "n", "mark", F.explode("sigs").alias("sig"))
    met = scratch.saved(rows.join(shared, "sig").select("sig", "id", "n", "mark"), "members")
    clear = met.filter("mark IS NULL").drop("mark")
    members = clear.unionByName(met.filter("mark IS NOT NULL").join(marks, ["id", "mark"], "left_anti").select(*clear.columns))
    ids = scratch.saved(members.select("id").distinct(), "ids")
    texts = scratch.saved(texts_of(docs, ids).join(ids, F.col("doc_id") == F.col("id"), "left_semi"), "texts")
    short = scratch.saved(sketches(texts, sim), "sketches")
    for pivots in STARS:
        scratch.settle()
        members = open_members(members, labels, scratch)
        if members.isEmpty():
            return labels
        pairs, members = pivot_pairs(members, pivots, sim, scratch)
        labels = contract(verified(possible(pairs, short, sim, scratch), texts, sim, scratch), labels, scratch)
    scratch.settle()
    members = open_members(members, labels, scratch)
    return labels if members.isEmpty() else contract(cross_links(members, texts, short, sim, scratch), labels, scratch)


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose doc_id may be among stored ids; nearly all others are left out."""
    flagged, flag = maybe_in(docs, "doc_id", bitmap_of(ids, "id"))
    return flagged.filter(flag).drop(flag)


def open_members(members: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """Members, with labels, of the signatures that still join different components.

    Of signatures with the same members one is kept; rows of members are told
    apart by their number, smallest and largest id and the exact sum of a 64-bit
    mix, in which repeated ids do not cancel out.
    """
    members = members.select("sig", "id", "n")

    def labelled(rows: DataFrame) -> DataFrame:
        return rows.join(labels, "id", "left").select("sig", "id", "n", F.coalesce("label", "id").alias("label"))

    split = scratch.saved(
        labelled(members)
        .groupBy("sig")
        .agg(
            F.min("label").alias("low"),
            F.max("label").alias("high"),
            F.struct(F.count(F.lit(1)), F.min("id"), F.max("id"), F.sum(F.xxhash64("id").cast("decimal(19,0)"))).alias("members"),
        )
        .filter("low <> high")
        .groupBy("members")
        .agg(F.min("sig").alias("sig"))
        .select("sig"),
        "split",
    )
    # few signatures are left: a bitmap keeps members of the others out of the join
    flagged, flag = maybe_in(members, "sig", bitmap_of(split, "sig"))
    return scratch.saved(labelled(flagged.filter(flag).drop(flag)).join(split, "sig"), "open")


def pivot_pairs(members: DataFrame, pivots: int, sim: Similarity, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Pairs of each signature's next pivots with its members, and the members without these pivots.

    Signatures of one group of near copies have much the same members, and as
    all choose by the same order they choose much the same pivots.
    """
    order = Window.partitionBy("sig").orderBy(F.xxhash64("id"), "id")
    pivot = scratch.saved(
        members.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= pivots)
        .select("sig", F.col("id").alias("p"), F.col("n").alias("pn"), F.col("label").alias("pl")),
        "pivots",
    )
    pairs = (
        members.join(pivot, "sig")
        .filter(
            (F.col("id") != F.col("p"))
            & (F.col("label") != F.col("pl"))
            & (F.least("n", "pn") * sim.den >= F.greatest("n", "pn") * sim.num)
        )
        .select(F.least("p", "id").alias("p"), F.greatest("p", "id").alias("q"))
        .distinct()
    )
    rest = members.join(pivot.select("sig", F.col("p").alias("id")), ["sig", "id"], "left_anti")
    return scratch.saved(pairs, "pairs"), scratch.saved(rest, "rest")


def possible(pairs: DataFrame, short: DataFrame, sim: Similarity, scratch: Scratch) -> DataFrame:
    """The pairs (p, q) whose sketches allow a link, so that the texts of the others are not sent.

    Of an id with several texts, any of its sketches may allow it.
    """
    for side in ("p", "q"):
        pairs = pairs.join(short.select(F.col("id").alias(side), F.col("n").alias(f"n{side}"), F.col("sketch").alias(f"s{side}")), side)
    gap, both = sim.den - sim.num, sim.den + sim.num

    def compare(batches):
        for batch in batches:
            sizes = batch.column("np").to_numpy() + batch.column("nq").to_numpy()
            keep = []
            for size, a, b in zip(sizes.tolist(), batch.column("sp"), batch.column("sq"), strict=True):
                a, b = (np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in (a, b))
                words = min(len(a), len(b))
                apart = int(np.bitwise_count(folded(a, words) ^ folded(b, words)).sum(dtype=np.int64))
                keep.append(apart * both <= gap * size)
            yield batch.select(["p", "q"]).filter(pa.array(keep, pa.bool_()))

    columns = ["p", "q", "np", "nq", "sp", "sq"]
    return scratch.saved(pairs.select(*columns).mapInArrow(compare, "p long, q long").distinct(), "possible")


def verified(pairs: DataFrame, texts: DataFrame, sim: Similarity, scratch: Scratch) -> DataFrame:
    """Links (a, b): the pairs (p, q) whose sets are similar enough, checked on whole texts.

    The members of a pivot are dealt over chunks of about ``CHUNK``, so a pivot
    with very many members is many tasks' work; a chunk is read as a stream
    that starts with the pivot.
    """
    # the side with more pairs acts as the pivot
    ends = pairs.select(F.explode(F.array("p", "q")).alias("id"))
    load = scratch.saved(ends.groupBy("id").agg(F.count(F.lit(1)).alias("load")), "load")
    dealt = (
        pairs.join(load.select(F.col("id").alias("p"), F.col("load").alias("lp")), "p")
        .join(load.select(F.col("id").alias("q"), F.col("load").alias("lq")), "q")
        .select(
            F.when(F.col("lp") >= F.col("lq"), F.col("p")).otherwise(F.col("q")).alias("hub"),
            F.when(F.col("lp") >= F.col("lq"), F.col("q")).otherwise(F.col("p")).alias("member"),
            F.greatest("lp", "lq").alias("load"),
        )
        .withColumn("chunk", F.pmod(F.xxhash64("member"), F.ceil(F.col("load") / CHUNK)))
    )
    dealt = scratch.saved(dealt.select("hub", "chunk", "member"), "dealt")
    wanted = dealt.select("hub", "chunk", F.col("member").alias("id"), F.lit(1).alias("part")).unionByName(
        dealt.select("hub", "chunk", F.col("hub").alias("id"), F.lit(0).alias("part")).distinct()
    )
    ready = (
        wanted.join(_only(texts, load), F.col("id") == F.col("doc_id"))
        .select("hub", "chunk", "part", "id", "text")
        .repartition("hub", "chunk")
        .sortWithinPartitions("hub", "chunk", "part")
    )

    def compare(batches):
        key, pivot = None, []
        for batch in sliced(batches, "text"):
            values, ends = shingle_sets(batch.column("text"), sim)
            hubs, chunks = batch.column("hub").to_pylist(), batch.column("chunk").to_pylist()
            parts, ids = batch.column("part").to_pylist(), batch.column("id").to_pylist()
            low, high = [], []
            for i, now in enumerate(zip(hubs, chunks, strict=True)):
                own = values[ends[i] : ends[i + 1]]
                if now != key:
                    key, pivot = now, []
                if parts[i] == 0:
                    pivot.append(own.copy())
                elif any(sim.holds(len(np.intersect1d(own, other, assume_unique=True)), len(own), len(other)) for other in pivot):
                    low.append(min(now[0], ids[i]))
                    high.append(max(now[0], ids[i]))
            yield pa.RecordBatch.from_arrays([pa.array(low, pa.int64()), pa.array(high, pa.int64())], names=["a", "b"])

    return ready.mapInArrow(compare, "a long, b long").distinct()


def _only(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """Texts of ids that may be wanted, so that the others are not shuffled."""
    return texts_of(texts, ids)


def sketch_words(size: int, sim: Similarity) -> int:
    """Words of a set's sketch: a power of two with about 8 bits for each element two linked sets may differ in."""
    most = size * (sim.den - sim.num) // sim.num + 1
    return 1 << min(8, max(0, (most // 8).bit_length()))


def sketch(own: np.ndarray, words: int) -> np.ndarray:
    """Parity of the elements hashed to each of ``64 * words`` bits, ``words`` a power of two.

    Two sketches differ in at most as many bits as their sets differ in elements.
    """
    place = mix(own ^ np.uint64(0xC0FFEE)) & np.uint64(64 * words - 1)
    parity = np.bincount(place.astype(np.int64), minlength=64 * words) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.uint64)


def folded(own: np.ndarray, words: int) -> np.ndarray:
    """The same set's sketch with fewer words: its halves laid over each other."""
    while len(own) > words:
        own = own[: len(own) // 2] ^ own[len(own) // 2 :]
    return own


def sketches(texts: DataFrame, sim: Similarity) -> DataFrame:
    """(id, n, sketch) of each text."""

    def build(batches):
        for batch in sliced(batches, "text"):
            values, ends = shingle_sets(batch.column("text"), sim)
            sizes = np.diff(ends)
            made = [sketch(values[a:b], sketch_words(b - a, sim)).tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(made, pa.binary())], names=["id", "n", "sketch"])

    return texts.select("doc_id", "text").mapInArrow(build, "id long, n long, sketch binary")


def cross_links(members: DataFrame, texts: DataFrame, short: DataFrame, sim: Similarity, scratch: Scratch) -> DataFrame:
    """Links (a, b) between different components of each signature, all pairs compared.

    Every member outside a signature's largest component meets all members of
    other components.  Members lie in blocks of at most ``BLOCK`` shingles (or
    one member), outsiders come as a stream to every block, and pairs live in
    the tasks only.  A first pass over sketches finds which members and
    outsiders of a block can have a link at all; a second one over the texts of
    these alone decides: out comes one link per outsider, block and component.
    """
    weight = members.groupBy("sig", "label").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("total"))
    plan = weight.groupBy("sig").agg(
        F.max(F.struct("size", "label"))["label"].alias("largest"), F.ceil(F.sum("total") / BLOCK).alias("blocks")
    )
    plan = scratch.saved(plan, "plan")
    placed = members.join(plan, "sig")
    inside = placed.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).withColumn("part", F.lit(0))
    outside = (
        placed.filter(F.col("label") != F.col("largest"))
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .withColumn("part", F.lit(1))
    )
    columns = ["sig", "block", "part", "id", "label"]
    dealt = inside.select(*columns).unionByName(outside.select(*columns))
    near = scratch.saved(_in_blocks(dealt.join(short, "id"), [*columns, "n", "sketch"], _near(sim), columns), "near")
    scratch.settle()
    full = near.join(_only(texts, near), F.col("id") == F.col("doc_id"))
    return _in_blocks(full, [*columns, "text"], _linked(sim), ["a", "b"]).distinct()


_TYPES = {"sig": "long", "block": "long", "part": "int", "id": "long", "label": "long", "a": "long", "b": "long"}


def _in_blocks(rows: DataFrame, columns: list[str], compare, out: list[str]) -> DataFrame:
    """Run ``compare`` over rows sorted by block, members before outsiders."""
    ready = rows.select(*columns).repartition("sig", "block").sortWithinPartitions("sig", "block", "part")
    return ready.mapInArrow(compare, ", ".join(f"{c} {_TYPES[c]}" for c in out))


def _near(sim: Similarity):
    """Rows of the blocks whose sketches allow a link with the other side."""
    names = ["sig", "block", "part", "id", "label"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]

    def compare(batches):
        block = None
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(batch.column(c).to_pylist() for c in (*names, "n", "sketch")), strict=True):
                sig, number, part, own_id, label, n, raw = row
                if block is None or block.key != (sig, number):
                    if block is not None:
                        out += block.touched()
                    block = _Sketches((sig, number), sim)
                own = np.frombuffer(raw, dtype=np.uint64)
                if part == 0:
                    block.add(row[:5], n, own)
                elif block.meet(label, n, own):
                    out.append(row[:5])
            yield _batch(out, names, kinds)
        if block is not None:
            yield _batch(block.touched(), names, kinds)

    return compare


def _batch(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


class _Sketches:
    """Sketches of the members of one block."""

    def __init__(self, key: tuple, sim: Similarity):
        self.key, self.sim, self.rows, self.sizes, self.held, self.matrix = key, sim, [], [], [], None

    def add(self, row: tuple, n: int, own: np.ndarray) -> None:
        self.rows.append(row)
        self.sizes.append(n)
        self.held.append(own)

    def meet(self, label: int, n: int, own: np.ndarray) -> bool:
        """Marks the members an outsider may be linked with; are there any?"""
        if not self.rows:
            return False
        if self.matrix is None:
            self.words = min(map(len, self.held))
            self.matrix = np.stack([folded(x, self.words) for x in self.held])
            self.size, self.label = np.array(self.sizes), np.array([r[4] for r in self.rows])
            self.hit = np.zeros(len(self.rows), dtype=bool)
        matrix = self.matrix
        if len(own) < self.words:
            matrix = np.stack([folded(x, len(own)) for x in matrix])
        gap, both = self.sim.den - self.sim.num, self.sim.den + self.sim.num
        apart = np.bitwise_count(matrix ^ folded(own, min(len(own), self.words))).sum(axis=1, dtype=np.int64)
        near = (apart * both <= gap * (self.size + n)) & (self.label != label)
        self.hit |= near
        return bool(near.any())

    def touched(self) -> list[tuple]:
        return [] if self.matrix is None else [self.rows[i] for i in np.flatnonzero(self.hit).tolist()]


def _linked(sim: Similarity):
    """Links between the members and the outsiders of the blocks."""
    columns = ("sig", "block", "part", "id", "label")

    def compare(batches):
        key, block = None, None
        for batch in sliced(batches, "text"):
            values, ends = shingle_sets(batch.column("text"), sim)
            rows = zip(*(batch.column(c).to_pylist() for c in columns), strict=True)
            a, b = [], []
            for i, (sig, number, part, own_id, label) in enumerate(rows):
                if (sig, number) != key:
                    key, block = (sig, number), _Block(sim)
                own = values[ends[i] : ends[i + 1]]
                if part == 0:
                    block.add(own_id, label, own.copy())
                else:
                    found = block.linked(label, own)
                    a += [own_id] * len(found)
                    b += found
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return compare


class _Block:
    """Members of one block, asked for links with an outsider."""

    def __init__(self, sim: Similarity):
        self.sim, self.ids, self.labels, self.sets, self.sketches = sim, [], [], [], None

    def add(self, own_id: int, label: int, own: np.ndarray) -> None:
        self.ids.append(own_id)
        self.labels.append(label)
        self.sets.append(own)

    def _close(self) -> None:
        self.sizes = np.array([len(s) for s in self.sets])
        self.words = sketch_words(int(self.sizes.max()), self.sim)
        self.sketches = np.stack([sketch(s, self.words) for s in self.sets])
        self.marks = np.array(self.labels)

    def linked(self, label: int, own: np.ndarray) -> list[int]:
        """One linked member of each other component that has one."""
        if not self.ids:
            return []
        if self.sketches is None:
            self._close()
        gap, both = self.sim.den - self.sim.num, self.sim.den + self.sim.num
        distance = np.bitwise_count(self.sketches ^ sketch(own, self.words)).sum(axis=1, dtype=np.int64)
        near = np.flatnonzero((distance * both <= gap * (self.sizes + len(own))) & (self.marks != label))
        out: dict[int, int] = {}
        for i in near[np.argsort(distance[near], kind="stable")].tolist():
            if self.labels[i] not in out:
                common = len(np.intersect1d(own, self.sets[i], assume_unique=True))
                if self.sim.holds(common, len(own), len(self.sets[i])):
                    out[self.labels[i]] = self.ids[i]
        return list(out.values())


def contract(links: DataFrame, labels: DataFrame | None, scratch: Scratch) -> DataFrame:
    """(id, label): each linked document with the smallest id of its component.

    Every document hooks onto the smallest neighbour; hooked nodes are merged
    and the remaining edges between merged nodes go into the next turn, so the
    number of turns grows with the logarithm of a component's width.
    ``labels`` holds the components found before.
    """
    spark = links.sparkSession
    if labels is None:
        labels = spark.createDataFrame([], "id long, label long")
    for side in ("a", "b"):
        links = (
            links.join(labels.select(F.col("id").alias(side), F.col("label").alias("_to")), side, "left")
            .withColumn(side, F.coalesce("_to", side))
            .drop("_to")
        )
    edges = scratch.saved(links.filter("a <> b").select("a", "b").distinct(), "edges")
    while not edges.isEmpty():
        hooks = scratch.saved(
            edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).groupBy("u").agg(F.min("v").alias("v")),
            "hooks",
        )
        moved = labels.join(hooks, labels.label == hooks.u, "left").select("id", F.coalesce("v", "label").alias("label"))
        fresh = hooks.join(labels, hooks.u == labels.id, "left_anti").select(F.col("u").alias("id"), F.col("v").alias("label"))
        labels = scratch.saved(moved.unionByName(fresh), "labels")
        ends = edges
        for side in ("a", "b"):
            ends = (
                ends.join(hooks.select(F.col("u").alias(side), F.col("v").alias("_to")), side, "left")
                .withColumn(side, F.coalesce("_to", side))
                .drop("_to")
            )
        onward = hooks.join(hooks.select(F.col("u").alias("v"), F.col("v").alias("w")), "v").select(F.col("v").alias("a"), F.col("w").alias("b"))
        edges = scratch.saved(ends.unionByName(onward).filter("a <> b").select("a", "b").distinct(), "edges")
    return labels


def one_per_component(docs: DataFrame, sim: Similarity) -> DataFrame:
    """``docs`` with one document of each group of linked ones: the one with the smallest doc_id.

    Rows are dropped through a join on the ids to drop alone; a bitmap of fixed
    size lets all other rows pass without a shuffle.  Of rows that repeat a kept
    doc_id and its text, all stay.
    """
    sets = components(docs, sim)
    gone = fresh(set(docs.columns), "dropped")
    dropped = saved(sets.filter(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias(gone)).distinct(), "dropped")
    flagged, flag = maybe_in(docs, "doc_id", bitmap_of(dropped, gone))
    clear = flagged.filter(~F.col(flag)).drop(flag)
    rest = flagged.filter(flag).drop(flag).join(dropped, F.col("doc_id") == F.col(gone), "left_anti")
    return clear.unionByName(rest)
