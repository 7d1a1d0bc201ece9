"""Top-k keyword search that skips what cannot win.

Beside the postings an index keeps *blocks*: for each token and each range of
``BLOCK_IDS`` file ids one row, with the files that hold the token, the most
occurrences any of them has per column, and the shortest of them.  BM25 grows
with occurrences and falls with length, so a block row bounds the score of all
its files without being opened:

1. The narrow columns of the query's tokens give every block's bound, and
   leave out blocks that lack a phrase that is required.
2. The blocks with the highest bounds are opened first; the k-th score among
   their files is the mark.
3. Of the rest only blocks whose bound reaches the mark are opened.

Scores are those of ``fulltext.rank_postings``, ties included.  Phrases of
several tokens need positions, which blocks do not have.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators.fulltext import IDF_FLOOR, K1, WEIGHTS, B, Phrase, rank_postings

#: Ids of a block, and blocks opened before there is a mark.
BLOCK_IDS = 1_024
FIRST_BLOCKS = 16
#: Tokens of files that a task groups at once.
SLICE_TOKENS = 500_000
#: Bounds that the driver holds; more stay distributed.
DRIVER_BLOCKS = 20_000
#: Sums may be rounded differently in a bound and in a score.
SLACK = 1e-9

_PIECES = "token string, block bigint, ids array<bigint>, lengths array<int>, counts array<int>, places array<int>"
BLOCKS = (
    "token string, block bigint, n bigint, most array<bigint>, shortest bigint,"
    " docs array<struct<id: bigint, counts: array<bigint>, n_tokens: bigint>>, places array<array<bigint>>"
)


@dataclass(frozen=True)
class Ranked:
    """Best files (id, rank), and how many block rows of the query's tokens were opened."""

    top: DataFrame
    opened: int


def build_blocks(postings: DataFrame, lengths: DataFrame, columns: Sequence[str] = tuple(WEIGHTS), block_ids: int = BLOCK_IDS) -> DataFrame:
    """(token, block, n, most, shortest, docs) out of postings (id, col, pos, token) and lengths (id, n_tokens).

    ``docs`` has (id, counts, n_tokens) per file; ``counts`` and ``most`` are
    occurrences per column.
    """
    counts = [F.count_if(F.col("col") == i) for i in range(len(columns))]
    per_file = postings.groupBy("token", "id").agg(F.array(*counts).alias("counts")).join(lengths, "id")
    most = F.array(*[F.max(F.get("counts", F.lit(i))) for i in range(len(columns))])
    return per_file.groupBy("token", F.floor(F.col("id") / block_ids).alias("block")).agg(
        F.count(F.lit(1)).alias("n"),
        most.alias("most"),
        F.min("n_tokens").alias("shortest"),
        F.sort_array(F.collect_list(F.struct("id", "counts", "n_tokens"))).alias("docs"),
    )


def indexed_blocks(files: DataFrame, keep: Callable[[DataFrame, str], DataFrame], columns: Sequence[str] = tuple(WEIGHTS), block_ids: int = BLOCK_IDS) -> DataFrame:
    """The rows of ``build_blocks`` with ``places``, straight from texts, in storage order.

    ``places`` has per file of ``docs`` its occurrences of the token, each as
    column << 32 | position.  Texts are cut once.  A task groups the tokens of
    a slice of files by (token, block) before anything is shuffled; the pieces
    are ranged by (token, block) and joined where they meet.  Rows without a
    token list all files of a block with their lengths.  ``keep`` writes a
    table and reads it back (ranging reads it twice).
    """
    cut = [F.regexp_extract_all(T.fold_for_index(F.coalesce(F.col(c), F.lit(""))), F.lit(T.TOKEN_PATTERN), 0).alias(f"c{i}") for i, c in enumerate(columns)]
    pieces = keep(files.select("id", *cut).mapInArrow(_pieces(len(columns), block_ids), _PIECES), "pieces")
    low = F.get("ids", F.lit(0))
    ranged = pieces.repartitionByRange("token", "block").sortWithinPartitions("token", "block", low)
    return ranged.mapInArrow(_joined(len(columns)), BLOCKS)


def _pieces(width: int, block_ids: int):
    def piece(ids: np.ndarray, lists: list[pa.Array], sizes: np.ndarray) -> pa.RecordBatch:
        by_id = np.argsort(ids, kind="stable")
        ids, place = ids[by_id], np.argsort(by_id, kind="stable")
        lengths = sizes.sum(axis=1)[by_id]
        doc = np.concatenate([np.repeat(place, sizes[:, c]) for c in range(width)])
        column = np.repeat(np.arange(width), sizes.sum(axis=0))
        pos = np.concatenate([np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) for n in sizes.T])
        words = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
        key = words.indices.to_numpy().astype(np.int64) * len(ids) + doc
        order = np.argsort(key, kind="stable")  # columns and positions stay in order
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        pair = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
        counts = np.bincount(pair * width + column[order], minlength=len(first) * width)
        code, holder = key[first] // len(ids), key[first] % len(ids)
        # beside the tokens one run of all files, without a token
        block = np.append(ids[holder], ids) // block_ids
        code = np.append(code, np.full(len(ids), -1))
        start = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (block[1:] != block[:-1])))
        holder = np.append(holder, np.arange(len(ids)))
        ends = np.append(start, len(holder))
        token = words.dictionary.take(pa.array(code[start], mask=code[start] < 0))
        places = np.append(first, np.full(len(ids), len(key)))

        def lists_of(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))

        return pa.RecordBatch.from_arrays(
            [
                token,
                pa.array(block[start]),
                lists_of(ends, ids[holder]),
                lists_of(ends, lengths[holder].astype(np.int32)),
                lists_of(ends * width, np.append(counts, np.zeros(len(ids) * width, np.int64)).astype(np.int32)),
                lists_of(np.append(places[start], len(key)), pos[order].astype(np.int32)),
            ],
            names=["token", "block", "ids", "lengths", "counts", "places"],
        )

    def run(batches):
        for batch in batches:
            ids = batch.column("id").to_numpy()
            lists = [batch.column(f"c{c}") for c in range(width)]
            sizes = np.stack([x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for x in lists], axis=1)
            total, at = np.append(0, np.cumsum(sizes.sum(axis=1))), 0
            while at < len(ids):
                to = max(at + 1, int(np.searchsorted(total, total[at] + SLICE_TOKENS, side="right")) - 1)
                yield piece(ids[at:to], [x.slice(at, to - at) for x in lists], sizes[at:to])
                at = to

    return run


def _joined(width: int):
    """Joins pieces of one (token, block) that follow each other; a run may go on in the next batch."""

    def codes(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        token = pc.fill_null(rows.column("token").combine_chunks(), "").dictionary_encode()
        return token.indices.to_numpy(), rows.column("block").to_numpy()

    def block_rows(rows: pa.Table) -> pa.RecordBatch:
        code, block = codes(rows)
        start = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (block[1:] != block[:-1])))
        ids_of = rows.column("ids").combine_chunks()
        held = ids_of.value_lengths().to_numpy()
        ids, lengths, counts, places = (rows.column(c).combine_chunks().flatten().to_numpy() for c in ("ids", "lengths", "counts", "places"))
        counts = counts.reshape(-1, width).astype(np.int64)
        group = np.repeat(np.repeat(np.arange(len(start)), np.diff(np.append(start, len(code)))), held)
        places = np.repeat(np.tile(np.arange(width), len(ids)), counts.ravel()) << 32 | places
        amount = counts.sum(axis=1)
        order = np.lexsort((ids, group))
        if (order[1:] < order[:-1]).any():
            begin = np.cumsum(amount) - amount
            ids, lengths, counts, amount, begin = ids[order], lengths[order], counts[order], amount[order], begin[order]
            places = places[np.repeat(begin - (np.cumsum(amount) - amount), amount) + np.arange(amount.sum())]
        low = np.searchsorted(group, np.arange(len(start)))
        ends = pa.array(np.append(low, len(ids)).astype(np.int32))
        fixed = lambda n, values: pa.ListArray.from_arrays(pa.array((np.arange(n + 1) * width).astype(np.int32)), pa.array(values.ravel()))
        docs = pa.StructArray.from_arrays([pa.array(ids), fixed(len(ids), counts), pa.array(lengths.astype(np.int64))], names=["id", "counts", "n_tokens"])
        held = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(amount)).astype(np.int32)), pa.array(places))
        return pa.RecordBatch.from_arrays(
            [
                rows.column("token").combine_chunks().take(pa.array(start)),
                pa.array(block[start]),
                pa.array(np.diff(np.append(low, len(ids)))),
                fixed(len(start), np.maximum.reduceat(counts, low, axis=0)),
                pa.array(np.minimum.reduceat(lengths, low).astype(np.int64)),
                pa.ListArray.from_arrays(ends, docs),
                pa.ListArray.from_arrays(ends, held),
            ],
            names=["token", "block", "n", "most", "shortest", "docs", "places"],
        )

    def run(batches):
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            code, block = codes(rows)
            last = int(np.flatnonzero((code != code[-1]) | (block != block[-1]))[-1]) + 1 if ((code != code[-1]) | (block != block[-1])).any() else 0
            if last:
                yield block_rows(rows.slice(0, last).combine_chunks())
            rest = rows.slice(last)
        if rest is not None:
            yield block_rows(rest.combine_chunks())

    return run


def postings_of(blocks: DataFrame) -> DataFrame:
    """(id, col, pos, token) out of blocks with ``places``."""
    rows = blocks.select("token", F.explode(F.arrays_zip(F.col("docs.id").alias("id"), F.col("places"))).alias("doc"))
    places = rows.select("token", F.col("doc.id").alias("id"), F.explode("doc.places").alias("place"))
    return places.select("id", F.shiftright("place", 32).cast("int").alias("col"), F.col("place").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("pos"), "token")


def lengths_of(blocks: DataFrame) -> DataFrame:
    """(id, n_tokens) of all files, from the rows without a token."""
    return blocks.filter(F.col("token").isNull()).select(F.inline("docs")).select("id", "n_tokens")


def layout_blocks(blocks: DataFrame) -> DataFrame:
    """Order for storage: a query's tokens lie in few row groups, whatever their number of blocks."""
    return blocks.repartitionByRange("token", "block").sortWithinPartitions("token", "block")


def corpus_totals(lengths: DataFrame) -> DataFrame:
    """One row: n_files, n_tokens."""
    return lengths.agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"))


def _weighted(counts: str, weights: dict[str, float], columns: Sequence[str]) -> str:
    return " + ".join(f"get({counts}, {i}) * {float(weights.get(c, 0.0))!r}D" for i, c in enumerate(columns))


def _test(phrase: Phrase) -> str:
    word = phrase.tokens[0].replace("\\", "\\\\").replace("'", "\\'")
    return f"startswith(token, '{word}')" if phrase.prefix else f"token = '{word}'"


def _summary(rows: DataFrame, phrases: Sequence[Phrase], weights: dict[str, float], columns: Sequence[str]) -> DataFrame:
    """Per block: its rows, most occurrences (f) and files hit (h) of each phrase, and its shortest file.

    A file counts once, however many tokens of a prefix it holds, and only
    where columns have weight.  Exact tokens are counted from the block rows
    alone, prefixes from the ids in them.
    """
    every = all(weights.get(c, 0.0) > 0 for c in columns)
    ids = "docs.id" if every else f"transform(filter(docs, d -> {_weighted('d.counts', weights, columns)} > 0), d -> d.id)"
    made = ["count(1) AS tokens", "min(shortest) AS shortest"]
    for i, phrase in enumerate(phrases):
        test = _test(phrase)
        made.append(f"sum(CASE WHEN {test} THEN {_weighted('most', weights, columns)} ELSE 0D END) AS f{i}")
        if every and not phrase.prefix:
            made.append(f"sum(CASE WHEN {test} THEN n ELSE 0 END) AS h{i}")
        else:
            made.append(f"cast(size(array_distinct(flatten(collect_list(CASE WHEN {test} THEN {ids} END)))) AS bigint) AS h{i}")
    return rows.groupBy("block").agg(*map(F.expr, made))


def _factor(files: int, hits: int) -> float:
    """Inverse document frequency of a phrase."""
    raw = math.log((files - hits + 0.5) / (hits + 0.5))
    return raw if raw > 0 else IDF_FLOOR


def rank_top(
    blocks: DataFrame,
    totals: DataFrame,
    phrases: Sequence[Phrase],
    limit: int,
    weights: dict[str, float] = WEIGHTS,
    require_all: bool = True,
    columns: Sequence[str] = tuple(WEIGHTS),
    digits: int | None = None,
) -> Ranked:
    """The ``limit`` best files by (rank, id), from stored blocks.

    ``digits`` rounds ranks before they are compared.  At most ``limit`` rows
    per step reach the driver, and the bounds of up to ``DRIVER_BLOCKS``
    blocks; beyond these, bounds stay a distributed table.
    """
    spark = blocks.sparkSession
    empty = Ranked(spark.createDataFrame([], "id long, rank double"), 0)
    if not phrases:
        return empty
    if any(len(p.tokens) > 1 for p in phrases):
        raise ValueError("blocks have no positions: phrases of several tokens are ranked by postings")
    if any(v < 0 for v in weights.values()):
        raise ValueError("bounds hold for weights of at least 0")
    ids = range(len(phrases))
    rows = blocks.filter(" OR ".join(_test(p) for p in phrases))
    summary = _summary(rows, phrases, weights, columns)
    known = summary.limit(DRIVER_BLOCKS + 1).collect()
    local = len(known) <= DRIVER_BLOCKS
    if local:
        hit = [sum(r[f"h{i}"] for r in known) for i in ids]
    else:
        hit = list(summary.agg(*[F.sum(f"h{i}") for i in ids]).first())
    if not known or not (all if require_all else any)(hit):
        return empty
    total = totals.first()
    factors = [_factor(total["n_files"], h) for h in hit]
    mean = total["n_tokens"] / total["n_files"]
    both = " AND " if require_all else " OR "
    present = both.join(f"f{i} > 0" for i in ids)

    def rank(length: str) -> str:
        norm = f"{K1!r}D * ({1 - B!r}D + {B!r}D * {length} / {mean!r}D)"
        return "-(" + " + ".join(f"{v!r}D * f{i} * {K1 + 1!r}D / (f{i} + {norm})" for i, v in enumerate(factors)) + ")"

    def best_of(opened: DataFrame) -> list:
        own = _weighted("counts", weights, columns)
        files = opened.selectExpr(*[f"{_test(p)} AS m{i}" for i, p in enumerate(phrases)], "inline(docs)")
        found = files.groupBy("id").agg(
            *[F.expr(f"sum(CASE WHEN m{i} THEN {own} ELSE 0D END) AS f{i}") for i in ids], F.expr("first(n_tokens) AS n_tokens")
        )
        shown = rank("n_tokens") if digits is None else f"round({rank('n_tokens')}, {digits})"
        return found.filter(present).selectExpr("id", f"{shown} AS rank").orderBy("rank", "id").limit(limit).collect()

    if local:
        bounds = sorted((_bound(r, factors, mean), r["block"], r["tokens"]) for r in known if (all if require_all else any)(r[f"f{i}"] > 0 for i in ids))
    else:
        table = summary.filter(present).selectExpr("block", "tokens", f"{rank('shortest')} AS bound")
        bounds = [(r["bound"], r["block"], r["tokens"]) for r in table.orderBy("bound", "block").limit(FIRST_BLOCKS).collect()]
    first = [b[1] for b in bounds[:FIRST_BLOCKS]]
    best = best_of(rows.filter(F.col("block").isin(first)))
    opened = sum(b[2] for b in bounds[:FIRST_BLOCKS])
    mark = float("inf")
    if len(best) == limit:
        mark = best[-1]["rank"] + SLACK * (1 + abs(best[-1]["rank"])) + (0 if digits is None else 10.0**-digits)
    more = []
    if local:
        rest = [b for b in bounds[FIRST_BLOCKS:] if b[0] <= mark]
        opened += sum(b[2] for b in rest)
        if rest:
            numbers = spark.createDataFrame([(b[1],) for b in rest], "block long")
            more = best_of(rows.join(F.broadcast(numbers), "block", "left_semi"))
    else:
        rest = table.filter(~F.col("block").isin(first) & (F.col("bound") <= mark))
        opened += rest.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
        more = best_of(rows.join(rest.select("block"), "block", "left_semi"))
    found = sorted((r["rank"], r["id"]) for r in best + more)[:limit]
    return Ranked(spark.createDataFrame([(i, r) for r, i in found], "id long, rank double"), opened)


def _bound(row: Any, factors: Sequence[float], mean: float) -> float:
    norm = K1 * (1 - B + B * row["shortest"] / mean)
    return -sum(v * row[f"f{i}"] * (K1 + 1) / (row[f"f{i}"] + norm) for i, v in enumerate(factors))


def best_files(
    index: Any,
    phrases: Sequence[Phrase],
    limit: int,
    weights: dict[str, float] = WEIGHTS,
    require_all: bool = True,
    digits: int | None = None,
) -> DataFrame:
    """(id, rank) of the ``limit`` best files of an index that has postings, lengths, blocks and totals.

    Phrases of several tokens are found by their positions in the postings.
    """
    if all(len(p.tokens) == 1 for p in phrases):
        return rank_top(index.blocks, index.totals, phrases, limit, weights, require_all, digits=digits).top
    ranked = rank_postings(index.postings, index.lengths, phrases, weights, require_all)
    ranked = ranked if digits is None else ranked.withColumn("rank", F.round("rank", digits))
    return ranked.orderBy("rank", "id").limit(limit)
