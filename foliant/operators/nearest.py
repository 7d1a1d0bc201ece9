"""Exact nearest files over a vector index, reading the clusters that can still win."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions import text as X
from foliant.functions import vectors as V
from foliant.operators import hybrid
from foliant.session import shared_dir
from foliant.sources import vectors as S
from foliant.sources.folder import as_uri

#: Rows, per wanted file, that the first round reads at least.
FIRST_ROWS = 50
#: Rows fetched per wanted file.
ROWS_PER_FILE = 4
#: Scores are rounded to ``hybrid.SCORE_DIGITS``; bounds give way by more than that.
SCORE_SLACK = 1e-8
#: Vectors of a packed block, and most tasks that groups of means are dealt to.
BLOCK = 4_096
MOST_TASKS = 10_000
#: Means and vectors that are multiplied at a time: their products stay in a core's cache.
TILE, PIECE = 256, 1_024
#: Rows of equal vectors that a block is made from, per vector; clusters with more of them fall into more blocks.
MOST_COPIES = 32


@dataclass(frozen=True)
class Found:
    """Best rows of a search (as many as were wanted), and how much it read."""

    hits: DataFrame
    clusters_read: int
    clusters: int
    rows_read: int
    rows: int


@dataclass(frozen=True)
class Scoring:
    """How rows are scored, and how scores and cosines bound each other."""

    #: adds ``score`` to rows and drops ``embedding``
    score: Callable[[DataFrame], DataFrame]
    #: highest score that a row with at most this cosine can have
    highest: Callable[[float], float]
    #: lowest cosine with which a row can reach a score
    needed: Callable[[float], float]


def by_cosine(query: Sequence[float]) -> Scoring:
    def score(rows: DataFrame) -> DataFrame:
        own = F.round(V.cosine_against(F.col("embedding"), query), hybrid.SCORE_DIGITS)
        return rows.withColumn("score", own).drop("embedding")

    return Scoring(score, lambda cosine: cosine, lambda wanted: wanted)


def by_hybrid(query: str, vector: Sequence[float], only_lexical: bool) -> Scoring:
    semantic, lexical = hybrid.hybrid_weights(hybrid.query_tokens(query))

    def score(rows: DataFrame) -> DataFrame:
        scored = hybrid.score_chunks(rows, query, vector)
        return scored.filter(F.col("lexical") > 0) if only_lexical else scored

    def highest(cosine: float) -> float:
        return min(1.0, semantic * min(1.0, max(0.0, (cosine - V.COSINE_BASELINE) / V.COSINE_RANGE)) + lexical)

    def needed(wanted: float) -> float:
        share = (wanted - lexical) / semantic
        return -1.0 if share <= 0 else V.COSINE_BASELINE + V.COSINE_RANGE * share

    return Scoring(score, highest, needed)


def _angles(index: S.VectorIndex, query: Sequence[float]) -> list[float]:
    """Angle of the query to each cluster's centre."""
    unit = V.unit_or_zero(query)
    return [
        0.0 if c.centre is None or len(c.centre) != len(unit) else float(np.arccos(np.clip(c.centre @ unit, -1.0, 1.0)))
        for c in index.clusters
    ]


def search(index: S.VectorIndex, query: Sequence[float], scoring: Scoring, top_k: int, without: int | None = None) -> Found:
    """The ``top_k`` files of highest score, each by its best chunk; ``without`` leaves one file out.

    Clusters are taken in the order of their bounds.  A first round reads
    enough of them to know ``top_k`` files; the last of these sets the mark
    that every further cluster, and every row by its angle, must be able to
    reach.  At most ``ROWS_PER_FILE`` rows per wanted file reach the driver
    at a time; where these are of too few files, the others are asked again.
    """
    spark = index.rows.sparkSession
    angles = _angles(index, query)
    prunable = bool(len(index.centres)) and len(query) == index.centres.shape[1] and bool(np.any(query))
    bound = [scoring.highest(c.best_cosine(a)) if prunable else scoring.highest(1.0) for c, a in zip(index.clusters, angles, strict=True)]
    order = sorted(range(len(bound)), key=lambda i: (-bound[i], i))
    snippet = X.truncate(F.col("chunk_text"), hybrid.SNIPPET_CHARS)
    rows = index.rows if without is None else index.rows.filter(F.col("file_id") != without)

    def best_of(chosen: list[int], mark: float | None) -> list:
        wanted = [(angles[i], index.clusters[i]) for i in chosen]
        reach = np.pi
        if mark is not None and prunable:
            reach = float(np.arccos(np.clip(scoring.needed(mark - SCORE_SLACK), -1.0, 1.0))) + S.ANGLE_SLACK
        whole = [c.number for a, c in wanted if c.centre is None or (a - reach <= c.low and c.high <= a + reach)]
        # the rest is cut by angle: clusters are folders, angles are sorted in their files
        tests = [f"cluster IN ({', '.join(map(str, whole))})"] if whole else []
        tests += [f"(cluster = {c.number} AND angle BETWEEN {a - reach!r}D AND {a + reach!r}D)" for a, c in wanted if c.number not in whole]
        test = F.expr(" OR ".join(tests))
        scored = scoring.score(rows.filter(test).drop("angle", "cluster"))
        hits: dict[int, Row] = {}
        while len(hits) < top_k:
            # the best rows of all: the first row of a file is its best chunk, and no other row is shuffled
            others = scored.filter(~F.col("file_id").isin(list(hits))) if hits else scored
            most = ROWS_PER_FILE * (top_k - len(hits))
            best = others.withColumn("chunk_snippet", snippet).select(*hybrid.HIT_SCHEMA.names).orderBy(F.desc("score"), "file_id", "chunk_index").limit(most).collect()
            for row in best:
                if len(hits) < top_k:
                    hits.setdefault(row["file_id"], row)
            if len(best) < most:
                break
        return list(hits.values())

    first, held = [], 0
    while len(first) < len(order) and held < FIRST_ROWS * top_k:
        first.append(order[len(first)])
        held += index.clusters[first[-1]].size
    found = best_of(first, None) if first else []
    mark = found[-1]["score"] if len(found) == top_k else None
    rest = [i for i in order[len(first) :] if mark is None or bound[i] >= mark - SCORE_SLACK]
    if rest:
        merged: dict[int, tuple] = {}
        for hit in found + best_of(rest, mark):
            own = (-hit["score"], hit["file_id"], hit["chunk_index"])
            if hit["file_id"] not in merged or own < merged[hit["file_id"]][0]:
                merged[hit["file_id"]] = (own, hit)
        found = [hit for _, hit in sorted(merged.values(), key=lambda x: x[0])][:top_k]
    read = [index.clusters[i] for i in first + rest]
    hits = spark.createDataFrame([tuple(h) for h in found], hybrid.HIT_SCHEMA)
    return Found(hits, len(read), len(index.clusters), sum(c.size for c in read), sum(c.size for c in index.clusters))


def similarity_search(index: S.VectorIndex, query: str, query_vector: Sequence[float] | None, top_k: int = hybrid.DEFAULT_TOP_K) -> Found:
    """``hybrid.similarity_search`` over an index: the same rows in the same order."""
    spark = index.rows.sparkSession
    total = sum(c.size for c in index.clusters)
    if not query.strip() or query_vector is None:
        return Found(spark.createDataFrame([], hybrid.HIT_SCHEMA), 0, len(index.clusters), 0, total)
    single = len(hybrid.query_tokens(query)) <= 1
    found = search(index, query_vector, by_hybrid(query, query_vector, single), top_k)
    hits = found.hits if single else hybrid.relatively_good(found.hits)
    ordered = hits.orderBy(F.desc("score"), "file_id", "chunk_index").select(*hybrid.HIT_SCHEMA.names)
    return Found(ordered, found.clusters_read, found.clusters, found.rows_read, found.rows)


def similar_files(index: S.VectorIndex, file_path: str, top_k: int = 10) -> Found:
    """``hybrid.similar_files`` over an index."""
    own = index.rows.filter(F.col("file_path") == file_path)
    mean = V.mean_vector(own, "embedding", "file_id").first()
    if mean is None:
        return Found(index.rows.sparkSession.createDataFrame([], hybrid.HIT_SCHEMA), 0, len(index.clusters), 0, sum(c.size for c in index.clusters))
    return search(index, mean["mean_vector"], by_cosine(mean["mean_vector"]), top_k, without=mean["file_id"])


# --------------------------------------------------------------------------
# similar files of every file

_PACKED = "cluster int, block long, ids binary, parts binary, vectors binary"
_WRITTEN = "cluster int, name string"
_OWNED = "cluster int, vector binary, files array<long>, parts array<long>"
_SIMILAR = "file_id long, rank int, other_id long, chunk_index int, score double"
#: Vectors per wanted file that a block first offers to a mean; more follow where these are too few files.
OFFERED = 2


def _pack(vector: str, width: int):
    def run(key, rows):
        cluster, block = (k.as_py() for k in key)
        units, good = S.units_of(rows.column(vector), width)
        ids, parts = (rows.column(c).to_numpy()[good].astype(np.int64) for c in ("file_id", "part"))
        order = np.lexsort((parts, ids))
        packed = [ids[order].tobytes(), parts[order].tobytes(), units[order].tobytes()]
        return pa.table(
            [pa.array([cluster], pa.int32()), pa.array([block], pa.int64()), *[pa.array([p], pa.binary()) for p in packed]],
            names=["cluster", "block", "ids", "parts", "vectors"],
        )

    return run


def _dealt(rows: DataFrame, key: Column, counted: Column) -> tuple[DataFrame, int]:
    """Rows of a stored table with ``block``, about ``BLOCK`` as ``counted`` of a cluster each, and the number of blocks."""
    # one row per cluster, of which there are at most S.MAX_CLUSTERS
    blocks, total = F.lit(1), 0
    for cluster, size in rows.groupBy("cluster").agg(counted).collect():
        total += -(-size // BLOCK)
        if size > BLOCK:
            blocks = F.when(F.col("cluster") == cluster, -(-size // BLOCK)).otherwise(blocks)
    return rows.withColumn("block", F.pmod(key, blocks.cast("long"))), total


def _lowest_owners(which: np.ndarray, files: np.ndarray, parts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each vector the ``most`` lowest files that have it, each with its lowest part, in the order of the vectors."""
    order = np.lexsort((parts, files, which))
    which, files, parts = which[order], files[order], parts[order]
    first = np.append(True, (which[1:] != which[:-1]) | (files[1:] != files[:-1]))[: len(which)]
    which, files, parts = which[first], files[first], parts[first]
    kept = np.arange(len(which)) - np.searchsorted(which, which) < most
    return which[kept], files[kept], parts[kept]


def _combine(width: int, most: int):
    """Distinct vectors of a batch, with their lowest owners."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            # equal vectors lie in one cluster, unless they are as near to another
            cluster = batch.column("cluster").to_numpy().astype(np.int32).view(np.uint8).reshape(n, 4)
            values = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float32).view(np.uint8).reshape(n, 4 * width)
            keys = np.concatenate([cluster, values], axis=1)
            coded = pa.Array.from_buffers(pa.binary(keys.shape[1]), n, [None, pa.py_buffer(keys)]).dictionary_encode()
            which = coded.indices.to_numpy()
            _, first = np.unique(which, return_index=True)
            owned, files, parts = _lowest_owners(which, *(batch.column(c).to_numpy().astype(np.int64) for c in ("file_id", "chunk_index")), most)
            starts = pa.array(np.searchsorted(owned, np.arange(len(first) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("cluster").take(pa.array(first)),
                    pa.array([v.tobytes() for v in values[first]], pa.binary()),
                    pa.ListArray.from_arrays(starts, pa.array(files)),
                    pa.ListArray.from_arrays(starts, pa.array(parts)),
                ],
                names=["cluster", "vector", "files", "parts"],
            )

    return run


def owned_vectors(chunks: DataFrame, width: int, top_k: int) -> DataFrame:
    """Vectors (cluster, vector, files, parts, key) of chunks, with the files that can still count.

    Chunks of equal vectors have equal scores.  Of the files that share one
    the ``top_k`` + 1 lowest ids suffice: any other file has ``top_k`` before
    it, even where the file that asks is one of them.  A vector comes once per
    batch of chunks that holds it; blocks bring these rows together.
    """
    found = chunks.select("cluster", "embedding", "file_id", "chunk_index").mapInArrow(_combine(width, top_k + 1), _OWNED)
    return found.withColumn("key", F.xxhash64("vector"))


def _write_block(folder: str, width: int, most: int):
    """Stores the distinct vectors of a block as a file, and names it."""

    def run(key, rows):
        cluster = key[0].as_py()
        rows = rows.combine_chunks()
        coded = rows.column("vector").combine_chunks().dictionary_encode()
        vectors = np.frombuffer(b"".join(coded.dictionary.to_pylist()), np.float32).reshape(-1, width)
        files, parts = (rows.column(c).combine_chunks() for c in ("files", "parts"))
        which = np.repeat(coded.indices.to_numpy(), files.value_lengths().to_numpy())
        which, files, parts = _lowest_owners(which, files.flatten().to_numpy(), parts.flatten().to_numpy(), most)
        # no cosine is known of a vector of infinite length
        known = np.isfinite(vectors).all(axis=1)
        owned = known[which]
        lists = [vectors[known], np.bincount(which, minlength=len(vectors))[known].astype(np.int32), files[owned], parts[owned]]
        table = pa.table([pa.array([x.tobytes()], pa.large_binary()) for x in lists], names=["vectors", "counts", "files", "parts"])
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        # a repeated task writes files of other names; those that count are the listed ones
        name = f"{uuid.uuid4().hex}.arrow"
        with system.open_output_stream(f"{base}/{name}") as sink, pa.ipc.new_file(sink, table.schema) as writer:
            writer.write_table(table)
        return pa.table([pa.array([cluster], pa.int32()), pa.array([name])], names=["cluster", "name"])

    return run


@dataclass(frozen=True)
class Block:
    """Distinct unit vectors, and the files with each: vector i has those from ``starts[i]`` to ``starts[i + 1]``."""

    vectors: np.ndarray
    starts: np.ndarray
    files: np.ndarray
    parts: np.ndarray

    @classmethod
    def read(cls, path: str, width: int) -> Block:
        system, base = fs.FileSystem.from_uri(path)
        with system.open_input_file(base) as file:
            row = pa.ipc.open_file(file).read_all().to_pylist()[0]
        # as they were stored; products take unit vectors
        vectors = np.frombuffer(row["vectors"], np.float32).reshape(-1, width).astype(np.float64)
        vectors /= np.sqrt((vectors * vectors).sum(axis=1))[:, None]
        counts = np.frombuffer(row["counts"], np.int32).astype(np.int64)
        files, parts = (np.frombuffer(row[n], np.int64) for n in ("files", "parts"))
        return cls(vectors, np.append(0, np.cumsum(counts)), files, parts)

    def owners(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``files`` of the owners of some vectors, and whose they are."""
        amount = self.starts[which + 1] - self.starts[which]
        whose = np.repeat(np.arange(len(which)), amount)
        return self.starts[which][whose] + np.arange(len(whose)) - np.repeat(np.cumsum(amount) - amount, amount), whose


class BestFiles:
    """The best ``top_k`` files of a group of means, block by block; memory does not grow with the blocks seen."""

    def __init__(self, means: np.ndarray, own: np.ndarray, top_k: int):
        self.means, self.own, self.top_k = means, own, top_k
        self.narrow = means.astype(np.float32)
        # products of narrow floats differ from the exact ones by less than half of this
        self.error = 1e-6 + 2.5e-7 * means.shape[1]
        #: file, part and score of the hits so far, best first; places without one have a score below all others
        self.files, self.parts = np.zeros((len(means), top_k), np.int64), np.zeros((len(means), top_k), np.int64)
        self.scores = np.full((len(means), top_k), -2.0)

    @property
    def mark(self) -> np.ndarray:
        """Score that a further hit of each mean has to reach."""
        return self.scores[:, -1]

    @property
    def hits(self) -> list[np.ndarray]:
        """Who, file, part, score of the hits so far."""
        who, place = np.nonzero(self.scores > -2.0)
        return [who, *(x[who, place] for x in (self.files, self.parts, self.scores))]

    def _merge(self, *found: np.ndarray) -> None:
        # only means with new hits are touched
        rows, at = np.unique(found[0], return_inverse=True)
        old, place = np.nonzero(self.scores[rows] > -2.0)
        held = [x[rows[old], place] for x in (self.files, self.parts, self.scores)]
        who, files, parts, scores = (np.concatenate(pair) for pair in zip([old, *held], [at, *found[1:]], strict=True))
        order = np.lexsort((parts, -scores, files, who))
        own, file = who[order], files[order]
        order = order[np.append(True, (own[1:] != own[:-1]) | (file[1:] != file[:-1]))]
        order = order[np.lexsort((files[order], -scores[order], who[order]))]
        own = who[order]
        place = np.arange(len(own)) - np.searchsorted(own, own)
        order, own, place = (x[place < self.top_k] for x in (order, own, place))
        for to, values in ((self.files, files), (self.parts, parts), (self.scores, scores)):
            to[rows[own], place] = values[order]

    def add(self, block: Block, rows: np.ndarray) -> None:
        """Let the means ``rows`` meet a block."""
        vectors = block.vectors.astype(np.float32)
        for offset in range(0, len(vectors), PIECE):
            piece = vectors[offset : offset + PIECE].T
            kept, held = [], 0
            for start in range(0, len(rows), TILE):
                tile = rows[start : start + TILE]
                narrow = self.narrow[tile] @ piece
                # most means have no hit in most blocks: one pass over the products tells which
                open_ = np.flatnonzero(narrow.max(axis=1) >= (self.mark[tile] - self.error).astype(np.float32))
                kept.append((tile[open_], narrow[open_]))
                held += len(open_)
                if held >= TILE or (held and start + TILE >= len(rows)):
                    self._offer(block, offset, *(np.concatenate(x) for x in zip(*kept, strict=True)))
                    kept, held = [], 0

    def _offer(self, block: Block, offset: int, rows: np.ndarray, narrow: np.ndarray) -> None:
        """Take the hits among the products of some means and the vectors from ``offset`` on."""
        offered, size = OFFERED * self.top_k, narrow.shape[1]
        while len(rows):
            hit = narrow >= (self.mark[rows] - self.error).astype(np.float32)[:, None]
            many = np.flatnonzero(np.count_nonzero(hit, axis=1) > offered) if offered < size else np.zeros(0, np.int64)
            edge = np.partition(narrow[many], size - offered, axis=1)[:, size - offered] if len(many) else np.zeros(0)
            hit[many] &= narrow[many] >= (edge - self.error).astype(np.float32)[:, None]
            who, which = np.divmod(np.flatnonzero(hit), size)
            who, which = rows[who], which + offset
            scores = np.round(np.clip(np.einsum("ij,ij->i", self.means[who], block.vectors[which]), -1.0, 1.0), hybrid.SCORE_DIGITS)
            good = scores >= self.mark[who]
            at, whose = block.owners(which[good])
            who, scores = who[good][whose], scores[good][whose]
            other = block.files[at] != self.own[who]
            if other.any():
                self._merge(who[other], block.files[at][other], block.parts[at][other], scores[other])
            # what lay below the edge matters where the hits do not reach it
            left = many[self.mark[rows[many]] < edge - self.error / 2]
            rows, narrow = rows[left], narrow[left]
            offered *= 8


def _search_groups(top_k: int, width: int, clusters: list[S.Cluster], names: dict[int, list[str]], folder: str):
    """Groups of means walk through the stored blocks, nearest clusters first, and leave out clusters that cannot win."""
    centres = np.array([c.centre for c in clusters])
    low, high = (np.array([getattr(c, n) for c in clusters]) for n in ("low", "high"))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                own = np.frombuffer(batch.column("ids")[i].as_py(), np.int64)
                if not len(own):
                    continue
                means = np.frombuffer(batch.column("vectors")[i].as_py(), np.float64).reshape(-1, width)
                angle = np.arccos(np.clip(means @ centres.T, -1.0, 1.0))
                gap = np.maximum(0.0, np.maximum(angle - high, low - angle) - S.ANGLE_SLACK)
                bound = np.cos(np.minimum(gap, np.pi))
                best = BestFiles(means, own, top_k)
                for c in np.lexsort((angle.sum(axis=0), -bound.sum(axis=0))).tolist():
                    for name in names.get(clusters[c].number, ()):
                        rows = np.flatnonzero(bound[:, c] >= best.mark - SCORE_SLACK)
                        if not len(rows):
                            break
                        best.add(Block.read(f"{folder}/{name}", width), rows)
                who, files, parts, scores = best.hits
                starts = np.searchsorted(who, np.arange(len(own)))
                rank = np.arange(len(who)) - starts[who] + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[who]), pa.array(rank, pa.int32()), pa.array(files), pa.array(parts, pa.int32()), pa.array(scores)],
                    names=["file_id", "rank", "other_id", "chunk_index", "score"],
                )

    return run


def all_similar_files(index: S.VectorIndex, stored: Callable[[DataFrame, str], DataFrame], top_k: int = 10) -> DataFrame:
    """For every file, the files closest to its mean vector: file_id, rank, other_id, chunk_index, score.

    Distinct vectors lie in files of about ``BLOCK`` of them in the shared
    folder, each with the files that have it.  A task takes a group of means
    and multiplies it with one block after the other, nearest clusters first;
    it holds one block and the hits so far, and passes over clusters that can
    no longer win.  Beside the product itself, one maximum per mean and block
    is all that is done for means without a hit there.  So no candidates are written, whatever the vectors are
    like; the products still grow with means times distinct vectors where
    these have no structure.  Vectors of another width, and zero vectors, take
    no part.  ``stored`` writes a table to the shared folder and reads it back.
    """
    centres = index.centres
    spark = index.rows.sparkSession
    if not centres.size:
        return spark.createDataFrame([], _SIMILAR)
    width, clusters = centres.shape[1], [c for c in index.clusters if c.centre is not None]
    rows = index.rows.filter(F.col("cluster") != S.LOOSE)
    vectors = stored(owned_vectors(rows, width, top_k), "vectors")
    folder = f"{as_uri(shared_dir(spark).rstrip('/'))}/work/vectors-{uuid.uuid4().hex}"
    distinct = F.greatest(F.approx_count_distinct("key"), F.floor(F.count(F.lit(1)) / MOST_COPIES))
    dealt, _ = _dealt(vectors, F.col("key"), distinct)
    written = dealt.groupBy("cluster", "block").applyInArrow(_write_block(folder, width, top_k + 1), _WRITTEN)
    names: dict[int, list[str]] = {}
    # one short row per block of vectors
    for row in stored(written, "names").collect():
        names.setdefault(row["cluster"], []).append(row["name"])
    means = V.mean_vector(rows, "embedding", "file_id", width=width).withColumn("at", S.place(F.col("mean_vector"), all_centres(index)))
    means = stored(means.select(F.col("at.cluster").alias("cluster"), "file_id", F.lit(0).alias("part"), "mean_vector"), "means")
    dealt, groups = _dealt(means, F.xxhash64("file_id"), F.count(F.lit(1)))
    packed = dealt.groupBy("cluster", "block").applyInArrow(_pack("mean_vector", width), _PACKED)
    # a group is little to read and much to do: each may have a task
    spread = stored(packed, "groups").repartition(max(1, min(groups, MOST_TASKS)))
    return spread.mapInArrow(_search_groups(top_k, width, clusters, names, folder), _SIMILAR)


def all_centres(index: S.VectorIndex) -> np.ndarray:
    """Centres by cluster number; a number without rows keeps a centre that no vector is near."""
    own = {c.number: c.centre for c in index.clusters if c.centre is not None}
    width = len(next(iter(own.values())))
    return np.array([own.get(i, np.zeros(width)) for i in range(max(own) + 1)])
