"""File events: de-duplication, rate limits, throttles, job fan-out.

The policies are folds over an ordered stream.  Run one by one they would put a
busy path, or the whole stream, into one task.  ``greedy_anchors`` cuts such a
fold into ranges of equally many rows instead and finds the ranges' entries by pointer doubling.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.config import AppConfig
from foliant.functions import paths as P
from foliant.session import shared_dir

# Default windows and limits of the event policies.
DEDUP_MS = 300
RATE_PER_SECOND = 200
RATE_WINDOW_MS = 1_000
DEBOUNCE_MS = 300
LIMIT_NOTICE_MS = 24 * 3600 * 1000
THROTTLE_DEFAULT = {"min_interval_ms": 1_000, "max_in_window": 10, "window_ms": 60_000}
THROTTLE_STRICT = {"min_interval_ms": 5_000, "max_in_window": 3, "window_ms": 60_000}

# Kinds of raw folder events.
ADD_KINDS = ("create_file", "create_any", "create_folder", "create_other", "rename_to", "rename_both")
REMOVE_KINDS = ("remove_file", "remove_any")

_NEVER = -(2**62)


def classify(kind: Column) -> Column:
    """``add``, ``remove`` or null for kinds that are ignored."""
    return F.when(kind.isin(*ADD_KINDS), "add").when(kind.isin(*REMOVE_KINDS), "remove")


# --------------------------------------------------------------------------
# greedy anchors


def _jumps(instants: np.ndarray, window: int) -> np.ndarray:
    """For each position the one a greedy walk goes on to, ``len(instants)`` behind the end."""
    return np.searchsorted(instants, instants + window)


def _hops(instants: np.ndarray, start: int, window: int) -> list[int]:
    """Positions a greedy walk keeps: first at or after ``start``, then one window on, ..."""
    jump = _jumps(instants, window).tolist()
    kept, i = [], int(np.searchsorted(instants, start))
    while i < len(jump):
        kept.append(i)
        i = jump[i]
    return kept


def _last_hops(instants: np.ndarray, window: int) -> np.ndarray:
    """For a walk starting at each position, the last position it keeps."""
    n = len(instants)
    jump = np.append(_jumps(instants, window), n)
    last = np.arange(n)
    while True:
        ahead = jump[last]
        moved = ahead < n
        if not moved.any():
            return last
        last = np.where(moved, np.minimum(ahead, n - 1), last)
        # Doubling: a jump now covers twice as many hops, as long as it stays inside.
        double = jump[np.minimum(jump, n)]
        jump = np.where(double < n, double, jump)


@dataclass(frozen=True)
class _Ranges:
    """What is known of the ranges of one table: as many rows as there are ranges.

    ``tail`` marks ranges that lie inside one key and continue it; only their
    walks depend on where they are entered.  ``until`` is, for each range, the
    position behind the last tail that continues its last key.
    """

    number: np.ndarray
    low: np.ndarray
    high: np.ndarray
    continues: np.ndarray
    tail: np.ndarray
    until: np.ndarray

    @classmethod
    def of(cls, edges: list) -> _Ranges:
        rows = sorted(edges, key=lambda e: e["r"])
        n = len(rows)
        continues = np.array([i > 0 and rows[i - 1]["high"]["k"] == rows[i]["low"]["k"] for i in range(n)], dtype=bool)
        tail = continues & np.array([e["low"]["k"] == e["high"]["k"] for e in rows], dtype=bool)
        until = np.arange(1, n + 1)
        for i in range(n - 2, -1, -1):
            if tail[i + 1]:
                until[i] = until[i + 1]
        pick = lambda side: np.array([e[side]["t"] for e in rows], dtype=np.int64)
        return cls(np.array([e["r"] for e in rows], dtype=np.int64), pick("low"), pick("high"), continues, tail, until)

    def onward(self, at: int, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tail in which the first instant at or after each query lies, -1 for none, and that instant where it is an edge."""
        a, b = at + 1, int(self.until[at])
        found = a + np.searchsorted(self.high[a:b], query)
        inside = found < b
        place = np.where(inside, found, 0)
        edge = inside & (query <= self.low[place])
        return np.where(inside, self.number[place], -1), np.where(edge, self.low[place], _NEVER)


def greedy_anchors(df: DataFrame, keys: Sequence[str], time_ms: str, window_ms: int, order: str) -> DataFrame:
    """(keys, time, first ``order`` value, anchor) for every distinct instant of each key.

    An instant becomes an anchor when it lies at least ``window_ms`` after the
    previous anchor; others carry the anchor before them.  Equals a sequential
    fold over each key, but no key is folded in one piece, however dense it is
    and however wide the window:

    1. Equal instants are merged, and the rest is cut into ranges of about
       equally many rows, sorted by key and time and stored.
    2. The walk of a key is known in the range in which the key begins.  A
       later range depends on its *first anchor*, which lies within the first
       window of the range.  For each instant there (a node), the range finds
       the last anchor of a walk that begins at it, and with it the range and
       the instant in which that walk goes on: a pointer from node to node.
    3. The pointers that are followed from the beginning of each key are found
       by doubling: rounds of joins, each of which makes pointers twice as
       long, as many rounds as the longest key's ranges have binary digits.
    4. Each range is walked again from its now known entry.

    A task holds the time stamps of one range at a time, and nodes stay rows
    of distributed tables; up to ``DRIVER_NODES`` of them are followed in one
    place instead.  The driver holds a few numbers per range.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/anchors-{uuid.uuid4().hex}"

    def keep(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{folder}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{folder}/{name}")

    instants = df.groupBy(*keys, F.col(time_ms).alias("t")).agg(F.min(order).alias("o"))
    ranged = instants.repartitionByRange(*keys, "t").sortWithinPartitions(*keys, "t").withColumn("r", F.spark_partition_id())
    ranged = keep(ranged, "ranges")
    key = F.struct(*[F.col(k) for k in keys]) if keys else F.lit(0)
    edge = F.struct(key.alias("k"), F.col("t"))
    known = _Ranges.of(ranged.groupBy("r").agg(F.min(edge).alias("low"), F.max(edge).alias("high")).collect())
    entries = _entries(ranged, known, keys, window_ms, keep)

    names = [*keys, "t", "o"]
    fields = {f.name: f.dataType.simpleString() for f in ranged.schema.fields}

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, at, starts, rows in _ranges(batches, keys):
            anchors = np.empty(len(at), dtype=np.int64)
            for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(at)], strict=True)):
                begin = entries.get(r, _NEVER) if i == 0 else _NEVER
                own = at[a:b]
                kept = np.array(_hops(own, begin + window_ms, window_ms), dtype=np.int64)
                anchors[a:b] = np.concatenate(([begin], own[kept]))[np.searchsorted(kept, np.arange(len(own)), side="right")]
            yield pa.RecordBatch.from_arrays([*[_flat(rows.column(n)) for n in names], pa.array(anchors)], [*names, "anchor"])

    return (
        _whole(ranged, keys)
        .mapInArrow(walk, ", ".join(f"`{n}` {fields[n]}" for n in names) + ", anchor bigint")
        .select(*keys, F.col("t").alias(time_ms), F.col("o").alias(order), "anchor")
    )


def _whole(ranged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ranges brought together again: files may have been split where they were read."""
    return ranged.repartition("r").sortWithinPartitions("r", *keys, "t")


def _entries(
    ranged: DataFrame, known: _Ranges, keys: Sequence[str], window: int, keep: Callable[[DataFrame, str], DataFrame]
) -> dict[int, int]:
    """The last anchor before each range that continues a key."""
    if not known.continues.any():
        return {}
    position = {int(r): i for i, r in enumerate(known.number.tolist())}

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Nodes (r, t) with the last anchor of their walk and where it goes on; the first range of a key has one."""
        for r, at, starts, _ in _ranges(batches, keys):
            i = position[r]
            if known.tail[i]:
                stop = int(np.searchsorted(at, at[0] + window))
                begin, out = at[:stop], at[_last_hops(at, window)[:stop]]
            else:
                tail = at[starts[-1] :]
                begin, out = tail[:1], tail[_hops(tail, int(tail[0]), window)[-1:]]
            to, edge = known.onward(i, out + window)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(begin), r), pa.int32()), pa.array(begin), pa.array(out), pa.array(to, pa.int32(), mask=to < 0),
                    pa.array(out + window), pa.array(edge, mask=edge == _NEVER),
                ],
                ["r", "t", "out", "to_r", "query", "to_t"],
            )

    nodes = keep(_whole(ranged, keys).mapInArrow(leave, "r int, t bigint, out bigint, to_r int, query bigint, to_t bigint"), "nodes")
    asked = nodes.filter(F.col("to_t").isNull() & F.col("to_r").isNotNull()).select(F.col("to_r").alias("r"), F.col("query").alias("t")).distinct()
    answers = _successors(ranged.select("r", "t"), asked).select(F.col("r").alias("to_r"), F.col("t").alias("query"), "found")
    # a range of the first column is never asked for, so heads keep what they know
    moves = nodes.join(answers, ["to_r", "query"], "left").select("r", "t", "out", "to_r", F.coalesce("to_t", "found").alias("to_t"))
    moves = keep(moves, "moves")
    heads = {int(r) for r, tail in zip(known.number.tolist(), known.tail.tolist(), strict=True) if not tail}
    out = _followed(moves, heads, int((known.until - np.arange(len(known.until))).max()), keep)
    entries, last = {}, _NEVER
    for i, r in enumerate(known.number.tolist()):
        if known.continues[i]:
            entries[r] = last
        last = out.get(r, last) if known.tail[i] else out[r]
    return entries


#: Nodes that are followed in one place; more are followed by doubling.
DRIVER_NODES = 50_000


def _followed(moves: DataFrame, heads: set[int], longest: int, keep: Callable[[DataFrame, str], DataFrame]) -> dict[int, int]:
    """The last anchor of each range that a walk from the beginning of its key visits.

    A range is visited at one node at most, so what is followed has no more
    rows than there are ranges.
    """
    spark = moves.sparkSession
    if moves.count() <= DRIVER_NODES:
        table = {(m["r"], m["t"]): m for m in moves.collect()}
        out = {}
        for (r, _), node in table.items():
            while r in heads and node is not None:
                out[node["r"]] = node["out"]
                node = table.get((node["to_r"], node["to_t"]))
        return out
    at_head = F.col("r").isin(sorted(heads))
    visited = {(m["r"], m["t"]) for m in moves.filter(at_head).select("r", "t").collect()}
    jumps, reach = moves.filter(F.col("to_r").isNotNull()).select("r", "t", "to_r", "to_t"), 1
    while True:
        here = F.broadcast(spark.createDataFrame(sorted(visited), "r int, t bigint"))
        visited |= {(m["to_r"], m["to_t"]) for m in jumps.join(here, ["r", "t"]).select("to_r", "to_t").collect()}
        reach *= 2
        if reach > longest:
            break
        onward = jumps.select(F.col("r").alias("to_r"), F.col("t").alias("to_t"), F.col("to_r").alias("r2"), F.col("to_t").alias("t2"))
        doubled = jumps.join(onward, ["to_r", "to_t"]).select("r", "t", F.col("r2").alias("to_r"), F.col("t2").alias("to_t"))
        jumps = keep(doubled, f"jumps-{reach}")
    here = F.broadcast(spark.createDataFrame(sorted(visited), "r int, t bigint"))
    return {m["r"]: m["out"] for m in moves.join(here, ["r", "t"]).select("r", "out").collect()}


def _successors(instants: DataFrame, asked: DataFrame) -> DataFrame:
    """(r, t, found): the first instant of range r at or after t, which is known to exist.

    Both are read as one stream, latest first, that remembers one instant.
    """
    both = instants.withColumn("ask", F.lit(False)).unionByName(asked.withColumn("ask", F.lit(True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            t, ask = batch.column("t").to_numpy(), batch.column("ask").to_numpy(zero_copy_only=False)
            place = np.maximum.accumulate(np.where(ask, -1, np.arange(len(t))))
            found = np.where(place < 0, carried, t[np.maximum(place, 0)])
            carried = int(found[-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("r").filter(pa.array(ask)), pa.array(t[ask]), pa.array(found[ask])], ["r", "t", "found"]
            )

    return both.repartition("r").sortWithinPartitions("r", F.desc("t"), "ask").mapInArrow(run, "r int, t bigint, found bigint")


def _flat(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def _changes(column: pa.Array) -> np.ndarray:
    """Where a value differs from the one before it; nulls equal each other."""
    before, after = column.slice(0, len(column) - 1), column.slice(1)
    differ = pc.fill_null(pc.not_equal(before, after), False).to_numpy(zero_copy_only=False)
    return differ | (before.is_null().to_numpy(zero_copy_only=False) != after.is_null().to_numpy(zero_copy_only=False))


def _ranges(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[int, np.ndarray, list[int], pa.Table]]:
    """Ranges of a sorted stream: number, time stamps, places where a key begins, rows."""
    held: list[pa.RecordBatch] = []

    def done() -> tuple[int, np.ndarray, list[int], pa.Table]:
        rows = pa.Table.from_batches(held)
        fresh = np.zeros(rows.num_rows, dtype=bool)
        fresh[0] = True
        for k in keys:
            fresh[1:] |= _changes(_flat(rows.column(k)))
        return rows.column("r")[0].as_py(), rows.column("t").to_numpy(), np.flatnonzero(fresh).tolist(), rows

    for batch in batches:
        number = batch.column("r").to_numpy()
        cuts = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), len(number)] if len(number) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and held[-1].column("r")[0].as_py() != number[a]:
                yield done()
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield done()


def dedup(events: DataFrame, window_ms: int = DEDUP_MS) -> DataFrame:
    """Add events left after dropping repeats of a path.

    A repeat lies within the window of the last *kept* event of its path.
    """
    adds = events.filter(F.col("op") == "add")
    return (
        greedy_anchors(adds, ["path"], "ts_ms", window_ms, "event_id")
        .filter(F.col("anchor") == F.col("ts_ms"))
        .select("event_id", "path", "ts_ms")
    )


def rate_limit(
    events: DataFrame, limit: int = RATE_PER_SECOND, window_ms: int = RATE_WINDOW_MS, keys: Sequence[str] = ()
) -> DataFrame:
    """Events let through: the first ``limit`` of each window, the rest is dropped.

    A window starts at the first event after the previous one ended.  Only the
    leading rows of a window survive each task, so a burst does not pile up.
    """
    anchors = greedy_anchors(events, keys, "ts_ms", window_ms, "event_id").select(*keys, "ts_ms", "anchor")
    order = Window.partitionBy(*keys, "anchor").orderBy("ts_ms", "event_id")
    return (
        events.join(anchors, [*keys, "ts_ms"])
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= limit)
        .select(*events.columns, F.col("anchor").alias("window_start_ms"), F.col("rank").cast("long"))
    )


def limit_notices(events: DataFrame, keys: Sequence[str] = (), window_ms: int = LIMIT_NOTICE_MS) -> DataFrame:
    """Limit notices actually shown: at most one per day."""
    return (
        greedy_anchors(events, keys, "ts_ms", window_ms, "event_id")
        .filter(F.col("anchor") == F.col("ts_ms"))
        .select(*keys, "event_id", "ts_ms")
    )


# --------------------------------------------------------------------------
# neighbours in time


def with_neighbour(
    df: DataFrame, keys: Sequence[str], time_ms: str, after: bool, bucket_ms: int = 3_600_000
) -> DataFrame:
    """(keys, time, neighbour) per distinct instant: the next or previous one, null at the ends.

    Windows run per time bucket; a bucket's outer neighbour comes from a table
    of bucket edges.  No window spans a whole key's rows.
    """
    instants = (
        df.select(*keys, F.col(time_ms).alias("t")).distinct()
        .withColumn("bucket", F.floor(F.col("t") / bucket_ms).cast("long"))
    )
    group = [*keys, "bucket"]
    edge = F.min("t") if after else F.max("t")
    shift = F.lead if after else F.lag
    per_key = Window.partitionBy(*keys).orderBy("bucket") if keys else Window.partitionBy(F.lit(0)).orderBy("bucket")
    edges = instants.groupBy(*group).agg(edge.alias("edge")).select(*group, shift("edge").over(per_key).alias("outer"))
    inner = shift("t").over(Window.partitionBy(*group).orderBy("t"))
    return (
        instants.withColumn("inner", inner)
        .join(edges, group)
        .select(*keys, F.col("t").alias(time_ms), F.coalesce("inner", "outer").alias("neighbour"))
    )


def debounce(
    events: DataFrame, keys: Sequence[str], quiet_ms: int = DEBOUNCE_MS, bucket_ms: int = 3_600_000
) -> DataFrame:
    """The last event of every burst: nothing follows it within ``quiet_ms``."""
    ends = with_neighbour(events, keys, "ts_ms", after=True, bucket_ms=bucket_ms).filter(
        F.col("neighbour").isNull() | (F.col("neighbour") - F.col("ts_ms") >= quiet_ms)
    )
    last = events.groupBy(*keys, "ts_ms").agg(F.max("event_id").alias("event_id"))
    return last.join(ends.select(*keys, "ts_ms"), [*keys, "ts_ms"], "left_semi").select(*keys, "ts_ms", "event_id")


def throttle(
    events: DataFrame,
    keys: Sequence[str],
    kind: str,
    min_interval_ms: int = THROTTLE_DEFAULT["min_interval_ms"],
    max_in_window: int = THROTTLE_DEFAULT["max_in_window"],
    window_ms: int = THROTTLE_DEFAULT["window_ms"],
) -> DataFrame:
    """Notifications shown under a per-kind interval and a shared count per window.

    Both conditions look at *shown* notifications only.  A pause longer than
    either window clears all state, so the stream is cut there and the parts
    are folded apart.  Equal instants of one kind are merged first: the second
    is never shown.  Each part is read as a sorted stream that remembers at
    most ``max_in_window`` time stamps and one per kind.  Within a part every
    decision hangs on the ones before it, so a key without pauses is one
    task's stream: serial by nature, but of constant memory.
    """
    merged = events.groupBy(*keys, kind, "ts_ms").agg(F.min("event_id").alias("event_id"))
    pause = max(window_ms, min_interval_ms)
    starts = with_neighbour(events, keys, "ts_ms", after=False).select(
        *keys, "ts_ms",
        F.when(F.col("neighbour").isNull() | (F.col("ts_ms") - F.col("neighbour") > pause), F.col("ts_ms")).alias("start"),
    )
    parts = merged.join(_carry_start(starts, keys), [*keys, "ts_ms"])
    part_keys = [*keys, "start"]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, shown, last = None, [], {}
        for pdf in batches:
            keep = np.zeros(len(pdf), dtype=bool)
            columns = [pdf[k].tolist() for k in part_keys]
            for i, (t, what) in enumerate(zip(pdf["ts_ms"].tolist(), pdf[kind].tolist(), strict=True)):
                part = tuple(c[i] for c in columns)
                if part != current:
                    current, shown, last = part, [], {}
                if what in last and t - last[what] < min_interval_ms:
                    continue
                shown = [s for s in shown if s >= t - window_ms]
                if len(shown) < max_in_window:
                    keep[i] = True
                    shown.append(t)
                    last[what] = t
            yield pdf.loc[keep, out]

    out = [*keys, kind, "ts_ms", "event_id"]
    types = {f.name: f.dataType.simpleString() for f in parts.schema.fields}
    return (
        parts.repartition(*part_keys)
        .sortWithinPartitions(*part_keys, "ts_ms", "event_id")
        .mapInPandas(fold, ", ".join(f"`{c}` {types[c]}" for c in out))
    )


def _carry_start(starts: DataFrame, keys: Sequence[str], bucket_ms: int = 3_600_000) -> DataFrame:
    """Fill each instant's part start from the latest start at or before it, bucket by bucket."""
    binned = starts.withColumn("bucket", F.floor(F.col("ts_ms") / bucket_ms).cast("long"))
    group = [*keys, "bucket"]
    inside = Window.partitionBy(*group).orderBy("ts_ms")
    before = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    carried = binned.groupBy(*group).agg(F.max("start").alias("s")).select(*group, F.max("s").over(before).alias("carry"))
    return (
        binned.withColumn("own", F.max("start").over(inside))
        .join(carried, group)
        .select(*keys, "ts_ms", F.coalesce("own", "carry").alias("start"))
    )


# --------------------------------------------------------------------------
# queue policy


def admit(events: DataFrame, cap: int, existing: int = 0) -> DataFrame:
    """Flag the first ``cap - existing`` events by arrival as ``admitted``.

    The cut is found by a top-n, so no global sort takes place.
    """
    room = max(cap - existing, 0)
    if room == 0:
        return events.withColumn("admitted", F.lit(False))
    key = F.struct("ts_ms", "event_id")
    edge = events.orderBy("ts_ms", "event_id").limit(room).agg(F.max(key).alias("edge")).scalar()
    return events.withColumn("admitted", key <= edge)


def job_list(path: Column, config: AppConfig) -> Column:
    """Job types of an added file, in order.

    Files that need preprocessing get content jobs only; vectors, summaries
    and tags follow once text is there.
    """
    ext = P.extension(path)
    media = ext.isin(*P.AUDIO_EXTENSIONS, *P.VIDEO_EXTENSIONS)
    needs_text = ext.isin(*P.RICH_EXTENSIONS, *P.QUEUE_IMAGE_EXTENSIONS) | media
    rules = [
        (config.is_enabled("office_docs"), ext.isin(*P.RICH_EXTENSIONS), "text_extraction"),
        (config.is_enabled("transcription"), media, "transcription"),
        (config.is_enabled("ocr"), ext.isin(*P.QUEUE_IMAGE_EXTENSIONS), "ocr"),
        *[(on, ~needs_text, job) for on, job in _followups(config)],
    ]
    return _chosen([F.when(test, F.lit(job)) for on, test, job in rules if on])


def _chosen(jobs: list[Column]) -> Column:
    return F.array_compact(F.array(*jobs)) if jobs else F.array().cast("array<string>")


def fan_out(events: DataFrame, config: AppConfig) -> DataFrame:
    """Jobs of each added file: (…, job_index, job_type)."""
    return events.select("*", F.posexplode(job_list(F.col("path"), config)).alias("job_index", "job_type"))


def _followups(config: AppConfig) -> list[tuple[bool, str]]:
    return [
        (config.is_enabled("embeddings") or config.is_enabled("semantic_similarity"), "embeddings"),
        (config.is_enabled("auto_summary"), "auto_summary"),
        (config.is_enabled("auto_tags"), "auto_tags"),
    ]


def useful_text(text: Column) -> Column:
    """Whether a content job gave text worth going on with."""
    from foliant.functions.text import is_meaningful

    return is_meaningful(F.coalesce(text, F.lit("")))


def next_job_list(path: Column, job_type: Column, text: Column, config: AppConfig) -> Column:
    """Job types that follow a finished content job.

    Meaningful text leads to vectors, summary and tags; a PDF without text
    goes to recognition.
    """
    retry = (job_type == "text_extraction") & (F.coalesce(text, F.lit("")) == "") & (P.extension(path) == "pdf")
    jobs = [F.when(useful_text(text), F.lit(job)) for on, job in _followups(config) if on]
    if config.is_enabled("ocr"):
        jobs.append(F.when(retry, F.lit("ocr")))
    return _chosen(jobs)


def next_jobs(finished: DataFrame, config: AppConfig) -> DataFrame:
    """Jobs that follow finished content jobs (path, job_type, text): (path, job_type)."""
    following = next_job_list(F.col("path"), F.col("job_type"), F.col("text"), config)
    return finished.select("path", F.explode(following).alias("job_type"))


def outcomes(jobs: DataFrame) -> DataFrame:
    """(path, outcome) once all content jobs of a path are done.

    ``enriched`` when any of them produced text, else ``needs_review``;
    ``pending`` while some are open.  Input rows are (path, job_type, status, success).
    """
    content = jobs.filter(F.col("job_type").isin("text_extraction", "transcription", "ocr"))
    per_path = content.groupBy("path").agg(
        F.count_if(F.col("status").isin("pending", "processing")).alias("open"),
        F.max(F.col("success").cast("int")).alias("any_success"),
    )
    return per_path.select(
        "path",
        F.when(F.col("open") > 0, "pending").when(F.col("any_success") == 1, "enriched").otherwise("needs_review").alias("outcome"),
    )


def progress(jobs: DataFrame) -> DataFrame:
    """One row of queue counters; ``progress`` is null without jobs."""
    status = F.col("status")
    done = F.count_if(status.isin("completed", "failed"))
    total = F.count(F.lit(1))
    return jobs.agg(
        total.alias("total_enqueued"),
        done.alias("completed_count"),
        F.count_if(status == "processing").alias("active_count"),
        F.count_if(status == "pending").alias("pending_count"),
        F.when(total > 0, done / total).alias("progress"),
    )
