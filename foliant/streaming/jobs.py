"""The life of a file's jobs as a stateful stream: arrival, jobs, results, dependent jobs, outcome.

`track` keeps one small state per file that has open jobs.  Its input are
messages: a file was added or removed, or a job of a file finished.  Its
output are jobs to start, jobs given up, and the outcome of a file.  Results
are messages again, so `Enrichment` closes the circle: it runs the jobs that a
batch starts and appends what became of them to the folder the stream reads.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.listener import StreamingQueryListener

from foliant.config import AppConfig
from foliant.operators import events as E

#: ``kind`` is added, removed or finished; the other columns belong to finished jobs.
MESSAGES = "path string, kind string, job_type string, success boolean, text string, ts_ms long"
#: ``action`` is start, give_up or outcome.
ACTIONS = "path string, action string, job_type string, outcome string, ts_ms long"
CONTENT_JOBS = ("text_extraction", "transcription", "ocr")
OPEN, DONE = "open", "done"
#: The state store that this kind of state needs.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Tracker(StatefulProcessor):
    """State of a file: its jobs (open or done, and whether they gave text), and its outcome once that is out.

    A repeated message changes nothing.  A job without a result after
    ``timeout_ms`` is given up and counts as failed.  When nothing is open any
    more the state goes; a removed file's goes at once.
    """

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jobs = handle.getMapState("jobs", "job_type string", "status string, success boolean")
        self.outcome = handle.getValueState("outcome", "outcome string")

    def _all(self) -> dict[str, tuple[str, bool]]:
        return {k[0]: (v[0], v[1]) for k, v in self.jobs.iterator()} if self.jobs.exists() else {}

    def _forget(self) -> None:
        self.jobs.clear()
        self.outcome.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def _start(self, known: dict, names: list[str], now: int, ts: int, out: list) -> None:
        for name in names:
            if name not in known:
                known[name] = (OPEN, False)
                self.jobs.updateValue((name,), (OPEN, False))
                out.append((name, "start", None, ts))
                self.handle.registerTimer(now + self.timeout_ms)

    def _close(self, known: dict, ts: int, out: list) -> None:
        """Tell the outcome once all content jobs are done, and forget a file without open jobs."""
        content = [v for k, v in known.items() if k in CONTENT_JOBS]
        if content and all(s == DONE for s, _ in content) and not self.outcome.exists():
            result = "enriched" if any(ok for _, ok in content) else "needs_review"
            self.outcome.update((result,))
            out.append((None, "outcome", result, ts))
        if known and all(s == DONE for s, _ in known.values()):
            self._forget()

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        now, out = timerValues.getCurrentProcessingTimeInMs(), []
        messages = pd.concat(list(rows)).sort_values(["ts_ms", "kind"], kind="stable")
        known = self._all()
        for row in messages.itertuples(index=False):
            ts = int(row.ts_ms)
            if row.kind == "removed":
                self._forget()
                known = {}
            elif row.kind == "added":
                self._start(known, list(row.jobs), now, ts, out)
            elif known.get(row.job_type, (DONE,))[0] == OPEN:
                known[row.job_type] = (DONE, bool(row.useful))
                self.jobs.updateValue((row.job_type,), known[row.job_type])
                self._start(known, list(row.next_jobs), now, ts, out)
                self._close(known, ts, out)
                if not self.jobs.exists():
                    known = {}
        yield self._frame(key[0], out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        known, out, now = self._all(), [], timerValues.getCurrentProcessingTimeInMs()
        for name, (status, _) in list(known.items()):
            if status == OPEN:
                known[name] = (DONE, False)
                self.jobs.updateValue((name,), known[name])
                out.append((name, "give_up", None, now))
        self._close(known, now, out)
        yield self._frame(key[0], out)

    @staticmethod
    def _frame(path: str, out: list) -> pd.DataFrame:
        texts = {"path": [path] * len(out), "action": [o[1] for o in out], "job_type": [o[0] for o in out], "outcome": [o[2] for o in out]}
        columns = {name: pd.Series(values, dtype="object") for name, values in texts.items()}
        return pd.DataFrame({**columns, "ts_ms": pd.Series([o[3] for o in out], dtype="int64")})

    def close(self) -> None:
        pass


def track(messages: DataFrame, config: AppConfig, timeout_ms: int = 600_000) -> DataFrame:
    """Stream of ``ACTIONS`` out of a stream of ``MESSAGES``.

    Which jobs a file needs, and which follow a result, are column expressions
    of ``operators.events``; the state only remembers what has been started.
    """
    spark = messages.sparkSession
    spark.conf.set(*STATE_STORE)
    none = F.array().cast("array<string>")
    ready = messages.select(
        "path",
        "kind",
        "job_type",
        "ts_ms",
        F.coalesce(F.col("success") & E.useful_text(F.col("text")), F.lit(False)).alias("useful"),
        F.when(F.col("kind") == "added", E.job_list(F.col("path"), config)).otherwise(none).alias("jobs"),
        F.when((F.col("kind") == "finished") & F.col("success") & F.col("job_type").isin(*CONTENT_JOBS), E.next_job_list(F.col("path"), F.col("job_type"), F.col("text"), config)).otherwise(none).alias("next_jobs"),
    )
    return ready.groupBy("path").transformWithStateInPandas(Tracker(timeout_ms), ACTIONS, "update", "ProcessingTime")


# --------------------------------------------------------------------------
# running jobs


def run_bounded(spark: SparkSession, jobs: list[tuple[str, Callable[[], Any]]], most: int) -> list[Any]:
    """Run (kind, job) with at most ``most`` at once, each kind in a scheduler pool of its own.

    With ``spark.scheduler.mode=FAIR`` the pools share the executors evenly, so
    a long job of one kind does not hold up the others.  Results, or the
    exceptions that ended jobs, come in the order of the jobs.
    """
    context = spark.sparkContext

    def run(kind: str, job: Callable[[], Any]) -> Any:
        context.setLocalProperty("spark.scheduler.pool", kind)
        try:
            return job()
        except Exception as failure:  # belongs to this job alone
            return failure
        finally:
            context.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(max_workers=max(1, most)) as pool:
        futures = [pool.submit(inheritable_thread_target(spark)(run), kind, job) for kind, job in jobs]
        return [f.result() for f in futures]


#: Maps a table of (path) to (path, text): "" for no text.  Raises when the job fails as a whole.
Job = Callable[[DataFrame], DataFrame]


class Enrichment:
    """Runs the jobs that a tracker starts and feeds back what became of them.

    ``jobs`` has a function per job type; a type without one fails.
    ``outcomes`` gets (path, outcome) of files whose content jobs are over.
    """

    def __init__(self, spark: SparkSession, results: str, jobs: dict[str, Job], outcomes: Callable[[DataFrame], None], most: int = 2):
        self.spark, self.results, self.jobs, self.outcomes, self.most = spark, results.rstrip("/"), jobs, outcomes, most

    def messages(self, events: DataFrame) -> DataFrame:
        """Folder events and job results as one stream of ``MESSAGES``."""
        kind = F.when(F.col("op") == "add", "added").when(F.col("op") == "remove", "removed")
        none = {"job_type": "string", "success": "boolean", "text": "string"}
        own = events.withColumn("kind", kind).filter("kind is not null")
        own = own.select("path", "kind", *[F.lit(None).cast(t).alias(n) for n, t in none.items()], "ts_ms")
        # the folder must be there before a stream can read it
        empty = self.spark.createDataFrame([], MESSAGES)
        empty.write.mode("overwrite").parquet(f"{self.results}/batch=start")
        fed = self.spark.readStream.schema(MESSAGES).parquet(f"{self.results}/*")
        return own.unionByName(fed.select(*own.columns))

    def handle(self, batch: DataFrame, number: int) -> None:
        """One batch of ``ACTIONS``.  A batch that runs again overwrites its own results."""
        actions = batch.persist()
        try:
            outcomes = actions.filter(F.col("action") == "outcome").select("path", "outcome")
            if not outcomes.isEmpty():
                self.outcomes(outcomes)
            kinds = sorted(r["job_type"] for r in actions.filter(F.col("action") == "start").select("job_type").distinct().collect())

            def run(kind: str) -> None:
                paths = actions.filter((F.col("action") == "start") & (F.col("job_type") == kind)).select("path").distinct()
                target = f"{self.results}/batch={number:012d}-{kind}"

                def write(rows: DataFrame) -> None:
                    done = rows.select(
                        "path", F.lit("finished").alias("kind"), F.lit(kind).alias("job_type"), "success", "text",
                        F.unix_millis(F.current_timestamp()).alias("ts_ms"),
                    )
                    done.write.mode("overwrite").parquet(target)

                try:
                    texts = self.jobs[kind](paths).select("path", "text")
                    write(paths.join(texts, "path", "left").withColumn("success", F.col("text").isNotNull()))
                except Exception:
                    write(paths.select("path", F.lit(None).cast("string").alias("text"), F.lit(False).alias("success")))

            run_bounded(self.spark, [(kind, lambda kind=kind: run(kind)) for kind in kinds], self.most)
        finally:
            actions.unpersist()


# --------------------------------------------------------------------------
# progress


class Progress(StreamingQueryListener):
    """Live counters of jobs: enqueued, completed and failed, from metrics observed in the stream.

    They start anew when nothing has happened for ``idle_seconds`` and all
    that was enqueued is over.
    """

    METRICS = "foliant_jobs"

    def __init__(self, idle_seconds: float = 2.0, clock: Callable[[], float] = time.monotonic):
        self.idle_seconds, self.clock, self.lock = idle_seconds, clock, threading.Lock()
        self.counts, self.last = {"enqueued": 0, "completed": 0, "failed": 0}, clock()

    @classmethod
    def observed(cls, messages: DataFrame) -> DataFrame:
        """``messages`` whose finished jobs are counted on the way."""
        over = F.col("kind") == "finished"
        return messages.observe(
            f"{cls.METRICS}_over", F.count_if(over & F.col("success")).alias("completed"), F.count_if(over & ~F.col("success")).alias("failed")
        )

    @classmethod
    def observed_actions(cls, actions: DataFrame) -> DataFrame:
        return actions.observe(f"{cls.METRICS}_begun", F.count_if(F.col("action") == "start").alias("enqueued"), F.count_if(F.col("action") == "give_up").alias("failed"))

    def add(self, **more: int) -> None:
        if not any(more.values()):
            return
        with self.lock:
            now = self.clock()
            over = self.counts["completed"] + self.counts["failed"] >= self.counts["enqueued"]
            if over and now - self.last >= self.idle_seconds:
                self.counts = dict.fromkeys(self.counts, 0)
            for name, n in more.items():
                self.counts[name] += n
            self.last = now

    def snapshot(self) -> dict[str, float]:
        """Counters now; ``progress`` is 1 where nothing is open."""
        with self.lock:
            over = self.counts["completed"] + self.counts["failed"]
            return {**self.counts, "active": max(0, self.counts["enqueued"] - over), "progress": min(1.0, over / self.counts["enqueued"]) if self.counts["enqueued"] else 1.0}

    def onQueryStarted(self, event: Any) -> None:
        pass

    def onQueryProgress(self, event: Any) -> None:
        for name, row in event.progress.observedMetrics.items():
            if name.startswith(self.METRICS):
                self.add(**{k: int(v or 0) for k, v in row.asDict().items()})

    def onQueryIdle(self, event: Any) -> None:
        pass

    def onQueryTerminated(self, event: Any) -> None:
        pass
