"""From a file's arrival to its outcome, with jobs that fail, hang and repeat."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from foliant.config import AppConfig
from foliant.sources import folder as D
from foliant.streaming import jobs as J

CONFIG = AppConfig(ocr=True, transcription=True, auto_tags=True, embeddings=False, semantic_similarity=False)
BODY = "A text that is long enough to be worth tagging, with several words in it."


class Flow:
    """A folder, a tracker and an enrichment, run batch by batch until nothing is left to do."""

    def __init__(self, spark, tmp_path, timeout_ms=600_000):
        self.spark, self.tmp, self.timeout = spark, tmp_path, timeout_ms
        self.inbox = tmp_path / "inbox"
        self.inbox.mkdir()
        self.outcomes, self.started = {}, []
        self.listener = J.Progress(idle_seconds=1e9)

        def logged(kind, answer):
            def job(paths):
                self.started += [(kind, r.path.rsplit("/", 1)[1]) for r in paths.collect()]
                return answer(paths)

            return job

        def texts(paths):
            return paths.filter(~F.col("path").contains("blank")).withColumn("text", F.lit(BODY))

        def broken(paths):
            raise RuntimeError("no model")

        self.jobs = {
            "text_extraction": logged("text_extraction", lambda p: p.withColumn("text", F.when(F.col("path").endswith(".pdf"), "").when(~F.col("path").contains("blank"), BODY))),
            "ocr": logged("ocr", texts),
            "transcription": logged("transcription", broken),
            "auto_tags": logged("auto_tags", lambda p: p.withColumn("text", F.lit("a, b"))),
        }
        self.enrichment = J.Enrichment(spark, str(tmp_path / "results"), self.jobs, lambda o: self.outcomes.update({r.path.rsplit("/", 1)[1]: r.outcome for r in o.collect()}))

    def run(self, times=1):
        for _ in range(times):
            events = D.folder_events(self.spark, str(self.inbox), str(self.tmp / "snapshots"))
            messages = J.Progress.observed(self.enrichment.messages(events))
            actions = J.Progress.observed_actions(J.track(messages, CONFIG, self.timeout))
            writer = actions.writeStream.foreachBatch(self.enrichment.handle).outputMode("update")
            writer.option("checkpointLocation", str(self.tmp / "cp")).trigger(availableNow=True).start().awaitTermination(180)


@pytest.fixture
def flow(spark, tmp_path):
    before = spark.conf.get(J.STATE_STORE[0], None)
    out = Flow(spark, tmp_path)
    spark.streams.addListener(out.listener)
    yield out
    spark.streams.removeListener(out.listener)
    if before is None:
        spark.conf.unset(J.STATE_STORE[0])
    else:
        spark.conf.set(J.STATE_STORE[0], before)


def test_from_arrival_to_outcome(flow):
    for name in ("a.docx", "blank.docx", "scan.pdf", "song.mp3", "plain.txt", "blank.png"):
        (flow.inbox / name).write_text("x")
    flow.run()
    assert sorted(flow.started) == [
        ("auto_tags", "plain.txt"), ("ocr", "blank.png"), ("text_extraction", "a.docx"), ("text_extraction", "blank.docx"),
        ("text_extraction", "scan.pdf"), ("transcription", "song.mp3"),
    ]
    assert flow.outcomes == {}
    flow.run()
    # text leads on to tags, a PDF without text to recognition; failed jobs lead to a review
    assert flow.outcomes == {"a.docx": "enriched", "blank.docx": "needs_review", "song.mp3": "needs_review", "blank.png": "needs_review"}
    assert sorted(flow.started[6:]) == [("auto_tags", "a.docx"), ("ocr", "scan.pdf")]
    flow.run(2)
    assert flow.outcomes["scan.pdf"] == "enriched" and "plain.txt" not in flow.outcomes
    assert sorted(flow.started[8:]) == [("auto_tags", "scan.pdf")]
    flow.run(2)
    assert len(flow.started) == 9
    for _ in range(100):
        counts = flow.listener.snapshot()
        if counts["completed"] + counts["failed"] == 9:
            break
        time.sleep(0.1)
    assert counts == {"enqueued": 9, "completed": 6, "failed": 3, "active": 0, "progress": 1.0}


def test_removed_and_added_again(flow):
    (flow.inbox / "a.docx").write_text("x")
    flow.run()
    (flow.inbox / "a.docx").unlink()
    flow.run()  # the result comes with the removal: the file is forgotten first or last, no outcome twice
    flow.outcomes.clear()
    (flow.inbox / "a.docx").write_text("x")
    flow.run(2)
    assert flow.started.count(("text_extraction", "a.docx")) == 2
    assert flow.outcomes == {"a.docx": "enriched"}


def test_hanging_job_is_given_up(flow, spark):
    flow.timeout = 1
    flow.jobs.clear()

    def never(paths):
        return paths.withColumn("text", F.lit(BODY))

    flow.jobs["text_extraction"] = never
    written = flow.enrichment.handle

    def lost(batch, number):
        """The results of jobs never arrive."""
        outcomes = batch.filter(F.col("action") == "outcome").select("path", "outcome")
        flow.outcomes.update({r.path.rsplit("/", 1)[1]: r.outcome for r in outcomes.collect()})

    flow.enrichment.handle = lost
    (flow.inbox / "a.docx").write_text("x")
    flow.run()
    assert flow.outcomes == {}
    time.sleep(0.1)
    (flow.inbox / "other.zip").write_text("x")  # anything that makes a batch
    flow.run()
    assert flow.outcomes == {"a.docx": "needs_review"}
    flow.enrichment.handle = written


@pytest.mark.parametrize("most", [1, 2, 5])
def test_bounded_concurrency(spark, most):
    now, peak, lock, pools = [0], [0], threading.Lock(), set()

    def job(i):
        def run():
            with lock:
                now[0] += 1
                peak[0] = max(peak[0], now[0])
            pools.add(spark.sparkContext.getLocalProperty("spark.scheduler.pool"))
            total = spark.range(10).count()
            time.sleep(0.2)
            with lock:
                now[0] -= 1
            if i == 3:
                raise ValueError("three")
            return total + i

        return run

    out = J.run_bounded(spark, [(f"kind{i % 2}", job(i)) for i in range(6)], most)
    assert peak[0] <= most and (most == 1 or peak[0] > 1)
    assert pools == {"kind0", "kind1"}
    assert [o for i, o in enumerate(out) if i != 3] == [10, 11, 12, 14, 15] and isinstance(out[3], ValueError)


def test_counters_start_anew_when_idle():
    now = [0.0]
    p = J.Progress(2.0, lambda: now[0])
    assert p.snapshot()["progress"] == 1.0
    p.add(enqueued=4)
    p.add(completed=1)
    assert p.snapshot() == {"enqueued": 4, "completed": 1, "failed": 0, "active": 3, "progress": 0.25}
    now[0] = 10.0
    p.add(failed=1)  # not idle: jobs were open all the time
    assert p.snapshot()["enqueued"] == 4
    p.add(completed=2)
    now[0] = 11.0
    p.add(enqueued=1)
    assert p.snapshot()["enqueued"] == 5
    p.add(completed=1)
    now[0] = 14.0
    p.add(enqueued=2)
    assert p.snapshot() == {"enqueued": 2, "completed": 0, "failed": 0, "active": 2, "progress": 0.0}
