"""Event policies against the plain folds they stand for."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliant.config import RESOURCE_SAVER_PRESET, AppConfig, Tier
from foliant.operators import events as E


@given(st.lists(st.integers(0, 500), min_size=1, max_size=60), st.integers(1, 120), st.integers(-200, 600))
@settings(max_examples=200, deadline=None)
def test_bucket_walks(times, window, start):
    at = np.array(sorted(set(times)))
    kept, edge = [], start
    for i, t in enumerate(at):
        if t >= edge:
            kept.append(i)
            edge = t + window
    assert E._hops(at, start, window) == kept
    assert E._last_hops(at, window).tolist() == [E._hops(at, t, window)[-1] for t in at]


def stream(n, seed, gaps):
    rng = random.Random(seed)
    t, rows = 0, []
    for i in range(n):
        t += rng.choice(gaps)
        # One path takes most of the stream.
        rows.append((i, f"/p{rng.choice([0, 0, 0, 1, 2])}", "add", t, rng.choice("ab")))
    return rows


SCHEMA = "event_id long, path string, op string, ts_ms long, kind string"
CASES = [(3000, 1, [0, 1, 5, 50, 120, 400, 900]), (1500, 2, [0, 40, 250, 5_000, 90_000]), (800, 3, [300, 299, 301, 1000, 999])]


@pytest.mark.parametrize(("n", "seed", "gaps"), CASES)
def test_dedup(spark, n, seed, gaps):
    rows = stream(n, seed, gaps)
    last, expected = {}, []
    for i, path, _, t, _ in rows:
        if path not in last or t - last[path] >= 300:
            last[path] = t
            expected.append(i)
    got = E.dedup(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert sorted(r.event_id for r in got) == expected


@pytest.mark.parametrize("nodes", [E.DRIVER_NODES, 0])
@pytest.mark.parametrize(("n", "seed", "gaps"), CASES)
def test_rate_limit(spark, monkeypatch, n, seed, gaps, nodes):
    """Ranges of one key, whose pointers are followed in one place or by doubling."""
    monkeypatch.setattr(E, "DRIVER_NODES", nodes)
    rows = stream(n, seed, gaps)
    start, count, expected = None, 0, []
    for i, _, _, t, _ in rows:
        if start is None or t - start >= 1000:
            start, count = t, 0
        count += 1
        if count <= 3:
            expected.append(i)
    got = E.rate_limit(spark.createDataFrame(rows, SCHEMA).repartition(4), limit=3).collect()
    assert sorted(r.event_id for r in got) == expected


@pytest.mark.parametrize("policy", [E.THROTTLE_DEFAULT, E.THROTTLE_STRICT])
@pytest.mark.parametrize(("n", "seed", "gaps"), CASES)
def test_throttle(spark, n, seed, gaps, policy):
    rows = stream(n, seed, gaps)
    shown, last, expected = [], {}, []
    for i, _, _, t, kind in rows:
        if kind in last and t - last[kind] < policy["min_interval_ms"]:
            continue
        shown = [s for s in shown if s >= t - policy["window_ms"]]
        if len(shown) < policy["max_in_window"]:
            shown.append(t)
            last[kind] = t
            expected.append(i)
    got = E.throttle(spark.createDataFrame(rows, SCHEMA).repartition(4), [], "kind", **policy).collect()
    assert sorted(r.event_id for r in got) == expected


def test_debounce(spark):
    rows = stream(1200, 5, [0, 10, 299, 300, 4000, 70_000])
    expected = []
    for j, (i, path, _, t, _) in enumerate(rows):
        later = next((r[3] for r in rows[j + 1 :] if r[1] == path), None)
        if later is None or later - t >= 300:
            expected.append(i)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for bucket in (1_000, 3_600_000):
        got = E.debounce(df, ["path"], bucket_ms=bucket).collect()
        assert sorted(r.event_id for r in got) == expected


def test_one_dense_key_inside_a_window(spark):
    """A million instants of one path, all within one window, and a few behind it."""
    n = 1_000_000
    rows = spark.range(n).select(F.col("id").alias("event_id"), F.lit("/hot").alias("path"), F.lit("add").alias("op"), F.col("id").alias("ts_ms"))
    late = spark.range(3).select((F.col("id") + n), F.lit("/hot"), F.lit("add"), (F.col("id") * 5 + 2 * n))
    got = sorted(r.event_id for r in E.dedup(rows.union(late), 2 * n + 7).collect())
    assert got == [0, n + 2]
    spaced = sorted(r.event_id for r in E.dedup(rows, 250_000).collect())
    assert spaced == [0, 250_000, 500_000, 750_000]


def test_notices_once_a_day(spark):
    day = 24 * 3600 * 1000
    rows = [(1, "/a", "add", 0, "k"), (2, "/a", "add", day - 1, "k"), (3, "/a", "add", day, "k"), (4, "/a", "add", day + 5, "k")]
    got = E.limit_notices(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.event_id for r in got) == [1, 3]


def test_admission(spark):
    rows = [(i, "/p", "add", 1000 - i // 2, "k") for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    order = sorted(rows, key=lambda r: (r[3], r[0]))
    got = {r.event_id for r in E.admit(df, 10, existing=3).filter("admitted").collect()}
    assert got == {r[0] for r in order[:7]}
    assert E.admit(df, 10, existing=10).filter("admitted").count() == 0


def test_classes(spark):
    kinds = {"create_file": "add", "create_any": "add", "rename_to": "add", "rename_both": "add", "rename_from": None,
             "modify": None, "remove_file": "remove", "remove_any": "remove", "remove_folder": None}
    df = spark.createDataFrame([(k,) for k in kinds], "k string")
    assert {r.k: r.o for r in df.select("k", E.classify(F.col("k")).alias("o")).collect()} == kinds


def jobs(spark, config):
    names = ["a.pdf", "b.DOCX", "c.png", "d.webp", "e.mp3", "f.mkv", "g.txt", "h"]
    df = spark.createDataFrame([(f"/w/{n}",) for n in names], "path string")
    out = {n: [] for n in names}
    for r in E.fan_out(df, config).orderBy("path", "job_index").collect():
        out[r.path[3:]].append(r.job_type)
    return out


def test_fan_out(spark):
    assert jobs(spark, AppConfig()) == {
        "a.pdf": ["text_extraction"], "b.DOCX": ["text_extraction"], "c.png": [], "d.webp": [], "e.mp3": [], "f.mkv": [],
        "g.txt": ["embeddings"], "h": ["embeddings"],
    }
    everything = AppConfig(ocr=True, transcription=True, auto_summary=True, auto_tags=True)
    got = jobs(spark, everything)
    assert got["d.webp"] == ["ocr"] and got["f.mkv"] == ["transcription"]
    assert got["g.txt"] == ["embeddings", "auto_summary", "auto_tags"]
    saver = jobs(spark, RESOURCE_SAVER_PRESET)
    assert [n for n, j in saver.items() if j] == ["a.pdf", "b.DOCX"]


def test_followups_and_outcomes(spark):
    done = spark.createDataFrame(
        [("/a.pdf", "text_extraction", ""), ("/b.pdf", "text_extraction", "long text"), ("/c.mp3", "transcription", "12")],
        "path string, job_type string, text string",
    )
    got = {(r.path, r.job_type) for r in E.next_jobs(done, AppConfig(ocr=True)).collect()}
    assert got == {("/a.pdf", "ocr"), ("/b.pdf", "embeddings")}
    states = spark.createDataFrame(
        [("/a", "text_extraction", "completed", False), ("/a", "ocr", "completed", True), ("/b", "ocr", "failed", False),
         ("/c", "ocr", "pending", False), ("/d", "embeddings", "completed", True)],
        "path string, job_type string, status string, success boolean",
    )
    assert {r.path: r.outcome for r in E.outcomes(states).collect()} == {"/a": "enriched", "/b": "needs_review", "/c": "pending"}


def test_progress(spark):
    empty = spark.createDataFrame([], "status string")
    assert E.progress(empty).first().progress is None
    df = spark.createDataFrame([(s,) for s in ("pending", "processing", "completed", "failed")], "status string")
    assert tuple(E.progress(df).first()) == (4, 2, 1, 1, 0.5)


def test_config_and_tiers():
    config = AppConfig(embeddings=False)
    assert not config.is_enabled("semantic_similarity")
    saver = AppConfig(resource_saver=True, ocr=True)
    assert not saver.is_enabled("ocr") and saver.is_enabled("office_docs")
    limits = saver.effective_limits
    assert (limits.max_concurrent_jobs, limits.max_file_size_mb, limits.max_media_minutes, limits.max_pages_per_pdf) == (1, 10, 0, 30)
    free, pro = Tier(), Tier(pro=True)
    assert free.can_perform("basic_indexing", 99, "max_indexed_files")
    assert not free.can_perform("basic_indexing", 100, "max_indexed_files")
    assert pro.can_perform("basic_indexing", 10_000, "max_indexed_files")
    assert not free.can_perform("semantic_search") and pro.can_perform("semantic_search")
    assert not Tier(pro=True, hardware_constrained=True).can_perform("semantic_search")
