"""Event policies and queue operators over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant import config as C
from foliant.functions import paths
from foliant.operators import events as E
from foliant.plans import sqlparts as P
from foliant.plans.registry import query
from foliant.plans.text_queries import EXT, TYPED, typed_files
from foliant.sources import extract
from foliant.sources import tables as S

# The supplied events are minutes apart, so the windows are wider than the defaults.
HOUR = 3_600_000
DEDUP, RATE, RATE_LIMIT, QUIET = 6 * HOUR, HOUR, 10, HOUR
MIN_INTERVAL, MAX_SHOWN, SHOWN_WINDOW = 6 * HOUR, 3, 24 * HOUR
ALL_ON = C.AppConfig(ocr=True, transcription=True, auto_summary=True, auto_tags=True)


@query("event_classes", f"WITH {P.FILE_EVENTS} SELECT event_id, path, op, ts_ms FROM file_events")
def event_classes(spark, sf_dir):
    raw = S.file_events(spark, sf_dir)
    kind = F.when(F.col("event_type") == "error", "remove_file").otherwise("create_file")
    return raw.select("event_id", "path", E.classify(kind).alias("op"), "ts_ms")


@query(
    "dedup_events",
    f"""WITH RECURSIVE {P.FILE_EVENTS}, adds AS (SELECT * FROM file_events WHERE op = 'add'), kept AS (
      SELECT path, min(ts_ms) AS t FROM adds GROUP BY path
      UNION ALL
      SELECT k.path, min(a.ts_ms) FROM kept k JOIN adds a ON a.path = k.path AND a.ts_ms >= k.t + {DEDUP} GROUP BY k.path, k.t)
    SELECT min(event_id) AS event_id, kept.path, t AS ts_ms FROM kept JOIN adds ON adds.path = kept.path AND ts_ms = t
    GROUP BY kept.path, t""",
)
def dedup_events(spark, sf_dir):
    return E.dedup(S.file_events(spark, sf_dir), DEDUP)


def _anchors_sql(window: int) -> str:
    """CTE ``anchors`` (t): window starts over all of ``src``."""
    return f"""anchors AS (
      SELECT min(ts_ms) AS t FROM src
      UNION ALL
      SELECT (SELECT min(ts_ms) FROM src WHERE ts_ms >= a.t + {window}) FROM anchors a
      WHERE EXISTS (SELECT 1 FROM src WHERE ts_ms >= a.t + {window}))"""


@query(
    "rate_limit_events",
    f"""WITH RECURSIVE {P.FILE_EVENTS}, src AS (SELECT event_id, ts_ms FROM file_events), {_anchors_sql(RATE)}, placed AS (
      SELECT src.*, anchors.t AS window_start_ms FROM src ASOF JOIN anchors ON src.ts_ms >= anchors.t), ranked AS (
      SELECT *, row_number() OVER (PARTITION BY window_start_ms ORDER BY ts_ms, event_id) AS rank FROM placed)
    SELECT event_id, ts_ms, window_start_ms, rank FROM ranked WHERE rank <= {RATE_LIMIT}""",
)
def rate_limit_events(spark, sf_dir):
    events = S.file_events(spark, sf_dir).select("event_id", "ts_ms")
    return E.rate_limit(events, RATE_LIMIT, RATE)


@query(
    "debounce_events",
    f"""WITH {P.FILE_EVENTS}, nexts AS (
      SELECT *, lead(ts_ms) OVER (PARTITION BY path ORDER BY ts_ms, event_id) AS following FROM file_events)
    SELECT path, ts_ms, event_id FROM nexts WHERE following IS NULL OR following - ts_ms >= {QUIET}""",
)
def debounce_events(spark, sf_dir):
    return E.debounce(S.file_events(spark, sf_dir), ["path"], QUIET, bucket_ms=24 * HOUR)


@query(
    "notification_throttle",
    f"""WITH RECURSIVE {P.FILE_EVENTS}, src AS (
      SELECT user_id, event_type, ts_ms, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts_ms, event_id) AS rn
      FROM file_events), fold AS (
      SELECT user_id, rn, event_type, ts_ms, event_id, true AS shown, [{{'t': ts_ms, 'k': event_type}}] AS hist FROM src WHERE rn = 1
      UNION ALL
      SELECT s.user_id, s.rn, s.event_type, s.ts_ms, s.event_id,
        len(list_filter(hist, lambda h: h.k = s.event_type AND s.ts_ms - h.t < {MIN_INTERVAL})) = 0
        AND len(list_filter(hist, lambda h: h.t >= s.ts_ms - {SHOWN_WINDOW})) < {MAX_SHOWN},
        CASE WHEN len(list_filter(hist, lambda h: h.k = s.event_type AND s.ts_ms - h.t < {MIN_INTERVAL})) = 0
              AND len(list_filter(hist, lambda h: h.t >= s.ts_ms - {SHOWN_WINDOW})) < {MAX_SHOWN}
             THEN list_append(list_filter(hist, lambda h: h.t >= s.ts_ms - {SHOWN_WINDOW}), {{'t': s.ts_ms, 'k': s.event_type}})
             ELSE list_filter(hist, lambda h: h.t >= s.ts_ms - {SHOWN_WINDOW}) END
      FROM fold f JOIN src s ON s.user_id = f.user_id AND s.rn = f.rn + 1)
    SELECT user_id, event_type, ts_ms, event_id FROM fold WHERE shown""",
)
def notification_throttle(spark, sf_dir):
    events = S.file_events(spark, sf_dir).select("user_id", "event_type", "ts_ms", "event_id")
    return E.throttle(events, ["user_id"], "event_type", MIN_INTERVAL, MAX_SHOWN, SHOWN_WINDOW)


@query(
    "limit_notices",
    f"""WITH RECURSIVE {P.FILE_EVENTS}, kept AS (
      SELECT user_id, min(ts_ms) AS t FROM file_events GROUP BY user_id
      UNION ALL
      SELECT k.user_id, min(a.ts_ms) FROM kept k JOIN file_events a ON a.user_id = k.user_id AND a.ts_ms >= k.t + {24 * HOUR}
      GROUP BY k.user_id, k.t)
    SELECT kept.user_id, min(event_id) AS event_id, t AS ts_ms FROM kept
    JOIN file_events f ON f.user_id = kept.user_id AND f.ts_ms = t GROUP BY kept.user_id, t""",
)
def limit_notices(spark, sf_dir):
    return E.limit_notices(S.file_events(spark, sf_dir), ["user_id"])


@query(
    "free_tier_cap",
    f"""WITH {P.FILE_EVENTS}, adds AS (
      SELECT event_id, ts_ms, row_number() OVER (ORDER BY ts_ms, event_id) AS n FROM file_events WHERE op = 'add')
    SELECT event_id, ts_ms, n <= {C.FREE_MAX_FILES} - 40 AS admitted FROM adds""",
)
def free_tier_cap(spark, sf_dir):
    adds = S.file_events(spark, sf_dir).filter(F.col("op") == "add").select("event_id", "ts_ms")
    return E.admit(adds, C.FREE_MAX_FILES, existing=40)


PRE = P.in_list(paths.RICH_EXTENSIONS + paths.QUEUE_IMAGE_EXTENSIONS + paths.AUDIO_EXTENSIONS + paths.VIDEO_EXTENSIONS)
MEDIA = P.in_list(paths.AUDIO_EXTENSIONS + paths.VIDEO_EXTENSIONS)
JOBS = f"""jobs AS (
  SELECT path, text, unnest(CASE WHEN {EXT} IN ('pdf', 'docx') THEN ['text_extraction'] WHEN {EXT} IN {MEDIA} THEN ['transcription']
    WHEN {EXT} IN {P.in_list(paths.QUEUE_IMAGE_EXTENSIONS)} THEN ['ocr'] ELSE ['embeddings', 'auto_summary', 'auto_tags'] END) AS job_type
  FROM typed)"""


def _jobs(spark, sf_dir):
    return E.fan_out(typed_files(spark, sf_dir), ALL_ON)


@query("job_fanout", f"WITH {TYPED}, {JOBS} SELECT path, job_type FROM jobs")
def job_fanout(spark, sf_dir):
    return _jobs(spark, sf_dir).select("path", "job_type")


@query(
    "job_fanout_default",
    f"""WITH {TYPED} SELECT path, 'text_extraction' AS job_type FROM typed WHERE {EXT} IN ('pdf', 'docx')
    UNION ALL SELECT path, 'embeddings' FROM typed WHERE {EXT} NOT IN {PRE}""",
)
def job_fanout_default(spark, sf_dir):
    return E.fan_out(typed_files(spark, sf_dir), C.AppConfig()).select("path", "job_type")


# Content jobs succeed when their file's text is long enough, PDFs of some sources have no text.
FINISHED = f"""{TYPED}, {JOBS}, finished AS (
  SELECT path, job_type, CASE WHEN path LIKE '/in/src1/%' THEN '' WHEN path LIKE '/in/src2/%' THEN '42' ELSE text END AS text
  FROM jobs WHERE job_type IN ('text_extraction', 'transcription', 'ocr'))"""
USEFUL = f"length({P.trim('text')}) > 3 AND regexp_matches(text, '[a-zA-Zа-яА-ЯёЁ]')"


def _finished(spark, sf_dir):
    text = F.when(F.startswith("path", F.lit("/in/src1/")), "").when(F.startswith("path", F.lit("/in/src2/")), "42")
    content = _jobs(spark, sf_dir).filter(F.col("job_type").isin("text_extraction", "transcription", "ocr"))
    return content.select("path", "job_type", text.otherwise(F.col("text")).alias("text"))


@query(
    "next_jobs",
    f"""WITH {FINISHED} SELECT path, unnest(['embeddings', 'auto_summary', 'auto_tags']) AS job_type FROM finished WHERE {USEFUL}
    UNION ALL SELECT path, 'ocr' FROM finished WHERE job_type = 'text_extraction' AND text = '' AND {EXT} = 'pdf'""",
)
def next_jobs(spark, sf_dir):
    return E.next_jobs(_finished(spark, sf_dir), ALL_ON)


@query(
    "tracker_outcome",
    f"""WITH {FINISHED} SELECT path, CASE WHEN path LIKE '/in/src3/%' THEN 'pending' WHEN {USEFUL} THEN 'enriched'
      ELSE 'needs_review' END AS outcome FROM finished""",
)
def tracker_outcome(spark, sf_dir):
    from foliant.functions.text import is_meaningful

    status = F.when(F.startswith("path", F.lit("/in/src3/")), "processing").otherwise("completed")
    jobs = _finished(spark, sf_dir).select("path", "job_type", status.alias("status"), is_meaningful(F.col("text")).alias("success"))
    return E.outcomes(jobs)


@query(
    "progress",
    f"""WITH {TYPED}, {JOBS}, st AS (SELECT CASE WHEN path LIKE '/in/src1/%' THEN 'pending' WHEN path LIKE '/in/src2/%' THEN
      'processing' WHEN path LIKE '/in/src3/%' THEN 'failed' ELSE 'completed' END AS s FROM jobs)
    SELECT count(*) AS total_enqueued, count(*) FILTER (s IN ('completed', 'failed')) AS completed_count,
      count(*) FILTER (s = 'processing') AS active_count, count(*) FILTER (s = 'pending') AS pending_count,
      round(count(*) FILTER (s IN ('completed', 'failed')) / CAST(count(*) AS DOUBLE), 6) AS progress FROM st""",
)
def progress(spark, sf_dir):
    starts = lambda s: F.startswith("path", F.lit(f"/in/{s}/"))
    status = F.when(starts("src1"), "pending").when(starts("src2"), "processing").when(starts("src3"), "failed")
    jobs = _jobs(spark, sf_dir).select(status.otherwise("completed").alias("status"))
    return E.progress(jobs).withColumn("progress", F.round("progress", 6))


@query(
    "tier_formats",
    f"""WITH {TYPED} SELECT path, {EXT} IN {P.in_list(C.FREE_FORMATS)} AND size_bytes <= {C.FREE_MAX_FILE_BYTES} AS free,
      {EXT} IN {P.in_list(C.PRO_FORMATS)} AND size_bytes <= {C.PRO_MAX_FILE_BYTES} AS pro FROM typed""",
)
def tier_formats(spark, sf_dir):
    files = typed_files(spark, sf_dir)
    fits = lambda t: paths.is_format_supported(F.col("path"), t.formats) & (F.col("size_bytes") <= t.max_file_bytes)
    return files.select("path", fits(C.Tier()).alias("free"), fits(C.Tier(pro=True)).alias("pro"))


@query(
    "saver_mode",
    f"""WITH {TYPED} SELECT path, CASE WHEN {EXT} = '' THEN 'unsupported_format' WHEN size_bytes > 10 * 1024 * 1024 THEN
      'file_too_large' WHEN {EXT} IN ('pdf', 'docx') OR {EXT} IN {P.in_list(paths.TEXT_EXTENSIONS)} THEN NULL
      ELSE 'unsupported_format' END AS extraction, 'transcription_disabled' AS transcription,
      CASE WHEN {EXT} IN ('pdf', 'docx') THEN 1 ELSE 0 END AS n_jobs FROM typed""",
)
def saver_mode(spark, sf_dir):
    """Limits and jobs under the resource saver."""
    saver = C.RESOURCE_SAVER_PRESET
    limits = saver.effective_limits
    files = typed_files(spark, sf_dir)
    p, size, there = F.col("path"), F.col("size_bytes"), F.lit(True)
    jobs = E.fan_out(files.select("path"), saver).groupBy("path").agg(F.count(F.lit(1)).cast("int").alias("n_jobs"))
    return (
        files.select(
            "path",
            extract.check_extraction(p, size, there, limits.max_file_size_mb)["error_code"].alias("extraction"),
            extract.check_transcription(p, size, there, limits.max_file_size_mb, limits.max_media_minutes)["error_code"].alias("transcription"),
        )
        .join(jobs, "path", "left")
        .fillna({"n_jobs": 0})
    )


@query(
    "event_windows",
    """SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n, round(sum(value), 4) AS total
    FROM events GROUP BY ALL""",
)
def event_windows(spark, sf_dir):
    events = S.table(spark, sf_dir, "events").groupBy("event_type", F.window("ts", "1 hour").alias("w"))
    agg = events.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return agg.select("event_type", F.col("w.start").alias("window_start"), "n", "total")
