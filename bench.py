"""Time the headline queries and print one JSON line.

Every query is planned anew and run to its last row without moving the result
to Python.  One warm-up run precedes the timed ones.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))

HEADLINE = (
    "keyword_search",
    "fts_and_prefix",
    "fts_or_exact",
    "fts_index_search",
    "fts_scan_search",
    "postings",
    "chunk_text",
    "cosine_scores",
    "hybrid_single_token",
    "hybrid_phrase",
    "similar_files",
    "rag_full_context",
    "rag_cascade_fallback",
    "tags",
    "distinct_tags",
    "summary_fallback",
    "summary_centrality",
    "upsert_preserve_text",
    "remove_file_cascade",
    "fs_reconcile",
    "files_wrong_or_missing_embeddings",
    "dedup_events",
    "rate_limit_events",
    "notification_throttle",
    "job_fanout",
    "extract_content",
    "nearest_files",
    "index_build",
)


def index_build(spark, sf_dir: str) -> None:
    """Tokenise, sort and store the search index of ``documents``, which the search queries find ready."""
    import uuid

    from foliant.session import shared_dir
    from foliant.sources import tables
    from foliant.sources.searchable import write_search_index

    write_search_index(tables.files(spark, sf_dir), f"{shared_dir(spark)}/bench/{uuid.uuid4().hex}")


def main() -> None:
    from foliant.plans.catalog import QUERIES
    from foliant.session import local_session

    # The supplied tables have one row group each; spread them, which larger tables do not need.
    spark = local_session("foliant-bench", CPUS, {"foliant.spread": CPUS})
    times: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        runs = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            if name == "index_build":
                index_build(spark, SF_DIR)
            else:
                QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs[1:]), 3)
    spark.stop()
    sf = os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
