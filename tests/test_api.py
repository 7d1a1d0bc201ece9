"""The stored index end to end, and the streaming forms."""

import json

import pytest
from pyspark.sql import functions as F

from foliant.api import Index
from foliant.config import AppConfig
from foliant.errors import ConcurrentUpdate, IndexNotInitialized, InvalidPath, WatcherNotRunning
from foliant.functions.embed import hash_embedder
from foliant.operators import rag
from foliant.sources import store
from foliant.streaming import events as streams

from test_extract import docx_bytes

BATCH = "file_path string, file_name string, description string, text_content string"


@pytest.fixture()
def ix(spark, tmp_path):
    index = Index(spark, str(tmp_path / "index"))
    index.init_index()
    return index


def add(ix, *rows):
    ix.index_files(ix.spark.createDataFrame(list(rows), BATCH))


def test_life_of_an_index(spark, ix):
    assert ix.get_indexed_file_count() == 0 and ix.get_embedding_count() == 0
    add(ix, ("/rust_guide.txt", "rust_guide.txt", "Guide", "Rust is a systems programming language"), ("/cooking.txt", "cooking.txt", "Food", "How to cook pasta"))
    assert ix.is_file_indexed("/rust_guide.txt") and not ix.is_file_indexed("/x")
    hit = ix.search_files("progr").first()
    assert (hit.file_path, hit.snippet) == ("/rust_guide.txt", "Rust is a systems programming language")
    assert hit.rank < 0 < hit.relevance < 1

    ix.update_transcript(spark.createDataFrame([("/cooking.txt", "quantum basil")], "file_path string, transcript_text string"))
    assert [r.file_path for r in ix.search_files("quantum").collect()] == ["/cooking.txt"]
    add(ix, ("/cooking.txt", "cooking.txt", "Kitchen", None))
    assert [r.file_path for r in ix.search_files("pasta").collect()] == ["/cooking.txt"]
    assert ix.search_files("food").count() == 0 and ix.search_files("kitchen").count() == 1

    ix.embed_missing()
    assert ix.has_embeddings("/cooking.txt") and ix.get_embedding_count() == 2
    assert [r.file_path for r in ix.semantic_search("pasta").collect()] == ["/cooking.txt"]
    assert [r.file_path for r in ix.find_similar_files("/cooking.txt").collect()] == ["/rust_guide.txt"]

    found = ix.rag_query("programming language")
    assert found["error_code"] is None and found["sources"]
    ix.init_llm(lambda system, user, n: f"{n} {'English' in system} {'Question: pasta' in user}")
    assert ix.rag_query("pasta")["answer"] == "300 True True"
    ix.unload_llm()

    ix.remove_from_index(spark.createDataFrame([("/cooking.txt",)], "file_path string"))
    assert ix.get_embedding_count() == 1 and ix.search_files("pasta").count() == 0
    ix.clear_all_embeddings()
    assert ix.get_embedding_count() == 0 and ix.get_indexed_file_count() == 1
    ix.clear_file_index()
    assert ix.get_indexed_file_count() == 0


def test_questions(spark, ix):
    assert ix.rag_query("")["error_code"] == ix.rag_query("  ")["error_code"] == "empty_question"
    assert ix.rag_query("anything")["error_code"] == "no_relevant_chunks"
    add(ix, *[(f"/file_{i}.txt", f"file_{i}.txt", "", f"shared topic number {i}") for i in range(5)])
    # Without vectors the keywords answer, then the file names.
    assert len(ix.rag_query("what is the topic", top_k=2)["sources"]) == 2
    by_name = ix.rag_query("ile_3", top_k=2)
    assert [s["file_path"] for s in by_name["sources"]] == ["/file_3.txt"]
    ix.embed_missing()
    assert len(ix.rag_query("shared topic number", top_k=2)["sources"]) <= 2
    assert ix.rag_query("topic", full_context=False)["error_code"] is None


def test_models_can_be_swapped(ix):
    assert not ix.is_semantic_model_ready() and ix.get_embedding_dim() == 64
    ix.init_semantic_model(lambda texts: hash_embedder(texts).repeat(6, axis=1))
    assert ix.is_semantic_model_ready() and ix.get_embedding_dim() == 384
    add(ix, ("/a.txt", "a.txt", "", "some text"))
    ix.embed_missing()
    assert ix.store.load("embeddings").select(F.size("embedding")).first()[0] == 384
    ix.unload_semantic_model()
    ix.embed_missing()
    assert ix.store.load("embeddings").select(F.size("embedding")).first()[0] == 64


def test_repeated_paths_and_generations(spark, ix):
    add(ix, ("/a", "a", "first", "one"), ("/n", "n", "new", "two"), ("/a", "a", "second", "three"), ("/n", "n", "newer", None))
    rows = {r.file_path: r for r in ix.files.collect()}
    assert ix.get_indexed_file_count() == 2 and len({r.id for r in rows.values()}) == 2
    batch = spark.createDataFrame([("/a", "x", 2), ("/a", "y", 3), ("/a", "z", 1)], "file_path string, text_content string, seq int")
    ix.update_text(batch, order="seq")
    assert ix.get_indexed_file_count() == 2 and ix.search_files("y").count() == 1 and ix.search_files("x").count() == 0
    # a removed file's id is never given out again
    top = max(r.id for r in rows.values())
    ix.remove_from_index(spark.createDataFrame([(p,) for p, r in rows.items() if r.id == top], "file_path string"))
    add(ix, ("/z", "z", "", "fresh"))
    assert ix.files.filter("file_path = '/z'").first().id > top
    # a writer that started from an older generation is refused
    base = ix.store.generation()[0]
    staged = ix.store.stage("files", ix.files)
    ix.mark_enriched(ix.files)
    with pytest.raises(ConcurrentUpdate):
        ix.store.publish(base, {"files": staged})


def test_changes_are_laid_over_and_merged(spark, ix, monkeypatch):
    monkeypatch.setattr(store, "MAX_CHANGES", 3)
    for k in range(5):
        add(ix, (f"/f{k % 3}", f"f{k % 3}", "", f"word{k} common"))
        parts = ix.store.generation()[1]["relations"]["files"]
        assert len(parts) <= 4
        assert ix.search_files(f"word{k}").count() == 1 and ix.get_indexed_file_count() == min(k + 1, 3)
    assert {r.file_path for r in ix.search_files("common").collect()} == {"/f0", "/f1", "/f2"}
    assert ix.search_files("word0").count() == ix.search_files("word1").count() == 0


def test_cancelled_questions(spark, ix, monkeypatch):
    add(ix, ("/a.txt", "a.txt", "", "some text"))
    assert ix.rag_query("some text", tag="q1")["error_code"] is None

    def stop(*_):
        raise RuntimeError("Job 7 cancelled part of cancelled job tags q1")

    monkeypatch.setattr(ix, "semantic_search", stop)
    assert ix.rag_query("some text", tag="q1")["error_code"] == "cancelled"
    ix.cancel("q1")


def test_missing_index(spark, tmp_path):
    with pytest.raises(IndexNotInitialized):
        Index(spark, str(tmp_path / "none")).get_indexed_file_count()


def test_watching_a_folder(spark, ix, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "a.txt").write_text("alpha body")
    (inbox / "b.docx").write_bytes(docx_bytes("beta body"))
    with pytest.raises(InvalidPath):
        ix.start_watching("relative")
    with pytest.raises(WatcherNotRunning):
        ix.stop_watching()
    ix.start_watching(str(inbox), interval=None).awaitTermination(120)
    assert sorted(r.file_name for r in ix.inbox().collect()) == ["a.txt", "b.docx"]
    (inbox / "c.txt").write_text("gamma body")
    ix.start_watching(str(inbox), interval=None).awaitTermination(120)
    assert ix.get_indexed_file_count() == 3
    assert [r.file_name for r in ix.search_files("beta").collect()] == ["b.docx"]
    (inbox / "a.txt").unlink()
    (inbox / "d.txt").write_text("delta")
    removed, new = ix.reconcile(str(inbox))
    assert removed == 1 and [r.file_name for r in new.collect()] == ["d.txt"]
    assert ix.search_files("alpha").count() == 0
    ix.add_new(str(inbox))
    assert [r.file_name for r in ix.search_files("delta").collect()] == ["d.txt"]
    # the watch takes vanished files out when it next runs, and new ones have vectors
    (inbox / "c.txt").unlink()
    (inbox / "e.txt").write_text("epsilon body")
    ix.start_watching(str(inbox), interval=None).awaitTermination(120)
    assert ix.search_files("gamma").count() == 0 and ix.has_embeddings(f"{inbox}/e.txt")
    wanted = spark.createDataFrame([(f"{inbox}/e.txt",), (f"{inbox}/gone.txt",)], "path string")
    codes = {r.path.rsplit("/", 1)[1]: r.error_code for r in ix.extract_paths(wanted, str(inbox)).collect()}
    assert codes == {"e.txt": None, "gone.txt": "file_not_found"}


def test_answer_events(spark):
    context = spark.createDataFrame([(1, "/a", "File: /a\nx", "x", 0), (2, "/a", "y", "y", 5)], "rank long, file_path string, part string, chunk_snippet string, chunk_offset long")
    answered = rag.answer(context)
    events = rag.stream_events(answered).collect()
    assert [(e.seq, e.type) for e in events] == [(0, "token"), (1, "done")]
    record = json.loads(events[1].payload)
    assert record["sources"] == [{"file_path": "/a", "chunk_snippet": "x", "chunk_offset": 0}]
    none = rag.stream_events(rag.answer(context.limit(0))).collect()
    assert [e.type for e in none] == ["done"] and json.loads(none[0].payload)["error_code"] == "no_relevant_chunks"
    assert json.loads(rag.result_json(rag.failed_answer(spark, "cancelled")).first()[0])["error_code"] == "cancelled"


def drain(stream, tmp_path, mode="append"):
    name = "t" + tmp_path.name.replace("-", "_")
    query = (
        stream.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination(180)
    return stream.sparkSession.table(name).collect()


def source(spark, tmp_path, rows):
    path = str(tmp_path / "events")
    shape = "event_id long, path string, op string, ts_ms long, watcher string"
    spark.createDataFrame(rows, shape).repartition(3).write.parquet(path)
    return spark.readStream.schema(shape).parquet(path)


ROWS = [(i, f"/p{i % 2}", "add", 1_000_000 + t, "w") for i, t in enumerate([0, 10, 200, 290, 310, 320, 700, 900, 1500, 5000])]


def test_stream_dedup(spark, tmp_path):
    last, expected = {}, []
    for i, path, _, t, _ in ROWS:
        if path not in last or t - last[path] >= 300:
            last[path] = t
            expected.append(i)
    got = drain(streams.dedup_stream(source(spark, tmp_path, ROWS), "1 hour"), tmp_path)
    assert sorted(r.event_id for r in got) == expected


def test_stream_rate_limit(spark, tmp_path):
    got = drain(streams.rate_limit_stream(source(spark, tmp_path, ROWS), "watcher", "1 hour", limit=3), tmp_path)
    assert sorted(r.event_id for r in got) == [0, 1, 2, 8, 9]


def test_stream_debounce(spark, tmp_path):
    rows = [(i, "/p", "add", t, "w") for i, t in enumerate([0, 100, 5_000, 5_100, 100_000])]
    stream = source(spark, tmp_path, rows)
    got = drain(streams.debounce_stream(stream, "path", "10 seconds"), tmp_path)
    assert sorted(r.event_id for r in got) == [1, 3]


def test_stream_counts(spark, tmp_path):
    rows = [(i, "/p", "add", t, "w") for i, t in enumerate([0, 100, 5_000, 100_000])]
    got = drain(streams.windowed_counts(source(spark, tmp_path, rows), "1 second", "10 seconds"), tmp_path)
    assert sorted(r.n for r in got) == [1, 2]


def test_watch_follows_removals_and_edits(spark, ix, tmp_path):
    """A pure removal needs no arrival; edits count when asked for; events are kept once."""
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    for name in ("a.txt", "b.txt"):
        (inbox / name).write_text(f"{name[0]}lpha body")
    ix.start_watching(str(inbox), interval=None).awaitTermination(180)
    ix.keep_events(str(tmp_path / "kept"), str(inbox)).awaitTermination(180)
    (inbox / "a.txt").unlink()
    ix.start_watching(str(inbox), interval=None).awaitTermination(180)
    assert [r.file_name for r in ix.files.collect()] == ["b.txt"]
    (inbox / "b.txt").write_text("omega body instead")
    ix.start_watching(str(inbox), interval=None, follow_edits=True).awaitTermination(180)
    assert [r.file_name for r in ix.search_files("omega").collect()] == ["b.txt"]
    ix.keep_events(str(tmp_path / "kept"), str(inbox)).awaitTermination(180)
    from foliant.sources.folder import read_events

    seen = sorted((r.op, r.file_name) for r in read_events(spark, str(tmp_path / "kept")).collect())
    assert seen == [("add", "a.txt"), ("add", "b.txt"), ("change", "b.txt"), ("remove", "a.txt")]


def test_enriching_a_folder(spark, tmp_path):
    """Arrival, extraction, tags and outcome; one file that cannot be read stays for review."""
    from foliant.streaming import jobs

    body = "Rust is a systems language. Memory safety matters in systems programming. Compilers check memory use."
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "good.docx").write_bytes(docx_bytes(body))
    (inbox / "bad.docx").write_bytes(b"no archive")
    config = AppConfig(auto_tags=True, embeddings=False, semantic_similarity=False)
    ix = Index(spark, str(tmp_path / "ix"), config)
    ix.init_index()
    before = spark.conf.get(jobs.STATE_STORE[0], None)
    try:
        for _ in range(3):
            ix.start_enriching(str(inbox), interval=None).awaitTermination(180)
    finally:
        spark.conf.unset(jobs.STATE_STORE[0]) if before is None else spark.conf.set(jobs.STATE_STORE[0], before)
    rows = {r.file_name: r for r in ix.files.collect()}
    assert set(rows) == {"good.docx"}
    assert rows["good.docx"].needs_review == 0 and "memory" in rows["good.docx"].tags and rows["good.docx"].text_content == body


def test_embedder_runs_once(spark, ix, tmp_path):
    log = str(tmp_path / "calls")

    def counting(texts):
        with open(log, "a") as f:
            f.write("x" * len(texts))
        return [[1.0, 0.0]] * len(texts)

    ix.init_semantic_model(counting, 2)
    rows = [(f"/f{i}", f"f{i}.txt", "", f"text number {i} " * 30) for i in range(5)]
    ix.index_files(spark.createDataFrame(rows, "file_path string, file_name string, description string, text_content string"))
    ix.embed_missing()
    chunks = ix.store.load("chunks").count()
    assert ix.get_embedding_count() == chunks == len(open(log).read())


def test_fallback_by_stored_index(spark, ix):
    rows = [("/a.txt", "a.txt", "", "contains zebra"), ("/zebra_b.txt", "zebra_b.txt", "", "nothing"), ("/c_special.txt", "c_special.txt", "", "else")]
    ix.index_files(spark.createDataFrame(rows, "file_path string, file_name string, description string, text_content string"))
    assert [r.file_path for r in ix._fallback("where is the zebra", 5).collect()] == ["/a.txt", "/zebra_b.txt"]
    assert [r.file_path for r in ix._fallback("the special thing", 5).collect()] == ["/c_special.txt"]
    assert ix._fallback("unknown", 5).count() == 0
