"""One object that ties the operators to a stored index.

Mutations take batches, since every one of them writes a new snapshot.
Results come back as DataFrames of at most the requested number of rows.
"""

from __future__ import annotations

import threading
import zlib
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from foliant.config import AppConfig
from foliant.errors import LlmNotLoaded, WatcherAlreadyRunning, WatcherNotRunning
from foliant.functions import embed as M
from foliant.functions import paths, prompts
from foliant.functions import text as X
from foliant.operators import enrich, fulltext, hybrid, index, names, rag
from foliant.operators.chunking import DEFAULT_OVERLAP, DEFAULT_SIZE, chunk_files
from foliant.session import ship_package
from foliant.sources import extract, files
from foliant.sources import folder as folders
from foliant.sources.searchable import stored
from foliant.sources.store import IndexStore
from foliant.streaming import events as streams
from foliant.streaming import jobs

# Maps (system prompt, user prompt, token limit) to an answer; "" means none.
AnswerModel = Callable[[str, str, int], str]


class Index:
    """A stored index and what can be asked of it."""

    def __init__(self, spark: SparkSession, root: str | None = None, config: AppConfig | None = None):
        ship_package(spark)
        self.spark = spark
        self.config = config or AppConfig()
        self.store = IndexStore(spark, root)
        self._embedder: M.Embedder = M.hash_embedder
        self._dim = M.STUB_DIM
        self._model: AnswerModel | None = None
        self._watch: StreamingQuery | None = None
        # jobs of a stream write one after the other: two changes of one generation would refuse each other
        self._writing = threading.RLock()

    # -- index ------------------------------------------------------------

    def init_index(self) -> None:
        self.store.create()

    def get_index_path(self) -> str:
        return self.store.root

    @property
    def files(self) -> DataFrame:
        return self.store.load("files")

    def _now(self):
        return F.unix_timestamp().cast("long")

    def _touched(self, batch: DataFrame) -> DataFrame:
        """Stored rows of the paths in a batch; a change builds on these alone."""
        return self.files.join(batch.select("file_path").distinct(), "file_path", "left_semi")

    def _publish(self, snapshot: DataFrame, touched: DataFrame) -> None:
        """Lay changed rows of ``files`` over the index, with their postings and lengths.

        The rows are staged first and read back, so that ids are settled; all
        relations become visible at once.
        """
        base = self.store.generation()[0]
        rows = self.store.stage("files", snapshot)
        old = self._touched(touched).select("id")
        new = self.store.read(rows)
        changed = old.union(new.select("id"))
        self.store.publish(
            base,
            changes={
                "files": (rows, self.store.stage_gone("files", old)),
                "postings": (
                    self.store.stage("postings", fulltext.build_postings(new)),
                    self.store.stage_gone("postings", changed),
                ),
                "doc_stats": (
                    self.store.stage("doc_stats", fulltext.document_lengths(new)),
                    self.store.stage_gone("doc_stats", changed),
                ),
            },
        )
        self.store.compact()

    def index_files(self, batch: DataFrame, preserve_text: bool = True, order: str | None = None) -> None:
        """Index (file_path, file_name, description, text_content) rows; the last by ``order`` of a path counts."""
        top = self.store.top_id()
        self._publish(index.upsert(self._touched(batch), batch, self._now(), preserve_text, order, top), batch)

    def index_for_review(self, batch: DataFrame, order: str | None = None) -> None:
        self._publish(index.insert_for_review(self._touched(batch), batch, self._now(), order, self.store.top_id()), batch)

    def update_text(self, batch: DataFrame, order: str | None = None) -> None:
        self._publish(index.update_text(self._touched(batch), batch, self._now(), order), batch)

    def update_transcript(self, batch: DataFrame, order: str | None = None) -> None:
        self._publish(index.update_transcript(self._touched(batch), batch, self._now(), order), batch)

    def update_description(self, batch: DataFrame, order: str | None = None) -> None:
        self._publish(index.update_description(self._touched(batch), batch, self._now(), order), batch)

    def update_tags(self, batch: DataFrame, order: str | None = None) -> None:
        self._publish(index.update_tags(self._touched(batch), batch, self._now(), order), batch)

    def save_review(self, batch: DataFrame, order: str | None = None) -> None:
        self._publish(index.save_review(self._touched(batch), batch, order), batch)

    def mark_enriched(self, paths_: DataFrame) -> None:
        marked = index.mark_enriched(self.files, paths_).join(paths_.select("file_path").distinct(), "file_path", "left_semi")
        self.store.change(files=(marked, marked.select("id")))

    def remove_from_index(self, paths_: DataFrame) -> None:
        gone = self.files.join(paths_.select("file_path"), "file_path", "left_semi").select("id")
        self.store.change(**{n: (None, gone) for n in ("files", "chunks", "embeddings", "postings", "doc_stats")})

    def clear_file_index(self) -> None:
        names = ("files", "chunks", "embeddings", "postings", "doc_stats")
        self.store.save(**{n: index.clear(self.store.load(n)) for n in names})

    def remove_missing(self, folder: str) -> int:
        """Take files that are gone from the folder out of all relations; returns their number."""
        gone = index.missing_on_disk(self.files, files.listing(self.spark, folder)).select("file_path")
        removed = gone.count()
        if removed:
            self.remove_from_index(gone)
        return removed

    def add_new(self, folder: str) -> None:
        """Index the folder's unknown files for review."""
        fresh = index.new_on_disk(self.files, files.listing(self.spark, folder)).select(F.col("file_path").alias("path"))
        texts = extract.extract_requested(fresh, files.scan(self.spark, folder)).select("path", F.col("text").alias("text_content"))
        self.index_for_review(texts.select(F.col("path").alias("file_path"), paths.base_name(F.col("path")).alias("file_name"), "text_content"))

    def reconcile(self, folder: str) -> tuple[int, DataFrame]:
        """Drop vanished files; return their number and the files not indexed yet."""
        removed = self.remove_missing(folder)
        return removed, index.new_on_disk(self.files, files.listing(self.spark, folder))

    # -- lookups ----------------------------------------------------------

    def is_file_indexed(self, path: str) -> bool:
        return not index.lookup(self.files, path).isEmpty()

    def get_indexed_file(self, path: str) -> DataFrame:
        return index.lookup(self.files, path)

    def get_indexed_file_count(self) -> int:
        return self.files.count()

    def inbox(self) -> DataFrame:
        return index.inbox(self.files).orderBy(F.desc("indexed_at"), "file_path")

    def has_embeddings(self, path: str) -> bool:
        own = self.files.filter(F.col("file_path") == path)
        return not index.with_embeddings(own, self.store.load("embeddings")).isEmpty()

    def get_embedding_count(self) -> int:
        return self.store.load("embeddings").count()

    # -- keyword search ---------------------------------------------------

    def search_files(self, query: str, limit: int = fulltext.DEFAULT_LIMIT, stem_ru: bool = False) -> DataFrame:
        """Best files by way of the inverted index, with snippets."""
        phrases = fulltext.parse_query(query, stem_ru)
        ranked = fulltext.rank_postings(self.store.load("postings"), self.store.load("doc_stats"), phrases)
        top = ranked.orderBy("rank", "id").limit(limit)
        return fulltext.result_page(self.files, top, phrases).orderBy("rank", "id").drop("id")

    # -- vectors ----------------------------------------------------------

    def init_semantic_model(self, embedder: M.Embedder, dim: int = M.MODEL_DIM) -> None:
        self._embedder, self._dim = embedder, dim

    def unload_semantic_model(self) -> None:
        self._embedder, self._dim = M.hash_embedder, M.STUB_DIM

    def is_semantic_model_ready(self) -> bool:
        return self._embedder is not M.hash_embedder

    def get_embedding_dim(self) -> int:
        return self._dim

    def chunk_text(self, texts: DataFrame, size: int = DEFAULT_SIZE, overlap: int = DEFAULT_OVERLAP) -> DataFrame:
        return chunk_files(texts, "text_content", size, overlap)

    def compute_embeddings(self, chunks: DataFrame) -> DataFrame:
        return M.embed_chunks(chunks, self._embedder)

    def store_chunks_and_embeddings(self, chunks: DataFrame, embeddings: DataFrame) -> None:
        touched = chunks.select("file_id")
        self.store.change(chunks=(chunks, touched), embeddings=(embeddings, touched))

    def embed_missing(self) -> None:
        """Chunk and embed every file that lacks vectors of the current width."""
        names = index.without_embeddings(self.files, self.store.load("embeddings"), self._dim)
        todo = self.files.join(names.select("file_path"), "file_path", "left_semi")
        joined = X.embedding_text(*[F.col(c) for c in ("description", "tags", "text_content", "transcript_text")])
        # written before they are ordered for storage, so that chunking and the model run once
        keep = stored(self.spark)
        chunks = keep(chunk_files(todo.withColumn("joined", joined), "joined"), "chunks")
        self.store_chunks_and_embeddings(chunks, keep(self.compute_embeddings(chunks), "embeddings"))
        keep.discard()

    def clear_all_embeddings(self) -> None:
        self.store.save(**{n: index.clear(self.store.load(n)) for n in ("chunks", "embeddings")})

    def _embedded(self) -> DataFrame:
        return hybrid.embedded(self.files, self.store.load("chunks"), self.store.load("embeddings"))

    def _query_vector(self, text: str) -> Sequence[float] | None:
        return np.asarray(self._embedder([text])[0], dtype=float).tolist() if text.strip() else None

    def semantic_search(self, query: str, top_k: int = hybrid.DEFAULT_TOP_K) -> DataFrame:
        return hybrid.similarity_search(self._embedded(), query, self._query_vector(query), top_k)

    def find_similar_files(self, path: str, top_k: int = 10) -> DataFrame:
        return hybrid.similar_files(self._embedded(), path, top_k)

    # -- questions --------------------------------------------------------

    def init_llm(self, model: AnswerModel) -> None:
        self._model = model

    def unload_llm(self) -> None:
        self._model = None

    def is_llm_ready(self) -> bool:
        return self._model is not None

    def rag_query(
        self, question: str, top_k: int = 5, full_context: bool = True, max_tokens: int = 300, tag: str | None = None
    ) -> dict:
        """Answer record as a dict: answer, sources, error_code.

        Fallbacks run only when the step before found nothing.  With
        ``full_context`` off, hits below the threshold end in
        ``no_relevant_chunks`` without a keyword search.  A query with a
        ``tag`` can be stopped by ``cancel``; its code is then ``cancelled``.
        """
        if not question.strip():
            return {"answer": "", "sources": [], "error_code": "empty_question"}
        context = self.spark.sparkContext
        if tag:
            context.addJobTag(tag)
        try:
            return self._answer(question, top_k, full_context, max_tokens)
        except Exception as failure:
            if tag and "cancelled" in str(failure).lower():
                return {"answer": "", "sources": [], "error_code": "cancelled"}
            raise
        finally:
            if tag:
                context.removeJobTag(tag)

    def cancel(self, tag: str) -> None:
        """Stop the queries that carry a tag."""
        self.spark.sparkContext.cancelJobsWithTag(tag)

    def _answer(self, question: str, top_k: int, full_context: bool, max_tokens: int) -> dict:
        hits = self.semantic_search(question, top_k).persist()
        try:
            if hits.isEmpty():
                context = self._fallback(question, top_k)
            else:
                context = rag.full_context(hits) if full_context else rag.snippet_context(hits)
            row = rag.answer(context).first()
        finally:
            hits.unpersist()
        answer = row["answer"]
        if self._model is not None and row["error_code"] is None:
            answer = self._generate(question, row["context"], max_tokens) or answer
        return {"answer": answer, "sources": [s.asDict() for s in row["sources"]], "error_code": row["error_code"]}

    def _fallback(self, question: str, top_k: int) -> DataFrame:
        """Files by keyword from the stored postings, else by name; only their texts are read."""

        def by_keyword(phrases: list[fulltext.Phrase], k: int) -> DataFrame:
            ranked = fulltext.rank_postings(
                self.store.load("postings"), self.store.load("doc_stats"), phrases, fulltext.UNWEIGHTED, require_all=False
            )
            return ranked.orderBy("rank", "id").limit(k)

        named = self.files.select("id", "file_name")
        return rag.indexed_fallback(self.files, question, top_k, by_keyword, named, names.build_name_grams(named))

    def _generate(self, question: str, context: str, max_tokens: int) -> str:
        if self._model is None:
            raise LlmNotLoaded("no generative model")
        language = prompts.LANGUAGE_NAMES[X.detect_language_literal(question)]
        user = f"Context from user's files:\n\n{context}\n\nQuestion: {question}"
        return self._model(prompts.RAG_PROMPT % language, user, max_tokens)

    # -- enrichment -------------------------------------------------------

    def summaries(self, generator: enrich.Generator | None = None) -> DataFrame:
        embedder = self._embedder if self.is_semantic_model_ready() else None
        return enrich.summarise(self.files, embedder, generator)

    def tags(self, generator: enrich.Generator | None = None) -> DataFrame:
        embedder = self._embedder if self.is_semantic_model_ready() else None
        return enrich.tag(self.files, embedder, generator)

    # -- folders ----------------------------------------------------------

    def get_default_watch_path(self) -> str:
        return files.default_watch_dir()

    def get_default_watch_path_preview(self) -> str:
        """The same for display: nothing is made, and a session without a home folder raises."""
        return files.default_watch_dir()

    def extract_folder(self, folder: str, pdf_reader: extract.PageReader | None = None) -> DataFrame:
        limits = self.config.effective_limits
        scanned = files.scan(self.spark, folder)
        return extract.extract_content(scanned, limits.max_file_size_mb, limits.max_pages_per_pdf, pdf_reader)

    def extract_paths(self, requests: DataFrame, folder: str, pdf_reader: extract.PageReader | None = None) -> DataFrame:
        """Extraction of single files: requested paths of a folder, with codes for those that are not there."""
        limits = self.config.effective_limits
        scanned = files.scan(self.spark, folder)
        return extract.extract_requested(
            requests, scanned, max_mb=limits.max_file_size_mb, max_pages=limits.max_pages_per_pdf, pdf_reader=pdf_reader
        )

    def transcribe_folder(self, folder: str, reader: extract.PageReader | None = None) -> DataFrame:
        limits = self.config.effective_limits
        scanned = files.scan(self.spark, folder)
        return extract.transcribe(scanned, reader, limits.max_file_size_mb, limits.max_media_minutes)

    def ocr_folder(self, folder: str, reader: extract.PageReader | None = None) -> DataFrame:
        limits = self.config.effective_limits
        scanned = files.scan(self.spark, folder)
        return extract.ocr(scanned, reader, limits.max_file_size_mb, limits.max_pages_per_pdf)

    def is_ocr_supported(self, files_: DataFrame) -> DataFrame:
        return files_.select("path", paths.is_ocr_supported(F.col("path")).alias("supported"))

    def _place(self, kind: str, folder: str) -> str:
        return f"{self.store.root}/_{kind}/{zlib.crc32(folder.encode())}"

    def folder_events(self, folder: str | None = None, max_files_per_trigger: int | None = None, name: str = "events") -> DataFrame:
        """Stream of added, changed and removed files, each once over restarts; ``name`` tells its readers apart."""
        target = files.resolve_watch_dir(folder)
        return folders.folder_events(self.spark, target, f"{self._place(name, target)}/snapshots", max_files_per_trigger)

    def keep_events(self, path: str, folder: str | None = None, interval: str | None = None) -> StreamingQuery:
        """Keep the events of a folder below ``path``, each once; ``sources.folder.read_events`` reads them."""
        target = files.resolve_watch_dir(folder)
        return folders.write_events(self.folder_events(target, name="kept"), path, f"{self._place('kept', target)}/checkpoint", interval)

    def start_watching(
        self,
        folder: str | None = None,
        interval: str | None = "1 second",
        max_files_per_trigger: int | None = None,
        follow_edits: bool = False,
    ) -> StreamingQuery:
        """Keep the index in step with a folder; without an interval, take in what has happened and stop.

        Added files are indexed for review and get vectors where the
        configuration asks for them; removed files leave all relations, also
        when nothing else happens.  Edits count with ``follow_edits`` only.
        """
        if self._watch is not None and self._watch.isActive:
            raise WatcherAlreadyRunning("a folder is being watched")
        target = files.resolve_watch_dir(folder)
        events = self.folder_events(target, max_files_per_trigger, "watch")
        limit = self.config.effective_limits.max_file_size_mb

        def texts(rows: DataFrame) -> DataFrame:
            scanned = folders.with_content(rows, limit * 1024 * 1024)
            return extract.extract_content(scanned, limit).select(
                F.col("path").alias("file_path"), paths.base_name(F.col("path")).alias("file_name"), F.col("text").alias("text_content")
            )

        def handle(batch: DataFrame, number: int) -> None:
            ops = {op: batch.filter(F.col("op") == op) for op in ("remove", "add", "change")}
            there = {r["op"] for r in batch.select("op").distinct().collect()}
            with self._writing:
                if "remove" in there:
                    self.remove_from_index(ops["remove"].select(F.col("path").alias("file_path")))
                if "add" in there:
                    self.index_for_review(texts(ops["add"]))
                if "change" in there and follow_edits:
                    self.update_text(texts(ops["change"]))
                if "add" in there and (self.config.is_enabled("embeddings") or self.config.is_enabled("semantic_similarity")):
                    self.embed_missing()

        self._watch = streams.start(events, handle, f"{self._place('watch', target)}/checkpoint", interval)
        return self._watch

    def start_enriching(
        self,
        folder: str | None = None,
        interval: str | None = "1 second",
        readers: dict[str, extract.PageReader] | None = None,
        timeout_ms: int = 600_000,
        progress: jobs.Progress | None = None,
    ) -> StreamingQuery:
        """Run the jobs of added files and those that follow from their texts, as the configuration asks.

        ``readers`` may have ``pdf``, ``ocr`` and ``transcription``.  Files
        whose jobs gave text are marked enriched.  At most
        ``max_concurrent_jobs`` kinds of jobs run at once; without an interval,
        one round of what is due is run.
        """
        target = files.resolve_watch_dir(folder)
        place = self._place("enrich", target)
        limits = self.config.effective_limits
        work = jobs.Enrichment(self.spark, f"{place}/results", self._jobs(readers or {}), self._settle, limits.max_concurrent_jobs)
        messages = work.messages(self.folder_events(target, name="enrich"))
        actions = jobs.track(jobs.Progress.observed(messages), self.config, timeout_ms)
        if progress is not None:
            self.spark.streams.addListener(progress)
        writer = jobs.Progress.observed_actions(actions).writeStream.foreachBatch(work.handle).outputMode("update")
        trigger = {"processingTime": interval} if interval else {"availableNow": True}
        return writer.option("checkpointLocation", f"{place}/checkpoint").trigger(**trigger).start()

    def _settle(self, outcomes: DataFrame) -> None:
        done = outcomes.filter(F.col("outcome") == "enriched").select(F.col("path").alias("file_path"))
        with self._writing:
            self.mark_enriched(done)

    def _jobs(self, readers: dict[str, extract.PageReader]) -> dict[str, jobs.Job]:
        """A function per job type: (path) to (path, text), with the index brought up to date."""
        limits = self.config.effective_limits

        def content(paths_: DataFrame) -> DataFrame:
            return folders.with_content(paths_, limits.max_file_size_mb * 1024 * 1024)

        def kept(found: DataFrame, update: Callable[[DataFrame], None]) -> DataFrame:
            """Texts as they were found, once, and the index with them."""
            rows = stored(self.spark)(found.select("path", "text", "error_code"), "texts")
            good = rows.filter("error_code IS NULL")
            batch = good.select(F.col("path").alias("file_path"), paths.base_name(F.col("path")).alias("file_name"), F.col("text").alias("text_content"))
            with self._writing:
                self.index_for_review(batch.withColumn("text_content", F.lit("")))
                update(batch)
            return good.select("path", "text")

        def spoken(batch: DataFrame) -> None:
            self.update_transcript(batch.withColumnRenamed("text_content", "transcript_text"))

        def mine(paths_: DataFrame) -> DataFrame:
            return self.files.join(paths_.select(F.col("path").alias("file_path")), "file_path", "left_semi")

        def made(rows: DataFrame, column: str, update: Callable[[DataFrame], None]) -> DataFrame:
            batch = stored(self.spark)(rows, "made")
            with self._writing:
                update(batch.filter(F.col(column) != ""))
            return batch.select(F.col("file_path").alias("path"), F.col(column).alias("text"))

        def text_extraction(paths_: DataFrame) -> DataFrame:
            found = extract.extract_content(content(paths_), limits.max_file_size_mb, limits.max_pages_per_pdf, readers.get("pdf"))
            return kept(found, self.update_text)

        def ocr(paths_: DataFrame) -> DataFrame:
            return kept(extract.ocr(content(paths_), readers.get("ocr"), limits.max_file_size_mb, limits.max_pages_per_pdf), self.update_text)

        def transcription(paths_: DataFrame) -> DataFrame:
            found = extract.transcribe(content(paths_), readers.get("transcription"), limits.max_file_size_mb, limits.max_media_minutes)
            return kept(found, spoken)

        def embeddings(paths_: DataFrame) -> DataFrame:
            with self._writing:
                self.embed_missing()
            return paths_.withColumn("text", F.lit(""))

        def auto_summary(paths_: DataFrame) -> DataFrame:
            own = mine(paths_)
            rows = enrich.summarise(own, self._embedder if self.is_semantic_model_ready() else None)
            rows = rows.join(own.select("id", "file_path"), "id").select("file_path", F.coalesce("summary", F.lit("")).alias("description"))
            return made(rows, "description", self.update_description)

        def auto_tags(paths_: DataFrame) -> DataFrame:
            own = mine(paths_)
            rows = enrich.tag(own, self._embedder if self.is_semantic_model_ready() else None)
            rows = rows.join(own.select("id", "file_path"), "id").select("file_path", X.join_tags(F.col("tags")).alias("tags"))
            return made(rows, "tags", self.update_tags)

        own = (text_extraction, ocr, transcription, embeddings, auto_summary, auto_tags)
        return {job.__name__: job for job in own}

    def start_reconciling(self, folder: str, interval: str = "60 seconds") -> StreamingQuery:
        """Compare index and folder again and again, without waiting for arrivals."""

        def both() -> None:
            self.remove_missing(folder)
            self.add_new(folder)

        ticks = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        checkpoint = f"{self.store.root}/_reconcile/{zlib.crc32(folder.encode())}"
        return streams.reconcile_periodically(ticks, both, checkpoint, interval)

    def stop_watching(self) -> None:
        if self._watch is None:
            raise WatcherNotRunning("no folder is being watched")
        self._watch.stop()
        self._watch = None

    def change_watch_path(self, folder: str, interval: str | None = "1 second") -> StreamingQuery:
        """Stop, empty the index and start over with another folder."""
        if self._watch is not None:
            self.stop_watching()
        self.clear_file_index()
        return self.start_watching(folder, interval)

