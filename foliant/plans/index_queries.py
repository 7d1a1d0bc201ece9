"""Index maintenance and lookups over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import index as I
from foliant.plans import sqlparts as P
from foliant.plans.registry import query
from foliant.schema import migrate_files
from foliant.sources import tables as S

NOW = 1_800_000_000

SHOWN = """file_path, file_name, description, md5(text_content) AS text_md5, md5(transcript_text) AS transcript_md5, tags,
  CAST(needs_review AS INTEGER) AS needs_review, CAST(indexed_at AS BIGINT) AS indexed_at"""


def _shown(files: DataFrame) -> DataFrame:
    """A snapshot without its ids, texts as digests."""
    return files.select(
        "file_path",
        "file_name",
        "description",
        F.md5("text_content").alias("text_md5"),
        F.md5("transcript_text").alias("transcript_md5"),
        "tags",
        F.col("needs_review").cast("int"),
        "indexed_at",
    )


def _now():
    return F.lit(NOW).cast("long")


def _labelled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the chunks of labelled documents; toxic ones are only 32 wide."""
    labels = S.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("file_id"), "toxic")
    return (
        S.embedded_chunks(spark, sf_dir)
        .join(labels, "file_id")
        .select(
            "file_id",
            "chunk_index",
            F.slice("embedding", 1, F.when(F.col("toxic") == 1, 32).otherwise(64)).alias("embedding"),
        )
    )


LABELLED = f"""{P.FILES}, {P.chunks()}, vectors AS (
  SELECT c.file_id, c.chunk_index, CASE WHEN toxic = 1 THEN 32 ELSE 64 END AS width
  FROM chunks c JOIN labels l ON l.doc_id = c.file_id)"""


@query(
    "index_counts",
    f"""WITH {P.FILES}, {P.EMBEDDED}
    SELECT (SELECT count(*) FROM files) AS n_files, (SELECT count(*) FROM chunks) AS n_chunks,
           (SELECT count(*) FROM embedded) AS n_embeddings,
           (SELECT CAST(sum(len(embedding)) * 4 AS BIGINT) FROM embedded) AS vector_bytes""",
)
def index_counts(spark, sf_dir):
    chunks = S.chunks(spark, sf_dir)
    return I.statistics(S.files(spark, sf_dir), chunks, S.embedded_chunks(spark, sf_dir))


@query(
    "inbox_files",
    f"""WITH {P.FILES_REVIEW} SELECT file_path, file_name, description, tags, indexed_at FROM files
    WHERE needs_review = 1 ORDER BY indexed_at DESC, file_path""",
)
def inbox_files(spark, sf_dir):
    return I.inbox(S.files(spark, sf_dir, review=True)).orderBy(F.desc("indexed_at"), "file_path")


@query("inbox_count", f"WITH {P.FILES_REVIEW} SELECT count(*) AS n FROM files WHERE needs_review = 1")
def inbox_count(spark, sf_dir):
    return I.inbox(S.files(spark, sf_dir, review=True)).agg(F.count(F.lit(1)).alias("n"))


@query(
    "is_indexed",
    f"""WITH {P.FILES}, {P.LISTING} SELECT l.file_path, f.file_path IS NOT NULL AS indexed
    FROM listing l LEFT JOIN files f ON f.file_path = l.file_path""",
)
def is_indexed(spark, sf_dir):
    known = S.files(spark, sf_dir).select("file_path", F.lit(True).alias("indexed"))
    listing = S.disk_listing(spark, sf_dir).select("file_path")
    return listing.join(known, "file_path", "left").fillna({"indexed": False})


@query(
    "indexed_file",
    f"""WITH {P.FILES} SELECT id, file_path, file_name, description, indexed_at FROM files
    WHERE file_path = (SELECT min(file_path) FROM files)""",
)
def indexed_file(spark, sf_dir):
    files = S.files(spark, sf_dir)
    return I.lookup(files, files.agg(F.min("file_path")).scalar())


def _upsert_sql(kept: str) -> str:
    return f"""WITH {P.FILES}, {P.INCOMING}
    SELECT file_path, file_name, description, md5(text_content) AS text_md5, md5(transcript_text) AS transcript_md5,
           tags, CAST(needs_review AS INTEGER) AS needs_review, CAST(indexed_at AS BIGINT) AS indexed_at FROM (
      SELECT f.file_path, coalesce(i.file_name, f.file_name) AS file_name,
             coalesce(i.description, f.description) AS description,
             CASE WHEN i.file_path IS NULL THEN f.text_content ELSE {kept} END AS text_content, transcript_text, tags,
             needs_review, CASE WHEN i.file_path IS NULL THEN indexed_at ELSE {NOW} END AS indexed_at
      FROM files f LEFT JOIN incoming i ON i.file_path = f.file_path
      UNION ALL
      SELECT file_path, file_name, description, coalesce(text_content, ''), '', '', 0, {NOW} FROM incoming i
      WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.file_path = i.file_path))"""


@query("upsert_files", _upsert_sql("coalesce(i.text_content, '')"))
def upsert_files(spark, sf_dir):
    files, batch = S.files(spark, sf_dir), S.incoming_files(spark, sf_dir)
    return _shown(I.upsert(files, batch, _now(), preserve_text=False))


@query("upsert_preserve_text", _upsert_sql("coalesce(i.text_content, f.text_content, '')"))
def upsert_preserve_text(spark, sf_dir):
    return _shown(I.upsert(S.files(spark, sf_dir), S.incoming_files(spark, sf_dir), _now()))


@query(
    "upsert_repeated_paths",
    f"""WITH {P.FILES}, {P.FILE_EVENTS}, batch AS (
      SELECT path AS file_path, max_by(event_type, event_id) AS kind, max(event_id) AS last FROM file_events GROUP BY path)
    SELECT {SHOWN} FROM files UNION ALL
    SELECT file_path, kind, 'event ' || last, md5('text ' || last), md5(''), '', 0, {NOW} FROM batch""",
)
def upsert_repeated_paths(spark, sf_dir):
    """A batch that names each path many times: the row of the last event counts."""
    e = F.col("event_id").cast("string")
    batch = S.file_events(spark, sf_dir).select(
        F.col("path").alias("file_path"), F.col("event_type").alias("file_name"), F.concat(F.lit("event "), e).alias("description"),
        F.concat(F.lit("text "), e).alias("text_content"), "event_id",
    )
    return _shown(I.upsert(S.files(spark, sf_dir), batch, _now(), order="event_id"))


INSERTED = f"""SELECT file_path, file_name, '' AS description, md5(coalesce(text_content, '')) AS text_md5,
  md5('') AS transcript_md5, '' AS tags, CAST(1 AS INTEGER) AS needs_review, CAST({NOW} AS BIGINT) AS indexed_at"""


@query(
    "insert_for_review",
    f"""WITH {P.FILES}, {P.INCOMING} SELECT {SHOWN} FROM files UNION ALL {INSERTED} FROM incoming i
    WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.file_path = i.file_path)""",
)
def insert_for_review(spark, sf_dir):
    return _shown(I.insert_for_review(S.files(spark, sf_dir), S.incoming_files(spark, sf_dir), _now()))


def _update_sql(batch: str, files: str = P.FILES_REVIEW, **values: str) -> str:
    """Twin of an update: ``batch`` yields file_path and the new values."""
    sets = ", ".join(f"CASE WHEN b.file_path IS NULL THEN f.{c} ELSE {v} END AS {c}" for c, v in values.items())
    return f"""WITH {files}, batch AS ({batch}), next AS (
      SELECT f.* EXCLUDE ({", ".join(values)}), {sets} FROM files f LEFT JOIN batch b ON b.file_path = f.file_path)
    SELECT {SHOWN} FROM next"""


# Every turn as a batch row of its own file, with a word added.
TURNS = f"SELECT {P.TURN_PATH} AS file_path, text || ' edited' AS value FROM conversations"
LABELS = """SELECT '/docs/' || source || '/' || d.doc_id || '.txt' AS file_path,
  'quality ' || quality AS value, 'toxic ' || toxic AS tag FROM labels l JOIN documents d ON d.doc_id = l.doc_id"""


def _turns(spark, sf_dir, column: str) -> DataFrame:
    return S.table(spark, sf_dir, "conversations").select(S.turn_path().alias("file_path"), F.concat("text", F.lit(" edited")).alias(column))


def _label_batch(spark, sf_dir) -> DataFrame:
    docs = S.table(spark, sf_dir, "documents").select("doc_id", S.document_path().alias("file_path"))
    return (
        S.table(spark, sf_dir, "labels")
        .join(docs, "doc_id")
        .select(
            "file_path",
            F.format_string("quality %d", "quality").alias("description"),
            F.format_string("toxic %d", "toxic").alias("tags"),
        )
    )


@query("update_text", _update_sql(TURNS, P.FILES_TRANSCRIPT, text_content="b.value", indexed_at=str(NOW)))
def update_text(spark, sf_dir):
    files = S.files(spark, sf_dir, transcripts=True)
    return _shown(I.update_text(files, _turns(spark, sf_dir, "text_content"), _now()))


@query("update_transcript", _update_sql(TURNS, P.FILES_TRANSCRIPT, transcript_text="b.value", indexed_at=str(NOW)))
def update_transcript(spark, sf_dir):
    files = S.files(spark, sf_dir, transcripts=True)
    return _shown(I.update_transcript(files, _turns(spark, sf_dir, "transcript_text"), _now()))


@query("update_description", _update_sql(LABELS, description="b.value", indexed_at=str(NOW)))
def update_description(spark, sf_dir):
    return _shown(I.update_description(S.files(spark, sf_dir, review=True), _label_batch(spark, sf_dir), _now()))


@query("update_tags", _update_sql(LABELS, tags="b.tag", indexed_at=str(NOW)))
def update_tags(spark, sf_dir):
    return _shown(I.update_tags(S.files(spark, sf_dir, review=True), _label_batch(spark, sf_dir), _now()))


@query("save_review", _update_sql(LABELS, description="b.value", tags="b.tag", needs_review="0"))
def save_review(spark, sf_dir):
    return _shown(I.save_review(S.files(spark, sf_dir, review=True), _label_batch(spark, sf_dir)))


MARKED = f"SELECT {P.DOC_PATH} AS file_path FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)"


@query("mark_enriched", _update_sql(MARKED, needs_review="0"))
def mark_enriched(spark, sf_dir):
    return _shown(I.mark_enriched(S.files(spark, sf_dir, review=True), _toxic_paths(spark, sf_dir)))


@query(
    "schema_migration",
    f"""WITH {P.FILES} SELECT {SHOWN} FROM (
      SELECT id, file_path, file_name, description, text_content, '' AS transcript_text, '' AS tags, 0 AS needs_review,
             indexed_at FROM files)""",
)
def schema_migration(spark, sf_dir):
    old = S.files(spark, sf_dir).drop("transcript_text", "tags", "needs_review")
    return _shown(migrate_files(old))


def _toxic_paths(spark, sf_dir) -> DataFrame:
    docs = S.table(spark, sf_dir, "documents").select("doc_id", S.document_path().alias("file_path"))
    toxic = S.table(spark, sf_dir, "labels").filter(F.col("toxic") == 1).select("doc_id")
    return docs.join(toxic, "doc_id", "left_semi")


@query(
    "remove_file_cascade",
    f"""WITH {P.FILES}, {P.chunks()} SELECT file_id, count(*) AS n_chunks, CAST(sum(chunk_offset) AS BIGINT) AS offsets
    FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = c.file_id AND l.toxic = 1)
    GROUP BY file_id""",
)
def remove_file_cascade(spark, sf_dir):
    left = I.remove(S.files(spark, sf_dir).select("id", "file_path"), _toxic_paths(spark, sf_dir))
    return (
        I.cascade(S.chunks(spark, sf_dir), left)
        .groupBy("file_id")
        .agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("chunk_offset").alias("offsets"))
    )


CHUNKS_SHOWN = "SELECT file_id, chunk_index, md5(chunk_text) AS chunk_md5, chunk_offset"
NEW_CHUNKS = P.chunks("fresh_files", 60, 20, "edited_text").replace("chunks AS", "fresh AS", 1)
FRESH_FILES = "fresh_files AS (SELECT f.*, transcript_text || ' edited' AS edited_text FROM files f WHERE id < 0)"


def _chunks_shown(chunks: DataFrame) -> DataFrame:
    return chunks.select("file_id", "chunk_index", F.md5("chunk_text").alias("chunk_md5"), "chunk_offset")


@query(
    "replace_chunks",
    f"""WITH {P.FILES_TRANSCRIPT}, {P.chunks(text="transcript_text")}, {FRESH_FILES}, {NEW_CHUNKS}
    {CHUNKS_SHOWN} FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM fresh_files f WHERE f.id = c.file_id)
    UNION ALL {CHUNKS_SHOWN} FROM fresh""",
)
def replace_chunks(spark, sf_dir):
    """The chunks of all recordings replaced by finer ones of their new wording."""
    from foliant.operators.chunking import chunk_files

    calls = S.recordings(spark, sf_dir).withColumn("transcript_text", F.concat("transcript_text", F.lit(" edited")))
    fresh = chunk_files(calls, "transcript_text", 60, 20)
    stored = chunk_files(S.files(spark, sf_dir, transcripts=True), "transcript_text")
    return _chunks_shown(I.replace_for_keys(stored, fresh, calls.select(F.col("id").alias("file_id"))))


@query(
    "remove_embeddings",
    f"""WITH {P.FILES}, {P.chunks()} {CHUNKS_SHOWN} FROM chunks c
    WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = c.file_id AND l.quality = 0)""",
)
def remove_embeddings(spark, sf_dir):
    poor = S.table(spark, sf_dir, "labels").filter(F.col("quality") == 0).select(F.col("doc_id").alias("file_id"))
    return _chunks_shown(I.remove_for_files(S.chunks(spark, sf_dir), poor))


@query(
    "purge_wrong_dim",
    f"""WITH {LABELLED} {CHUNKS_SHOWN} FROM chunks c
    WHERE EXISTS (SELECT 1 FROM vectors v WHERE v.file_id = c.file_id AND v.chunk_index = c.chunk_index AND width = 64)""",
)
def purge_wrong_dim(spark, sf_dir):
    good = I.drop_wrong_width(_labelled_vectors(spark, sf_dir), 64)
    return _chunks_shown(I.drop_orphan_chunks(S.chunks(spark, sf_dir), good))


@query(
    "orphan_chunks",
    f"""WITH {LABELLED} {CHUNKS_SHOWN} FROM chunks c
    WHERE NOT EXISTS (SELECT 1 FROM vectors v WHERE v.file_id = c.file_id AND v.chunk_index = c.chunk_index)""",
)
def orphan_chunks(spark, sf_dir):
    return _chunks_shown(I.orphan_chunks(S.chunks(spark, sf_dir), _labelled_vectors(spark, sf_dir)))


@query(
    "has_embeddings",
    f"""WITH {LABELLED} SELECT f.file_path, EXISTS (SELECT 1 FROM vectors v WHERE v.file_id = f.id) AS has_embeddings
    FROM files f""",
)
def has_embeddings(spark, sf_dir):
    files = S.files(spark, sf_dir).select("id", "file_path")
    owners = _labelled_vectors(spark, sf_dir).select(F.col("file_id").alias("id")).distinct()
    marked = files.join(owners.withColumn("has_embeddings", F.lit(True)), "id", "left")
    return marked.select("file_path", F.coalesce("has_embeddings", F.lit(False)).alias("has_embeddings"))


@query(
    "files_without_embeddings",
    f"""WITH {LABELLED} SELECT file_path, file_name FROM files
    WHERE id NOT IN (SELECT file_id FROM vectors)""",
)
def files_without_embeddings(spark, sf_dir):
    return I.without_embeddings(S.files(spark, sf_dir), _labelled_vectors(spark, sf_dir))


@query(
    "files_wrong_or_missing_embeddings",
    f"""WITH {LABELLED} SELECT file_path, file_name FROM files
    WHERE id NOT IN (SELECT file_id FROM vectors WHERE width = 64)""",
)
def files_wrong_or_missing_embeddings(spark, sf_dir):
    return I.without_embeddings(S.files(spark, sf_dir), _labelled_vectors(spark, sf_dir), width=64)


@query(
    "fs_sync_removed",
    f"""WITH {P.FILES}, {P.LISTING} SELECT id, file_path FROM files f
    WHERE NOT EXISTS (SELECT 1 FROM listing l WHERE l.file_path = f.file_path)""",
)
def fs_sync_removed(spark, sf_dir):
    return I.missing_on_disk(S.files(spark, sf_dir), S.disk_listing(spark, sf_dir)).select("id", "file_path")


@query(
    "fs_sync_new",
    f"""WITH {P.FILES}, {P.LISTING} SELECT file_path, file_name FROM listing l
    WHERE file_name <> 'desktop.ini' AND NOT EXISTS (SELECT 1 FROM files f WHERE f.file_path = l.file_path)""",
)
def fs_sync_new(spark, sf_dir):
    return I.new_on_disk(S.files(spark, sf_dir), S.disk_listing(spark, sf_dir)).select("file_path", "file_name")


@query(
    "fs_reconcile",
    f"""WITH {P.FILES}, {P.LISTING} SELECT {SHOWN} FROM files f
    WHERE EXISTS (SELECT 1 FROM listing l WHERE l.file_path = f.file_path)
    UNION ALL {INSERTED.replace("coalesce(text_content, '')", "''")} FROM listing l
    WHERE file_name <> 'desktop.ini' AND NOT EXISTS (SELECT 1 FROM files f WHERE f.file_path = l.file_path)""",
)
def fs_reconcile(spark, sf_dir):
    return _shown(I.reconcile(S.files(spark, sf_dir), S.disk_listing(spark, sf_dir), _now()))
