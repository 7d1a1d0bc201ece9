"""Index maintenance: each operation maps a snapshot to the next one.

Batches join on ``file_path`` with the snapshot on the left of a left join, so
a small batch is broadcast by size and the stored texts stay in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = "file_path"


def last_per_path(batch: DataFrame, order: str | None) -> DataFrame:
    """One row per path: the last by ``order``, or by place in the batch when no column is named."""
    if order is None:
        order = "_place"
        batch = batch.withColumn(order, F.monotonically_increasing_id())
    others = [c for c in batch.columns if c not in (KEY, "_place")]
    return batch.groupBy(KEY).agg(F.max_by(F.struct(*others), order).alias("r")).select(KEY, "r.*")


def _new_ids(files: DataFrame, above: int = 0) -> Column:
    """Ids above the highest one in use and above ``above``; unique, not dense."""
    top = files.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).scalar()
    return F.greatest(top, F.lit(above)) + 1 + F.monotonically_increasing_id()


def upsert(
    files: DataFrame, batch: DataFrame, now: Column, preserve_text: bool = True, order: str | None = None, above: int = 0
) -> DataFrame:
    """Insert or replace by path.

    The batch has (file_path, file_name, description, text_content).  A batch
    row without text keeps the stored one, or clears it when ``preserve_text``
    is off.  Of several rows for a path the last by ``order`` counts.
    """
    batch = last_per_path(batch, order)
    fresh = batch.select(
        KEY,
        F.struct("file_name", "description", "text_content").alias("new"),
    )
    given = F.col("new").isNotNull()
    kept = F.coalesce("new.text_content", "text_content", F.lit("")) if preserve_text else F.coalesce(
        "new.text_content", F.lit("")
    )
    updated = (
        files.join(fresh, KEY, "left")
        .withColumns(
            {
                "file_name": F.coalesce("new.file_name", "file_name"),
                "description": F.coalesce("new.description", "description"),
                "text_content": F.when(given, kept).otherwise(F.col("text_content")),
                "indexed_at": F.when(given, now).otherwise(F.col("indexed_at")),
            }
        )
        .select(*files.columns)
    )
    return updated.unionByName(_inserted(files, batch, now, needs_review=0, above=above))


def _inserted(files: DataFrame, batch: DataFrame, now: Column, needs_review: int, above: int = 0) -> DataFrame:
    absent = batch.join(files.select(KEY), KEY, "left_anti")
    defaults = {
        "id": _new_ids(files, above),
        "description": F.coalesce("description", F.lit("")) if "description" in batch.columns else F.lit(""),
        "text_content": F.coalesce("text_content", F.lit("")),
        "transcript_text": F.lit(""),
        "tags": F.lit(""),
        "needs_review": F.lit(needs_review),
        "indexed_at": now,
    }
    return absent.select(*[defaults[c].alias(c) if c in defaults else F.col(c) for c in files.columns])


def insert_for_review(
    files: DataFrame, batch: DataFrame, now: Column, order: str | None = None, above: int = 0
) -> DataFrame:
    """Add unknown paths flagged for review; known ones stay untouched."""
    wanted = [KEY, "file_name", "text_content", *([order] if order else [])]
    unique = last_per_path(batch.select(*wanted), order)
    return files.unionByName(_inserted(files, unique, now, needs_review=1, above=above))


def update(
    files: DataFrame, batch: DataFrame, columns: dict[str, str], now: Column | None = None, order: str | None = None
) -> DataFrame:
    """Set columns of known paths from a batch; unknown paths are ignored.

    ``columns`` maps target to batch column.  ``now`` stamps the touched rows.
    Of several rows for a path the last by ``order`` counts.
    """
    batch = last_per_path(batch, order)
    new = F.struct(*[F.col(source).alias(target) for target, source in columns.items()])
    given = F.col("_new").isNotNull()
    values = {t: F.when(given, F.col(f"_new.{t}")).otherwise(F.col(t)) for t in columns}
    if now is not None:
        values["indexed_at"] = F.when(given, now).otherwise(F.col("indexed_at"))
    return files.join(batch.select(KEY, new.alias("_new")), KEY, "left").withColumns(values).select(*files.columns)


def update_text(files: DataFrame, batch: DataFrame, now: Column, order: str | None = None) -> DataFrame:
    return update(files, batch, {"text_content": "text_content"}, now, order)


def update_transcript(files: DataFrame, batch: DataFrame, now: Column, order: str | None = None) -> DataFrame:
    return update(files, batch, {"transcript_text": "transcript_text"}, now, order)


def update_description(files: DataFrame, batch: DataFrame, now: Column, order: str | None = None) -> DataFrame:
    return update(files, batch, {"description": "description"}, now, order)


def update_tags(files: DataFrame, batch: DataFrame, now: Column, order: str | None = None) -> DataFrame:
    return update(files, batch, {"tags": "tags"}, now, order)


def save_review(files: DataFrame, batch: DataFrame, order: str | None = None) -> DataFrame:
    """Store the reviewed description and tags; the time stamp stays."""
    reviewed = batch.withColumn("_done", F.lit(0))
    return update(files, reviewed, {"description": "description", "tags": "tags", "needs_review": "_done"}, order=order)


def mark_enriched(files: DataFrame, paths: DataFrame) -> DataFrame:
    """Clear the review flag of the given paths; the time stamp stays."""
    done = paths.select(KEY).distinct().withColumn("_done", F.lit(0))
    return update(files, done, {"needs_review": "_done"})


def remove(files: DataFrame, paths: DataFrame) -> DataFrame:
    return files.join(paths.select(KEY), KEY, "left_anti")


def cascade(children: DataFrame, files: DataFrame, key: str = "file_id") -> DataFrame:
    """Keep chunks, vectors or postings whose file is still there."""
    return children.join(files.select(F.col("id").alias(key)), key, "left_semi")


def clear(df: DataFrame) -> DataFrame:
    return df.limit(0)


def replace_for_files(stored: DataFrame, fresh: DataFrame, key: str = "file_id") -> DataFrame:
    """Swap the rows of the files that ``fresh`` covers (chunks, vectors or postings)."""
    return replace_for_keys(stored, fresh, fresh.select(key).distinct(), key)


def replace_for_keys(stored: DataFrame, fresh: DataFrame, touched: DataFrame, key: str = "file_id") -> DataFrame:
    """As above with the touched files given, some of which may have no new rows."""
    return stored.join(touched.select(key), key, "left_anti").unionByName(fresh)


def remove_for_files(stored: DataFrame, file_ids: DataFrame, key: str = "file_id") -> DataFrame:
    return stored.join(file_ids.select(key), key, "left_anti")


def drop_wrong_width(embeddings: DataFrame, width: int) -> DataFrame:
    return embeddings.filter(F.size("embedding") == width)


def drop_orphan_chunks(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    keys = ["file_id", "chunk_index"]
    return chunks.join(embeddings.select(*keys), keys, "left_semi")


def orphan_chunks(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    keys = ["file_id", "chunk_index"]
    return chunks.join(embeddings.select(*keys), keys, "left_anti")


def missing_on_disk(files: DataFrame, listing: DataFrame) -> DataFrame:
    """Indexed files that are gone."""
    return files.join(listing.select(KEY), KEY, "left_anti")


def new_on_disk(files: DataFrame, listing: DataFrame) -> DataFrame:
    """Listed files the index does not know, system files left out."""
    from foliant.functions.paths import is_hidden_or_system

    known = files.select(KEY)
    return listing.filter(~is_hidden_or_system(F.col("file_name"), skip_hidden=False)).join(known, KEY, "left_anti")


def reconcile(files: DataFrame, listing: DataFrame, now: Column) -> DataFrame:
    """Drop vanished files and add new ones for review."""
    batch = new_on_disk(files, listing)
    if "text_content" not in batch.columns:
        batch = batch.withColumn("text_content", F.lit(None).cast("string"))
    return insert_for_review(remove(files, missing_on_disk(files, listing)), batch, now)


# --------------------------------------------------------------------------
# lookups


def lookup(files: DataFrame, file_path: str) -> DataFrame:
    return files.filter(F.col(KEY) == file_path).select("id", KEY, "file_name", "description", "indexed_at")


def inbox(files: DataFrame) -> DataFrame:
    """Files waiting for review."""
    return files.filter(F.col("needs_review") == 1).select(KEY, "file_name", "description", "tags", "indexed_at")


def with_embeddings(files: DataFrame, embeddings: DataFrame) -> DataFrame:
    owners = embeddings.select(F.col("file_id").alias("id"))
    return files.join(owners, "id", "left_semi")


def without_embeddings(files: DataFrame, embeddings: DataFrame, width: int | None = None) -> DataFrame:
    """Files to embed: no vector at all, or none of the wanted width."""
    if width is not None:
        embeddings = drop_wrong_width(embeddings, width)
    owners = embeddings.select(F.col("file_id").alias("id"))
    return files.join(owners, "id", "left_anti").select(KEY, "file_name")


def statistics(files: DataFrame, chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """One row: number of files, chunks, vectors and vector bytes."""
    a = files.agg(F.count(F.lit(1)).alias("n_files"))
    b = chunks.agg(F.count(F.lit(1)).alias("n_chunks"))
    c = embeddings.agg(
        F.count(F.lit(1)).alias("n_embeddings"),
        F.coalesce(F.sum(F.size("embedding").cast("long") * 4), F.lit(0)).alias("vector_bytes"),
    ).select(F.struct("*"))
    return a.withColumn("n_chunks", b.scalar()).withColumn("_c", c.scalar()).select("n_files", "n_chunks", "_c.*")
