"""The supplied parquet tables seen as the index relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators.chunking import chunk_files


def table(spark: SparkSession, sf_dir: str, name: str, spread: int | None = None) -> DataFrame:
    """A supplied table; ``spread`` deals its rows over that many partitions.

    A file with a single row group is read by one task, which then does all
    the work.  Such small files can be spread by the caller's choice, here or
    for all tables with the setting ``foliant.spread``; otherwise rows stay
    where they are read.
    """
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    spread = spread or int(spark.conf.get("foliant.spread", "0"))
    return df.repartition(spread) if spread else df


def document_path() -> Column:
    return F.concat(F.lit("/docs/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))


def document_name() -> Column:
    return F.concat_ws("_", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))


def files(spark: SparkSession, sf_dir: str, review: bool = False, transcripts: bool = False) -> DataFrame:
    """``files`` relation over ``documents``.

    The join with ``labels`` and the files of ``conversations`` are left out
    unless asked for: a plan that needs neither scans ``documents`` alone.
    """
    out = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        document_path().alias("file_path"),
        document_name().alias("file_name"),
        F.col("source").alias("description"),
        F.col("text").alias("text_content"),
        F.lit("").alias("transcript_text"),
        F.concat_ws(", ", "lang", "source").alias("tags"),
        F.lit(0).alias("needs_review"),
        (F.lit(1_700_000_000) + F.col("doc_id")).cast("long").alias("indexed_at"),
    )
    if review:
        flagged = (
            table(spark, sf_dir, "labels")
            .filter(F.col("quality") == 0)
            .select(F.col("doc_id").alias("id"), F.lit(1).alias("flag"))
        )
        out = (
            out.drop("needs_review")
            .join(flagged, "id", "left")
            .withColumn("needs_review", F.coalesce("flag", F.lit(0)))
            .drop("flag")
        )
    if transcripts:
        out = out.unionByName(recordings(spark, sf_dir))
    return out.select(
        "id", "file_path", "file_name", "description", "text_content", "transcript_text", "tags", "needs_review",
        "indexed_at",
    )


def turn_path() -> Column:
    return F.concat(F.lit("/calls/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"), F.lit(".mp3"))


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of a conversation as a recording of its own, with its words as transcript."""
    return table(spark, sf_dir, "conversations").select(
        (-1 - (F.col("conv_id") * 1_000_000 + F.col("turn"))).alias("id"),
        turn_path().alias("file_path"),
        F.concat(F.col("turn").cast("string"), F.lit(".mp3")).alias("file_name"),
        F.col("role").alias("description"),
        F.lit("").alias("text_content"),
        F.col("text").alias("transcript_text"),
        F.lit("").alias("tags"),
        F.lit(0).alias("needs_review"),
        (F.lit(1_700_000_000) + F.col("conv_id")).cast("long").alias("indexed_at"),
    )


def chunks(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return chunk_files(files(spark, sf_dir), keep=keep)


def vector_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def with_vectors(spark: SparkSession, sf_dir: str, df: DataFrame, key: Column) -> DataFrame:
    """Attach a stored vector by ``key`` modulo the number of vectors."""
    vectors = vector_table(spark, sf_dir)
    count = vectors.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        df.withColumn("vec_id", F.pmod(key, count))
        .join(vectors.select("vec_id", "embedding"), "vec_id")
        .drop("vec_id")
    )


def embedded_chunks(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``chunks`` with vectors: chunk vector id = file_id * 31 + chunk_index."""
    return with_vectors(
        spark, sf_dir, chunks(spark, sf_dir, keep), F.col("file_id") * 31 + F.col("chunk_index")
    )


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """Mean of the vectors labelled 0, rounded to six decimals.

    Runs one aggregate; a single vector reaches the driver.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    mean = (
        vector_table(spark, sf_dir)
        .filter(F.col("label") == 0)
        .agg(vector_to_array(Summarizer.mean(array_to_vector(F.col("embedding").cast("array<double>")))).alias("v"))
        .first()["v"]
    )
    return [round(x, 6) for x in mean]


def incoming_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of index requests: a new description for every labelled document, and all pages.

    Only pages bring text along.
    """
    relabelled = (
        table(spark, sf_dir, "labels")
        .join(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id")
        .select(
            document_path().alias("file_path"),
            document_name().alias("file_name"),
            F.format_string("quality %d toxic %d", "quality", "toxic").alias("description"),
            F.lit(None).cast("string").alias("text_content"),
        )
    )
    return relabelled.unionByName(pages_as_files(spark, sf_dir))


def pages_as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        F.format_string("/pages/%d.html", "page_id").alias("file_path"),
        F.format_string("%d.html", "page_id").alias("file_name"),
        F.col("url").alias("description"),
        F.col("html").alias("text_content"),
    )


def disk_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies on disk: every document except the toxic ones, and all pages."""
    toxic = table(spark, sf_dir, "labels").filter(F.col("toxic") == 1).select("doc_id")
    kept = (
        table(spark, sf_dir, "documents")
        .select("doc_id", "source", "lang")
        .join(toxic, "doc_id", "left_anti")
        .select(document_path().alias("file_path"), document_name().alias("file_name"))
    )
    return kept.unionByName(pages_as_files(spark, sf_dir).select("file_path", "file_name"))


def file_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as file events of one folder per user.

    ``error`` removes the path, everything else adds it.
    """
    return table(spark, sf_dir, "events").select(
        F.col("event_id"),
        F.concat(F.lit("/watch/"), F.col("user_id").cast("string"), F.lit("_"), F.col("event_type")).alias("path"),
        F.when(F.col("event_type") == "error", "remove").otherwise("add").alias("op"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
        "user_id",
        "event_type",
        "value",
        "ts",
    )
