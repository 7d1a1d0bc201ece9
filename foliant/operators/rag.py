"""Retrieval for questions: context, sources, fallbacks, answer record.

Every step past the top-k cut works on at most ``top_k`` rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions import jsonfmt
from foliant.functions import text as X
from foliant.functions.prompts import CONTEXT_SEPARATOR, stub_answer
from foliant.operators import fulltext, names

MIN_SIMILARITY = 0.05
SOURCE_CHARS = 200

# Columns of a context row, in rank order.  ``chunk_snippet`` is for display.
CONTEXT = ("rank", "file_path", "part", "chunk_snippet", "chunk_offset")


def snippet_context(hits: DataFrame, threshold: float = MIN_SIMILARITY) -> DataFrame:
    """Context rows out of the chunks of similarity hits above a threshold."""
    return _ranked(hits.filter(F.col("score") >= threshold)).select(
        "rank", "file_path", F.col("chunk_text").alias("part"), "chunk_snippet", "chunk_offset"
    )


def full_context(hits: DataFrame) -> DataFrame:
    """Context rows that name the file of each chunk; hits carry their chunk's text."""
    return _ranked(hits).select(
        "rank", "file_path", _file_part(F.col("chunk_text")).alias("part"), "chunk_snippet", "chunk_offset"
    )


def _ranked(hits: DataFrame) -> DataFrame:
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "file_id", "chunk_index")  # top_k rows
    return hits.withColumn("rank", F.row_number().over(order).cast("long"))


def _file_part(body: Column) -> Column:
    return F.concat(F.lit("File: "), F.col("file_path"), F.lit("\n"), body)


def keyword_hits(files: DataFrame, question: str, top_k: int) -> DataFrame:
    """Files matching any keyword of the question exactly, unweighted rank."""
    phrases = fulltext.parse_keywords(question)
    ranked = fulltext.rank_files(files, phrases, fulltext.UNWEIGHTED, require_all=False)
    return ranked.orderBy("rank", "id").limit(top_k).select(
        "id", "file_path", X.first_text(F.col("text_content"), F.col("description")).alias("content"), "rank"
    )


def name_hits(files: DataFrame, question: str, top_k: int) -> DataFrame:
    """Files whose name contains the first keyword that any name contains.

    ``_`` and ``%`` in a keyword stay wildcards; case is folded for ASCII only.
    Ordering by the first matching keyword puts the winning keyword on top, so
    the cut needs no second pass.
    """
    keywords = [k for k in X.query_keywords_literal(question) if len(k) >= 3]
    name = X.fold_ascii_case(F.col("file_name"))
    matched = F.coalesce(
        *[F.when(name.like(f"%{k}%"), F.lit(i)) for i, k in enumerate(keywords)], F.lit(None).cast("int")
    )
    top = (
        files.withColumn("keyword", matched)
        .filter(F.col("keyword").isNotNull())
        .orderBy("keyword", "id")
        .limit(top_k)
        .select("id", "file_path", X.first_text(F.col("text_content"), F.col("description")).alias("content"), "keyword")
    )
    return _first_group(top, "keyword")


def _first_group(df: DataFrame, column: str) -> DataFrame:
    """Rows with the lowest value of a column; the input is a few top-k cuts."""
    lowest = F.min(column).over(Window.partitionBy(F.lit(0)))
    return df.withColumn("_lowest", lowest).filter(F.col(column) == F.col("_lowest")).drop("_lowest")


def fallback_context(files: DataFrame, question: str, top_k: int) -> DataFrame:
    """Keyword search, or file names when that finds nothing: two scans of ``files``."""

    def by_text() -> DataFrame:
        return _fallback_parts(keyword_hits(files, question, top_k).withColumnRenamed("rank", "order"))

    def by_name() -> DataFrame:
        return _fallback_parts(name_hits(files, question, top_k).withColumn("order", F.lit(0.0)))

    return first_available(by_text, by_name)


def indexed_fallback(
    files: DataFrame,
    question: str,
    top_k: int,
    by_keyword: Callable[[list[fulltext.Phrase], int], DataFrame],
    file_names: DataFrame,
    grams: DataFrame,
) -> DataFrame:
    """``fallback_context`` from stored indexes; texts are read of the ``top_k`` files found.

    ``by_keyword`` gives (id, rank) of the best files that hold any of some
    exact phrases, unweighted.  Names are searched through their trigrams,
    keyword by keyword until one is found.
    """

    def contents(order: dict[int, float]) -> DataFrame:
        ranks = F.create_map(*[F.lit(v) for pair in order.items() for v in pair])
        found = files.filter(F.col("id").isin(list(order)))  # ids reach the scan
        shown = found.select("id", "file_path", X.first_text(F.col("text_content"), F.col("description")).alias("content"))
        return _fallback_parts(shown.withColumn("order", ranks[F.col("id")].cast("double")))

    def by_text() -> dict[int, float]:
        phrases = fulltext.parse_keywords(question)
        return {r["id"]: r["rank"] for r in by_keyword(phrases, top_k).collect()} if phrases else {}

    def by_name() -> dict[int, float]:
        for keyword in (k for k in X.query_keywords_literal(question) if len(k) >= 3):
            ids = names.names_like(file_names, grams, keyword).orderBy("id").limit(top_k).collect()
            if ids:
                return {r["id"]: 0.0 for r in ids}
        return {}

    order = by_text() or by_name()
    if not order:
        return _fallback_parts(files.limit(0).select("id", "file_path", F.lit("").alias("content"), F.lit(0.0).alias("order")))
    return contents(order)


def _fallback_parts(hits: DataFrame) -> DataFrame:
    """Context rows with the whole contents of the files found, ``top_k`` at most."""
    order = Window.partitionBy(F.lit(0)).orderBy("order", "id")  # top_k rows
    return hits.withColumn("rank", F.row_number().over(order).cast("long")).select(
        "rank",
        "file_path",
        _file_part(F.col("content")).alias("part"),
        X.truncate(F.col("content"), SOURCE_CHARS).alias("chunk_snippet"),
        F.lit(0).cast("long").alias("chunk_offset"),
    )


def first_available(*contexts: Callable[[], DataFrame]) -> DataFrame:
    """The first context that has rows.

    Contexts are planned one after the other, and one is only run if those
    before it came out empty.  A context is ``top_k`` rows, which are kept.
    """
    found = None
    for build in contexts:
        found = build().select(*CONTEXT).persist()
        if not found.isEmpty():
            break
    return found


def answer(context: DataFrame, max_fragments: int = 3, max_chars: int = 300) -> DataFrame:
    """One row (answer, context, sources, error_code) out of context rows.

    The answer without a model shows the first ``max_fragments`` parts, each up
    to ``max_chars`` characters; the context holds all of them.

    Without context the answer is empty and the code ``no_relevant_chunks``.
    Sources keep the first entry per path.
    """
    collected = context.groupBy().agg(
        F.array_sort(F.collect_list(F.struct(*CONTEXT))).alias("rows"),
    )
    rows = F.col("rows")
    text = F.array_join(F.transform(rows, lambda r: r["part"]), CONTEXT_SEPARATOR)
    paths = F.transform(rows, lambda r: r["file_path"])
    sources = F.transform(
        F.filter(rows, lambda r, i: F.array_position(paths, r["file_path"]) == i + 1),
        lambda r: F.struct(r["file_path"].alias("file_path"), r["chunk_snippet"].alias("chunk_snippet"),
                           r["chunk_offset"].alias("chunk_offset")),
    )
    found = F.size(rows) > 0
    return collected.select(
        F.when(found, stub_answer(text, F.size(rows), max_fragments, max_chars)).otherwise("").alias("answer"),
        F.when(found, text).otherwise("").alias("context"),
        sources.alias("sources"),
        F.when(~found, "no_relevant_chunks").alias("error_code"),
    )


def failed_answer(spark, error_code: str) -> DataFrame:
    """Answer record of a request that found no way to run."""
    return spark.createDataFrame(
        [("", "", [], error_code)],
        "answer string, context string, sources array<struct<file_path:string,chunk_snippet:string,chunk_offset:bigint>>,"
        " error_code string",
    )


def result_json(answered: DataFrame) -> DataFrame:
    return answered.select(
        jsonfmt.rag_result_json(F.col("answer"), F.col("sources"), F.col("error_code")).alias("result_json")
    )


def stream_events(answered: DataFrame) -> DataFrame:
    """(seq, type, payload): the whole answer as one token event, then the record."""
    record = jsonfmt.rag_result_json(F.col("answer"), F.col("sources"), F.col("error_code"))
    events = F.array(
        F.when(F.col("answer") != "", F.struct(F.lit(0).alias("seq"), F.lit("token").alias("type"), F.col("answer").alias("payload"))),
        F.struct(F.lit(1).alias("seq"), F.lit("done").alias("type"), record.alias("payload")),
    )
    return answered.select(F.inline(F.array_compact(events)))
