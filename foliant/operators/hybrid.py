"""Vector and hybrid retrieval over the chunk table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from foliant.functions import text as X
from foliant.functions import vectors as V

SNIPPET_CHARS = 200
DEFAULT_TOP_K = 20

# Thresholds on hybrid scores.
RELATIVE_KEEP = 0.82
MIN_SCORE = 0.15

# Scores are rounded before they are compared, so that equal hits tie exactly.
SCORE_DIGITS = 9

HIT_SCHEMA = T.StructType(
    [
        T.StructField("file_id", T.LongType()),
        T.StructField("chunk_index", T.IntegerType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("chunk_snippet", T.StringType()),
        T.StructField("chunk_text", T.StringType()),
        T.StructField("chunk_offset", T.LongType()),
        T.StructField("score", T.DoubleType()),
    ]
)


def embedded(files: DataFrame, chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Chunks with their vector and file, one row per embedded chunk.

    Chunks and vectors share (file_id, chunk_index); stored bucketed by
    file_id, the three relations meet without a shuffle.
    """
    return (
        chunks.join(embeddings, ["file_id", "chunk_index"])
        .join(files.select(F.col("id").alias("file_id"), "file_path", "file_name"), "file_id")
        .select("file_id", "chunk_index", "file_path", "file_name", "chunk_text", "chunk_offset", "embedding")
    )


def query_tokens(query: str) -> list[str]:
    return X.normalize_lexical_literal(query).split()


def hybrid_weights(tokens: Sequence[str]) -> tuple[float, float]:
    """(semantic, lexical) weight: the shorter the query, the more wording counts."""
    if len(tokens) <= 1:
        return 0.35, 0.65
    if all(len(t) <= 4 for t in tokens):
        return 0.55, 0.45
    return 0.8, 0.2


def lexical_score(query: str, file_name: Column, chunk_text: Column) -> Column:
    """Substring evidence for a literal query, clamped to 0..1.

    A token scores 0.8 in the file name, else 0.4 in the chunk; the whole
    query adds 0.3 or 0.15.  A token or its stem may match.  Both texts count
    as normalised, which matters to blanks only: tokens are looked up in the
    lower-cased texts directly, and the whole query as a pattern.
    """
    whole = X.normalize_lexical_literal(query)
    tokens = whole.split()
    if not tokens:
        return F.lit(0.0)
    name, body = F.lower(file_name), F.lower(chunk_text)

    def has(text: Column, needle: str) -> Column:
        return reduce(or_, (_occurs(text, n) for n in dict.fromkeys((needle, X.stem_ru_literal(needle)))))

    score = F.lit(0.0)
    for token in tokens:
        if len(token) >= 2:
            score = score + F.when(has(name, token), 0.8).when(has(body, token), 0.4).otherwise(0.0)
    if len(whole) >= 4:
        score = score + F.when(has(name, whole), 0.3).when(has(body, whole), 0.15).otherwise(0.0)
    return V.clamp(score, 0.0, 1.0)


def _occurs(lower: Column, needle: str) -> Column:
    """Whether a normalised needle occurs in the normalised form of a lower-cased text."""
    words = needle.split()
    if len(words) == 1 and words[0] == needle:
        return F.contains(lower, F.lit(needle))
    # The words first: the pattern then runs on few texts only.
    all_words = reduce(and_, (F.contains(lower, F.lit(w)) for w in words)) if words else F.lit(True)
    return all_words & lower.rlike(X.normalized_pattern(needle))


def score_chunks(embedded_chunks: DataFrame, query: str, query_vector: Sequence[float]) -> DataFrame:
    """Every chunk with its cosine, calibrated, lexical and hybrid score."""
    semantic_weight, lexical_weight = hybrid_weights(query_tokens(query))
    return (
        embedded_chunks.withColumn("lexical", lexical_score(query, F.col("file_name"), F.col("chunk_text")))
        .withColumn("cosine", V.cosine_against(F.col("embedding"), query_vector))
        .drop("embedding")
        .withColumn("semantic", V.calibrate(F.col("cosine")))
        .withColumn(
            "score",
            F.round(
                V.clamp(semantic_weight * F.col("semantic") + lexical_weight * F.col("lexical"), 0.0, 1.0), SCORE_DIGITS
            ),
        )
    )


def best_per_file(scored: DataFrame) -> DataFrame:
    """Best chunk of each file, the earlier one on a tie.

    An aggregate, so it is combined on the map side however many chunks a
    file has.  The chunk's text comes along, so later steps need no second
    pass over the chunks; the snippet is for display.
    """
    payload = F.struct("chunk_index", "file_path", "file_name", "chunk_text", "chunk_offset", "score")
    order = F.struct("score", (-F.col("chunk_index")).alias("tie"))
    return (
        scored.groupBy("file_id")
        .agg(F.max_by(payload, order).alias("hit"))
        .select("file_id", "hit.*")
        .withColumn("chunk_snippet", X.truncate(F.col("chunk_text"), SNIPPET_CHARS))
    )


def relatively_good(top: DataFrame) -> DataFrame:
    """Hits close enough to the best of them."""
    best = F.max("score").over(Window.partitionBy(F.lit(0)))  # over top_k rows only
    return (
        top.withColumn("best", best)
        .filter(F.col("score") >= F.greatest(F.round(F.col("best") * RELATIVE_KEEP, SCORE_DIGITS), F.lit(MIN_SCORE)))
        .drop("best")
    )


def similarity_search(
    embedded_chunks: DataFrame, query: str, query_vector: Sequence[float] | None, top_k: int = DEFAULT_TOP_K
) -> DataFrame:
    """Best files for a query by hybrid score.

    The relative threshold is applied after the cut to ``top_k``: the overall
    best score is among those rows, and the threshold only drops rows from the
    end, so both orders give the same result.
    """
    spark = embedded_chunks.sparkSession
    if not query.strip() or query_vector is None:
        return spark.createDataFrame([], HIT_SCHEMA)
    scored = score_chunks(embedded_chunks, query, query_vector)
    single = len(query_tokens(query)) <= 1
    if single:
        scored = scored.filter(F.col("lexical") > 0)
    top = best_per_file(scored).orderBy(F.desc("score"), "file_id", "chunk_index").limit(top_k)
    if not single:
        top = relatively_good(top)
    return top.orderBy(F.desc("score"), "file_id", "chunk_index").select(*HIT_SCHEMA.names)


def similar_files(embedded_chunks: DataFrame, file_path: str, top_k: int = 10) -> DataFrame:
    """Files whose chunks are closest to the mean vector of one file.

    Each file is judged by its best chunk, so a file with many chunks leaves
    room for others.  The mean vector is the only thing fetched.
    """
    own = embedded_chunks.filter(F.col("file_path") == file_path)
    mean = V.mean_vector(own, "embedding", "file_id").first()
    if mean is None:
        return embedded_chunks.sparkSession.createDataFrame([], HIT_SCHEMA)
    scored = (
        embedded_chunks.filter(F.col("file_id") != mean["file_id"])
        .withColumn("score", F.round(V.cosine_against(F.col("embedding"), mean["mean_vector"]), SCORE_DIGITS))
        .drop("embedding")
    )
    return (
        best_per_file(scored)
        .orderBy(F.desc("score"), "file_id", "chunk_index")
        .limit(top_k)
        .select(*HIT_SCHEMA.names)
    )
