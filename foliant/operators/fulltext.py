"""Keyword search: tokens, phrases, BM25 ranking, snippets.

Two ways to the same ranking:

* ``rank_files`` scans a ``files`` relation.  Phrase hits and document lengths
  are regex counts on each row, so no row is shuffled: one pass yields the
  corpus totals (a single row), a second one ranks and keeps the top rows.
* ``rank_postings`` reads a stored inverted index, whose files are sorted by
  token, and touches only the rows of the query's tokens.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.functions.vectors import relevance

# BM25 parameters and column weights.
K1 = 1.2
B = 0.75
IDF_FLOOR = 1e-6
WEIGHTS = {"file_name": 5.0, "description": 10.0, "text_content": 1.0, "transcript_text": 1.0, "tags": 8.0}
UNWEIGHTED = dict.fromkeys(WEIGHTS, 1.0)

DEFAULT_LIMIT = 50


@dataclass(frozen=True)
class Phrase:
    """Adjacent tokens; with ``prefix`` the last one may continue."""

    tokens: tuple[str, ...]
    prefix: bool

    def pattern(self) -> str:
        """Regex matching the first token where the phrase occurs.

        The rest of the phrase sits in a look-ahead, so occurrences may overlap.
        """
        inside = f"[{T.TOKEN_CLASS}]"
        gap = f"[^{T.TOKEN_CLASS}]+"
        end = "" if self.prefix else f"(?!{inside})"
        first, *rest = self.tokens
        if not rest:
            return f"(?<!{inside}){first}{end}"
        return f"(?<!{inside}){first}(?={gap}{gap.join(rest)}{end})"


def index_tokens_literal(text: str) -> tuple[str, ...]:
    return tuple(re.findall(r"[^\W_]+", T.fold_for_index_literal(text)))


def _phrases(words: Sequence[str], prefix: bool) -> list[Phrase]:
    tokenized = (index_tokens_literal(w) for w in words)
    return [Phrase(t, prefix) for t in tokenized if t]


def parse_query(query: str, stem_ru: bool = False) -> list[Phrase]:
    """Prefix phrases of a search box query, all of which must match."""
    words = ("".join(c for c in w if c.isalnum() or c in "_-") for w in query.split())
    words = [T.stem_ru_keep_case_literal(w) if stem_ru else w for w in words if w]
    return _phrases(words, prefix=True)


def parse_keywords(question: str) -> list[Phrase]:
    """Exact phrases of a question's keywords, any of which may match."""
    return _phrases(T.keyword_terms_literal(T.query_keywords_literal(question)), prefix=False)


# --------------------------------------------------------------------------
# scan form


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(T.TOKEN_PATTERN))


def bm25(factors: Sequence[Column], frequency: Sequence[Column], length: Column, mean_length: Column) -> Column:
    norm = K1 * (1 - B + B * length / mean_length)
    return -reduce(add, (i * f * (K1 + 1) / (f + norm) for i, f in zip(factors, frequency, strict=True)))


def idf(rows: Column, hits: Column) -> Column:
    raw = F.ln((rows - hits + 0.5) / (hits + 0.5))
    return F.when(raw > 0, raw).otherwise(F.lit(IDF_FLOOR))


def corpus_totals(files: DataFrame, phrases: Sequence[Phrase], columns: Sequence[str]) -> DataFrame:
    """One row: number of files, number of tokens, and files hit per phrase."""
    folded = files.select(*[T.fold_for_index(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in columns])
    hit = [reduce(or_, (F.col(c).rlike(p.pattern()) for c in columns)) for p in phrases]
    return folded.agg(
        F.count(F.lit(1)).alias("n_files"),
        F.coalesce(F.sum(reduce(add, (token_count(F.col(c)) for c in columns))), F.lit(0)).alias("n_tokens"),
        *[F.count_if(h).alias(f"hits_{i}") for i, h in enumerate(hit)],
    )


def rank_files(
    files: DataFrame, phrases: Sequence[Phrase], weights: dict[str, float] = WEIGHTS, require_all: bool = True
) -> DataFrame:
    """Matching files with their ``rank`` (negative, lower is better).

    ``require_all`` demands every phrase, otherwise one is enough.
    """
    if not phrases:
        return files.limit(0).withColumn("rank", F.lit(0.0))
    columns = [c for c in weights if c in files.columns]
    totals = corpus_totals(files, phrases, columns).select(F.struct("*")).scalar()
    # ``inline`` keeps the optimizer from pushing filters below the folding and
    # the counting, which would then be evaluated twice per row.
    folded = files.select(
        "*", F.inline(F.array(F.struct(*[T.fold_for_index(F.coalesce(F.col(c), F.lit(""))).alias(f"_f_{c}") for c in columns])))
    )
    # Cheap row filter ahead of the counting: plain substring tests.
    candidate = [reduce(or_, (F.contains(F.col(f"_f_{c}"), F.lit(p.tokens[0])) for c in columns)) for p in phrases]
    folded = folded.filter(reduce(and_ if require_all else or_, candidate))
    hits = {
        f"_n_{i}": reduce(
            add, (F.regexp_count(F.col(f"_f_{c}"), F.lit(p.pattern())) * float(weights[c]) for c in columns)
        )
        for i, p in enumerate(phrases)
    }
    counted = folded.select(*files.columns, *[f"_f_{c}" for c in columns], F.inline(F.array(F.struct(*[v.alias(k) for k, v in hits.items()]))))
    present = [F.col(f"_n_{i}") > 0 for i in range(len(phrases))]
    matched = (
        counted.filter(reduce(and_ if require_all else or_, present))
        .withColumn("_length", reduce(add, (token_count(F.col(f"_f_{c}")) for c in columns)))
        .withColumn("_totals", totals)
    )
    total = F.col("_totals")
    rank = bm25(
        [idf(total["n_files"], total[f"hits_{i}"]) for i in range(len(phrases))],
        [F.col(f"_n_{i}") for i in range(len(phrases))],
        F.col("_length"),
        total["n_tokens"] / total["n_files"],
    )
    return matched.withColumn("rank", rank).select(*files.columns, "rank")


def keyword_search(
    files: DataFrame,
    query: str,
    limit: int = DEFAULT_LIMIT,
    stem_ru: bool = False,
    weights: dict[str, float] = WEIGHTS,
) -> DataFrame:
    """Best files for a search box query, with snippets; ties go to the lower id."""
    phrases = parse_query(query, stem_ru)
    top = rank_files(files, phrases, weights).orderBy("rank", "id").limit(limit)
    return _page(top, phrases)


def result_page(files: DataFrame, best: DataFrame, phrases: Sequence[Phrase]) -> DataFrame:
    """What a result page shows of the files in ``best`` (id, rank), a page's worth of rows; no text is shuffled."""
    return _page(files.join(F.broadcast(best), "id"), phrases)


def _page(found: DataFrame, phrases: Sequence[Phrase]) -> DataFrame:
    return found.select(
        "id",
        "file_path",
        "file_name",
        "description",
        snippet(F.col("text_content"), phrases).alias("snippet"),
        "rank",
        relevance(F.col("rank")).alias("relevance"),
        "indexed_at",
    )


# --------------------------------------------------------------------------
# stored inverted index


def build_postings(files: DataFrame, columns: Sequence[str] = tuple(WEIGHTS)) -> DataFrame:
    """Every token occurrence as (id, col, pos, token)."""
    texts = F.array(*[F.coalesce(F.col(c), F.lit("")) for c in columns])
    return files.select("id", F.posexplode(texts).alias("col", "text")).select(
        "id",
        "col",
        F.posexplode(F.regexp_extract_all(T.fold_for_index(F.col("text")), F.lit(T.TOKEN_PATTERN), 0)).alias(
            "pos", "token"
        ),
    )


def document_lengths(files: DataFrame, columns: Sequence[str] = tuple(WEIGHTS)) -> DataFrame:
    """Tokens per file over all columns."""
    length = reduce(add, (token_count(T.fold_for_index(F.coalesce(F.col(c), F.lit("")))) for c in columns))
    return files.select("id", length.cast("long").alias("n_tokens"))


def layout_postings(postings: DataFrame, partitions: int | None = None) -> DataFrame:
    """Order for storage: files hold narrow token ranges.

    The file id is part of the range key, so a token that makes up a large
    share of all rows spreads over several partitions.
    """
    keys = ["token", "id", "col", "pos"]
    ranged = postings.repartitionByRange(partitions, *keys) if partitions else postings.repartitionByRange(*keys)
    return ranged.sortWithinPartitions(*keys)


def token_matches(phrase: Phrase, position: int) -> Column:
    token = phrase.tokens[position]
    last = position == len(phrase.tokens) - 1
    return F.startswith(F.col("token"), F.lit(token)) if last and phrase.prefix else F.col("token") == token


def phrase_occurrences(postings: DataFrame, phrase: Phrase) -> DataFrame:
    """(id, col, pos) where a phrase starts."""
    out = postings.filter(token_matches(phrase, 0)).select("id", "col", "pos")
    for i in range(1, len(phrase.tokens)):
        following = postings.filter(token_matches(phrase, i)).select("id", "col", (F.col("pos") - i).alias("pos"))
        out = out.join(following, ["id", "col", "pos"], "left_semi")
    return out


def rank_postings(
    postings: DataFrame,
    lengths: DataFrame,
    phrases: Sequence[Phrase],
    weights: dict[str, float] = WEIGHTS,
    require_all: bool = True,
    columns: Sequence[str] = tuple(WEIGHTS),
) -> DataFrame:
    """(id, rank) of matching files from a stored index."""
    if not phrases:
        return lengths.select("id", F.lit(0.0).alias("rank")).limit(0)
    weight = F.get(F.array(*[F.lit(float(weights.get(c, 0.0))) for c in columns]), F.col("col"))
    ids = range(len(phrases))
    # All single tokens share one pass over the postings.
    single = [i for i in ids if len(phrases[i].tokens) == 1]
    matches = {i: token_matches(phrases[i], 0) for i in single}
    parts = []
    if single:
        found = postings.filter(reduce(or_, matches.values()))
        parts.append((found, {i: F.when(m, weight).otherwise(0.0) for i, m in matches.items()}))
    for i in ids:
        if i not in single:
            parts.append((phrase_occurrences(postings, phrases[i]), {i: weight}))
    hits = reduce(
        DataFrame.unionByName,
        (df.select("id", *[values.get(i, F.lit(0.0)).alias(f"f_{i}") for i in ids]) for df, values in parts),
    )
    per_file = hits.groupBy("id").agg(*[F.sum(f"f_{i}").alias(f"f_{i}") for i in ids])
    totals = lengths.agg(F.count(F.lit(1)).alias("n_files"), F.sum("n_tokens").alias("n_tokens"))
    found = per_file.agg(*[F.count_if(F.col(f"f_{i}") > 0).alias(f"hits_{i}") for i in ids])
    totals, found = totals.select(F.struct("*")).scalar(), found.select(F.struct("*")).scalar()
    present = [F.col(f"f_{i}") > 0 for i in ids]
    rank = bm25(
        [idf(totals["n_files"], found[f"hits_{i}"]) for i in ids],
        [F.col(f"f_{i}") for i in ids],
        F.col("n_tokens"),
        totals["n_tokens"] / totals["n_files"],
    )
    return (
        per_file.filter(reduce(and_ if require_all else or_, present))
        .join(lengths, "id")
        .select("id", rank.alias("rank"))
    )


# --------------------------------------------------------------------------
# snippets

SENTENCE = "[^.!?\n]+[.!?]*"


def snippet(text: Column, phrases: Sequence[Phrase]) -> Column:
    """The first sentence of the text with a hit of any phrase, else its first sentence.

    Sentences end at ``.``, ``!``, ``?`` or a line break and come trimmed.
    """
    parts = F.regexp_extract_all(text, F.lit(SENTENCE), 0)
    if not phrases:
        return F.coalesce(T.trim_ws(F.get(parts, F.lit(0))), F.lit(""))
    hit = F.filter(parts, lambda s: reduce(or_, (T.fold_for_index(s).rlike(p.pattern()) for p in phrases)))
    return F.coalesce(T.trim_ws(F.coalesce(F.get(hit, F.lit(0)), F.get(parts, F.lit(0)))), F.lit(""))
