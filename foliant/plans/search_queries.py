"""Keyword search over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import fulltext as X
from foliant.operators.blockmax import best_files
from foliant.plans import sqlparts as P
from foliant.plans.registry import query
from foliant.sources import tables as S
from foliant.sources.searchable import Searchable, searchable

RANK_DIGITS = 12


def _phrases(parsed) -> list[tuple[tuple[str, ...], bool]]:
    return [(p.tokens, p.prefix) for p in parsed]


def _rank_sql(parsed, weights, require_all: bool, limit: int | None = None, base: str = P.FILES) -> str:
    tail = f"ORDER BY round(rank, {RANK_DIGITS}), id LIMIT {limit}" if limit else ""
    return f"""WITH {P.bm25(_phrases(parsed), weights, require_all, base)}
    SELECT id, round(rank, {RANK_DIGITS}) AS rank FROM ranked {tail}"""


def _ranked(df, limit: int | None = None):
    out = df.select("id", F.round("rank", RANK_DIGITS).alias("rank"))
    return out.orderBy("rank", "id").limit(limit) if limit else out


def documents_index(spark, sf_dir) -> Searchable:
    """The stored index of ``documents``."""
    return searchable(spark, sf_dir, "documents", ("documents",), lambda: S.files(spark, sf_dir))


def _search(index: Searchable, phrases, weights=X.WEIGHTS, require_all: bool = True):
    return X.rank_postings(index.postings, index.lengths, phrases, weights, require_all)


@query("postings", f"WITH {P.FILES}, {P.POSTINGS} SELECT id, CAST(col AS INTEGER) AS col, pos, token FROM postings")
def postings(spark, sf_dir):
    return X.build_postings(S.files(spark, sf_dir))


@query(
    "doc_stats",
    f"""WITH {P.FILES}, {P.POSTINGS}
    SELECT files.id, count(token) AS n_tokens FROM files LEFT JOIN postings ON postings.id = files.id GROUP BY files.id""",
)
def doc_stats(spark, sf_dir):
    return X.document_lengths(S.files(spark, sf_dir))


FLAGSHIP, PAGE = "eau", "le eau"


def _page_sql(text: str) -> str:
    """A result page; the snippet is the first sentence with a token that starts like a word of the query."""
    hit = "|".join(w for p in X.parse_query(text) for w in p.tokens)
    parts = "regexp_extract_all(text_content, '[^.!?\\n]+[.!?]*')"
    found = f"list_filter({parts}, lambda s: regexp_matches({P.fold('s')}, '(^|[^\\p{{L}}\\p{{N}}])({hit})'))"
    return f"""WITH {P.bm25(_phrases(X.parse_query(text)), X.WEIGHTS, True)}
    SELECT f.id, file_path, file_name, description, coalesce({P.trim(f"coalesce(({found})[1], ({parts})[1])")}, '') AS snippet,
           round(rank, 12) AS rank, round(1 / (1 + abs(rank)), 12) AS relevance, indexed_at
    FROM ranked JOIN files f ON f.id = ranked.id ORDER BY round(rank, 12), f.id LIMIT 20"""


def _page(spark, sf_dir, text: str):
    """The best files by the stored index; only they are looked up and cut into snippets."""
    phrases = X.parse_query(text)
    best = best_files(documents_index(spark, sf_dir), phrases, 20, digits=RANK_DIGITS)
    top = X.result_page(S.files(spark, sf_dir), best, phrases).orderBy("rank", "id")
    return top.withColumns({c: F.round(c, RANK_DIGITS) for c in ("rank", "relevance")})


@query("keyword_search", _page_sql(FLAGSHIP))
def keyword_search(spark, sf_dir):
    return _page(spark, sf_dir, FLAGSHIP)


@query("snippet", f"SELECT id, file_path, snippet FROM ({_page_sql(PAGE)})")
def snippet(spark, sf_dir):
    """Result page of a query of two words."""
    return _page(spark, sf_dir, PAGE).select("id", "file_path", "snippet")


@query("bm25_weighted", _rank_sql(X.parse_query("reau"), X.WEIGHTS, True))
def bm25_weighted(spark, sf_dir):
    return _ranked(_search(documents_index(spark, sf_dir), X.parse_query("reau")))


@query("bm25_unweighted", _rank_sql(X.parse_query("reau"), X.UNWEIGHTED, True))
def bm25_unweighted(spark, sf_dir):
    return _ranked(_search(documents_index(spark, sf_dir), X.parse_query("reau"), X.UNWEIGHTED))


@query("fts_and_prefix", _rank_sql(X.parse_query("enp eau"), X.WEIGHTS, True))
def fts_and_prefix(spark, sf_dir):
    return _ranked(_search(documents_index(spark, sf_dir), X.parse_query("enp eau")))


@query("fts_phrase_prefix", _rank_sql(X.parse_query("de-la"), X.WEIGHTS, True))
def fts_phrase_prefix(spark, sf_dir):
    return _ranked(_search(documents_index(spark, sf_dir), X.parse_query("de-la")))


OR_QUESTION = "Which documents mention eaux, leaux and die-und please?"


@query("fts_or_exact", _rank_sql(X.parse_keywords(OR_QUESTION), X.UNWEIGHTED, False))
def fts_or_exact(spark, sf_dir):
    return _ranked(_search(documents_index(spark, sf_dir), X.parse_keywords(OR_QUESTION), X.UNWEIGHTED, False))


@query("fts_transcript", _rank_sql(X.parse_query("que"), X.WEIGHTS, True, base=P.FILES_TRANSCRIPT))
def fts_transcript(spark, sf_dir):
    """Search over documents and recordings, which carry a transcript."""
    build = lambda: S.files(spark, sf_dir, transcripts=True)
    index = searchable(spark, sf_dir, "transcripts", ("documents", "conversations"), build)
    return _ranked(_search(index, X.parse_query("que")))


@query("fts_top", _rank_sql(X.parse_query("th en"), X.WEIGHTS, True, limit=50))
def fts_top(spark, sf_dir):
    """Common words: only blocks of files that can reach the best fifty are opened."""
    return best_files(documents_index(spark, sf_dir), X.parse_query("th en"), 50, digits=RANK_DIGITS)


@query("fts_scan_search", _rank_sql(X.parse_query("enp eau"), X.WEIGHTS, True))
def fts_scan_search(spark, sf_dir):
    """The same ranking without an index: two passes over all texts."""
    return _ranked(X.rank_files(S.files(spark, sf_dir), X.parse_query("enp eau")))


@query("fts_index_search", _rank_sql(X.parse_query("enp eau"), X.WEIGHTS, True, limit=20))
def fts_index_search(spark, sf_dir):
    """Best files by the stored index."""
    return best_files(documents_index(spark, sf_dir), X.parse_query("enp eau"), 20, digits=RANK_DIGITS)


ANY_QUESTION = "Which und oder les mit documents?"


@query("fts_top_any", _rank_sql(X.parse_keywords(ANY_QUESTION), X.UNWEIGHTED, False, limit=30))
def fts_top_any(spark, sf_dir):
    """Best files that hold any of some words."""
    return best_files(documents_index(spark, sf_dir), X.parse_keywords(ANY_QUESTION), 30, X.UNWEIGHTED, False, RANK_DIGITS)


@query(
    "relevance",
    f"""WITH {P.bm25(_phrases(X.parse_query("reau")), X.WEIGHTS, True)}
    SELECT id, round(1 / (1 + abs(rank)), 12) AS relevance FROM ranked""",
)
def relevance(spark, sf_dir):
    from foliant.functions.vectors import relevance as score

    ranked = _search(documents_index(spark, sf_dir), X.parse_query("reau"))
    return ranked.select("id", F.round(score(F.col("rank")), RANK_DIGITS).alias("relevance"))


CYRILLIC_FILES = P.FILES.replace("text AS text_content", "translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', 'абцдефгхийклмнопярстувюыез') AS text_content")


@query("fts_stemmed", _rank_sql(X.parse_query("тионами", stem_ru=True), X.WEIGHTS, True, base=CYRILLIC_FILES))
def fts_stemmed(spark, sf_dir):
    """Stemmed search over texts spelled in Cyrillic letters."""
    latin, cyrillic = "abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопярстувюыез"

    def build():
        return S.files(spark, sf_dir).withColumn("text_content", F.translate(F.lower("text_content"), latin, cyrillic))

    index = searchable(spark, sf_dir, "cyrillic", ("documents",), build)
    return _ranked(_search(index, X.parse_query("тионами", stem_ru=True)))
