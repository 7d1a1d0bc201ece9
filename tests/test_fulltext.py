"""Keyword search against the FTS5 engine of Python's own sqlite3 module."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from foliant.operators import fulltext as X

WEIGHT_ORDER = list(X.WEIGHTS)


def fts_db(rows):
    con = sqlite3.connect(":memory:")
    columns = ", ".join(WEIGHT_ORDER)
    con.execute(f"CREATE VIRTUAL TABLE t USING fts5({columns})")
    for r in rows:
        con.execute(f"INSERT INTO t(rowid, {columns}) VALUES (?,?,?,?,?,?)", r)
    return con


def match_text(phrases, joiner=" "):
    return joiner.join('"' + " ".join(p.tokens) + '"' + ("*" if p.prefix else "") for p in phrases)


def sqlite_rank(con, match, weights):
    args = ", ".join(str(weights[c]) for c in WEIGHT_ORDER)
    return con.execute(f"SELECT rowid, bm25(t, {args}) AS r FROM t WHERE t MATCH ? ORDER BY r, rowid", (match,)).fetchall()


WORDS = "eau leau Café cafe naïve foo bar foobar pdf_doc doc-x über ёж еж straße ø1 2024 pdf éte".split()


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(7)
    rows = []
    for i in range(1, 61):
        texts = [" ".join(rng.choices(WORDS, k=k)) for k in (2, 5, rng.randint(0, 90), rng.randint(0, 6), 2)]
        texts[2] = texts[2].replace("foo ", "foo. ").replace("bar ", "bar\n")
        rows.append((i, *texts))
    files = spark.createDataFrame(
        [(r[0], f"/d/{r[0]}", *r[1:], 0, 0) for r in rows],
        "id long, file_path string, " + ", ".join(f"{c} string" for c in WEIGHT_ORDER) + ", needs_review int, indexed_at long",
    ).cache()
    return files, fts_db(rows)


QUERIES = ["eau", "caf", "foo-bar", "pdf_doc", "ube", "foo bar", "ёж", "eau foo doc-x", "naive ø", "2024 pdf", "é", "ete"]


@pytest.mark.parametrize("query", QUERIES)
def test_prefix_search_equals_fts5(corpus, query):
    files, con = corpus
    phrases = X.parse_query(query)
    expected = sqlite_rank(con, match_text(phrases), X.WEIGHTS)
    got = [(r.id, r.rank) for r in X.rank_files(files, phrases).orderBy("rank", "id").select("id", "rank").collect()]
    assert {i for i, _ in got} == {i for i, _ in expected}
    ranks = dict(expected)
    for i, rank in got:
        assert rank == pytest.approx(ranks[i], rel=1e-9)


def test_snippets(spark):
    text = "First words here. Second one has Éau in it!\nThird line: foo, bar follow. Eau again."
    df = spark.createDataFrame([(text,), ("  Nothing to see. Really",), ("",), (None,)], "t string")

    def cut(query):
        return [r[0] for r in df.select(X.snippet(F.col("t"), X.parse_query(query))).collect()]

    assert cut("eau") == ["Second one has Éau in it!", "Nothing to see.", "", ""]
    assert cut("foo-bar")[0] == "Third line: foo, bar follow."
    assert cut("zzz")[0] == cut("")[0] == "First words here."


def test_queries_parse():
    assert X.parse_query("  ?! - ") == []
    assert X.parse_query('foo-bar "x"') == [X.Phrase(("foo", "bar"), True), X.Phrase(("x",), True)]
    assert X.parse_query("папками", stem_ru=True) == [X.Phrase(("папк",), True)]


FILES = [
    ("/path/to/report.pdf", "report.pdf", "Квартальный отчёт за Q3 2025", None),
    ("/path/to/notes.txt", "notes.txt", "Заметки по проекту", "Текст заметки с ключевыми словами для поиска"),
    ("/media/podcast.mp3", "podcast.mp3", "Weekly tech podcast", None, "quantum computing breakthroughs"),
    ("/mixed/video_notes.mp4", "video_notes.mp4", "Video with notes", "Written notes", "Spoken words"),
    ("/path/to/document.pdf", "document.pdf", "Important document about programming", None, "", "work, urgent"),
]


@pytest.mark.parametrize(
    ("query", "names"),
    [
        ("отчёт", {"report.pdf"}),
        ("report", {"report.pdf"}),
        ("ключевыми", {"notes.txt"}),
        ("doc", {"document.pdf"}),
        ("quantum", {"podcast.mp3"}),
        ("Written", {"video_notes.mp4"}),
        ("Spoken", {"video_notes.mp4"}),
        ("urgent", {"document.pdf"}),
        ("", set()),
        ("   ", set()),
    ],
)
def test_fixture_searches(make_files, query, names):
    found = X.keyword_search(make_files(FILES), query)
    assert {r.file_name for r in found.collect()} == names
