import json

import pytest
from pyspark.sql import functions as F

from foliant.functions import jsonfmt, paths, prompts
from foliant.functions import text as X
from foliant.operators.chunking import chunk_files


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


STEMS = {
    "папка": "папк", "папки": "папк", "папку": "папк", "папкой": "папк", "папками": "папк", "документы": "документ",
    "документов": "документ", "документами": "документ", "файлы": "файл", "файле": "файл", "да": "да", "нет": "нет",
    "кот": "кот", "доме": "дом", "мяч": "мяч", "оно": "оно", "hello": "hello", "document": "document", "files": "files",
    "Папка": "папк", "ФАЙЛЫ": "файл",
}


def test_stems(spark):
    df = spark.createDataFrame([(w,) for w in STEMS], "w string")
    got = {r.w: r.s for r in df.select("w", X.stem_ru(F.col("w")).alias("s")).collect()}
    assert got == STEMS
    assert {w: X.stem_ru_literal(w) for w in STEMS} == STEMS


def test_stem_keeping_case(spark):
    words = {"Папками": "Папк", "папка": "папк", "ая": "ая", "тоями": "тоями", "Files": "Files"}
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r.w: r.s for r in df.select("w", X.stem_ru_keep_case(F.col("w")).alias("s")).collect()}
    assert got == words
    assert {w: X.stem_ru_keep_case_literal(w) for w in words} == words


@pytest.mark.parametrize(
    ("text", "size", "overlap", "expected"),
    [
        ("ABCDEFGHIJ", 5, 2, [("ABCDE", 0), ("DEFGH", 3), ("GHIJ", 6), ("J", 9)]),
        ("short", 100, 10, [("short", 0)]),
        ("", 100, 10, []),
        ("abc", 0, 5, [("a", 0), ("b", 1), ("c", 2)]),
        ("abcd", 3, 9, [("abc", 0), ("bcd", 1), ("cd", 2), ("d", 3)]),
        ("Привет мир", 4, 1, [("Прив", 0), ("вет ", 6), (" мир", 12), ("р", 17)]),
        ("a😀b😀c", 2, 1, [("a😀", 0), ("😀b", 1), ("b😀", 5), ("😀c", 6), ("c", 10)]),
    ],
)
def test_chunks(spark, text, size, overlap, expected):
    df = spark.createDataFrame([(1, text)], "id long, text_content string")
    rows = chunk_files(df, size=size, overlap=overlap).orderBy("chunk_index").collect()
    assert [(r.chunk_text, r.chunk_offset) for r in rows] == expected
    assert [r.chunk_index for r in rows] == list(range(len(rows)))


def brute_chunks(text, size, overlap):
    step = max(size, 1) - min(overlap, max(size, 1) - 1)
    return [
        (i, text[s : s + max(size, 1)], len(text[:s].encode())) for i, s in enumerate(range(0, len(text), step))
    ]


def test_chunks_of_long_texts_cross_blocks(spark):
    text = "".join(chr(97 + i % 26) + ("é" if i % 7 == 0 else "") + ("\n" if i % 50 == 0 else "") for i in range(70_000))
    df = spark.createDataFrame([(1, text)], "id long, text_content string")
    for size, overlap in ((500, 50), (37, 36), (100, 0)):
        rows = chunk_files(df, size=size, overlap=overlap).orderBy("chunk_index").collect()
        assert [(r.chunk_index, r.chunk_text, r.chunk_offset) for r in rows] == brute_chunks(text, size, overlap)


def test_clamped_chunks(spark):
    df = spark.createDataFrame([(1, "abcde")], "id long, text_content string")
    rows = chunk_files(df, clamped=True).orderBy("chunk_index").collect()
    assert [r.chunk_text for r in rows] == ["abcde", "bcde", "cde", "de", "e"]


def test_words(spark):
    words = one(spark, X.tag_words(F.lit("Hello world! This is a test-document with Numbers123. 2024 и это")))
    assert words == ["hello", "world", "this", "test-document", "with", "numbers123", "это"]


def test_sentences(spark):
    assert one(spark, X.split_sentences(F.lit("First sentence here. Ok. Second one follows! tail"))) == [
        "First sentence here.",
        "Ok. Second one follows!",
    ]
    assert one(spark, X.split_sentences(F.lit("Pi is about 3.14159 or so"))) == ["Pi is about 3.", "14159 or so"]
    assert one(spark, X.split_sentences(F.lit(""))) == []


def test_paragraphs(spark):
    assert one(spark, X.split_paragraphs(F.lit(" a \n\n\n\n b\nc \n\n"))) == ["a", "b\nc"]


def test_truncation(spark):
    assert one(spark, X.truncate(F.lit("longer text"), 6)) == "longer…"
    assert one(spark, X.truncate(F.lit("short"), 6)) == "short"


def test_language(spark):
    assert one(spark, X.detect_language(F.lit("Привет, как дела? ok"))) == "ru"
    assert one(spark, X.detect_language(F.lit("hello мир"))) == "en"
    assert one(spark, X.detect_language(F.lit("12345"))) == "en"
    # The whole text counts.
    assert one(spark, X.detect_language(F.lit("a" * 1000 + "я" * 5000))) == "ru"
    assert X.detect_language_literal("Что это?") == "ru"


def test_plural(spark):
    df = spark.createDataFrame([(n,) for n in (1, 2, 4, 5, 11, 14, 21, 22, 111)], "n long")
    got = [r[0] for r in df.orderBy("n").select(X.pluralize_fragment(F.col("n"))).collect()]
    assert got == ["фрагмент", "фрагмента", "фрагмента", "фрагментов", "фрагментов", "фрагментов", "фрагмент", "фрагмента", "фрагментов"]


def test_keywords(spark):
    question = "Where is the pdf_doc_1, pdf and the Report? report"
    assert one(spark, X.query_keywords(F.lit(question))) == ["pdf_doc_1", "pdf", "report"]
    assert X.query_keywords_literal(question) == ["pdf_doc_1", "pdf", "report"]
    words = ["doc_doc", "doc", "pdf_x"]
    expected = ["doc_doc", "doc", "pdf_x", "pdf"]
    assert X.keyword_terms_literal(words) == expected
    assert one(spark, X.keyword_terms(F.array(*map(F.lit, words)))) == expected


def test_meaningful(spark):
    cases = {"abcd": True, "abc": False, " ab ": False, "1234": False, "12ж4": True, "": False}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r.t: r.m for r in df.select("t", X.is_meaningful(F.col("t")).alias("m")).collect()} == cases


def test_embedding_text(spark):
    df = spark.createDataFrame([("d", "", "text ", "tr"), ("", "", "", ""), (None, None, "x", None)], "a string, b string, c string, d string")
    got = [r[0] for r in df.select(X.embedding_text(*[F.col(c) for c in "abcd"])).collect()]
    assert got == ["d\ntext \ntr", None, "x"]


def test_paths(spark):
    cases = {"/path/to/file.txt": "file.txt", "file.txt": "file.txt", "/": "/", "/a/b/": "b"}
    df = spark.createDataFrame([(p,) for p in cases], "p string")
    assert {r.p: r.n for r in df.select("p", paths.base_name(F.col("p")).alias("n")).collect()} == cases
    kinds = {"/x/A.PDF": "pdf", "/x/.env": "", "/x.d/noext": "", "/a.tar.GZ": "gz"}
    df = spark.createDataFrame([(p,) for p in kinds], "p string")
    assert {r.p: r.e for r in df.select("p", paths.extension(F.col("p")).alias("e")).collect()} == kinds


def test_json_round_trip(spark):
    texts = ['plain', 'quote " back \\ slash', "line\nbreak\ttab\r", "bell\x07 and \x1f", "ёж 😀"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", jsonfmt.json_string(F.col("t")).alias("j")).collect():
        assert json.loads(r.j) == r.t
    back = jsonfmt.parse_string_array(jsonfmt.json_array(F.array(jsonfmt.json_string(F.col("t")), F.lit('"x"'))))
    for r in df.filter(~F.col("t").rlike("[\\x00-\\x08\\x1f]")).select("t", back.alias("b")).collect():
        assert r.b == [r.t, "x"]


@pytest.mark.parametrize(
    ("text", "expected"),
    [("[]", []), (" [ ] ", []), ('["a", "b"]', ["a", "b"]), ("nope", None), ('["a"', None), ("[1]", None), ('["a\\u0041"]', ["a\\u0041"])],
)
def test_string_arrays(spark, text, expected):
    assert one(spark, jsonfmt.parse_string_array(F.lit(text))) == expected


def test_numbers(spark):
    df = spark.createDataFrame([(1.0,), (0.5,), (1e-05,), (0.123456,), (0.0,), (-2.25,)], "x double")
    assert [r[0] for r in df.select(jsonfmt.json_number(F.col("x"))).collect()] == ["1", "0.5", "0.00001", "0.123456", "0", "-2.25"]


def test_prompts(spark):
    assert one(spark, prompts.language_name(F.lit("pt-BR"))) == "Portuguese"
    assert one(spark, prompts.language_name(F.lit("xx"))) == "English"
    answer = one(spark, prompts.stub_answer(F.lit("one\n\n---\n\n  \n\n---\n\nthree\n\n---\n\nfour"), F.lit(4)))
    assert answer == "Showing the 3 most relevant snippet(s) found (out of 4):\n\n1. one\n\n3. three\n"
