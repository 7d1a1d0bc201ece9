import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.functions.embed import hash_embedder
from foliant.operators import enrich as E

RUST = (
    "Rust is a systems programming language. It focuses on safety and speed. Memory safety comes without a garbage "
    "collector. The borrow checker enforces ownership rules. Many companies use Rust in production."
)


def run(make_files, step, text, **options):
    return step(make_files([("/f", "f", "", text)]), **options).first()


@pytest.mark.parametrize(("text", "code"), [("", "empty_content"), ("  \n ", "empty_content"), ("Short text.", "content_too_short")])
def test_guards(make_files, text, code):
    assert run(make_files, E.summarise, text).error_code == code
    assert run(make_files, E.tag, text).error_code == code


def test_leading_summary(make_files):
    row = run(make_files, E.summarise, RUST)
    assert row.error_code is None
    assert row.summary == "Rust is a systems programming language. It focuses on safety and speed. Memory safety comes without a garbage collector."


def test_central_summary_equals_all_pairs(spark):
    rng = np.random.default_rng(5)
    rows, expected = [], {}
    for fid in range(6):
        vectors = rng.normal(size=(fid * 3 + 1, 16)).astype(np.float32)
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        sims = unit @ unit.T
        n = len(vectors)
        scores = [(sims[i].sum() - sims[i, i]) / (n - 1) if n > 1 else 0 for i in range(n)]
        best = sorted(sorted(range(n), key=lambda i: (-round(float(scores[i]), 6), i))[:3])
        expected[fid] = " ".join(f"s{i}" for i in best)
        rows += [(fid, i, f"s{i}", v.tolist()) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "id long, sentence_index int, sentence string, embedding array<float>")
    assert {r.id: r.summary for r in E.central_summary(df).collect()} == expected


def test_generated_texts_win(make_files):
    files = make_files([("/a", "a", "", RUST), ("/b", "b", "", "Short text."), ("/c", "c", "", RUST + " More words follow.")])

    def model(prompts):
        assert all("Document:" in p for p in prompts)
        return [" A summary, tags, x, here " if "More words" in p else "" for p in prompts]

    rows = {r.id: r for r in E.summarise(files, generator=model).collect()}
    assert rows[3].summary == "A summary, tags, x, here" and rows[1].summary.startswith("Rust is")
    assert rows[2].error_code == "content_too_short"
    tags = {r.id: r.tags for r in E.tag(files, generator=model).collect()}
    assert tags[3] == ["A summary", "tags", "here"]
    assert "rust" in tags[1] and tags[2] == []


def test_tags(make_files):
    text = "Neural networks learn. Neural networks generalise well.\n\nTraining data shapes neural models. The data matters."
    row = run(make_files, E.tag, text)
    # Two words lead with equal scores; the alphabet decides.
    assert row.tags[:2] == ["data", "networks"] and len(row.tags) == 7 and "the" not in row.tags


def test_embedded_steps_run(make_files):
    assert run(make_files, E.summarise, RUST, embedder=hash_embedder).error_code is None
    assert len(run(make_files, E.tag, RUST, embedder=hash_embedder).tags) == 7


def test_close_tags_are_dropped(spark):
    rows = [(1, i + 1, f"w{i}", v) for i, v in enumerate([[1.0, 0.0], [0.99, 0.05], [0.0, 1.0], [0.05, 0.99], [-1.0, 0.0]])]
    df = spark.createDataFrame(rows, "id long, position int, word string, embedding array<float>")
    words, vectors = df.drop("embedding"), df.select("word", "embedding")
    attach = lambda block: block.join(vectors, "word")
    assert E.distinct_tags(words, attach).first().tags == ["w0", "w2", "w4"]
    assert E.distinct_tags(words, attach, max_tags=2).first().tags == ["w0", "w2"]


def test_distinct_tags_walk_the_whole_list(spark):
    """Fifty near duplicates come first; six better ones follow, for one file after three rounds."""
    same = [(1, k + 1, f"same{k:02d}", [1.0, 0.001 * k] + [0.0] * 8) for k in range(50)]
    other = [(1, 51 + k, f"other{k}", [0.0, 0.0] + [float(k == j) for j in range(8)]) for k in range(6)]
    few = [(2, 1, "only", [1.0] + [0.0] * 9)]
    exact = [(3, k + 1, f"x{k:02d}", [1.0] * 10) for k in range(E.FIRST_BLOCK)]
    df = spark.createDataFrame(same + other + few + exact, "id long, position int, word string, embedding array<float>")
    vectors = df.select("id", "position", "embedding")
    got = E.distinct_tags(df.drop("embedding"), lambda block: block.join(vectors, ["id", "position"])).collect()
    assert {r.id: r.tags for r in got} == {1: ["same00", *(f"other{k}" for k in range(6))], 2: ["only"], 3: ["x00"]}


def test_long_texts_are_read_to_the_end(make_files):
    filler = "\n\n".join(f"Some plain paragraph number{k % 50} says nothing of note." for k in range(20_000))
    text = filler + "\n\n" + "zebra " * 40_000
    assert len(text) > 1_000_000
    row = run(make_files, E.tag, text)
    assert row.tags[0] == "zebra"


def test_tfidf(spark):
    df = spark.createDataFrame([(1, "alpha beta alpha 42 xy\n\nbeta gamma gamma-ray the the the the and some more filler words")], "id long, text_content string")
    rows = {r.word: r for r in E.tfidf(df).collect()}
    assert "the" not in rows and "42" not in rows and "xy" not in rows
    assert (rows["alpha"].tf, rows["alpha"].df, rows["beta"].tf, rows["beta"].df) == (2, 1, 2, 2)
    total = 15
    assert rows["alpha"].score == pytest.approx(2 / total * (np.log(2 / 1) + 1))
    assert rows["beta"].score == pytest.approx(2 / total * 1)


@pytest.mark.parametrize("batch", [1, 3, 1000])
def test_centrality_of_files_across_batches(spark, batch):
    """Files that begin, end or last over several batches; one shuffle of vectors in all."""
    rng = np.random.default_rng(5)
    rows = [(f, i, f"sentence {f} {i}", rng.normal(size=4).tolist()) for f, n in enumerate([1, 2, 7, 1, 4, 12, 3]) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, sentence_index int, sentence string, embedding array<float>")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = {(r.id, r.sentence_index): r.centrality for r in E.sentence_centrality(df).collect()}
        chosen = {r.id: r.summary for r in E.central_summary(df).collect()}
        plan = E.central_summary(df)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    unit = {(f, i): np.array(v) / np.linalg.norm(v) for f, i, _, v in rows}
    expected = {}
    for key, u in unit.items():
        others = [float(u @ v) for other, v in unit.items() if other[0] == key[0] and other != key]
        expected[key] = sum(others) / len(others) if others else 0.0
    assert got.keys() == expected.keys() and all(got[k] == pytest.approx(expected[k], abs=1e-6) for k in expected)
    for f in {f for f, _ in unit}:
        best = sorted(sorted((k for k in expected if k[0] == f), key=lambda k: (-round(expected[k], 6), k))[:3])
        assert chosen[f] == " ".join(f"sentence {f} {i}" for _, i in best)
    assert plan.count("Exchange") == 1


def test_words_of_a_batch_are_counted_by_file():
    import pyarrow as pa

    blocks = pa.array([[["b", "a", "b"], ["b"]], [], None, [["the", "a"], [], ["c", "a"]]], pa.list_(pa.list_(pa.string())))
    own = E.Counted.of(blocks)
    words = own.words.to_pylist()
    got = list(zip(own.file.tolist(), [words[c] for c in own.code], own.tf.tolist(), own.df.tolist(), strict=True))
    assert got == [(0, "a", 1, 1), (0, "b", 3, 2), (3, "a", 2, 2), (3, "c", 1, 1), (3, "the", 1, 1)]
    assert own.totals.tolist() == [4, 0, 0, 4] and own.paragraphs.tolist() == [2, 0, 0, 3]
    assert own.ranked(None).to_pylist() == [["b", "a"], [], [], ["a", "c"]]
    assert own.ranked(1).to_pylist() == [["b"], [], [], ["a"]]


def test_tags_rank_a_batch_once(make_files):
    plan = E.tags(make_files([("/a", "a", "", RUST)]))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and plan.count("ArrowEvalPython") == 1


def test_tags_of_unequal_widths_are_not_close(spark):
    rows = [(1, 1, "a", [1.0, 0.0]), (1, 2, "b", [1.0, 0.0, 0.0]), (1, 3, "c", [0.0, 0.0]), (1, 4, "d", [0.9, 0.1]), (1, 5, "e", [0.9, 0.1, 0.0])]
    df = spark.createDataFrame(rows, "id long, position int, word string, embedding array<float>")
    vectors = df.select("word", "embedding")
    assert E.distinct_tags(df.drop("embedding"), lambda block: block.join(vectors, "word")).first().tags == ["a", "b", "c"]


def test_batches_for_python_are_bounded(spark):
    """A worker's memory follows bytes, not 10,000 rows of any length."""
    from foliant.functions import text as X
    from foliant.session import BATCH_BYTES, bound_batches

    bound_batches(spark)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == BATCH_BYTES

    import pyarrow as pa

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    texts = spark.range(0, 2_000, 1, 1).select("id", F.repeat(F.lit("word "), 4_000).alias("text_content"))
    assert texts.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] < 2 * BATCH_BYTES
    assert texts.select(F.size(X.split_sentences(F.col("text_content"))).alias("n")).agg(F.sum("n")).first()[0] == 2_000
