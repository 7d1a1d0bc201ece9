import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.functions import embed as M
from foliant.functions import vectors as V
from foliant.operators import hybrid

UNIT = 64


def vec(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_normalise(spark):
    assert one(spark, V.l2_normalize(vec(3, 4))) == pytest.approx([0.6, 0.8])
    assert one(spark, V.l2_normalize(vec(0, 0))) == [0, 0]


@pytest.mark.parametrize(
    ("a", "b", "prefix", "strict"),
    [
        ((1, 2), (1, 2), 1, 1),
        ((1, 0), (0, 1), 0, 0),
        ((1, 2), (-1, -2), -1, -1),
        ((1, 0, 0), (1, 0), 1, 0),
        ((0, 0), (1, 1), 0, 0),
    ],
)
def test_cosine(spark, a, b, prefix, strict):
    assert one(spark, V.cosine_prefix(vec(*a), vec(*b))) == pytest.approx(prefix)
    assert one(spark, V.cosine_strict(vec(*a), vec(*b))) == pytest.approx(strict)
    df = spark.createDataFrame([([float(x) for x in a],)], "v array<float>")
    assert df.select(V.cosine_against(F.col("v"), b)).first()[0] == pytest.approx(prefix)


def test_scoring_mixed_widths(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=int(w)).tolist()) for i, w in enumerate(rng.choice([3, 8, 20], size=200))] + [(200, []), (201, None)]
    q = rng.normal(size=8)
    df = spark.createDataFrame(rows, "i int, v array<float>")
    got = {r.i: r.s for r in df.select("i", V.cosine_against(F.col("v"), q.tolist()).alias("s")).collect()}
    for i, v in rows:
        v = np.asarray(v if v else [], dtype=np.float32).astype(float)
        n = min(len(v), 8)
        expected = v[:n] @ q[:n] / np.linalg.norm(v[:n]) / np.linalg.norm(q[:n]) if n else 0
        assert got[i] == pytest.approx(expected, abs=1e-9)


def test_mean_vector(spark):
    df = spark.createDataFrame([(1, [2.0, 0.0]), (1, [0.0, 2.0])], "k int, v array<float>")
    assert V.mean_vector(df, "v", "k").first()["mean_vector"] == pytest.approx([0.5**0.5] * 2)


def test_mean_vector_of_one_width(spark, monkeypatch):
    """The form for single floats of one width gives the means of the general one; a key may have most rows, or be null."""
    monkeypatch.setattr(V, "LOT_BYTES", 1_000)
    rng = np.random.default_rng(4)
    rows = [(None if i % 50 == 3 else i if i % 3 else 7, [float(x) for x in rng.normal(size=6)]) for i in range(400)] + [(-1, [0.0] * 6)]
    df = spark.createDataFrame(rows, "k long, v array<float>")
    expected = {r.k: r.mean_vector for r in V.mean_vector(df, "v", "k").collect()}
    found = V.mean_vector(df, "v", "k", width=6).collect()
    assert len(found) == len(expected) and {r.k for r in found} == set(expected)
    for r in found:
        assert r.mean_vector == pytest.approx(expected[r.k], abs=1e-12)


def test_blobs(spark):
    df = spark.createDataFrame([([1.0, -0.5, 0.25, 3.15],), ([0.1] * 384,), (None,)], "v array<float>")
    rows = df.select("v", V.to_blob(F.col("v")).alias("b")).withColumn("w", V.from_blob(F.col("b"))).collect()
    assert [r.v for r in rows] == [r.w for r in rows]
    assert [len(r.b) for r in rows[:2]] == [16, 1536]


def test_calibration_and_relevance(spark):
    assert one(spark, V.calibrate(F.lit(0.42))) == 0
    assert one(spark, V.calibrate(F.lit(0.9))) == 1
    assert one(spark, V.relevance(F.lit(-3.0))) == 0.25


def test_hash_vectors():
    a, b, c, none = M.hash_embedder(["red fish", "Fish, red", "blue bird sings", ""])
    assert np.linalg.norm(a) == pytest.approx(1) and a == pytest.approx(b)
    assert a @ b > a @ c and not none.any()


def test_blobs_of_odd_rows(spark):
    df = spark.createDataFrame([(1, [1.0, -0.5, 0.25]), (2, []), (3, None)], "id int, v array<float>")
    back = df.select("id", V.to_blob(F.col("v")).alias("b")).select("id", "b", V.from_blob(F.col("b")).alias("v"))
    got = {r.id: (r.b, r.v) for r in back.collect()}
    assert got[1] == (bytearray(np.array([1, -0.5, 0.25], "<f4").tobytes()), [1.0, -0.5, 0.25])
    assert got[2] == (bytearray(), []) and got[3] == (None, None)
    cut = spark.createDataFrame([(bytearray(got[1][0] + b"xy"),), (bytearray(b"abc"),)], "b binary")
    assert [r[0] for r in cut.select(V.from_blob(F.col("b"))).collect()] == [[1.0, -0.5, 0.25], []]


def test_many_chunks_do_not_crowd_out_other_files(spark):
    rows = [(0, 0, "/probe", "p", "t", 0, [1.0, 0.0])]
    rows += [(1, k, "/big", "b", f"c{k}", k, [1.0, 0.001 * k]) for k in range(30)]
    rows += [(2 + k, 0, f"/f{k:02d}", "f", "t", 0, [1.0, 0.5 + 0.01 * k]) for k in range(12)]
    shape = "file_id long, chunk_index int, file_path string, file_name string, chunk_text string, chunk_offset long, embedding array<float>"
    got = hybrid.similar_files(spark.createDataFrame(rows, shape), "/probe", 10).collect()
    assert [r.file_path for r in got] == ["/big", *(f"/f{k:02d}" for k in range(9))]


def test_mean_pooling():
    hidden = np.array([[[1.0, 0.0], [0.0, 1.0], [9.0, 9.0]]])
    assert M.mean_pool(hidden, np.array([[1, 1, 0]]))[0] == pytest.approx([0.5**0.5] * 2)


def search_base(spark, files):
    """Embedded chunks of (path, name, text) rows, one chunk each."""
    vectors = M.hash_embedder([t for _, _, t in files])
    rows = [(i, 0, p, n, t, 0, v.tolist()) for i, ((p, n, t), v) in enumerate(zip(files, vectors, strict=True))]
    return spark.createDataFrame(
        rows,
        "file_id long, chunk_index int, file_path string, file_name string, chunk_text string, chunk_offset long, embedding array<float>",
    )


def ask(spark, files, query, k=20):
    return hybrid.similarity_search(search_base(spark, files), query, M.hash_embedder([query])[0].tolist(), k).collect()


def test_search_fixtures(spark):
    files = [("/a.txt", "a.txt", "rust programming language systems"), ("/b.txt", "b.txt", "delicious recipes for pasta")]
    assert [r.file_path for r in ask(spark, files, "programming")] == ["/a.txt"]
    files = [("/1", "КомплексУпражнений.txt", "общие заметки"), ("/2", "SerpAPI.txt", "api интеграции и автоматизация")]
    assert ask(spark, files, "упражнени")[0].file_name == "КомплексУпражнений.txt"
    files = [("/folders.txt", "folders.txt", "Создайте новые папки для хранения документов"), ("/other.txt", "other.txt", "рецепт приготовления борща")]
    assert ask(spark, files, "папка")[0].file_path == "/folders.txt"
    assert ask(spark, files, "  ") == []
    assert ask(spark, files, "?!") == []


def test_similar_fixtures(spark):
    base = search_base(spark, [("/x.txt", "x.txt", "alpha"), ("/y.txt", "y.txt", "beta"), ("/z.txt", "z.txt", "gamma")])
    assert {r.file_path for r in hybrid.similar_files(base, "/x.txt", 10).collect()} == {"/y.txt", "/z.txt"}
    assert hybrid.similar_files(base, "/nonexistent", 10).collect() == []


def brute_search(rows, query, qv, k):
    """The ranking written as a plain loop."""
    tokens = query.split()
    ws, wl = hybrid.hybrid_weights(tokens)
    scored = []
    for fid, idx, _, name, text, v in rows:
        v = np.asarray(v, dtype=np.float32).astype(float)
        cos = float(v @ qv / np.linalg.norm(v) / np.linalg.norm(qv))
        sem = min(1, max(0, (cos - 0.42) / 0.43))
        lex = sum(0.8 if t in name else 0.4 if t in text else 0 for t in tokens if len(t) >= 2)
        lex += (0.3 if query in name else 0.15 if query in text else 0) if len(query) >= 4 else 0
        scored.append((round(min(1, ws * sem + wl * min(1, lex)), 9), fid, idx, min(1, lex)))
    scored.sort(key=lambda s: (-s[0], s[1], s[2]))
    if len(tokens) <= 1:
        scored = [s for s in scored if s[3] > 0]
    else:
        scored = [s for s in scored if s[0] >= max(0.82 * scored[0][0], 0.15)]
    seen, out = set(), []
    for s in scored:
        if s[1] not in seen:
            seen.add(s[1])
            out.append((s[1], s[2]))
    return out[:k]


@pytest.mark.parametrize("query", ["alpha", "al be", "alpha gamma delta"])
@pytest.mark.parametrize("k", [3, 50])
def test_search_equals_a_plain_loop(spark, query, k):
    rng = np.random.default_rng(11)
    words = ["alpha", "beta", "gamma", "delta", "al", "be"]
    center = rng.normal(size=UNIT)
    rows = []
    for fid in range(40):
        # One file holds a third of all chunks.
        for idx in range(60 if fid == 7 else 3):
            v = center + rng.normal(size=UNIT) * rng.choice([0.3, 1.0, 3.0])
            rows.append((fid, idx, f"/{fid}", f"{rng.choice(words)}.txt", " ".join(rng.choice(words, 3)), v.tolist()))
    df = spark.createDataFrame(
        [(*r[:5], 0, r[5]) for r in rows],
        "file_id long, chunk_index int, file_path string, file_name string, chunk_text string, chunk_offset long, embedding array<float>",
    ).repartition(4)
    got = hybrid.similarity_search(df, query, center.tolist(), k).collect()
    assert [(r.file_id, r.chunk_index) for r in got] == brute_search(rows, query, center, k)
