"""Pruned vector search beside a full scan, on clustered, spread and odd vectors."""

import numpy as np
import pytest

from foliant.operators import hybrid, nearest
from foliant.sources import vectors as S
from foliant.sources.searchable import stored

WIDTH = 16


def rows_of(vectors, per_file=3):
    return [
        (i // per_file, i % per_file, f"/f{i // per_file}", f"name{i // per_file}.txt", f"chunk {i} word{i % 7}", i * 10, [float(x) for x in v])
        for i, v in enumerate(vectors)
    ]


def embedded(spark, rows):
    return spark.createDataFrame(
        rows, "file_id long, chunk_index int, file_path string, file_name string, chunk_text string, chunk_offset long, embedding array<float>"
    )


def clustered(n, seed=1, spread=0.15):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, WIDTH))
    return centres[rng.integers(0, 12, n)] + spread * rng.normal(size=(n, WIDTH))


def odd():
    """Equal vectors, zero vectors, narrow ones, and a file of one chunk."""
    base = clustered(90, 3).tolist()
    base[10] = base[0]
    base[11] = [0.0] * WIDTH
    base[40] = base[0][:5]
    return base + [base[0]] * 4


@pytest.fixture(scope="module", params=["clustered", "uniform", "odd"])
def data(request, spark, tmp_path_factory):
    vectors = {"clustered": clustered(900).tolist(), "uniform": np.random.default_rng(2).normal(size=(300, WIDTH)).tolist(), "odd": odd()}[request.param]
    folder = str(tmp_path_factory.mktemp("vectors") / "index")
    frame = embedded(spark, rows_of(vectors))
    S.publish(spark, folder, lambda draft: S.write_index(frame, draft))
    return request.param, frame, S.read_index(spark, folder)


def plain(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("k", [1, 5, 400])
def test_cosine_search_equals_scan(data, k):
    name, frame, index = data
    q = (clustered(1, 1)[0] if name != "uniform" else np.random.default_rng(9).normal(size=WIDTH)).tolist()
    scoring = nearest.by_cosine(q)
    found = nearest.search(index, q, scoring, k)
    expected = hybrid.best_per_file(scoring.score(frame)).select(*hybrid.HIT_SCHEMA.names)
    expected = sorted(plain(expected), key=lambda r: (-r[7], r[0]))[:k]
    assert plain(found.hits.orderBy(*[-found.hits.score, "file_id"])) == expected
    if name == "clustered" and k == 5:
        assert found.rows_read < 0.4 * found.rows and found.clusters_read < found.clusters


@pytest.mark.parametrize("text", ["word3", "chunk word3 name1", "no such longer phrase", "12"])
def test_hybrid_search_equals_scan(data, text):
    _, frame, index = data
    q = clustered(1, 5)[0].tolist()
    assert plain(nearest.similarity_search(index, text, q, 7).hits) == plain(hybrid.similarity_search(frame, text, q, 7))


def test_similar_files_equals_scan(data):
    name, frame, index = data
    for path in ["/f2", "/none"] + (["/f0"] if name != "odd" else []):
        assert plain(nearest.similar_files(index, path, 6).hits) == plain(hybrid.similar_files(frame, path, 6))


@pytest.mark.parametrize(("k", "block"), [(4, 2_048), (4, 16), (1000, 50)])
def test_all_similar_files(spark, data, monkeypatch, k, block):
    monkeypatch.setattr(nearest, "BLOCK", block)
    _, frame, index = data
    rows = [r for r in frame.collect() if len(r.embedding) == WIDTH and any(r.embedding)]
    unit = {(r.file_id, r.chunk_index): np.array(r.embedding, float) / np.linalg.norm(np.array(r.embedding, float)) for r in rows}
    expected = []
    for own in sorted({f for f, _ in unit}):
        mean = np.mean([np.array(r.embedding, float) for r in rows if r.file_id == own], axis=0)
        mean /= np.linalg.norm(mean)
        best = {}
        for (f, c), v in unit.items():
            if f != own:
                best[f] = min(best.get(f, (9, 0)), (-round(float(np.clip(mean @ v, -1, 1)), 9), c))
        order = sorted((s, f, c) for f, (s, c) in best.items())[:k]
        expected += [(own, i, f, c, -s) for i, (s, f, c) in enumerate(order, 1)]
    got = [tuple(r) for r in nearest.all_similar_files(index, stored(spark), k).orderBy("file_id", "rank").collect()]
    assert [g[:2] for g in got] == [e[:2] for e in expected]
    assert [g[4] for g in got] == pytest.approx([e[4] for e in expected], abs=2e-9)
    # neighbours may trade places only where the last digit of their scores differs
    assert sum(g[:4] != e[:4] for g, e in zip(got, expected, strict=True)) <= len(got) // 100


def test_empty_index(spark, tmp_path):
    S.write_index(embedded(spark, []), str(tmp_path / "i"))
    index = S.read_index(spark, str(tmp_path / "i"))
    assert nearest.search(index, [1.0] * WIDTH, nearest.by_cosine([1.0] * WIDTH), 3).hits.count() == 0
    assert nearest.all_similar_files(index, stored(spark), 3).count() == 0


def test_publish_keeps_the_first(spark, tmp_path):
    folder = str(tmp_path / "x")

    def write(text, inner=None):
        def run(draft):
            spark.createDataFrame([(text,)], "t string").write.parquet(f"{draft}/t")
            if inner:
                inner()

        return run

    S.publish(spark, folder, write("slow", lambda: S.publish(spark, folder, write("fast"))))
    assert [r.t for r in spark.read.parquet(f"{folder}/t").collect()] == ["fast"]
    assert [p.name for p in tmp_path.iterdir()] == ["x"]


def test_all_similar_files_writes_no_candidates(spark, tmp_path):
    """Vectors without structure leave every cluster open; copies of a vector count once."""
    base = np.random.default_rng(7).normal(size=(150, WIDTH)).tolist()
    frame = embedded(spark, rows_of(base * 4))
    S.write_index(frame, str(tmp_path / "i"))
    written = {}

    def counted(df, name, keep=stored(spark)):
        out = keep(df, name)
        written[name] = out.count()
        return out

    found = nearest.all_similar_files(S.read_index(spark, str(tmp_path / "i")), counted, 5)
    assert found.count() == 200 * 5
    assert max(written.values()) <= 200


@pytest.mark.parametrize("offered", [1, 8])
def test_best_files_of_blocks(monkeypatch, offered):
    """One file owns all near vectors of a block, so further ones have to be offered."""
    monkeypatch.setattr(nearest, "OFFERED", offered)
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(400, WIDTH))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    means = np.concatenate([vectors[:3], rng.normal(size=(5, WIDTH))])
    means /= np.linalg.norm(means, axis=1)[:, None]
    files = np.where(vectors @ means[0] > -0.2, 7, np.arange(400) % 40)
    best = nearest.BestFiles(means, np.arange(8), 4)
    for part in np.split(np.arange(400), 5):
        block = nearest.Block(vectors[part], np.arange(len(part) + 1), files[part], part)
        best.add(block, np.arange(8))
    for q in range(8):
        own = {}
        for i, f in enumerate(files.tolist()):
            if f != q:
                own[f] = min(own.get(f, (9, 0)), (-round(float(means[q] @ vectors[i]), 9), i))
        expected = [(f, i, -s) for s, f, i in sorted((s, f, i) for f, (s, i) in own.items())[:4]]
        mine = best.hits[0] == q
        assert [x[mine].tolist() for x in best.hits[1:]] == [list(x) for x in zip(*expected, strict=True)]


def test_search_shuffles_no_texts(data, monkeypatch):
    """Files with many near chunks: further rounds leave out the files found, and results are those of the scan."""
    monkeypatch.setattr(nearest, "ROWS_PER_FILE", 1)
    monkeypatch.setattr(nearest.hybrid, "best_per_file", lambda scored: pytest.fail("groups all rows with their texts"))
    _, frame, index = data
    q = clustered(1, 4)[0].tolist()
    scored = nearest.by_cosine(q).score(frame).collect()
    best = {}
    for r in scored:
        best[r.file_id] = min(best.get(r.file_id, (9, 0)), (-r.score, r.chunk_index))
    expected = [(f, c, -s) for s, f, c in sorted((s, f, c) for f, (s, c) in best.items())[:20]]
    found = nearest.search(index, q, nearest.by_cosine(q), 20).hits
    assert sorted(((r.file_id, r.chunk_index, r.score) for r in found.collect()), key=lambda r: (-r[2], r[0])) == expected


def test_blocks_without_hits_cost_no_more_than_products():
    """Means that have their files pass over a block of far vectors without a look at single products."""
    rng = np.random.default_rng(5)
    means = np.abs(rng.normal(size=(40, WIDTH)))
    means /= np.linalg.norm(means, axis=1)[:, None]
    best = nearest.BestFiles(means, np.arange(40), 3)
    best.add(nearest.Block(means, np.arange(41), np.arange(40), np.zeros(40, np.int64)), np.arange(40))
    before = [x.tolist() for x in best.hits]

    class Far(nearest.Block):
        def owners(self, which):
            pytest.fail("looks at the vectors of a block without hits")

    best.add(Far(-means, np.arange(41), np.arange(100, 140), np.zeros(40, np.int64)), np.arange(40))
    assert [x.tolist() for x in best.hits] == before


def test_all_similar_files_shuffles_no_pairs(spark, data):
    """Neither files nor arrays are grouped by Spark; equal vectors and chunks of a file may come in many batches."""
    _, _, index = data
    plans = {}

    def planned(df, name, keep=stored(spark)):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return keep(df, name)

    def found(keep):
        rows = nearest.all_similar_files(index, keep, 5).collect()
        return sorted((r.file_id, r.rank, r.other_id, r.chunk_index, round(r.score, 8)) for r in rows)

    whole = found(planned)
    assert "Exchange" not in plans["vectors"] and "Aggregate" not in plans["vectors"] + plans["means"]
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert found(stored(spark)) == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_lowest_owners():
    which, files, parts = (np.array(x) for x in ([1, 0, 1, 1, 1, 0, 1], [9, 4, 2, 9, 5, 4, 7], [3, 8, 1, 2, 0, 6, 5]))
    assert [x.tolist() for x in nearest._lowest_owners(which, files, parts, 3)] == [[0, 1, 1, 1], [4, 2, 5, 7], [6, 1, 0, 5]]
    assert [len(x) for x in nearest._lowest_owners(which[:0], files[:0], parts[:0], 3)] == [0, 0, 0]


@pytest.mark.parametrize(("tile", "piece", "offered"), [(3, 16, 1), (7, 50, 2), (256, 1_024, 8)])
def test_best_files_by_pieces(monkeypatch, tile, piece, offered):
    """Pieces of a block, vectors with several owners and files with many vectors give the hits of a full scan."""
    for name, value in (("TILE", tile), ("PIECE", piece), ("OFFERED", offered)):
        monkeypatch.setattr(nearest, name, value)
    rng = np.random.default_rng(6)
    vectors, means = (x / np.linalg.norm(x, axis=1)[:, None] for x in (rng.normal(size=(300, WIDTH)), rng.normal(size=(20, WIDTH))))
    owners = [sorted(set(rng.integers(0, 30, 1 + i % 4).tolist())) if i % 5 else [3] for i in range(300)]
    best = nearest.BestFiles(means, np.arange(20), 4)
    for part in np.split(np.arange(300), [90, 91, 200]):
        counts = [len(owners[i]) for i in part]
        files = np.array([f for i in part for f in owners[i]])
        best.add(nearest.Block(vectors[part], np.append(0, np.cumsum(counts)), files, np.repeat(part, counts)), np.arange(20))
    for q in range(20):
        own = {}
        for i, v in enumerate(vectors):
            for f in owners[i]:
                if f != q:
                    own[f] = min(own.get(f, (9, 0)), (-round(float(means[q] @ v), 9), i))
        expected = [(f, i, -s) for s, f, i in sorted((s, f, i) for f, (s, i) in own.items())[:4]]
        mine = best.hits[0] == q
        assert list(zip(*(x[mine].tolist() for x in best.hits[1:]), strict=True)) == expected
