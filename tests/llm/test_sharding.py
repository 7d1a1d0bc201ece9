"""The permutation beside the same rounds on Python numbers; shards beside their law."""

import zlib

import pytest
from pyspark.sql import functions as F

from foliant.llm import sharding as S

from .conftest import ODD


def plain_place(x, n, key=S.KEY):
    p = S.Permutation(n, key)
    a, b = p.sides
    while True:
        left, right = divmod(x, b)
        for i, (c0, c1, c2) in enumerate(p.constants()):
            added = ((right % S.PRIMES[0]) * c0 + c1) % S.PRIMES[0] % S.PRIMES[1] * c2 % S.PRIMES[1]
            left, right = right, (left + added) % (b if i % 2 else a)
        x = left * b + right
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 3, 7, 24, 25, 1000, 4099])
def test_permutation(spark, n):
    p = S.Permutation(n, b"k")
    a, b = p.sides
    assert a * b >= n and p.walks < max(a, 2)
    rows = p.rows(p.places(spark.range(n), "id", "p"), "p", "back").collect()
    assert {r["id"]: r["p"] for r in rows} == {i: plain_place(i, n, b"k") for i in range(n)}
    assert sorted(r["p"] for r in rows) == list(range(n))
    assert all(r["id"] == r["back"] for r in rows)


def test_long_walks(spark, monkeypatch):
    """Walks that no short stride ends are walked to their end."""
    monkeypatch.setattr(S, "STRIDES", (1,))
    n = 4099  # 65 x 64 = 4160: walks of several steps exist
    assert any(plain_steps(i, n) > 1 for i in range(n))
    rows = S.Permutation(n).places(spark.range(n), "id", "p").collect()
    assert [r["p"] for r in sorted(rows)] == [plain_place(i, n) for i in range(n)]


def plain_steps(x, n):
    p, steps = S.Permutation(n), 0
    a, b = p.sides
    while True:
        left, right = divmod(x, b)
        for i, (c0, c1, c2) in enumerate(p.constants()):
            added = ((right % S.PRIMES[0]) * c0 + c1) % S.PRIMES[0] % S.PRIMES[1] * c2 % S.PRIMES[1]
            left, right = right, (left + added) % (b if i % 2 else a)
        x, steps = left * b + right, steps + 1
        if x < n:
            return steps


def test_large_numbers(spark):
    n = 10**15 + 7
    p = S.Permutation(n)
    ids = spark.range(200).select((F.col("id") * 5_000_000_000_000 + 11).alias("id"))
    rows = p.rows(p.places(ids, "id", "p"), "p", "back").collect()
    assert all(r["id"] == r["back"] and r["p"] == plain_place(r["id"], n) for r in rows)


@pytest.mark.parametrize("shards", [1, 5, 24])
def test_odd_rows(spark, docs, shards):
    rows = ODD + [(100 + i, f"text {i}") for i in range(60)] + [(50, "a"), (50, "b"), (50, "a")]
    out = S.placed(docs(rows), shards).collect()
    assert len(out) == len(rows)
    assert sorted((r["doc_id"] is not None, r["doc_id"], r["size"], r["text_crc32"]) for r in out) == sorted(
        (i is not None, i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows
    )
    assert {r["law"] for r in out} == {"rows"} and {r["grown_shard"] for r in out} == {None}
    slots = {}
    for r in out:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["place"] == plain_place(r["row_number"], len(rows)) == r["slot"] * shards + r["shard"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    ordered = [r["doc_id"] for r in sorted(out, key=lambda r: r["row_number"])]
    assert ordered == sorted([i for i, _ in rows], key=lambda i: (i is not None, i or 0))


def test_same_whatever_the_partitions(spark, docs):
    rows = [(i * 7 % 301, f"t{i}") for i in range(301)] + ODD
    one = sorted(map(str, S.placed(docs(rows).repartition(1)).collect()))
    many = sorted(map(str, S.placed(docs(rows[::-1]).repartition(9)).collect()))
    assert one == many
    other = sorted(map(str, S.placed(docs(rows), key=b"other").collect()))
    assert one != other


def test_empty_table(spark, docs):
    out = S.placed(docs([]))
    assert out.count() == 0
    assert [f.dataType.simpleString() for f in out.schema.fields[:7]] == ["bigint", "bigint", "bigint", "string", "int", "bigint", "int"]


def test_native(spark, docs):
    plan = S.placed(docs(ODD))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_row_at_is_the_inverse(spark, docs):
    placed = S.placed(docs([(i, "x") for i in range(50)]), 7)
    slots = spark.range(9).select(F.col("id").alias("slot")).crossJoin(spark.range(7).select(F.col("id").cast("int").alias("shard")))
    found = {(r["shard"], r["slot"]): r["row_number"] for r in S.row_at(slots, 50, 7).collect()}
    assert found == {(r["shard"], r["slot"]): r["row_number"] for r in placed.collect()}


def test_written_shards(spark, docs, tmp_path):
    rows = ODD + [(50, "a"), (50, "b")]
    table = docs(rows).withColumn("shard", F.lit("mine")).withColumn("pos", F.lit(1))
    out = S.written(table, str(tmp_path / "shards"), 5).collect()
    place = {(r["shard"], r["slot"]): r["doc_id"] for r in S.placed(docs(rows), 5).collect()}
    assert {(r["shard"], r["slot"]): r["doc"]["doc_id"] for r in out} == place
    assert sorted(str(r["doc"]["text"]) for r in out) == sorted(str(t) for _, t in rows)
    assert {r["doc"]["shard"] for r in out} == {"mine"}
