"""PartEnum join against all pairs."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from foliant.llm import common, jaccard
from foliant.llm.jaccard import Similarity

from .conftest import ODD


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute_sets(rows, n):
    sets = defaultdict(list)
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", fold(text))
        grams = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
        sets[i].append(frozenset(grams))
    return sets


def brute(rows, sim):
    """(doc_id, n, component) of every row, by comparing all pairs that share a shingle."""
    sets = brute_sets([r for r in rows if r[0] is not None], sim.words)
    flat = [(i, s) for i, own in sets.items() for s in own]
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = defaultdict(list)
    for at, (i, s) in enumerate(flat):
        common = Counter(other for g in s for other in index[g])
        for other, count in common.items():
            j, t = flat[other]
            if sim.den * count >= sim.num * (len(s) + len(t) - count):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
        for g in s:
            index[g].append(at)
    return sorted((i, len(s), find(i)) for i, s in flat)


def varied(seed):
    """Bases, exact copies, near copies in chains, shared passages and short texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    rows, passage = [], [word() for _ in range(40)]
    for _ in range(12):
        base = [word() for _ in range(rng.choice((1, 2, 4, 6, 9, 14, 30, 90, 250)))]
        if rng.random() < 0.5:
            base[len(base) // 2 : len(base) // 2] = passage
        text = list(base)
        for _ in range(rng.randrange(1, 14)):
            rows.append((len(rows), " ".join(text)))
            if rng.random() < 0.7:
                text = list(text if rng.random() < 0.5 else base)
                for _ in range(rng.randrange(1, 4)):
                    text[rng.randrange(len(text))] = word()
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("sim", [Similarity(3, 9, 10), Similarity(5, 4, 5), Similarity(2, 1, 2)])
def test_components(spark, docs, sim):
    rows = varied(sim.words)
    got = sorted(map(tuple, jaccard.components(docs(rows), sim).collect()))
    assert got == brute(rows, sim)


def test_every_linked_pair_shares_a_signature():
    sim = Similarity(3, 9, 10)
    rng = np.random.default_rng(5)
    for size in (1, 5, 10, 12, 19, 40, 150, 600, 3000):
        for _ in range(20):
            a = rng.integers(0, 2**63, size, dtype=np.uint64)
            gone = rng.integers(0, size // 10 + 1)
            extra = rng.integers(0, size // 10 + 1)
            b = np.concatenate([a[gone:], rng.integers(0, 2**63, extra, dtype=np.uint64)])
            common = size - gone
            if not sim.holds(common, len(a), len(b)):
                continue
            a, b = np.unique(a), np.unique(b)
            values, ends = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
            sig, out = jaccard.signatures(values, ends, sim)
            assert set(sig[: out[1]].tolist()) & set(sig[out[1] :].tolist()), (size, gone, extra)


def test_odd_rows(spark, docs):
    sim = Similarity(3, 9, 10)
    got = sorted((r for r in map(tuple, jaccard.components(docs(ODD), sim).collect()) if r[0] is not None))
    assert got == brute(ODD, sim)


def test_empty_table(spark, docs):
    assert jaccard.components(docs([]), Similarity()).count() == 0
    assert jaccard.one_per_component(docs([]), Similarity()).count() == 0


def test_one_of_each_group_stays(spark, docs):
    rows = varied(11)
    sim = Similarity(5, 4, 5)
    kept = jaccard.one_per_component(docs(rows), sim)
    assert kept.columns == docs(rows).columns
    expected = sorted(i for i, _, c in brute(rows, sim) if i == c)
    assert sorted(r["doc_id"] for r in kept.collect()) == expected


def test_large_group_of_near_copies(spark, docs, monkeypatch):
    """A group whose members are mostly not linked to the first pivot."""
    monkeypatch.setattr(jaccard, "CHUNK", 7)
    monkeypatch.setattr(jaccard, "BLOCK", 2000)
    rng = random.Random(2)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(120):
        text = list(base)
        for _ in range(rng.randrange(0, 5)):
            text[rng.randrange(120)] = f"x{rng.random()}"
        rows.append((i, " ".join(text)))
    sim = Similarity(3, 9, 10)
    assert sorted(map(tuple, jaccard.components(docs(rows), sim).collect())) == brute(rows, sim)


def test_short_texts_have_one_shingle():
    values, ends = jaccard.shingle_sets(pa.array(["a b", "a b", "b a", "", None, "a b c"]), Similarity(3, 9, 10))
    assert np.diff(ends).tolist() == [1, 1, 1, 0, 0, 1]
    assert values[0] == values[1] != values[2]


def test_sketches_never_exceed_the_distance():
    rng = np.random.default_rng(7)
    for size in (1, 10, 300):
        a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
        b = np.unique(np.concatenate([a[size // 3 :], rng.integers(0, 2**63, 20, dtype=np.uint64)]))
        apart = len(np.setxor1d(a, b))
        for words in (1, 4, 64):
            assert np.bitwise_count(jaccard.sketch(a, words) ^ jaccard.sketch(b, words)).sum() <= apart
            assert jaccard.folded(jaccard.sketch(a, 4 * words), words).tolist() == jaccard.sketch(a, words).tolist()


def texts_apart(rng, n=60):
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


def test_one_id_with_several_texts(spark, docs):
    rng = random.Random(4)
    sim = Similarity(5, 4, 5)
    rows = []
    for k in range(0, 40, 10):
        a, b = texts_apart(rng), texts_apart(rng)
        near = [*b[:-1], "other"]
        rows += [(k + 3, " ".join(a)), (k + 7, " ".join(a)), (k + 7, " ".join(b)), (k + 9, " ".join(near))]
    expected = brute(rows, sim)
    assert (9, 56, 3) in expected
    assert sorted(map(tuple, jaccard.components(docs(rows), sim).collect())) == expected
    assert {r["doc_id"] for r in jaccard.one_per_component(docs(rows), sim).collect()} == {3, 13, 23, 33}


def test_doubled_table(spark, docs):
    sim = Similarity(3, 9, 10)
    rows = varied(3) * 2
    assert sorted(map(tuple, jaccard.components(docs(rows), sim).collect())) == brute(rows, sim)


def test_signatures_of_repeated_rows_differ(spark):
    rows = [(sig, i, 10) for sig, own in ((1, (1, 5, 9)), (2, (1, 6, 9)), (3, (1, 6, 9))) for i in own] * 2
    members = spark.createDataFrame(rows, "sig long, id long, n long")
    scratch = jaccard.Scratch(spark, "test")
    got = jaccard.open_members(members, spark.createDataFrame([], "id long, label long"), scratch).collect()
    assert {r["sig"] for r in got} == {1, 2}
    scratch.discard()


@pytest.fixture
def stored(monkeypatch):
    """Rows of the tables that a computation stores, by name."""
    counts, plain = Counter(), jaccard.Scratch.stored

    def counted(self, df, name):
        out = plain(self, df, name)
        counts[name] += out[0].count()
        return out

    monkeypatch.setattr(jaccard.Scratch, "stored", counted)
    return counts


def test_copies_make_no_signatures(spark, docs, stored):
    rng = random.Random(6)
    rows = [(3 * k + copy, text) for k in range(30) for text in [" ".join(texts_apart(rng))] for copy in range(3)]
    sim = Similarity(5, 4, 5)
    assert sorted(map(tuple, jaccard.components(docs(rows), sim).collect())) == brute(rows, sim)
    assert stored["copies"] == 60
    assert stored["shared"] == stored["members"] == 0


def test_texts_of_unlike_pairs_are_not_sent(spark, docs, stored):
    """Texts that share most of their words with each other, yet too few for a link."""
    rng = random.Random(8)
    base = texts_apart(rng, 150)
    rows = []
    for i in range(30):
        at = rng.randrange(90)
        rows.append((i, " ".join([*base[:at], *texts_apart(rng), *base[at + 60 :]])))
    rows.append((99, rows[3][1] + " more"))
    sim = Similarity(5, 4, 5)
    expected = brute(rows, sim)
    assert sum(i != c for i, _, c in expected) <= 3
    assert sorted(map(tuple, jaccard.components(docs(rows), sim).collect())) == expected
    assert stored["pairs"] > 20
    assert stored["dealt"] <= 5


def test_counted_signatures():
    rng = np.random.default_rng(3)
    sig = rng.integers(-(2**63), 2**63, 5000, dtype=np.int64)
    runs = [sig[:3000], sig[2500:], np.repeat(sig[100:110], 9), sig[4990:]]
    keys = [jaccard.keyed(r, 8) for r in runs]
    sent = [jaccard.packed(k) for k in keys]
    tails = defaultdict(list)
    for batch in sent:
        for block, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            tails[block].append(own)
    # a signature takes few bytes, and one that is found often is sent twice
    assert sum(len(x) for own in tails.values() for x in own) == jaccard.TAIL * (3000 + 2500 + 20 + 10)
    got = [x for block, own in tails.items() for x in jaccard.repeated(block, own).column("sig").to_pylist()]
    assert len(got) == len(set(got))
    assert set(got) == {k for k, n in Counter(np.concatenate(keys).tolist()).items() if n > 1}
    assert len(set(jaccard.keyed(sig, 8).tolist())) == 5000


def test_rows_that_only_look_like_copies(spark, monkeypatch):
    """A bitmap so full that it takes many rows for copies."""
    monkeypatch.setattr(common, "BITMAP_BITS", 1 << 15)
    monkeypatch.setattr(common, "MOST_BITMAP_BITS", 1 << 15)
    known = spark.range(8000).selectExpr("id as doc_id", "5L as n", "id % 7000 as d1", "id % 7000 as d2")
    scratch = jaccard.Scratch(spark, "test")
    marks = scratch.saved(jaccard.marked(known.selectExpr("doc_id as id", "n", "d1", "d2").filter("id >= 7000")), "marks")
    copies = jaccard.copies_of(known, marks, scratch)
    ids = np.arange(8000)
    own = jaccard.marks_of(ids, np.full(8000, 5), ids % 7000, ids % 7000)
    assert copies.maybe.may_hold(own)[:7000].any()
    assert not copies.surely(own)[:7000].any()
    assert copies.surely(own)[7000:].mean() > 0.97
    scratch.discard()


def test_bitmaps_are_fetched_by_few_jobs(spark, monkeypatch):
    """The number of shuffle partitions does not multiply the driver's jobs, one after another."""
    monkeypatch.setattr(common, "BITMAP_BITS", 1 << 18)
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = {name: spark.conf.get(name) for name in names}
    scratch = jaccard.Scratch(spark, "test")
    ids = scratch.saved(spark.range(0, 90_000, 3).toDF("id"), "ids")
    try:
        spark.conf.set(names[0], "40")
        spark.conf.set(names[1], "false")
        spark.sparkContext.setJobGroup("bitmap", "")
        held = common.bitmap_of(ids, "id")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for name, value in before.items():
            spark.conf.set(name, value)
    assert held.bits == 1 << 20  # four pieces
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("bitmap")) <= 12
    rows, flag = common.maybe_in(spark.range(90_000).toDF("id"), "id", held)
    found = {r["id"] for r in rows.filter(flag).collect()}
    assert found >= set(range(0, 90_000, 3))
    assert len(found) < 33_000
    scratch.discard()
