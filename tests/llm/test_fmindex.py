import hashlib
import random
import re

import numpy as np

from foliant.llm import fmindex
from foliant.llm.fmindex import FMIndex, WaveletMatrix, suffix_array

from .conftest import ODD


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def windows(items):
    out = {}
    for i, text in items:
        w = words(text)
        for k in range(max(1, len(w) - 9) if w else 0):
            out.setdefault(tuple(w[k : k + 10]), set()).add(i)
    return out


def brute(text, known):
    w = words(text)
    hit, items = set(), set()
    lengths = {len(k) for k in known}
    for at in range(len(w)):
        for n in lengths:
            own = tuple(w[at : at + n])
            if len(own) == n and own in known:
                hit.update(range(at, at + n))
                items |= known[own]
    names = sorted(map(str, items))
    return (len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit))


def collapsed(rng, n, sigma):
    text = [rng.randint(0, sigma) for _ in range(n)] + [0]
    return np.array([x for i, x in enumerate(text) if x or not i or text[i - 1]], dtype=np.int64)


def test_suffix_array_orders_segments():
    rng = random.Random(4)
    for _ in range(200):
        text = collapsed(rng, rng.randint(0, 60), rng.choice((1, 2, 5, 400)))
        key = lambda i, t=text: [(x, i + k if x == 0 else 0) for k, x in enumerate(t[i : i + 1 + int(np.argmax(t[i:] == 0))])]
        assert suffix_array(text, int(text.max())).tolist() == sorted(range(len(text)), key=key)


def test_wavelet_ranks():
    rng = np.random.default_rng(1)
    for sigma in (1, 3, 4, 100):
        text = rng.integers(0, sigma + 1, 300)
        tree = WaveletMatrix(text, sigma)
        symbols, ends = rng.integers(0, sigma + 1, 200), rng.integers(0, 301, 200)
        assert tree.rank(symbols, ends).tolist() == [int((text[:e] == s).sum()) for s, e in zip(symbols, ends, strict=True)]
        at = rng.integers(0, 300, 100)
        got, before = tree.access(at)
        assert got.tolist() == text[at].tolist()
        assert before.tolist() == [int((text[:i] == text[i]).sum()) for i in at]


def test_search_and_locate():
    rng = random.Random(8)
    for _ in range(150):
        sigma = rng.choice((1, 2, 4, 50))
        text = collapsed(rng, rng.randint(1, 120), sigma)
        index = FMIndex(text, sigma)
        phrases = [[rng.randint(1, sigma) for _ in range(rng.randint(1, 10))] for _ in range(30)]
        table = np.zeros((30, 10), dtype=np.int64)
        for i, p in enumerate(phrases):
            table[i, : len(p)] = p
        low, high = index.search(table, np.array([len(p) for p in phrases]))
        for i, p in enumerate(phrases):
            places = sorted(index.locate(np.arange(low[i], high[i])).tolist())
            assert places == [k for k in range(len(text)) if text[k : k + len(p)].tolist() == p]


def items_table(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_against_brute_force(spark, docs, small_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()] + ODD
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small_dir}/benchmark.parquet").collect()]
    items += [(900, "very long text"), (901, None), (902, "..."), (903, "ONE"), (900, "Two words")]
    known = windows(items)
    got = fmindex.contamination(docs(rows), items_table(spark, items)).drop("spans").collect()
    expected = [(i, *brute(t, known)) for i, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    assert any(r.contaminated for r in got)


def test_blocks_of_items_give_the_same(spark, docs, monkeypatch):
    items = [(k, f"alpha beta gamma {k} delta epsilon zeta eta theta iota kappa lambda {k}") for k in range(6)]
    rows = [(1, f"x {items[2][1]} y {items[5][1]} z"), (2, "nothing of it")]
    whole = fmindex.contamination(docs(rows), items_table(spark, items)).collect()
    monkeypatch.setattr(fmindex, "BLOCK_BYTES", 1)
    assert fmindex.contamination(docs(rows), items_table(spark, items)).collect() == whole


def test_blocks_are_read_back_as_written(spark, monkeypatch):
    rows = [(k, " ".join(f"w{k % 7}x{j}" for j in range(k))) for k in range(40)] + [(None, "lone words"), (41, None), (42, "")]
    monkeypatch.setattr(fmindex, "BLOCK_BYTES", 200)
    found = fmindex.blocks(items_table(spark, rows), "item_id", "text")
    first, again = ([(b.vocabulary[row[:n] - 1].tolist(), names) for b in found for row, n, names in zip(b.symbols, b.lengths, b.items, strict=True)] for _ in range(2))
    assert len(found.names) > 5 and first == again
    known = {}
    for window, names in first:
        known.setdefault(tuple(window), set()).update(names)
    assert sorted(map(sorted, known.values())) == sorted(sorted(str(x) for x in v if x is not None) for v in windows(rows).values())
    monkeypatch.setattr(fmindex, "HELD_BYTES", 0)
    found.held, found.size = {}, 0
    assert len(list(found)) == len(found.names) and all(b.nbytes == 0 for b in found.held.values())


def test_cleaned_texts_hold_no_window(spark, docs, small_dir):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small_dir}/benchmark.parquet").collect()]
    known = windows(items)
    split = words(items[3][1])
    joined = " ".join([*split[:5], *words(items[4][1])[:10], *split[5:10]])
    rows = [(1, "Start. " + items[0][1] + " End."), (2, "clean text stays, as it is"), (3, joined), (4, None), (5, items[1][1])]
    got = {r["doc_id"]: r for r in fmindex.cleaned(docs(rows), items_table(spark, items)).collect()}
    assert got[2]["text"] == rows[1][1] and got[4]["text"] is None
    assert got[1]["text"].startswith("Start. ") and got[1]["text"].endswith(" End.")
    assert all(brute(r["text"], known)[1] == 0 for r in got.values())
    assert all(r["n_chars"] == len(r["text"]) for r in got.values() if r["text"] is not None)


def test_empty_tables(spark, docs):
    assert fmindex.contamination(docs([]), items_table(spark, [(1, "a b")])).count() == 0
    got = fmindex.contamination(docs([(1, "a b")]), items_table(spark, [])).collect()
    assert [(r.n_words, r.n_hit, r.contaminated) for r in got] == [(2, 0, False)]
