"""The audit beside plain counting; transducers beside sorted lists."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.llm import divergence as D

from .conftest import ODD


def spans(terms):
    ends = np.cumsum([len(t) for t in terms]) if terms else np.zeros(0, int)
    return np.frombuffer(b"".join(terms), np.uint8), ends - [len(t) for t in terms], ends


@settings(max_examples=80, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=6), max_size=40), st.lists(st.binary(min_size=1, max_size=7), max_size=20))
def test_transducer_gives_ordinals(terms, others):
    terms = sorted(terms)
    t = D.Transducer.of(D.Transducer.build(terms).table())
    asked = terms + others
    place = {w: i for i, w in enumerate(terms)}
    assert t.walk(*spans(asked)).tolist() == [place.get(w, -1) for w in asked]


def test_transducer_is_minimal():
    """No two states have the same right language: as many states as distinct sets of endings."""
    words = sorted({a + b + c for a in (b"x", b"yy", b"zzz") for b in (b"run", b"walk") for c in (b"", b"s", b"ing")} | {b"a", b"b" * 3000})
    endings = {w[:i]: frozenset(v[i:] for v in words if v[:i] == w[:i]) for w in words for i in range(len(w) + 1)}
    assert D.Transducer.build(words).states == len(set(endings.values()))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=12), min_size=1, max_size=8, unique=True), st.lists(st.binary(min_size=1, max_size=12), max_size=20))
def test_shard_of_a_term(lows, asked):
    asked = [a.replace(b"\0", b"a") for a in asked]
    lows = sorted({x.replace(b"\0", b"a") for x in lows} | {b"aaaaaaaaX", b"aaaaaaaaY"})
    expected = [sum(low <= a for low in lows) - 1 for a in asked]
    assert D.shards_of(lows, *spans(asked)).tolist() == expected


def brute(rows, least, reported):
    """Rows (text, lang, source) to (lang, source, part, item, value, rank)."""
    frequency, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        frequency[lang].update(set(terms))
        counts[lang, source].update(terms)
        groups.add((lang, source))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted((t for t, n in frequency[lang].items() if n >= least), key=str.encode)
        own = sorted(s for g, s in groups if g == lang)

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept}

        q = shares(sum((counts[lang, s] for s in own), Counter()))
        p = {s: shares(counts[lang, s]) for s in own}
        for s in own:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in own if o != s]
            out += [(lang, s, "pair", o, -v, i) for i, (v, _, o) in enumerate(sorted(pairs), 1)]
            terms = [(q[t] - p[s][t], t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            out += [(lang, s, "term", t, -v, i) for i, (v, _, t) in enumerate(sorted(terms)[:reported], 1)]
    return sorted(out)


def table(spark, rows):
    full = [(i, t, lang, s, 1, "x", 2) for i, (t, lang, s) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, term string, ord int")


def made_rows():
    rng = np.random.default_rng(5)
    words = ["Alpha", "beta", "gamma", "Ünder", "日本語", "x" * 40, "prefixedaa", "prefixedab", "prefixedabc", "b-eta", "don't", "é", "zz"]
    rows = []
    for i in range(120):
        text = " ".join(rng.choice(words, rng.integers(0, 30)).tolist())
        rows.append((text, ["en", None, "", "fr"][i % 4], [None, "a", "b", "é", "Z"][i % 5]))
    rows += [(t, None, None) for _, t in ODD] + [("lonely words", "xx", "s1"), (None, "xx", "s2"), ("", "yy", "s")] + [("beta " * 50, "fr", "a")] * 4
    return rows


@pytest.mark.parametrize(("shard_terms", "cells", "reported"), [(D.SHARD_TERMS, D.CELLS, 50), (2, 4, 3), (1, 10, 50)])
def test_equals_plain_counting(spark, shard_terms, cells, reported):
    rows = made_rows()
    out = D.audited(table(spark, rows), 10, reported, shard_terms, cells)
    assert sorted(map(tuple, out.collect())) == brute(rows, 10, reported)


def test_contract_threshold(spark):
    rows = [("common rare", "en", "a")] * 29 + [("common", "en", "b")]
    assert sorted(map(tuple, D.audited(table(spark, rows)).collect())) == brute(rows, 30, 50)


def test_empty_table(spark):
    out = D.audited(table(spark, []))
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"] and out.count() == 0


def test_counts_beyond_64_bits(spark):
    """Shares stay exact where the product does not fit a long."""
    df = spark.createDataFrame([(10**14 + 3, 7 * 10**14, 10**6)], "n long, total long, terms long")
    assert df.select(D.share("n", "total", "terms")).first()[0] == 1 + 10**9 * (10**14 + 8) // (7 * 10**14 + 5 * 10**6)
