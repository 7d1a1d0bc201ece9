import hashlib
import itertools
import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.llm import bpe
from foliant.llm.queries import BYTE_TOKENIZER, tokenizer

from .conftest import ODD

os.environ["TOKENIZERS_PARALLELISM"] = "false"
PATH = tokenizer(BYTE_TOKENIZER)
SPECIAL = "<|endoftext|>"
STRANGE = [
    "", " ", "a  b", " a", "a ", "\n\nx", "x\n", "x\n y", "a\tb", "don't I'll", f"{SPECIAL}x {SPECIAL}", "a" * 999, "　x y", "a b",
    "x\x1cy \x1c z", "日本語 テキスト", "🙂🙂 ok", "1234567 890", "a\r\nb", "ſtoken", "\x85 b", "é́ ́x", "x    \n   y", "0 0\n0",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


OWN = bpe.ByteBPE(PATH)


def same(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    own = np.frombuffer(OWN.encode(text), dtype="<u4")
    assert own.tolist() == ids
    assert OWN.decode(own) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", STRANGE)
def test_strange_texts(library, text):
    same(library, text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("ab theinŌ's\n é1.😀<|endof>", max_size=60))
def test_any_text(library, text):
    same(library, text)


def merged(word, merges):
    """Plain BPE: the earliest merge first, leftmost pairs first."""
    parts = [bytes([b]) for b in word]
    rank = {m: i for i, m in enumerate(merges)}
    while True:
        best = min((rank[p] for p in itertools.pairwise(parts) if p in rank), default=None)
        if best is None:
            return parts
        out, i = [], 0
        while i < len(parts):
            if i + 1 < len(parts) and (parts[i], parts[i + 1]) == merges[best]:
                out.append(parts[i] + parts[i + 1])
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out


@pytest.mark.parametrize("seed", range(30))
def test_automaton_of_random_merges(seed):
    """Every string over a small alphabet, for merge lists full of overlaps."""
    rng = random.Random(seed)
    known = [b"a", b"b", b"c"][: rng.choice((1, 2, 3))]
    letters, merges = list(known), []
    for _ in range(rng.randrange(1, 9)):
        a, b = rng.choice(known), rng.choice(known)
        if (a, b) not in merges and a + b not in known:
            merges.append((a, b))
            known.append(a + b)
    automaton = bpe.TokenAutomaton({t: i for i, t in enumerate(known)}, merges)
    for n in range(1, 8):
        for word in itertools.product(letters, repeat=n):
            word = b"".join(word)
            ids = automaton.encode(word)
            assert [known[i] for i in ids] == merged(word, merges), (word, merges)
            assert automaton.decode(ids) == word


def test_table(spark, docs, library, small_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small_dir}/documents.parquet").limit(60).collect()] + ODD
    expected = []
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        sha = lambda raw: hashlib.sha256(raw).hexdigest()
        expected.append((i, len(ids), sha(np.array(ids, dtype="<u4").tobytes()), sha(decoded.encode())))
    got = bpe.round_trip(docs(rows), PATH).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))
    made = bpe.encoded(docs(rows), PATH).collect()
    assert all(r.exact and r.n_tokens == len(r.token_ids) for r in made)
    assert bpe.round_trip(docs([]), PATH).count() == 0


def test_forgetting_changes_nothing():
    own = bpe.ByteBPE(PATH)
    texts = [f"word{k} other words{k % 7}, and more" for k in range(200)]
    first = [own.encode(t) for t in texts]
    small = bpe.ByteBPE(PATH)
    small.words.limit = small.units.limit = 5
    assert [small.encode(t) for t in texts] == first
