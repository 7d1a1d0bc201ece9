import re
from collections import Counter

import pyarrow as pa
import pytest
import zstandard

from foliant.llm import quality

from .conftest import ODD


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed)


def band_verdict(text):
    raw = (text or "").encode()
    if not raw:
        return True
    ratio = lambda x: len(x) / len(zstandard.ZstdCompressor(level=3).compress(x))
    band = [b for b in quality.WHOLE if len(raw) >= b.from_bytes][-1]
    chunks = [raw[i : i + 4096] for i in range(0, len(raw), 4096)]
    if len(chunks) > 1 and len(chunks[-1]) < 1024:
        chunks[-2:] = [chunks[-2] + chunks[-1]]
    limits = [quality.CHUNK if len(c) >= 1024 else band for c in chunks]
    bad = sum(not x.low <= ratio(c) <= x.high for x, c in zip(limits, chunks, strict=True))
    return band.low <= ratio(raw) <= band.high and bad <= len(chunks) / 2


def test_against_brute_force(spark, docs, small_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()] + ODD
    got = quality.assessed(docs(rows)).collect()
    key = lambda r: (str(r[0]), *r[1:])
    mine = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got]
    expected = [(i, *brute(t), not brute(t)[-1] and band_verdict(t)) for i, t in rows]
    assert sorted(mine, key=key) == sorted(expected, key=key)


def test_repetition_and_noise_go_prose_stays(spark, docs, small_dir):
    import random

    rng = random.Random(1)
    noise = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(60)) for _ in range(200))
    loop = "\n".join(f"{k} the same sentence comes again and again with a number in front of it" for k in range(300))
    got = {r["doc_id"] for r in quality.kept_rows(docs([(1, noise), (2, loop)])).collect()}
    assert got == set()
    good = spark.read.parquet(f"{small_dir}/documents.parquet").join(spark.read.parquet(f"{small_dir}/labels.parquet").filter("quality = 1"), "doc_id")
    good = good.select("doc_id", "text", "lang", "source", "n_chars")
    base = [r for r in quality.assessed(good).collect() if not r.base_failed]
    assert base and all(r.kept for r in base)


def test_kept_rows_keep_columns(spark, docs):
    table = docs(ODD)
    assert quality.kept_rows(table).schema == table.schema
    assert quality.kept_rows(docs([])).count() == 0


@pytest.mark.parametrize("cut", [1, 5, 10**9])
def test_slices_do_not_matter(cut):
    from foliant.llm.arrays import sliced

    texts = [t for _, t in ODD]
    batch = pa.record_batch([pa.array(texts, pa.string())], names=["text"])
    own = zstandard.ZstdCompressor(level=3)
    parts = [quality.measure(b.column("text"), own) for b in sliced(iter([batch]), "text", cut)]
    assert [x for p in parts for x in p[4].tolist()] == [brute(t)[4] for t in texts]


def test_chunks_cover_every_byte():
    for size, expected in ((1, [1]), (1023, [1023]), (4096, [4096]), (4097, [4097]), (5119, [5119]), (5120, [4096, 1024]), (9000, [4096, 4904])):
        borders = quality.chunk_borders(7, 7 + size)
        assert [b - a for a, b in borders] == expected
        assert borders[0][0] == 7 and borders[-1][1] == 7 + size and all(x[1] == y[0] for x, y in zip(borders, borders[1:], strict=False))
