import os
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.llm import tokenfiles
from foliant.llm.queries import WORD_TOKENIZER, tokenizer

from .conftest import ODD

os.environ["TOKENIZERS_PARALLELISM"] = "false"
PATH = tokenizer(WORD_TOKENIZER)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


SOME = st.text(max_size=60) | st.text("ab theinΣA's\n é1.,!=\u0338\u0301\t\x1c\xa0<|endof>EN", max_size=60)


@settings(max_examples=500, deadline=None)
@given(st.lists(SOME, max_size=4))
def test_word_encoder(library, texts):
    ids, bounds = tokenfiles.encoder(PATH).encode(pa.array([*texts, "<|endoftext|>", "<|ENDOFTEXT|>", "don't 12'ss a.'s"]))
    for text, a, b in zip(texts, bounds[:-1], bounds[1:], strict=False):
        assert ids[a:b].tolist() == library.encode(text, add_special_tokens=False).ids
    closed, ends = tokenfiles.encoder(PATH).encode(pa.array([*texts, None]), 2)
    assert [closed[b - 1] for b in ends[1:]] == [2] * (len(texts) + 1) and ends[-1] == len(closed)


def expected(library, rows):
    out, start = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_table(spark, docs, library, small_dir):
    rows = [(r["doc_id"] + 100, r["text"]) for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()] + ODD
    got = tokenfiles.packed(docs(rows).repartition(3), PATH).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected(library, rows)))


def test_random_access(tmp_path):
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 49000, 10_000).astype("<u2")
    writer = tokenfiles.ShardWriter(pa.OSFile(str(tmp_path / tokenfiles.shard_name(0)), "wb"), ids.dtype, length=64, rows=4)
    for part in np.array_split(ids, 37):
        writer.add(part)
    writer.close()
    reader = tokenfiles.ShardReader(f"file://{tmp_path}", 0, length=64, rows=4)
    n = -(-len(ids) // 64)
    for i in rng.permutation(n).tolist():
        own, mask = reader.sequence(i)
        assert mask.sum() == min(64, len(ids) - 64 * i)
        assert own[mask].tolist() == ids[64 * i : 64 * i + 64].tolist()
    before = pa.total_allocated_bytes()
    values = reader.file.get_batch(3).column(0).flatten().to_numpy()
    assert pa.total_allocated_bytes() == before and not values.flags.owndata
    for start, count in ((0, 10), (250, 700), (9_990, 10)):
        assert np.concatenate(reader.ids(start, count)).tolist() == ids[start : start + count].tolist()
    reader.close()


def test_empty_table(spark, docs):
    assert tokenfiles.packed(docs([]), PATH).count() == 0
