"""The pipeline against the same decisions made row by row."""

import shutil

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from foliant.llm import secrets
from foliant.llm.queries import BYTE_TOKENIZER, tokenizer

from .conftest import ODD
from .test_fmindex import brute as hits
from .test_fmindex import windows
from .test_jaccard import brute as components
from .test_quality import band_verdict
from .test_quality import brute as counts


@pytest.fixture(scope="module")
def folder(spark, small_dir, tmp_path_factory):
    """The small tables with odd rows, without the id that rows share."""
    path = tmp_path_factory.mktemp("tables")
    shutil.copy(f"{small_dir}/benchmark.parquet", path)
    base = spark.read.parquet(f"{small_dir}/documents.parquet")
    odd = [(i + 10_000, t, None, "src", None) for i, t in ODD if i not in (None, 7)]
    base.unionByName(spark.createDataFrame(odd, base.schema)).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_run(spark, folder):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    known = windows([(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()])
    kept = [(i, t) for i, t in rows if not counts(t)[-1] and band_verdict(t)]
    first = {i for i, _, c in components(kept, corpus_pipeline.NEAR) if i == c}
    kept = dict((i, t) for i, t in kept if i in first)
    library = Tokenizer.from_file(tokenizer(BYTE_TOKENIZER))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert got.keys() == kept.keys()
    changed = 0
    for i, text in kept.items():
        own = library.decode(got[i].token_ids, skip_special_tokens=False)
        assert got[i].exact and len(got[i].token_ids) == got[i].n_tokens
        dirty = hits(text, known)[-1] or any(secrets.findings(text))
        changed += bool(dirty)
        if not dirty:
            assert own == text
        assert not hits(own, known)[-1]
        assert not secrets.findings(own)[0]
        assert np.array_equal(library.encode(own, add_special_tokens=False).ids, got[i].token_ids)
    assert changed


def test_stages_keep_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).schema == docs.schema, name
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0, name


def test_registered():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert entry.queries()["pipeline"] is corpus_pipeline.run
