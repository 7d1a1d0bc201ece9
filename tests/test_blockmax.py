"""Block-max search and trigram names beside the full forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.operators import blockmax, fulltext, names, rag
from foliant.sources.searchable import read_search_index, write_search_index

WORDS = ["the", "then", "there", "alpha", "alpine", "beta", "gamma", "rare", "Ünder", "über"]


@pytest.fixture(scope="module")
def files(spark):
    """Few short files with many hits among many long ones with few."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(600):
        n = 3 if 200 <= i < 205 else int(rng.integers(20, 60))
        text = " ".join(rng.choice(WORDS[:7], n))
        text = "the the alpha common common common" if 200 <= i < 205 else text + " common"
        text += " rare" if i in (17, 204, 599) else ""
        rows.append((i * 3, f"/f{i}", f"{'Über' if i % 50 == 0 else 'note'}_{i}.txt", ["", "the desc", None][i % 3], None if i == 9 else text, "über" if i % 97 == 0 else "", "beta, tag" if i % 11 == 0 else ""))
    return spark.createDataFrame(rows, "id long, file_path string, file_name string, description string, text_content string, transcript_text string, tags string")


@pytest.fixture(scope="module")
def index(spark, files, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("index") / "i")
    write_search_index(files, folder)
    return read_search_index(spark, folder)


@pytest.mark.parametrize("block_ids", [1_024, 16])
@pytest.mark.parametrize(
    ("phrases", "weights", "require_all"),
    [
        (fulltext.parse_query("the"), fulltext.WEIGHTS, True),
        (fulltext.parse_query("the alp"), fulltext.WEIGHTS, True),
        (fulltext.parse_query("rare the"), fulltext.WEIGHTS, True),
        (fulltext.parse_query("rare nowhere"), fulltext.WEIGHTS, True),
        ([fulltext.Phrase(("rare",), False), fulltext.Phrase(("beta",), False)], fulltext.UNWEIGHTED, False),
        ([fulltext.Phrase(("nowhere",), False), fulltext.Phrase(("gamma",), False)], fulltext.UNWEIGHTED, False),
        ([fulltext.Phrase(("uber",), False)], {**fulltext.UNWEIGHTED, "transcript_text": 0.0}, True),
        ([], fulltext.WEIGHTS, True),
    ],
)
def test_equals_full_ranking(index, monkeypatch, block_ids, phrases, weights, require_all):
    if block_ids == 16:  # many blocks: bounds stay distributed
        monkeypatch.setattr(blockmax, "DRIVER_BLOCKS", 3)
    blocks = blockmax.build_blocks(index.postings, index.lengths, block_ids=block_ids).persist()
    for limit in (5, 1000):
        full = fulltext.rank_postings(index.postings, index.lengths, phrases, weights, require_all)
        expected = [(r.id, r.rank) for r in full.withColumn("rank", F.round("rank", 12)).orderBy("rank", "id").limit(limit).collect()]
        found = blockmax.rank_top(blocks, index.totals, phrases, limit, weights, require_all, digits=12)
        assert [(r.id, r.rank) for r in found.top.orderBy("rank", "id").collect()] == expected
    blocks.unpersist()


def test_common_words_open_few_blocks(index):
    blocks = blockmax.build_blocks(index.postings, index.lengths, block_ids=16)
    common = blockmax.rank_top(blocks, index.totals, [fulltext.Phrase(("common",), False)], 3, fulltext.UNWEIGHTED, False)
    assert common.opened < blocks.filter("token = 'common'").count() / 4
    # a required rare word leaves the blocks of a common one closed
    both = blockmax.rank_top(blocks, index.totals, fulltext.parse_query("rare alpha"), 3)
    assert both.opened <= 3 * 2 + 3


def test_phrases_need_postings(index):
    with pytest.raises(ValueError):
        blockmax.rank_top(index.blocks, index.totals, fulltext.parse_query("foo-bar"), 5)


@pytest.mark.parametrize("pattern", ["note_1", "uber", "über", "_59", "txt", "no%9", "e_", "ote_25", "zzz", "%", "note_599.txt"])
def test_names_like(files, index, pattern):
    found = sorted(r.id for r in names.names_like(index.names, index.grams, pattern).collect())
    from foliant.functions import text as X

    expected = files.filter(X.fold_ascii_case(F.col("file_name")).like(f"%{pattern}%"))
    assert found == sorted(r.id for r in expected.collect())


def test_trigram_filter_is_pushed(index):
    plan = names.names_like(index.names, index.grams, "note_59")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in plan or "PushedFilters: [IsNotNull(gram), In(gram" in plan or "In(gram" in plan


@pytest.mark.parametrize("question", ["where is rare", "find note_59 please", "nothing here at all zzz", "über alles", ""])
def test_indexed_fallback(files, index, question):
    def by_keyword(phrases, k):
        return blockmax.best_files(index, phrases, k, fulltext.UNWEIGHTED, False)

    plain = rag.fallback_context(files, question, 4).orderBy("rank").collect()
    fast = rag.indexed_fallback(files, question, 4, by_keyword, index.names, index.grams).orderBy("rank").collect()
    assert fast == plain


def test_empty_index(spark, files, tmp_path):
    write_search_index(files.limit(0), str(tmp_path / "i"))
    own = read_search_index(spark, str(tmp_path / "i"))
    assert blockmax.rank_top(own.blocks, own.totals, fulltext.parse_query("the"), 5).top.count() == 0
    assert names.names_like(own.names, own.grams, "note").count() == 0


@pytest.mark.parametrize("slice_tokens", [500_000, 40])
def test_index_holds_each_token_once_in_shuffle_order(spark, files, tmp_path, monkeypatch, slice_tokens):
    """Blocks come from one shuffle of grouped tokens, and equal those that are built of single occurrences."""
    monkeypatch.setattr(blockmax, "SLICE_TOKENS", slice_tokens)
    kept = {}

    def keep(df, name):
        df.write.parquet(str(tmp_path / name))
        kept[name] = spark.read.schema(df.schema).parquet(str(tmp_path / name))
        return kept[name]

    made = blockmax.indexed_blocks(files.repartition(5), keep, block_ids=64).persist()
    postings, lengths = fulltext.build_postings(files), fulltext.document_lengths(files)
    if slice_tokens > 40:
        assert kept["pieces"].count() < postings.select("token", "id").distinct().count()
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    with_token = made.filter("token IS NOT NULL")
    assert rows(blockmax.postings_of(with_token)) == rows(postings)
    assert rows(blockmax.lengths_of(made)) == rows(lengths)
    columns = ["token", "block", "n", "most", "shortest", "docs"]
    assert rows(with_token.select(columns)) == rows(blockmax.build_blocks(postings, lengths, block_ids=64).select(columns))
    made.unpersist()


def test_token_filter_reaches_the_blocks(index):
    plan = fulltext.phrase_occurrences(index.postings, fulltext.Phrase(("the",), True))._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(token,the)" in plan and "most" not in plan


def test_result_page_shuffles_no_texts(spark, files, index):
    phrases = fulltext.parse_query("rare")
    best = blockmax.best_files(index, phrases, 5)
    page = fulltext.result_page(files.withColumn("indexed_at", F.lit(0)), best, phrases)
    assert sorted(r.id for r in page.collect()) == [51, 612, 1797]
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
