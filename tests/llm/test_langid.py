import zlib

import numpy as np

from foliant.llm import langid

from .conftest import ODD


def test_held_out_accuracy(spark, small_dir):
    docs = spark.read.parquet(small_dir.replace("sf0.001", "sf0.01") + "/documents.parquet")
    model = langid.train(docs.filter(~langid.held_out()))
    got = {r.doc_id: r for r in langid.predicted(docs, model).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert all(0 <= r.score <= 1 for r in got.values())
    unseen = [i for i, r in got.items() if r.held_out]
    right = sum(got[i].lang_pred == truth[i] for i in unseen) / len(unseen)
    assert len(unseen) > 200 and right >= 0.97, right


def test_masks_equal_separate_filters():
    rng = np.random.default_rng(1)
    own = {lang: rng.integers(-(2**62), 2**62, 3000) for lang in ("aa", "bb", "cc")}
    model = langid.filters([(lang, int(g)) for lang, values in own.items() for g in values])
    for bit, lang in enumerate(model.languages):
        assert (model.masks(own[lang].view(np.uint64)) >> np.uint64(bit) & np.uint64(1)).all()
    absent = rng.integers(0, 2**62, 50_000).astype(np.uint64)
    yes = [float((model.masks(absent) >> np.uint64(b) & np.uint64(1)).mean()) for b in range(3)]
    assert np.allclose(yes, model.false_yes, atol=2e-3)


def test_texts_without_letters(spark, docs):
    labelled = spark.createDataFrame([(k, "the words of a text " * 5, "en") for k in range(9)] + [(99, "der Text die Worte " * 5, "de")], "doc_id long, text string, lang string")
    model = langid.train(labelled)
    got = {r.doc_id: r for r in langid.predicted(docs([*ODD, (50, "123 !!! 🙂"), (51, "die Worte"), (52, "of a text")]), model).collect()}
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (1, 2, 3, 50))
    assert (got[51].lang_pred, got[52].lang_pred) == ("de", "en") and got[None].held_out is False
    assert got[4].lang_pred in ("de", "en")


def test_nothing_learned(spark, docs):
    model = langid.train(docs([(1, "some text")]))
    assert [tuple(r)[2:] for r in langid.predicted(docs([(1, "some text")]), model).collect()] == [("und", 0.0)]
    assert langid.predicted(docs([]), model).count() == 0
