import pytest
from pyspark.sql import functions as F

from foliant import errors
from foliant.operators import index as I
from foliant.schema import migrate_files

def now():
    return F.lit(9_999).cast("long")


FILES = [("/a.txt", "a.txt", "File A", "text a"), ("/b.txt", "b.txt", "File B", None)]
BATCH = "file_path string, file_name string, description string, text_content string"


def by_path(df):
    return {r.file_path: r for r in df.collect()}


def test_upsert(spark, make_files):
    files = make_files(FILES)
    batch = spark.createDataFrame([("/a.txt", "a2.txt", "new", None), ("/c.txt", "c.txt", "C", "text c")], BATCH)
    kept, cleared = by_path(I.upsert(files, batch, now())), by_path(I.upsert(files, batch, now(), preserve_text=False))
    assert kept.keys() == {"/a.txt", "/b.txt", "/c.txt"}
    assert (kept["/a.txt"].file_name, kept["/a.txt"].text_content, kept["/a.txt"].indexed_at) == ("a2.txt", "text a", 9_999)
    assert cleared["/a.txt"].text_content == ""
    assert kept["/b.txt"].indexed_at == 1002
    assert kept["/a.txt"].id == 1 and kept["/c.txt"].id > 2


def test_upsert_takes_the_last_of_a_batch(spark, make_files):
    batch = spark.createDataFrame([("/a.txt", "x", "first", "1", 1), ("/a.txt", "y", "last", "2", 2)], BATCH + ", seq int")
    got = by_path(I.upsert(make_files(FILES), batch, now(), order="seq"))
    assert got["/a.txt"].description == "last" and len(got) == 2


def test_new_ids_are_unique(spark, make_files):
    batch = spark.range(500).select(
        F.concat(F.lit("/n/"), "id").alias("file_path"), F.lit("n").alias("file_name"), F.lit("").alias("description"),
        F.lit("t").alias("text_content"),
    ).repartition(4)
    got = I.upsert(make_files(FILES), batch, now())
    assert got.count() == 502 and got.select("id").distinct().count() == 502


def test_review(spark, make_files):
    files = make_files(FILES)
    batch = spark.createDataFrame([("/a.txt", "a.txt", None), ("/n.txt", "n.txt", "body")], "file_path string, file_name string, text_content string")
    got = by_path(I.insert_for_review(files, batch, now()))
    assert got["/a.txt"].needs_review == 0 and got["/a.txt"].description == "File A"
    assert (got["/n.txt"].needs_review, got["/n.txt"].text_content) == (1, "body")
    snapshot = I.insert_for_review(files, batch, now())
    assert [r.file_path for r in I.inbox(snapshot).collect()] == ["/n.txt"]
    reviewed = spark.createDataFrame([("/n.txt", "desc", "x, y")], "file_path string, description string, tags string")
    saved = by_path(I.save_review(snapshot, reviewed))["/n.txt"]
    assert (saved.description, saved.tags, saved.needs_review, saved.indexed_at) == ("desc", "x, y", 0, 9_999)
    assert by_path(I.mark_enriched(snapshot, reviewed))["/n.txt"].needs_review == 0


def test_updates(spark, make_files):
    files = make_files(FILES)
    one = spark.createDataFrame([("/a.txt", "v"), ("/missing", "v")], "file_path string, value string")
    for operation, column in (
        (I.update_text, "text_content"), (I.update_transcript, "transcript_text"), (I.update_description, "description"),
        (I.update_tags, "tags"),
    ):
        got = by_path(operation(files, one.withColumnRenamed("value", column), now()))
        assert got.keys() == {"/a.txt", "/b.txt"}
        assert got["/a.txt"][column] == "v" and got["/a.txt"].indexed_at == 9_999
        assert got["/b.txt"].indexed_at == 1002


def test_removal_cascades(spark, make_files):
    files = make_files(FILES)
    chunks = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "file_id long, chunk_index int")
    left = I.remove(files, spark.createDataFrame([("/a.txt",)], "file_path string"))
    assert I.cascade(chunks, left).collect() == [(2, 0)]
    assert I.clear(files).count() == 0


def test_chunk_maintenance(spark):
    stored = spark.createDataFrame([(1, 0, "old"), (2, 0, "two")], "file_id long, chunk_index int, chunk_text string")
    fresh = spark.createDataFrame([(1, 0, "new"), (1, 1, "more")], stored.schema)
    assert sorted(tuple(r) for r in I.replace_for_files(stored, fresh).collect()) == [(1, 0, "new"), (1, 1, "more"), (2, 0, "two")]
    vectors = spark.createDataFrame([(1, 0, [1.0] * 64), (2, 0, [1.0] * 384)], "file_id long, chunk_index int, embedding array<float>")
    good = I.drop_wrong_width(vectors, 384)
    assert [r.file_id for r in good.collect()] == [2]
    assert [r.file_id for r in I.drop_orphan_chunks(stored, good).collect()] == [2]
    assert [r.file_id for r in I.orphan_chunks(stored, good).collect()] == [1]


def test_reconcile(spark, make_files):
    listing = spark.createDataFrame([("/b.txt", "b.txt"), ("/n.txt", "n.txt"), ("/desktop.ini", "desktop.ini"), ("/.x", ".x")], "file_path string, file_name string")
    files = make_files(FILES)
    assert [r.file_path for r in I.missing_on_disk(files, listing).collect()] == ["/a.txt"]
    assert sorted(r.file_path for r in I.new_on_disk(files, listing).collect()) == ["/.x", "/n.txt"]
    assert by_path(I.reconcile(files, listing, now())).keys() == {"/b.txt", "/n.txt", "/.x"}


def test_missing_vectors(spark, make_files):
    vectors = spark.createDataFrame([(1, 0, [1.0] * 64)], "file_id long, chunk_index int, embedding array<float>")
    files = make_files(FILES)
    assert [r.file_path for r in I.without_embeddings(files, vectors).collect()] == ["/b.txt"]
    assert sorted(r.file_path for r in I.without_embeddings(files, vectors, 384).collect()) == ["/a.txt", "/b.txt"]


def test_migration(spark):
    old = spark.createDataFrame([(1, "/a", "a", 5)], "id long, file_path string, file_name string, indexed_at int")
    row = migrate_files(old).first()
    assert (row.transcript_text, row.tags, row.needs_review, row.indexed_at) == ("", "", 0, 5)
    with pytest.raises(ValueError):
        migrate_files(old.drop("file_name"))


def test_errors():
    assert errors.InvalidPath("x").code == "INVALID_PATH" and not errors.InvalidPath("x").recoverable
    assert errors.WatcherNotRunning("x").as_dict() == {"code": "WATCHER_NOT_RUNNING", "message": "x", "recoverable": True}
    assert len({c.code for c in errors.FoliantError.__subclasses__()}) == 20
