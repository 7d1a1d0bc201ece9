"""Folder events and their sink: every difference once, also over restarts and killed batches."""

import json
import os

import pytest

from foliant.sources import folder as D


@pytest.fixture
def run(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()

    def drain(most=None):
        """Run the stream until nothing is new; returns the events of this run."""
        before = {r.event_id for r in D.read_events(spark, str(tmp_path / "out")).collect()}
        events = D.folder_events(spark, str(inbox), str(tmp_path / "snapshots"), most)
        D.write_events(events, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
        rows = D.read_events(spark, str(tmp_path / "out")).collect()
        assert len({r.event_id for r in rows}) == len(rows)
        return sorted((r.op, r.file_name) for r in rows if r.event_id not in before)

    return inbox, drain


def test_add_edit_delete_over_restarts(run):
    inbox, drain = run
    (inbox / "a.txt").write_text("one")
    (inbox / "b.txt").write_text("two")
    (inbox / ".hidden").write_text("x")
    (inbox / "desktop.ini").write_text("x")
    (inbox / "sub").mkdir()
    assert drain() == [("add", "a.txt"), ("add", "b.txt")]
    assert drain() == []
    (inbox / "a.txt").write_text("one more")
    (inbox / "b.txt").unlink()
    (inbox / "c.txt").write_text("three")
    assert drain() == [("add", "c.txt"), ("change", "a.txt"), ("remove", "b.txt")]
    # a pure removal is an event too
    (inbox / "c.txt").unlink()
    assert drain() == [("remove", "c.txt")]
    (inbox / "c.txt").write_text("three")
    assert drain() == [("add", "c.txt")]


def test_batches_are_bounded(run):
    inbox, drain = run
    for i in range(5):
        (inbox / f"{i}.txt").write_text("x")
    seen = []
    for _ in range(4):
        got = drain(2)
        assert len(got) <= 2
        seen += got
    assert sorted(seen) == [("add", f"{i}.txt") for i in range(5)]


def test_batch_runs_again(tmp_path):
    """A batch that was planned and lost gives the same events, and old snapshots go only after a commit."""
    inbox, state = tmp_path / "inbox", str(tmp_path / "snapshots")
    inbox.mkdir()
    (inbox / "a").write_text("1")
    options = {"path": str(inbox), "snapshots": state}

    def events(stream, start, end):
        return [r for part in stream.partitions(start, end) for batch in stream.read(part) for r in batch.to_pylist()]

    first = D.FolderStream(options)
    end = first.latestOffset()
    assert first.latestOffset() == end == {"snapshot": 1}
    once = events(first, first.initialOffset(), end)
    (inbox / "b").write_text("2")
    again = D.FolderStream(options)  # restarted before the batch was committed
    later = again.latestOffset()
    assert events(again, again.initialOffset(), end) == once and [r["path"] for r in once] == [str(inbox / "a")]
    assert [(r["op"], r["path"]) for r in events(again, end, later)] == [("add", str(inbox / "b"))]
    again.commit(later)
    assert D.Snapshots(state).last() == 2 and len(os.listdir(state)) == 2
    assert D.FolderStream(options).latestOffset() == later


def test_buckets_of_different_sizes(tmp_path, monkeypatch):
    monkeypatch.setattr(D, "BUCKET_FILES", 4)
    snapshots = D.Snapshots(str(tmp_path / "s"))
    old = {f"/f{i}": (i, 1) for i in range(5)}
    new = {f"/f{i}": (i, 1 + (i == 3)) for i in range(2, 40)}
    snapshots.store(1, old)
    snapshots.store(2, new)
    assert snapshots.about(1)["buckets"] < snapshots.about(2)["buckets"] and snapshots.load(2) == new
    stream = D.FolderStream({"path": "/none", "snapshots": str(tmp_path / "s")})
    got = [r for p in stream.partitions({"snapshot": 1}, {"snapshot": 2}) for b in stream.read(p) for r in b.to_pylist()]
    assert sorted((r["path"], r["op"]) for r in got) == sorted(D.differences(old, new))
    assert len({r["event_id"] for r in got}) == len(got)
    back = [r for p in stream.partitions({"snapshot": 2}, {"snapshot": 1}) for b in stream.read(p) for r in b.to_pylist()]
    assert sorted((r["path"], r["op"]) for r in back) == sorted(D.differences(new, old))


def test_content_of_events(spark, tmp_path):
    (tmp_path / "a.txt").write_text("body")
    (tmp_path / "big.txt").write_text("x" * 100)
    rows = [(1, "add", f"{tmp_path}/{n}", n, size, 0, 0) for n, size in [("a.txt", 4), ("big.txt", 100), ("gone.txt", 1)]]
    got = D.with_content(spark.createDataFrame(rows, D.EVENTS), max_bytes=50).collect()
    assert {r.file_name: r.content and bytes(r.content) for r in got} == {"a.txt": b"body", "big.txt": None}
    assert {r.file_name: r.length for r in got} == {"a.txt": 4, "big.txt": 100} and all(r.modified_at.year > 2000 for r in got)


def test_killed_batch_is_kept_once(tmp_path):
    """Drafts without a commit are not seen; a batch that commits twice counts once; an abort cleans up."""
    import pyarrow as pa

    out = str(tmp_path / "out")
    batch = pa.RecordBatch.from_pydict({"event_id": [1, 2]})
    writer = D.EventWriter(out)
    writer.write(iter([batch]))  # the driver dies before the commit
    again = [writer.write(iter([batch])), writer.write(iter([])), None]
    writer.commit(again, 0)
    late = writer.write(iter([batch]))
    writer.commit([late], 0)  # the same batch, run again after a restart
    failed = writer.write(iter([batch]))
    writer.abort([failed, None], 1)
    place = D.Place.of(out)
    named = [n for b in place.names() if b.startswith("batch-") for n in json.loads(place.read(b))]
    assert named == again[0].names
    assert late.names[0] not in place.names() and failed.names[0] not in place.names()


def test_killed_query_is_kept_once(spark, tmp_path):
    """A query that stops between commit and checkpoint repeats its batch without repeating rows."""
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "a.txt").write_text("x")
    places = [str(tmp_path / n) for n in ("snapshots", "out", "cp")]
    D.write_events(D.folder_events(spark, str(inbox), places[0]), places[1], places[2]).awaitTermination(120)
    os.unlink(f"{places[2]}/commits/0")
    for crc in [n for n in os.listdir(f"{places[2]}/commits") if n.endswith(".crc")]:
        os.unlink(f"{places[2]}/commits/{crc}")
    (inbox / "b.txt").write_text("x")
    D.write_events(D.folder_events(spark, str(inbox), places[0]), places[1], places[2]).awaitTermination(120)
    D.write_events(D.folder_events(spark, str(inbox), places[0]), places[1], places[2]).awaitTermination(120)
    assert sorted(r.file_name for r in D.read_events(spark, places[1]).collect()) == ["a.txt", "b.txt"]
