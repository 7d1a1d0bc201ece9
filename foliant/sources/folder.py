"""A folder as a stream of added, changed and removed files, and a sink that keeps events exactly once.

Spark's own file stream reports arrivals only.  `FolderSource` compares
listings: an offset names a *snapshot*, a stored listing of the folder as far
as it has been reported.  The events of a micro-batch are the difference of
the two snapshots between which it lies, so a batch that runs again, also
after a restart, gives the same events.
"""

from __future__ import annotations

import json
import time
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceStreamArrowWriter,
    DataSourceStreamReader,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from foliant.functions import paths as P
from foliant.session import ship_package
from foliant.sources.files import resolve_watch_dir

#: ``op`` is add, change or remove.  ``ts_ms`` is when the snapshot was taken, ``event_id`` ascends with snapshots.
EVENTS = "event_id long, op string, path string, file_name string, length long, modified_ms long, ts_ms long"
SCAN = "path string, file_name string, modified_at timestamp, length long, content binary"
#: Files of a listing that one task compares.
BUCKET_FILES = 50_000
LISTED = pa.schema([("path", pa.string()), ("length", pa.int64()), ("modified_us", pa.int64())])


def as_uri(folder: str) -> str:
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"


@dataclass(frozen=True)
class Place:
    """A folder on a file system that tasks and driver reach."""

    system: fs.FileSystem
    base: str
    #: what stands before ``base`` in the paths that events carry
    prefix: str

    @classmethod
    def of(cls, folder: str) -> Place:
        uri = as_uri(folder.rstrip("/"))
        system, base = fs.FileSystem.from_uri(uri)
        parts = urlsplit(uri)
        if parts.scheme in ("", "file"):
            return cls(system, base, "")
        return cls(system, base, uri.removesuffix(base) if uri.endswith(base) else f"{parts.scheme}://")

    def files(self) -> Iterator[tuple[str, int, int]]:
        """Regular files directly in the folder: path, length, time of change in microseconds."""
        found = self.system.get_file_info(fs.FileSelector(self.base, recursive=False, allow_not_found=True))
        for info in found:
            if info.type == fs.FileType.File:
                yield f"{self.prefix}{info.path}", info.size, (info.mtime_ns or 0) // 1000

    def names(self) -> list[str]:
        return [i.base_name for i in self.system.get_file_info(fs.FileSelector(self.base, recursive=False, allow_not_found=True))]

    def read(self, name: str) -> bytes:
        with self.system.open_input_stream(f"{self.base}/{name}") as stream:
            return stream.read()

    def publish(self, name: str, data: bytes) -> None:
        """Write a file that is whole as soon as it has its name."""
        draft = f"{self.base}/.{name}-{uuid.uuid4().hex}"
        with self.system.open_output_stream(draft) as stream:
            stream.write(data)
        self.system.move(draft, f"{self.base}/{name}")


def bucket_of(path: str, buckets: int) -> int:
    return zlib.crc32(path.encode()) % buckets


class Snapshots:
    """Stored listings: one small file names a snapshot, its rows lie in buckets by path."""

    def __init__(self, folder: str):
        self.place = Place.of(folder)

    def last(self) -> int:
        found = [int(n[9:-5]) for n in self.place.names() if n.startswith("snapshot-") and n.endswith(".json")]
        return max(found, default=0)

    def about(self, number: int) -> dict:
        """Folder, number of buckets and time of a snapshot; snapshot 0 is empty."""
        if number == 0:
            return {"folder": None, "buckets": 1, "taken_ms": 0}
        return json.loads(self.place.read(f"snapshot-{number:012d}.json"))

    def bucket(self, about: dict, i: int) -> dict[str, tuple[int, int]]:
        if about["folder"] is None:
            return {}
        path = f"{self.place.base}/{about['folder']}/{i:06d}.parquet"
        with self.place.system.open_input_file(path) as file:
            rows = pq.read_table(file)
        return {p: (n, m) for p, n, m in zip(*(rows.column(c).to_pylist() for c in LISTED.names), strict=True)}

    def load(self, number: int) -> dict[str, tuple[int, int]]:
        about = self.about(number)
        out: dict[str, tuple[int, int]] = {}
        for i in range(about["buckets"]):
            out.update(self.bucket(about, i))
        return out

    def store(self, number: int, files: dict[str, tuple[int, int]]) -> None:
        # a power of two, so that buckets of snapshots of different sizes nest
        buckets = 1 << max(0, (len(files) // BUCKET_FILES).bit_length())
        split: list[list[str]] = [[] for _ in range(buckets)]
        for path in sorted(files):
            split[bucket_of(path, buckets)].append(path)
        folder = f"rows-{number:012d}-{uuid.uuid4().hex}"
        self.place.system.create_dir(f"{self.place.base}/{folder}", recursive=True)
        for i, paths in enumerate(split):
            rows = pa.table([paths, [files[p][0] for p in paths], [files[p][1] for p in paths]], schema=LISTED)
            with self.place.system.open_output_stream(f"{self.place.base}/{folder}/{i:06d}.parquet") as stream:
                pq.write_table(rows, stream)
        about = {"folder": folder, "buckets": buckets, "taken_ms": time.time_ns() // 1_000_000}
        self.place.publish(f"snapshot-{number:012d}.json", json.dumps(about).encode())

    def forget_before(self, number: int) -> None:
        """Delete snapshots that no batch can start from any more, and rows that no snapshot names."""
        for name in self.place.names():
            if name.startswith("snapshot-") and int(name[9:-5]) < number:
                self.place.system.delete_file(f"{self.place.base}/{name}")
            elif name.startswith("rows-") and int(name[5:17]) < number:
                self.place.system.delete_dir(f"{self.place.base}/{name}")


def differences(old: dict[str, tuple[int, int]], new: dict[str, tuple[int, int]]) -> Iterator[tuple[str, str]]:
    """(path, op) of files that differ, by path."""
    for path in sorted(old.keys() | new.keys()):
        if path not in new:
            yield path, "remove"
        elif path not in old:
            yield path, "add"
        elif old[path] != new[path]:
            yield path, "change"


class Span(InputPartition):
    """One bucket of the difference of two snapshots."""

    def __init__(self, start: dict, end: dict, number: int, bucket: int, buckets: int):
        self.start, self.end, self.number, self.bucket, self.buckets = start, end, number, bucket, buckets


class FolderStream(DataSourceStreamReader):
    """Offsets are ``{"snapshot": n}``; ``most`` bounds the events of a batch, the rest comes with the next ones."""

    def __init__(self, options: dict):
        self.folder, self.state = options["path"], options["snapshots"]
        self.most = int(options.get("maxfilespertrigger", 0))
        self.seen: tuple[int, dict] | None = None

    def initialOffset(self) -> dict:
        return {"snapshot": 0}

    def latestOffset(self) -> dict:
        snapshots = Snapshots(self.state)
        number = snapshots.last()
        if self.seen is None or self.seen[0] != number:
            self.seen = (number, snapshots.load(number))
        old = self.seen[1]
        new = {path: (size, changed) for path, size, changed in Place.of(self.folder).files()}
        if new == old:
            return {"snapshot": number}
        if self.most:
            reported = dict(old)
            for path, op in list(differences(old, new))[: self.most]:
                if op == "remove":
                    del reported[path]
                else:
                    reported[path] = new[path]
            new = reported
        snapshots.store(number + 1, new)
        self.seen = (number + 1, new)
        return {"snapshot": number + 1}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        snapshots = Snapshots(self.state)
        first, last = snapshots.about(start["snapshot"]), snapshots.about(end["snapshot"])
        if start == end:
            return []
        buckets = max(first["buckets"], last["buckets"])
        return [Span(first, last, end["snapshot"], i, buckets) for i in range(buckets)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        snapshots = Snapshots(self.state)
        sides = []
        for about in (partition.start, partition.end):
            rows = snapshots.bucket(about, partition.bucket % about["buckets"])
            sides.append({p: v for p, v in rows.items() if bucket_of(p, partition.buckets) == partition.bucket})
        old, new = sides
        found = list(differences(old, new))
        ids = [(partition.number << 36) + (i * partition.buckets + partition.bucket) for i in range(len(found))]
        facts = [new.get(path) or old[path] for path, _ in found]
        columns = [
            pa.array(ids, pa.int64()),
            pa.array([op for _, op in found], pa.string()),
            pa.array([path for path, _ in found], pa.string()),
            pa.array([path.rsplit("/", 1)[-1] for path, _ in found], pa.string()),
            pa.array([size for size, _ in facts], pa.int64()),
            pa.array([changed // 1000 for _, changed in facts], pa.int64()),
            pa.array([partition.end["taken_ms"]] * len(found), pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in EVENTS.split(", ")])

    def commit(self, end: dict) -> None:
        Snapshots(self.state).forget_before(end["snapshot"])


class FolderSource(DataSource):
    """Options: ``path`` (the folder), ``snapshots`` (where listings are kept), ``maxFilesPerTrigger``."""

    @classmethod
    def name(cls) -> str:
        return "foliant_folder"

    def schema(self) -> str:
        return EVENTS

    def streamReader(self, schema: StructType) -> FolderStream:
        return FolderStream({k.lower(): v for k, v in self.options.items()})


def folder_events(
    spark: SparkSession, folder: str, snapshots: str, max_files_per_trigger: int | None = None, skip_hidden: bool = True
) -> DataFrame:
    """Stream of ``EVENTS`` of the files directly in a folder: those there at first, then every later difference.

    ``snapshots`` is a folder of this stream's own, reachable by all
    executors; a stream goes on with the checkpoint and the snapshots it
    stopped with.  A file that comes and goes, or changes twice, between two
    listings is seen as it is at the second one.  ``max_files_per_trigger``
    bounds the events of a batch.
    """
    ship_package(spark)
    spark.dataSource.register(FolderSource)
    reader = spark.readStream.format(FolderSource.name()).option("path", resolve_watch_dir(folder)).option("snapshots", snapshots)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load().filter(~P.is_hidden_or_system(F.col("file_name"), skip_hidden))


def with_content(events: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Files (path) of events as a scan gives them: (path, file_name, modified_at, length, content).

    Each file is looked up and read where its row is.  Files above
    ``max_bytes`` are not opened, and have no content; files that are gone
    meanwhile are left out, their removal is another event.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for path in batch.column("path").to_pylist():
                system, own = fs.FileSystem.from_uri(as_uri(path))
                info, content = system.get_file_info(own), None
                if info.type != fs.FileType.File:
                    continue
                try:
                    if max_bytes is None or info.size <= max_bytes:
                        with system.open_input_stream(own) as stream:
                            content = stream.read()
                except FileNotFoundError:
                    continue
                rows.append((path, path.rsplit("/", 1)[-1], (info.mtime_ns or 0) // 1000, info.size, content))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.string(), pa.string(), pa.timestamp("us", tz="UTC"), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["path", "file_name", "modified_at", "length", "content"]
            )

    return events.select("path").mapInArrow(run, SCAN)


# --------------------------------------------------------------------------
# sink


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class EventWriter(DataSourceStreamArrowWriter):
    """Tasks write drafts; a batch becomes visible as one small file that names them.

    The name of that file is the number of the batch.  A batch that runs again
    finds it and drops its own drafts, so every event is kept once.
    """

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        place = Place.of(self.folder)
        names, writer, sink = [], None, None
        for batch in iterator:
            if batch.num_rows and writer is None:
                names.append(f"part-{uuid.uuid4().hex}.parquet")
                place.system.create_dir(place.base, recursive=True)
                sink = place.system.open_output_stream(f"{place.base}/{names[0]}")
                writer = pq.ParquetWriter(sink, batch.schema)
            if batch.num_rows:
                writer.write_batch(batch)
        if writer is not None:
            writer.close()
            sink.close()
        return Written(names)

    def _drop(self, messages: Sequence[Written | None]) -> None:
        place = Place.of(self.folder)
        for message in messages:
            for name in message.names if message else ():
                place.system.delete_file(f"{place.base}/{name}")

    def commit(self, messages: Sequence[Written | None], batchId: int) -> None:
        place = Place.of(self.folder)
        place.system.create_dir(place.base, recursive=True)
        name = f"batch-{batchId:012d}.json"
        if name in place.names():
            self._drop(messages)
            return
        place.publish(name, json.dumps([n for m in messages if m for n in m.names]).encode())

    def abort(self, messages: Sequence[Written | None], batchId: int) -> None:
        self._drop(messages)


class EventSink(DataSource):
    """Streaming sink; the option ``path`` names its folder."""

    @classmethod
    def name(cls) -> str:
        return "foliant_events"

    def streamWriter(self, schema: StructType, overwrite: bool) -> EventWriter:
        return EventWriter(self.options["path"])


def write_events(events: DataFrame, folder: str, checkpoint: str, interval: str | None = None):
    """Start a query that keeps a stream in a folder, each row once; without an interval, drain it and stop."""
    spark = events.sparkSession
    spark.dataSource.register(EventSink)
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    writer = events.writeStream.format(EventSink.name()).option("path", folder).option("checkpointLocation", checkpoint)
    return writer.trigger(**trigger).start()


def read_events(spark: SparkSession, folder: str, schema: str | StructType = EVENTS) -> DataFrame:
    """What a sink has committed; drafts of batches that failed are not seen."""
    place = Place.of(folder)
    found = sorted(n for n in place.names() if n.startswith("batch-") and n.endswith(".json"))
    parts = [f"{folder.rstrip('/')}/{name}" for batch in found for name in json.loads(place.read(batch))]
    return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)
