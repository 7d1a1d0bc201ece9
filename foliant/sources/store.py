"""Index snapshots as parquet in a shared folder, published in generations."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant import schema
from foliant.errors import ConcurrentUpdate, IndexNotInitialized
from foliant.session import shared_dir

# Sort keys of each relation: readers skip row groups by their minima and maxima.
LAYOUT = {
    "files": ("file_path",),
    "chunks": ("file_id", "chunk_index"),
    "embeddings": ("file_id", "chunk_index"),
    "postings": ("token", "id", "col", "pos"),
    "doc_stats": ("id",),
}
SCHEMAS = {
    "files": schema.FILES,
    "chunks": schema.CHUNKS,
    "embeddings": schema.EMBEDDINGS,
    "postings": schema.POSTINGS,
}


# What a change replaces in each relation.
KEYS = {"files": "id", "chunks": "file_id", "embeddings": "file_id", "postings": "id", "doc_stats": "id"}
#: Changes laid over a relation before it is written anew.
MAX_CHANGES = 8


class IndexStore:
    """Relations under one folder, in generations.

    A relation is a full version and the changes laid over it: each change
    holds new rows, and the ids whose older rows they replace.  So a batch
    writes what it touches, however large the index is; after ``MAX_CHANGES``
    the relation is written anew.

    A generation names all these folders and becomes visible as one small file
    once they are written.  A job that dies leaves the generation before it in
    place, readers never mix two, and of two writers that started from the same
    generation the later one is refused.
    """

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = (root or f"{shared_dir(spark)}/index").rstrip("/")

    def _files(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/_generations")
        return jvm, path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def generation(self) -> tuple[int, dict]:
        """Number and content of the newest generation: relation folders, and the highest id given out."""
        _, path, system = self._files()
        if not system.exists(path):
            return 0, {"relations": {}, "top_id": 0}
        names = [s.getPath().getName() for s in system.listStatus(path)]
        numbers = [int(n[4:-5]) for n in names if n.startswith("gen-") and n.endswith(".json")]
        if not numbers:
            return 0, {"relations": {}, "top_id": 0}
        row = self.spark.read.text(f"{self.root}/_generations/gen-{max(numbers):012d}.json", wholetext=True).first()
        return max(numbers), json.loads(row["value"])

    def read(self, folder: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{folder}")

    def load(self, name: str) -> DataFrame:
        parts = self.generation()[1]["relations"].get(name)
        if parts is None:
            raise IndexNotInitialized(f"no snapshot of {name} under {self.root}")
        whole = self.read(parts[0]["rows"])
        for part in parts[1:]:
            whole = whole.join(self.read(part["gone"]), KEYS[name], "left_anti")
            if part["rows"]:
                whole = whole.unionByName(self.read(part["rows"]))
        return whole

    def top_id(self) -> int:
        """No id up to this one is given out again, even when its file is gone."""
        return self.generation()[1]["top_id"]

    def stage(self, name: str, df: DataFrame) -> str:
        """Write a relation without publishing it; returns its folder.

        Rows are ranged on the whole sort key, so rows sharing its first
        column may still spread over several files.
        """
        keys = LAYOUT[name]
        folder = f"{name}/{uuid.uuid4().hex}"
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.parquet(f"{self.root}/{folder}")
        return folder

    def stage_gone(self, name: str, ids: DataFrame) -> str:
        """Write the ids, in the first column, whose rows of a relation a change replaces."""
        folder = f"{name}/{uuid.uuid4().hex}"
        ids.select(F.col(ids.columns[0]).alias(KEYS[name])).distinct().write.parquet(f"{self.root}/{folder}")
        return folder

    def publish(
        self, base: int, full: dict[str, str] | None = None, changes: dict[str, tuple[str | None, str]] | None = None
    ) -> None:
        """Make staged folders visible together, on top of generation ``base``.

        ``full`` replaces relations, ``changes`` lays (rows, ids) over them.
        """
        number, content = self.generation()
        if number != base:
            raise ConcurrentUpdate(f"generation {number} was published while {base} was being changed")
        relations = dict(content["relations"])
        for name, folder in (full or {}).items():
            relations[name] = [{"rows": folder, "gone": None}]
        for name, (rows, gone) in (changes or {}).items():
            relations[name] = [*relations[name], {"rows": rows, "gone": gone}]
        top = content["top_id"]
        for folder in ((full or {}).get("files"), (changes or {}).get("files", (None,))[0]):
            if folder:
                top = max(top, self.read(folder).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0])
        jvm, path, system = self._files()
        system.mkdirs(path)
        draft = jvm.org.apache.hadoop.fs.Path(path, f".{uuid.uuid4().hex}")
        stream = system.create(draft, False)
        stream.write(json.dumps({"relations": relations, "top_id": top}).encode())
        stream.close()
        target = jvm.org.apache.hadoop.fs.Path(path, f"gen-{number + 1:012d}.json")
        if system.exists(target) or not system.rename(draft, target):
            raise ConcurrentUpdate(f"generation {number + 1} is there already")

    def save(self, **relations: DataFrame) -> None:
        """Write whole relations anew and publish them together."""
        base = self.generation()[0]
        self.publish(base, {name: self.stage(name, df) for name, df in relations.items()})

    def change(self, **changes: tuple[DataFrame | None, DataFrame]) -> None:
        """Lay (new rows, replaced ids) over relations and publish them together."""
        base = self.generation()[0]
        staged = {n: (None if rows is None else self.stage(n, rows), self.stage_gone(n, ids)) for n, (rows, ids) in changes.items()}
        self.publish(base, changes=staged)
        self.compact()

    def compact(self) -> None:
        """Write relations with many changes anew."""
        base, content = self.generation()
        long = [n for n, parts in content["relations"].items() if len(parts) > MAX_CHANGES]
        if long:
            self.publish(base, {n: self.stage(n, self.load(n)) for n in long})

    def create(self) -> None:
        """Empty relations, unless there are some already."""
        there = self.generation()[1]["relations"]
        missing = {n: self.spark.createDataFrame([], s) for n, s in SCHEMAS.items() if n not in there}
        if "doc_stats" not in there:
            missing["doc_stats"] = self.spark.createDataFrame([], "id bigint, n_tokens bigint")
        if missing:
            self.save(**missing)
