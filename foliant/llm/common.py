"""Small Spark helpers shared by the operators of this package."""

from __future__ import annotations

import gc
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.session import shared_dir, ship_package

#: Fewest and most bits of a membership bitmap (8 to 128 MB), and bits per id between them.
BITMAP_BITS = 1 << 26
MOST_BITMAP_BITS = 1 << 30
BITS_PER_ID = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """New folder below the one that driver and executors share, as named by ``spark.checkpoint.dir``."""
    return f"{shared_dir(spark).rstrip('/')}/foliant-llm/{purpose}-{uuid.uuid4().hex}"


def saved(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the shared folder and read it back: ends the lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Intermediate tables of one computation, deleted together once its result is stored."""

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark, self.root, self.count = spark, shared_folder(spark, purpose), 0

    def saved(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table below the shared folder and read it back, like ``saved``."""
        return self.stored(df, name)[0]

    def stored(self, df: DataFrame, name: str) -> tuple[DataFrame, str]:
        """The table as read back, and the folder it lies in."""
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def settle(self) -> None:
        """Let go of the shuffle files of finished jobs.

        Spark deletes them when the driver's garbage collector finds their jobs
        gone, which on an idle driver may be much later.
        """
        gc.collect()
        self.spark._jvm.System.gc()

    def discard(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@dataclass(frozen=True)
class Bitmap:
    """Broadcast membership bitmap of ids: false positives only."""

    bits: int
    shared: Broadcast

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        """Which 64-bit hashes may be in it."""
        held = self.shared.value
        place = hashes.astype(np.int64) & (self.bits - 1)
        return (held[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


def bitmap_of(ids: DataFrame, column: str, hashed: bool = False) -> Bitmap:
    """Bitmap of the ids of a stored table.

    It thins out rows before a join that decides exactly.  Its size follows the
    number of ids up to ``MOST_BITMAP_BITS``, which bounds the broadcast; with
    still more ids it lets more rows through, and nothing else changes.
    ``hashed`` ids are taken by their low bits, others are hashed first.

    The buckets are merged by all tasks of the aggregate; only then they are put
    into pieces of ``BITMAP_BITS``.  The driver fetches piece after piece, each
    by a job of its own, which for the aggregate's many small tasks would take
    far longer than the work.
    """
    bits = min(max(BITMAP_BITS, 1 << (BITS_PER_ID * max(ids.count(), 1) - 1).bit_length()), MOST_BITMAP_BITS)
    key = F.col(column) if hashed else F.xxhash64(column)
    # Spark's bucket numbers and positions count from 1: value v is bit v - 1.
    bit = F.pmod(key, F.lit(bits)) + 1
    rows = (
        ids.filter(F.col(column).isNotNull())
        .select(bit.alias("bit"))
        .groupBy(F.bitmap_bucket_number("bit").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    )
    held = np.zeros(bits // 8, dtype=np.uint8)
    for row in rows.repartition(max(bits // BITMAP_BITS, 1)).toLocalIterator():
        part = np.frombuffer(bytes(row["bits"]), dtype=np.uint8)
        start = (row["bucket"] - 1) * len(part)
        held[start : start + len(part)] |= part
    return Bitmap(bits, ids.sparkSession.sparkContext.broadcast(held))


def maybe_in(df: DataFrame, column: str, bitmap: Bitmap) -> tuple[DataFrame, str]:
    """``df`` with a flag that is false only for rows whose id is surely not in the bitmap, and the flag's name."""
    names, taken = df.columns, set(df.columns)
    key, flag = fresh(taken, "key"), fresh(taken, "maybe")
    hashed = df.withColumn(key, F.xxhash64(column))
    schema = df.withColumn(flag, F.lit(True)).schema

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            hit = bitmap.may_hold(batch.column(key).fill_null(0).to_numpy(zero_copy_only=False))
            columns = [batch.column(n) for n in names] + [pa.array(hit)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, flag])

    return hashed.mapInArrow(run, schema), flag


#: Rows of a lookup table that may be broadcast; above it the join is left to shuffle.
SMALL_ROWS = 100_000


def numbered(stored: DataFrame, group: list[str], order: list[str], scratch: Scratch) -> DataFrame:
    """``stored`` with ``pos``, the place of a row within its group from 0, and ``total``, the rows of the group.

    Built-in functions only.  Rows are ranged by (group, order), so that no
    group is one task's, and each range numbers its own; what stands before a
    range is a running sum over one row per range and group.  ``order`` should
    end in a column that tells equal rows apart, or they share a range.
    ``stored`` is read twice (ranging samples it), hence a written table.
    """
    taken = set(stored.columns)
    part, at, shift = (fresh(taken, name) for name in ("part", "at", "shift"))
    id_ = F.monotonically_increasing_id()  # range number and place in the range
    ranged = stored.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    ranged = scratch.saved(ranged.withColumn(part, F.shiftright(id_, 33)).withColumn(at, id_.bitwiseAND(F.lit((1 << 33) - 1))), "ranged")
    counts = ranged.groupBy(*group, part).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("low"))
    before = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = scratch.saved(
        counts.select(
            *group,
            part,
            (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("low")).alias(shift),
            F.sum("n").over(Window.partitionBy(*group)).alias("total"),
        ),
        "bases",
    )
    return (
        ranged.join(small(bases), [*group, part])
        .withColumn("pos", F.col(at) + F.col(shift))
        .drop(part, at, shift)
    )


def small(stored: DataFrame) -> DataFrame:
    """A stored lookup table, marked for broadcast where its counted rows allow it."""
    return F.broadcast(stored) if stored.count() <= SMALL_ROWS else stored


def fresh(taken: set[str], name: str) -> str:
    """A column name that no column has."""
    held = {t.lower() for t in taken}
    while name.lower() in held:
        name = f"_{name}"
    taken.add(name)
    return name
