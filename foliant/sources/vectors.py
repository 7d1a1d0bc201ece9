"""Embedded chunks stored by cluster, so that a vector query reads the clusters that can still win.

Each vector lies in the cluster of its nearest centre, and its angle to that
centre is stored beside it.  By the triangle inequality on the sphere, the
angle between a query and a vector is at least the difference of their angles
to the centre.  That bounds every cosine of a cluster, and of any range of
angles within it, before a row is read.

Centres come from a bounded sample (``SAMPLE`` vectors by hash); they decide
how much is read, never what is found.  Vectors of another width than the
centres', and zero vectors, have no angle: they form the cluster ``LOOSE``,
which every query reads.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Vectors from which centres are found, and most centres.
SAMPLE = 10_000
MAX_CLUSTERS = 1_024
LOOSE = -1
#: Angles are exact to far less than this.
ANGLE_SLACK = 1e-6

ROWS = (
    "file_id bigint, chunk_index int, file_path string, file_name string, chunk_text string, chunk_offset bigint,"
    " embedding array<float>, angle double, cluster int"
)
COLUMNS = [c.split()[0] for c in ROWS.split(", ")]


@dataclass(frozen=True)
class Cluster:
    number: int
    size: int
    low: float
    high: float
    centre: np.ndarray | None

    def best_cosine(self, angle: float) -> float:
        """No vector of the cluster has a higher cosine to a query at this angle from the centre."""
        if self.centre is None:
            return 1.0
        gap = max(0.0, angle - self.high, self.low - angle)
        return float(np.cos(min(max(0.0, gap - ANGLE_SLACK), np.pi)))


@dataclass(frozen=True)
class VectorIndex:
    """Stored rows (``ROWS``, in folders by cluster), and what is known of each cluster."""

    rows: DataFrame
    clusters: list[Cluster]

    @property
    def centres(self) -> np.ndarray:
        own = [c.centre for c in self.clusters if c.centre is not None]
        return np.array(own) if own else np.zeros((0, 0))


def spherical_centres(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centres of unit vectors by k-means on the sphere."""
    centres = sample[np.unique(np.linspace(0, len(sample) - 1, k).astype(int))].copy()
    for _ in range(rounds):
        nearest = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        norms = np.sqrt((sums * sums).sum(axis=1))
        moved = norms > 1e-12
        centres[moved] = sums[moved] / norms[moved, None]
    return centres


def units_of(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the rows that have this width and are not zero, and which rows these are."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == width)
    values = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), width)
    norms = np.sqrt((values * values).sum(axis=1))
    good = norms > 1e-12
    return values[good] / norms[good, None], rows[good]


def place(vector: Column, centres: np.ndarray) -> Column:
    """(cluster, angle) of each vector."""

    @F.arrow_udf("struct<cluster:int,angle:double>")
    def nearest(column: pa.Array) -> pa.Array:
        cluster, angle = np.full(len(column), LOOSE, np.int32), np.zeros(len(column))
        if centres.size:
            units, rows = units_of(column, centres.shape[1])
            cosines = units @ centres.T
            best = np.argmax(cosines, axis=1) if len(rows) else np.zeros(0, int)
            cluster[rows] = best
            angle[rows] = np.arccos(np.clip(cosines[np.arange(len(rows)), best], -1.0, 1.0))
        return pa.StructArray.from_arrays([pa.array(cluster), pa.array(angle)], names=["cluster", "angle"])

    return nearest(vector)


def write_index(embedded: DataFrame, folder: str, vectors: DataFrame | None = None, clusters: int | None = None) -> None:
    """Store embedded chunks (``ROWS`` without cluster and angle) below ``folder``.

    ``vectors`` may name a cheaper source of (embedding) to sample from.  The
    number of clusters follows from the sample unless given.
    """
    source = embedded if vectors is None else vectors
    width = source.filter(F.size("embedding") > 0).groupBy(F.size("embedding").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    centres = np.zeros((0, 0))
    if width:
        sized = source.filter(F.size("embedding") == width[0]["w"]).select("embedding")
        # the smallest hashes: a sample that does not depend on how rows are dealt
        rows = sized.orderBy(F.xxhash64("embedding")).limit(SAMPLE).collect()
        units, _ = units_of(pa.array([r["embedding"] for r in rows], pa.list_(pa.float64())), width[0]["w"])
        if len(units):
            centres = spherical_centres(units, min(clusters or isqrt(len(units)), MAX_CLUSTERS, len(units)))
    placed = embedded.withColumn("at", place(F.col("embedding"), centres)).select("*", "at.cluster", "at.angle").drop("at")
    # rebalancing splits a large cluster over several tasks and files
    ordered = placed.select(*COLUMNS).hint("rebalance", "cluster").sortWithinPartitions("cluster", "angle")
    ordered.write.partitionBy("cluster").parquet(f"{folder}/rows")
    spark = embedded.sparkSession
    known = spark.read.schema(ROWS).parquet(f"{folder}/rows").groupBy("cluster").agg(
        F.count(F.lit(1)).alias("size"), F.min("angle").alias("low"), F.max("angle").alias("high")
    )
    centre = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cluster int, centre array<double>")
    known.join(F.broadcast(centre), "cluster", "left").write.parquet(f"{folder}/clusters")


def read_index(spark: SparkSession, folder: str) -> VectorIndex:
    """At most ``MAX_CLUSTERS`` + 1 rows come to the driver."""
    schema = "cluster int, size long, low double, high double, centre array<double>"
    rows = sorted(spark.read.schema(schema).parquet(f"{folder}/clusters").collect(), key=lambda r: r["cluster"])
    clusters = [
        Cluster(r["cluster"], r["size"], r["low"], r["high"], None if r["centre"] is None else np.array(r["centre"])) for r in rows
    ]
    # an empty index has no files that a schema could be read from
    return VectorIndex(spark.read.schema(ROWS).parquet(f"{folder}/rows"), clusters)


def publish(spark: SparkSession, folder: str, write: Callable[[str], None]) -> None:
    """Write a folder's content under another name and give it its own when it is whole.

    Of sessions that build at once the first wins, and none overwrites what another reads.
    """
    Path = spark._jvm.org.apache.hadoop.fs.Path
    target, draft = Path(folder), Path(f"{folder}-draft-{uuid.uuid4().hex}")
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(target):
        return
    write(draft.toString())
    if system.exists(target) or not system.rename(draft, target):
        system.delete(draft, True)
