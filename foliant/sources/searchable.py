"""Indexes of the supplied tables, stored once per data folder."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import blockmax, names
from foliant.session import shared_dir
from foliant.sources import tables, vectors


class Searchable(NamedTuple):
    """Stored tables of an inverted index over files."""

    postings: DataFrame
    lengths: DataFrame
    #: postings in blocks with bounds, and the corpus totals
    blocks: DataFrame
    totals: DataFrame
    #: trigrams of file names, and the names
    grams: DataFrame
    names: DataFrame


def stored_folder(spark: SparkSession, sf_dir: str, name: str, inputs: tuple[str, ...], write: Callable[[str], None]) -> str:
    """Folder that ``write`` filled, from tables as they are now.

    It is written when it is missing or a table has changed, and appears as a
    whole: sessions that build at once do not disturb each other.
    """
    Path = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    seen = [sf_dir]
    for table in inputs:
        path = Path(f"{sf_dir.rstrip('/')}/{table}.parquet")
        system = path.getFileSystem(conf)
        files = system.listFiles(path, True)
        while files.hasNext():
            status = files.next()
            seen.append(f"{status.getPath()} {status.getLen()} {status.getModificationTime()}")
    folder = f"{shared_dir(spark).rstrip('/')}/search/{name}-{zlib.crc32(chr(10).join(sorted(seen)).encode()):08x}"
    vectors.publish(spark, folder, write)
    return folder


def searchable(spark: SparkSession, sf_dir: str, name: str, inputs: tuple[str, ...], build: Callable[[], DataFrame]) -> Searchable:
    """The stored inverted index ``name`` over files that ``build`` makes from the input tables.

    Blocks are sorted by token, so a query reads the row groups of its tokens
    alone; postings are a view of them.
    """

    def write(folder: str) -> None:
        write_search_index(build(), folder)

    folder = stored_folder(spark, sf_dir, name, inputs, write)
    return read_search_index(spark, folder)


#: Schemas of the stored parts, so that reading them costs no look into their files.
SCHEMAS = {
    "lengths": "id bigint, n_tokens bigint",
    "blocks": blockmax.BLOCKS,
    "totals": "n_files bigint, n_tokens bigint",
    "grams": "gram string, id bigint",
    "names": "id bigint, file_name string",
}


def read_search_index(spark: SparkSession, folder: str) -> Searchable:
    """Postings are the places that blocks hold; a filter of tokens reaches the files of the blocks."""
    parts = {n: spark.read.schema(s).parquet(f"{folder}/{n}") for n, s in SCHEMAS.items()}
    blocks = parts.pop("blocks").filter(F.col("token").isNotNull())
    return Searchable(postings=blockmax.postings_of(blocks), blocks=blocks.drop("places"), **parts)


def write_search_index(files: DataFrame, folder: str) -> None:
    """Tokenise, group and store all parts of an index below ``folder``."""
    spark = files.sparkSession
    keep = stored(spark)
    blockmax.indexed_blocks(files, keep).write.parquet(f"{folder}/blocks")
    keep.discard()
    blockmax.lengths_of(spark.read.schema(blockmax.BLOCKS).parquet(f"{folder}/blocks")).write.parquet(f"{folder}/lengths")
    blockmax.corpus_totals(spark.read.schema(SCHEMAS["lengths"]).parquet(f"{folder}/lengths")).write.parquet(f"{folder}/totals")
    names.layout_name_grams(names.build_name_grams(files)).write.parquet(f"{folder}/grams")
    files.select("id", "file_name").repartitionByRange("id").sortWithinPartitions("id").write.parquet(f"{folder}/names")


def vector_index(spark: SparkSession, sf_dir: str) -> vectors.VectorIndex:
    """The stored chunks of ``documents`` with their vectors, by cluster."""

    def write(folder: str) -> None:
        embedded = tables.embedded_chunks(spark, sf_dir, keep=("file_path", "file_name"))
        vectors.write_index(embedded, folder, tables.vector_table(spark, sf_dir))

    return vectors.read_index(spark, stored_folder(spark, sf_dir, "vectors", ("documents", "embeddings"), write))


class stored:  # noqa: N801  (used like a function)
    """Writes intermediate tables of one computation below a folder of its own, and reads them back."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark).rstrip('/')}/work/{uuid.uuid4().hex}"

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def discard(self) -> None:
        """Delete the tables, once nothing is read from them any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
