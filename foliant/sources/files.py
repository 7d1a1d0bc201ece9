"""Folders as sources: scans, listings and a stream of arriving files."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.errors import DesktopDirNotFound, InvalidPath
from foliant.functions import paths as P

DEFAULT_FOLDER = "Foliant"
SCAN_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def default_watch_dir(home: str | None = None) -> str:
    """Folder watched unless another one is named; not created here."""
    base = home if home is not None else os.path.expanduser("~")
    if not base or not os.path.isabs(base):
        raise DesktopDirNotFound("home folder is not available")
    return os.path.join(base, "Desktop", DEFAULT_FOLDER)


def resolve_watch_dir(override: str | None = None) -> str:
    """The folder to watch: an absolute override, or the default one."""
    if override is None:
        return default_watch_dir()
    if not override.strip():
        raise InvalidPath("watch path is empty")
    if "://" not in override and not os.path.isabs(override):
        raise InvalidPath(f"watch path is not absolute: {override}")
    return override


def _plain_path():
    """Path without the ``file:`` scheme that the scan puts in front."""
    return F.regexp_replace("path", "^file:/*", "/")


def scan(spark: SparkSession, folder: str, skip_hidden: bool = True) -> DataFrame:
    """Files directly in a folder: (path, file_name, modified_at, length, content).

    Spark's own listing leaves out names starting with ``.`` or ``_``.
    A plan that does not use ``content`` only lists; filters on ``length``
    reach the source, so oversized files are not opened.
    """
    found = spark.read.format("binaryFile").load(resolve_watch_dir(folder))
    return _shaped(found, skip_hidden)


def _shaped(found: DataFrame, skip_hidden: bool) -> DataFrame:
    named = found.withColumn("path", _plain_path()).withColumn("file_name", P.base_name(F.col("path")))
    return named.filter(~P.is_hidden_or_system(F.col("file_name"), skip_hidden)).select(
        "path", "file_name", F.col("modificationTime").alias("modified_at"), "length", "content"
    )


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(file_path, file_name) of a folder, for reconciliation."""
    return scan(spark, folder, skip_hidden=False).select(F.col("path").alias("file_path"), "file_name")


def arrivals(spark: SparkSession, folder: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Stream of files arriving in a folder, each once; edits are not reported.

    ``max_files_per_trigger`` bounds how much is taken on at a time.
    """
    reader = spark.readStream.format("binaryFile").schema(SCAN_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return _shaped(reader.load(resolve_watch_dir(folder)), skip_hidden=True)
