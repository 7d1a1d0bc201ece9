"""Substring search in file names by an index of trigrams.

A name that contains a substring contains all its trigrams.  The index lists,
for each trigram, the files whose name has it; intersecting the lists of a
keyword leaves few names, on which the pattern itself then decides.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as X

GRAM = 3


def _grams(text: Column) -> Column:
    last = F.length(text) - (GRAM - 1)
    places = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substr(text, i, F.lit(GRAM))))


def build_name_grams(files: DataFrame) -> DataFrame:
    """(gram, id) of every trigram of the folded file names."""
    folded = X.fold_ascii_case(F.coalesce("file_name", F.lit("")))
    return files.select("id", F.explode(_grams(folded)).alias("gram")).select("gram", "id")


def layout_name_grams(grams: DataFrame) -> DataFrame:
    """Order for storage; the id spreads a trigram that most names have."""
    return grams.repartitionByRange("gram", "id").sortWithinPartitions("gram", "id")


def pattern_grams(pattern: str) -> list[str]:
    """Trigrams that every match of a LIKE pattern has; ``%`` and ``_`` stand for anything."""
    runs = re.split(r"[%_]", pattern)
    return sorted({run[i : i + GRAM] for run in runs for i in range(len(run) - GRAM + 1)})


def names_like(names: DataFrame, grams: DataFrame, pattern: str) -> DataFrame:
    """Ids of files (id, file_name) whose folded name is LIKE ``%pattern%``.

    A pattern without a run of three characters is looked for in all names.
    """
    wanted = pattern_grams(pattern)
    if wanted:
        lists = grams.filter(F.col("gram").isin(wanted))
        ids = lists.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(wanted)).select("id")
        names = names.join(ids, "id", "left_semi")
    return names.filter(X.fold_ascii_case(F.col("file_name")).like(f"%{pattern}%")).select("id")
