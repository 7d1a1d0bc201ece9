"""Language identification by bit-sliced n-gram Bloom filters.

All languages share one array of 64-bit slots: bit l of a slot belongs to
language l.  An n-gram is hashed to ``HASHES`` slots, and the AND of these slots
is the set of all languages whose filter contains it, found at once.  A text
sums up, per language, how many of its n-grams that language contains.  A filter
filled to a share f answers yes for f ** HASHES of the absent n-grams, so a
count c of n becomes (c / n - fp) / (1 - fp).  The largest corrected share
decides; ties go to the smaller name.

Training.  N-grams are runs of ``ORDER`` letters of words, folded to lower case
and framed by blanks.  A bounded sample of labelled texts, about ``SAMPLE`` per
language, chosen by a bound on a hash of the id, gives each n-gram's share of a language's
texts; a language holds an n-gram if its share is at least ``LEAST`` there and
at least ``KEEN`` of the largest share in any language.  At most ``CAPACITY``
n-grams per language enter the filter, the most frequent first, so what reaches
the driver is bounded by languages * CAPACITY numbers.

A null text, or one without letters, is ``und`` with score 0, as is any text
when nothing was learned.  Languages beyond 64 are refused.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.llm.arrays import mix, sliced

ORDER = 4
HASHES = 4
SLOTS = 1 << 20
SAMPLE = 2000
CAPACITY = 20_000
LEAST = 0.002
KEEN = 0.5
UNKNOWN = "und"

LETTERS = re.compile(r"[^\W\d_]+")


def grams(text: str) -> np.ndarray:
    """Hashes of the text's letter n-grams, one per place."""
    words = LETTERS.findall(text.lower())
    if not words:
        return np.zeros(0, dtype=np.uint64)
    framed = " " + " ".join(words) + " "
    points = np.frombuffer(framed.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    n = max(1, len(points) - ORDER + 1)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(min(ORDER, len(points))):
        out = mix(out * np.uint64(31) + points[i : i + n])
    return out


def slots(hashes: np.ndarray) -> list[np.ndarray]:
    """The slots of n-grams, by double hashing."""
    step = mix(hashes ^ np.uint64(0x1F83D9AB)) | np.uint64(1)
    return [((hashes + np.uint64(i) * step) & np.uint64(SLOTS - 1)).astype(np.int64) for i in range(HASHES)]


@dataclass(frozen=True)
class Filters:
    """Languages in order of their bits, the bit-sliced slots, and each filter's share of false yes."""

    languages: tuple[str, ...]
    bits: np.ndarray
    false_yes: np.ndarray

    def masks(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), ~np.uint64(0))
        for place in slots(hashes):
            out &= self.bits[place]
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        hashes = grams(text or "")
        if not len(hashes) or not self.languages:
            return UNKNOWN, 0.0
        masks = self.masks(hashes)
        counts = np.array([int((masks >> np.uint64(bit) & np.uint64(1)).sum()) for bit in range(len(self.languages))])
        share = np.clip((counts / len(hashes) - self.false_yes) / (1 - self.false_yes), 0.0, 1.0)
        best = int(np.argmax(share))
        return self.languages[best], float(share[best])


def filters(entries: list[tuple[str, int]]) -> Filters:
    """Bit-sliced filters out of (language, n-gram hash as a signed number)."""
    languages = tuple(sorted({lang for lang, _ in entries}))
    if len(languages) > 64:
        raise ValueError("more than 64 languages")
    bits = np.zeros(SLOTS, dtype=np.uint64)
    for bit, lang in enumerate(languages):
        own = np.array([g for name, g in entries if name == lang], dtype=np.int64).view(np.uint64)
        for place in slots(own):
            bits[place] |= np.uint64(1 << bit)
    fill = np.array([(bits >> np.uint64(b) & np.uint64(1)).mean() for b in range(len(languages))])
    return Filters(languages, bits, fill**HASHES)


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Filters:
    """Fit the filters on ``labelled`` rows with a text and a language."""
    rows = labelled.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
    ).filter("text is not null and lang is not null")
    amounts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("amount")).limit(65).collect()
    if len(amounts) > 64:
        raise ValueError("more than 64 languages")
    if not amounts:
        return filters([])
    spark = labelled.sparkSession
    # a hash bound that lets about SAMPLE texts of each language through
    parts = [(r["lang"], -(1 << 63) + min((1 << 64) - 1, (SAMPLE << 64) // r["amount"])) for r in amounts]
    bounds = F.broadcast(spark.createDataFrame(parts, "lang string, bound long"))
    chosen_rows = rows.join(bounds, "lang").filter(F.xxhash64("id") <= F.col("bound"))
    taken = [(r["lang"], r["texts"]) for r in chosen_rows.groupBy("lang").agg(F.count(F.lit(1)).alias("texts")).collect()]
    if not taken:
        return filters([])
    sample = chosen_rows.join(F.broadcast(spark.createDataFrame(taken, "lang string, texts long")), "lang")

    def distinct_grams(batches):
        for batch in sliced(batches, "text"):
            made, langs, totals = [], [], []
            for text, lang, texts in zip(*(batch.column(c).to_pylist() for c in ("text", "lang", "texts")), strict=True):
                own = np.unique(grams(text))
                made.append(own)
                langs += [lang] * len(own)
                totals += [texts] * len(own)
            joined = np.concatenate(made).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(totals, pa.int64()), pa.array(joined)], names=["lang", "texts", "gram"]
            )

    found = sample.select("lang", "texts", "text").mapInArrow(distinct_grams, "lang string, texts long, gram long")
    share = found.groupBy("lang", "gram").agg((F.count(F.lit(1)) / F.max("texts")).alias("share")).filter(F.col("share") >= LEAST)
    top = Window.partitionBy("gram")
    keen = share.withColumn("most", F.max("share").over(top)).filter(F.col("share") >= KEEN * F.col("most"))
    best = Window.partitionBy("lang").orderBy(F.col("share").desc(), "gram")
    chosen = keen.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= CAPACITY)
    return filters([(r["lang"], r["gram"]) for r in chosen.select("lang", "gram").collect()])


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that is never learned from."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2


def predicted(docs: DataFrame, model: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in sliced(batches, "text"):
            made = [sent.value.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array([m for m, _ in made], pa.string()), pa.array([s for _, s in made], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    own = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"),
        F.col(text_col).alias("text"),
    )
    return own.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
