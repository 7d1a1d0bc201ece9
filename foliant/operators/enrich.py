"""Summaries and tags of file contents."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions import text as X
from foliant.functions import vectors as V
from foliant.functions.embed import Embedder, embed
from foliant.functions.prompts import SUMMARY_PROMPT, TAGS_PROMPT, chat_prompt, document_prompt, system_prompt
from foliant.session import shared_dir

SUMMARY_SENTENCES = 3
MAX_TAGS = 7
TAG_SIMILARITY = 0.8


def content_error(text: Column) -> Column:
    """Why a text is not enriched, null when it is."""
    trimmed = X.trim_ws(F.coalesce(text, F.lit("")))
    return F.when(trimmed == "", "empty_content").when(
        F.octet_length(trimmed) < X.MIN_CONTENT_BYTES, "content_too_short"
    )


def sentences(files: DataFrame, text: str = "text_content") -> DataFrame:
    """(id, sentence_index, sentence) of texts long enough to summarise."""
    split = X.split_sentences(F.col(text))
    return (
        files.filter(content_error(F.col(text)).isNull())
        .select("id", F.posexplode(split).alias("sentence_index", "sentence"))
    )


def first_sentences(files: DataFrame, text: str = "text_content") -> DataFrame:
    """(id, summary, error_code): the leading sentences, for use without a model."""
    cut = X.split_sentences(F.coalesce(F.col(text), F.lit("")))
    error = content_error(F.col(text))
    coded = files.select("id", error.alias("error"), F.when(error.isNull(), cut).alias("parts"))
    empty = F.col("error").isNull() & (F.size("parts") == 0)
    return coded.select(
        "id",
        F.coalesce(F.array_join(F.slice("parts", 1, SUMMARY_SENTENCES), " "), F.lit("")).alias("summary"),
        F.when(empty, "content_too_short").otherwise(F.col("error")).alias("error_code"),
    )


def _in_files(embedded_sentences: DataFrame, *keep: str) -> DataFrame:
    """Sentences in order, all of a file in one partition; vectors as they came, which are narrower than unit vectors."""
    rows = embedded_sentences.select("id", "sentence_index", *keep, "embedding")
    return rows.repartition("id").sortWithinPartitions("id", "sentence_index")


def _whole_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by id, cut between files."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        if rest is not None and rest[-1].column("id")[-1] == batch.column("id")[0]:
            # the file goes on: its rows are joined once it ends
            if batch.column("id")[0] == batch.column("id")[-1]:
                rest.append(rows)
                continue
        elif rest is not None:
            yield pa.concat_tables(rest).combine_chunks()
            rest = None
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(ids, ids[-1]))
        if last:
            yield pa.concat_tables([*(rest or []), rows.slice(0, last)]).combine_chunks()
            rest = None
        rest = [*(rest or []), rows.slice(last)]
    if rest is not None:
        yield pa.concat_tables(rest).combine_chunks()


def _central(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Where each file begins, and the centrality of each sentence."""
    ids = rows.column("id").to_numpy()
    starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    units = V.units(rows.column("embedding").combine_chunks())
    n = np.diff(np.append(starts, len(ids)))
    sums, file = np.add.reduceat(units, starts, axis=0), np.repeat(np.arange(len(starts)), n)
    others = n[file] - 1
    score = (np.einsum("ij,ij->i", units, sums[file]) - np.einsum("ij,ij->i", units, units)) / np.maximum(others, 1)
    return starts, np.where(others > 0, score, 0.0)


def sentence_centrality(embedded_sentences: DataFrame) -> DataFrame:
    """(id, sentence_index, centrality): mean cosine to the other sentences of the file.

    With unit vectors u and their sum S this is (u.S - u.u) / (n - 1), which
    needs one sum per file instead of all pairs of sentences.  One shuffle
    brings the vectors of a file together; a task holds a batch of rows, or
    the sentences of one file.
    """

    def run(batches):
        for rows in _whole_files(batches):
            _, score = _central(rows)
            yield from rows.select(["id", "sentence_index"]).append_column("centrality", pa.array(score)).to_batches()

    return _in_files(embedded_sentences).mapInArrow(run, "id long, sentence_index int, centrality double")


def central_summary(embedded_sentences: DataFrame) -> DataFrame:
    """(id, summary): the three most central sentences, in their original order.

    Input rows are (id, sentence_index, sentence, embedding).  The sentences
    travel with their vectors, and the task that scores them picks.
    """

    def run(batches):
        for rows in _whole_files(batches):
            starts, score = _central(rows)
            at = rows.column("sentence_index").to_numpy()
            file = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(at))))
            order = np.lexsort((at, -np.round(score, 9), file))
            best = order[np.arange(len(order)) - starts[file[order]] < SUMMARY_SENTENCES]
            best = np.sort(best)  # rows are in the order of the text
            texts = rows.column("sentence").take(pa.array(best)).to_pylist()
            ends = np.searchsorted(file[best], np.arange(len(starts) + 1))
            summaries = [" ".join(texts[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]
            ids = rows.column("id").combine_chunks().take(pa.array(starts))
            yield pa.RecordBatch.from_arrays([ids, pa.array(summaries, pa.string())], names=["id", "summary"])

    return _in_files(embedded_sentences, "sentence").mapInArrow(run, "id long, summary string")


@dataclass(frozen=True)
class Counted:
    """Distinct words of a batch of files, by file and word."""

    #: number of files, and of the words and paragraphs of each
    files: int
    totals: np.ndarray
    paragraphs: np.ndarray
    #: per distinct word of a file: the file, the word as its place in ``words``, occurrences, paragraphs with it
    file: np.ndarray
    code: np.ndarray
    tf: np.ndarray
    df: np.ndarray
    words: pa.Array

    @classmethod
    def of(cls, blocks: pa.Array) -> Counted:
        """From the words of each paragraph of each file."""
        paragraphs = blocks.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        inner = blocks.flatten()
        lengths = inner.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        held = inner.flatten().dictionary_encode()
        order = pc.sort_indices(held.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        paragraph = np.repeat(np.arange(len(lengths)), lengths)
        file = np.repeat(np.arange(len(blocks)), paragraphs)[paragraph]
        width = max(len(order), 1)
        key = file * width + place[held.indices.to_numpy()]
        sort = np.argsort(key, kind="stable")  # paragraphs stay in order
        key, paragraph = key[sort], paragraph[sort]
        fresh = np.append(True, key[1:] != key[:-1])[: len(key)]
        starts = np.flatnonzero(fresh)
        turned = fresh | np.append(True, paragraph[1:] != paragraph[:-1])[: len(key)]
        df = np.add.reduceat(turned.astype(np.int64), starts) if len(starts) else starts
        totals = np.bincount(file, minlength=len(blocks))
        words = held.dictionary.take(pa.array(order))
        return cls(len(blocks), totals, paragraphs, key[starts] // width, key[starts] % width, np.diff(np.append(starts, len(key))), df, words)

    def lists(self, values: pa.Array, file: np.ndarray) -> pa.Array:
        """Values, in the order of their files, as one list per file."""
        ends = np.append(0, np.cumsum(np.bincount(file, minlength=self.files)))
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)

    def ranked(self, most: int | None) -> pa.Array:
        """Words that may be tags, best first, ``most`` per file; equal scores in word order."""
        kept = ~pc.is_in(self.words, pa.array(X.TAG_STOPWORDS)).to_numpy(zero_copy_only=False)
        kept = kept[self.code] if len(self.code) else np.zeros(0, bool)
        file, code, tf, df = self.file[kept], self.code[kept], self.tf[kept], self.df[kept]
        score = (tf / self.totals[file]) * (np.log(np.maximum(self.paragraphs, 1)[file] / df) + 1.0)
        order = np.argsort(-np.round(score, 9), kind="stable")  # words of a file are in order
        order = order[np.argsort(file[order], kind="stable")]
        file, code = file[order], code[order]
        if most is not None:
            first = np.arange(len(file)) - np.searchsorted(file, np.arange(self.files))[file] < most
            file, code = file[first], code[first]
        return self.lists(self.words.take(pa.array(code)), file)


def _word_blocks(files: DataFrame, text: str) -> DataFrame:
    """(id, blocks): the words of each paragraph of texts long enough to tag."""
    blocks = F.transform(X.split_paragraphs(F.col(text)), X.tag_words)
    return files.filter(content_error(F.col(text)).isNull()).select("id", blocks.alias("blocks"))


def term_arrays(files: DataFrame, text: str = "text_content") -> DataFrame:
    """(id, total, paragraphs, terms) of texts long enough to tag.

    ``terms`` holds (word, tf, df): occurrences in the file, and paragraphs
    with the word.  Words are counted for a batch of files at once, and nothing
    is shuffled.
    """

    @F.arrow_udf(f"struct<total:int,paragraphs:int,terms:{_TERMS}>")
    def count(blocks: pa.Array) -> pa.Array:
        own = Counted.of(blocks)
        terms = pa.StructArray.from_arrays([own.words.take(pa.array(own.code)), pa.array(own.tf), pa.array(own.df)], names=["word", "tf", "df"])
        totals, paragraphs = pa.array(own.totals.astype(np.int32)), pa.array(np.maximum(own.paragraphs, 1).astype(np.int32))
        return pa.StructArray.from_arrays([totals, paragraphs, own.lists(terms, own.file)], names=["total", "paragraphs", "terms"])

    return _word_blocks(files, text).select("id", F.inline(F.array(count("blocks"))))


_TERMS = "array<struct<word:string,tf:bigint,df:bigint>>"


def _ranked_words(files: DataFrame, text: str, most: int | None) -> DataFrame:
    """(id, words), best first."""

    @F.arrow_udf("array<string>")
    def rank(blocks: pa.Array) -> pa.Array:
        return Counted.of(blocks).ranked(most)

    # ``inline`` keeps later filters from being pushed down here, where words would be ranked once more
    return _word_blocks(files, text).select("id", F.inline(F.array(F.struct(rank("blocks").alias("words")))))


def scored_terms(files: DataFrame, text: str = "text_content") -> DataFrame:
    """(id, terms) with (word, tf, df, score); stop words count in totals only."""
    rows = term_arrays(files, text)
    kept = F.filter("terms", lambda t: ~t["word"].isin(*X.TAG_STOPWORDS))
    scored = F.transform(
        kept,
        lambda t: F.struct(
            t["word"].alias("word"),
            t["tf"].alias("tf"),
            t["df"].alias("df"),
            ((t["tf"] / F.col("total")) * (F.ln(F.col("paragraphs") / t["df"]) + 1.0)).alias("score"),
        ),
    )
    return rows.select("id", scored.alias("terms"))


def term_statistics(files: DataFrame, text: str = "text_content") -> DataFrame:
    """(id, word, tf, df), a row per word."""
    return term_arrays(files, text).select("id", F.inline("terms"))


def tfidf(files: DataFrame, text: str = "text_content") -> DataFrame:
    """(id, word, tf, df, score), a row per tag candidate."""
    return scored_terms(files, text).select("id", F.inline("terms"))


def tag_candidates(files: DataFrame, text: str = "text_content") -> DataFrame:
    """(id, position, word): all words of each file that may be tags, best first."""
    best = _ranked_words(files, text, None).select("id", F.posexplode("words").alias("at", "word"))
    return best.select("id", (F.col("at") + 1).alias("position"), "word")


def tags(files: DataFrame, text: str = "text_content", max_tags: int = MAX_TAGS) -> DataFrame:
    """(id, tags), best first, of files that have any."""
    return _ranked_words(files, text, max_tags).filter(F.size("words") > 0).withColumnRenamed("words", "tags")


Attach = Callable[[DataFrame], DataFrame]

#: Candidates per file that get their vectors in the first round; each round doubles the number.
FIRST_BLOCK = 3 * MAX_TAGS


def distinct_tags(
    candidates: DataFrame, attach: Attach, max_tags: int = MAX_TAGS, threshold: float = TAG_SIMILARITY
) -> DataFrame:
    """(id, tags) after dropping words too close to a better one.

    Greedy by position over the whole ranked list: ``attach`` adds
    ``embedding`` to candidate rows (id, position, word), a block of positions
    at a time, until every file has ``max_tags`` words or no candidates left.
    """
    spark = candidates.sparkSession
    folder = f"{shared_dir(spark)}/tags-{uuid.uuid4().hex}"
    candidates.write.parquet(f"{folder}/candidates")
    candidates = spark.read.schema(candidates.schema).parquet(f"{folder}/candidates")
    done: list[DataFrame] = []
    kept, low, size, turn = None, 0, FIRST_BLOCK, 0
    while True:
        block = candidates.filter((F.col("position") > low) & (F.col("position") <= low + size))
        if kept is not None:
            block = block.join(kept.select("id"), "id", "left_semi")
        lists = attach(block).groupBy("id").agg(
            F.array_sort(F.collect_list(F.struct("position", "word", "embedding"))).alias("rows")
        )
        entries = "array<struct<word:string,embedding:array<float>>>"
        lists = lists.join(kept, "id", "left") if kept is not None else lists.withColumn("kept", F.lit(None).cast(entries))
        walked = lists.select("id", F.size("rows").alias("seen"), _walk(F.col("kept"), F.col("rows"), max_tags, threshold).alias("kept"))
        path = f"{folder}/round-{turn}"
        walked.write.parquet(path)
        walked = spark.read.schema(walked.schema).parquet(path)
        going = (F.size("kept") < max_tags) & (F.col("seen") == size)
        done.append(walked.filter(~going).select("id", "kept"))
        kept = walked.filter(going).select("id", "kept")
        low, size, turn = low + size, 2 * size, turn + 1
        if kept.isEmpty():
            break
        # a file whose candidates end with the block has no rows in the next one
        rest = candidates.filter(F.col("position") > low).select("id").distinct()
        done.append(kept.join(rest, "id", "left_anti"))
        kept = kept.join(rest, "id", "left_semi")
    picked = reduce(DataFrame.unionByName, done)
    return picked.select("id", F.transform("kept", lambda r: r["word"]).alias("tags"))


def _unit_rows(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors (zero vectors stay zero), padded to the widest, and their widths."""
    widths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    matrix = np.zeros((len(widths), int(widths.max(initial=0))))
    matrix[np.arange(matrix.shape[1]) < widths[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    norms = np.sqrt((matrix * matrix).sum(axis=1))
    good = norms >= V.EPSILON
    return np.where(good[:, None], matrix / np.where(good, norms, 1.0)[:, None], 0.0), widths


def _walk(kept: Column, rows: Column, max_tags: int, threshold: float) -> Column:
    """The kept words with their vectors after one more block, a matrix product per word."""

    @F.arrow_udf("array<struct<word:string,embedding:array<float>>>")
    def walk(before: pa.Array, block: pa.Array) -> pa.Array:
        parts = [before.flatten(), block.flatten()]
        words, vectors = (pa.concat_arrays([p.field(c) for p in parts]) for c in ("word", "embedding"))
        old, fresh = (x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (before, block))
        matrix, widths = _unit_rows(vectors)
        old_ends, fresh_ends = np.cumsum(old), np.cumsum(fresh) + len(parts[0])
        picked, ends = [], [0]
        for i in range(len(block)):
            here = np.append(np.arange(old_ends[i] - old[i], old_ends[i]), np.arange(fresh_ends[i] - fresh[i], fresh_ends[i]))
            close = (matrix[here] @ matrix[here].T > threshold) & (widths[here][:, None] == widths[here])
            chosen = list(range(old[i]))
            for j in range(old[i], len(here)):
                if len(chosen) == max_tags:
                    break
                if not close[j, chosen].any():
                    chosen.append(j)
            picked.append(here[chosen])
            ends.append(ends[-1] + len(chosen))
        take = pa.array(np.concatenate(picked) if picked else np.zeros(0, np.int64))
        entries = pa.StructArray.from_arrays([words.take(take), vectors.take(take)], names=["word", "embedding"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries)

    return walk(kept, rows)


# --------------------------------------------------------------------------
# whole steps

# A generator maps prompts to answers, a batch at a time; "" means no answer.
Generator = Callable[[list[str]], list[str]]


def _generate(prompt: Column, generator: Generator) -> Column:
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            wanted = prompts.notna()
            out = pd.Series([""] * len(prompts), dtype="object")
            out[wanted.to_numpy()] = generator(prompts[wanted].tolist())
            yield out

    return run(prompt)


def _document_prompt(text: Column, template: str) -> Column:
    return chat_prompt(system_prompt(template, X.detect_language(text)), document_prompt(text))


def summarise(
    files: DataFrame, embedder: Embedder | None = None, generator: Generator | None = None, text: str = "text_content"
) -> DataFrame:
    """(id, summary, error_code) of every file.

    A generated summary wins; else the most central sentences where an
    embedder is given; else the leading ones.
    """
    base = first_sentences(files, text)
    if embedder is not None:
        cut = sentences(files, text)
        central = central_summary(cut.withColumn("embedding", embed(F.col("sentence"), embedder)))
        base = base.join(central.withColumnRenamed("summary", "central"), "id", "left").select(
            "id", F.coalesce("central", "summary").alias("summary"), "error_code"
        )
    if generator is not None:
        prompt = F.when(content_error(F.col(text)).isNull(), _document_prompt(F.col(text), SUMMARY_PROMPT))
        answers = files.select("id", X.trim_ws(_generate(prompt, generator)).alias("generated"))
        given = F.col("generated") != ""
        base = base.join(answers, "id").select(
            "id",
            F.when(given, F.col("generated")).otherwise(F.col("summary")).alias("summary"),
            F.when(~given, F.col("error_code")).alias("error_code"),
        )
    return base


def tag(
    files: DataFrame, embedder: Embedder | None = None, generator: Generator | None = None, text: str = "text_content"
) -> DataFrame:
    """(id, tags, error_code) of every file.

    Generated tags win; else the best words by TF-IDF, without near
    duplicates where an embedder is given.
    """
    if embedder is None:
        best = tags(files, text)
    else:
        def attach(block: DataFrame) -> DataFrame:
            # Each word of a block is embedded once, however many files it tags.
            words = block.select("word").distinct().withColumn("embedding", embed(F.col("word"), embedder))
            return block.join(words, "word")

        best = distinct_tags(tag_candidates(files, text), attach)
    coded = files.select("id", content_error(F.col(text)).alias("error"))
    out = coded.join(best, "id", "left")
    if generator is not None:
        prompt = F.when(content_error(F.col(text)).isNull(), _document_prompt(F.col(text), TAGS_PROMPT))
        answers = files.select("id", X.parse_tag_list(_generate(prompt, generator)).alias("generated"))
        out = out.join(answers, "id").withColumn("tags", F.when(F.size("generated") > 0, F.col("generated")).otherwise(F.col("tags")))
    none = F.array().cast("array<string>")
    return out.select(
        "id",
        F.coalesce("tags", none).alias("tags"),
        F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("tags").isNull(), "generation_failed").alias("error_code"),
    )
