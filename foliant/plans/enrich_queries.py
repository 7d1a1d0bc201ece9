"""Summaries and tags over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import jsonfmt
from foliant.operators import enrich as E
from foliant.plans import sqlparts as P
from foliant.plans.registry import query
from foliant.sources import tables as S


def _spaced(spark, sf_dir):
    """Documents with a paragraph per line; ``id`` and ``text`` only."""
    return S.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text_content")
    )


SPACED = "spaced AS (SELECT doc_id AS id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents)"
TERMS = f"""{SPACED}, checked AS (
  SELECT id, text FROM spaced WHERE {P.ERROR} IS NULL), blocks AS (
  SELECT id, unnest(list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: {P.trim("x")}),
         lambda x: x <> '')) AS block FROM checked), numbered AS (
  SELECT id, row_number() OVER () AS paragraph, block FROM blocks), words AS (
  SELECT id, paragraph, word FROM (
    SELECT id, paragraph, unnest(regexp_extract_all(lower(block), '([\\p{{L}}\\p{{N}}-]+)')) AS word FROM numbered)
  WHERE strlen(word) >= 3 AND NOT regexp_matches(word, '^[0-9]+$')), counts AS (
  SELECT id, word, count(*) AS tf, count(DISTINCT paragraph) AS df FROM words GROUP BY id, word), totals AS (
  SELECT id, count(*) AS total FROM words GROUP BY id), paras AS (
  SELECT id, count(*) AS paragraphs FROM blocks GROUP BY id), scored AS (
  SELECT id, word, tf, df, (CAST(tf AS DOUBLE) / total) * (ln(CAST(paragraphs AS DOUBLE) / df) + 1.0) AS score
  FROM counts JOIN totals USING (id) JOIN paras USING (id) WHERE word NOT IN {P.TAG_STOPS}), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, word) AS position FROM scored)"""


@query("term_frequency", f"WITH {TERMS} SELECT id, word, tf, df FROM counts")
def term_frequency(spark, sf_dir):
    return E.term_statistics(_spaced(spark, sf_dir)).select("id", "word", "tf", "df")


@query("tfidf", f"WITH {TERMS} SELECT id, word, round(score, 6) AS score FROM scored")
def tfidf(spark, sf_dir):
    return E.tfidf(_spaced(spark, sf_dir)).select("id", "word", F.round("score", 6).alias("score"))


@query(
    "tags",
    f"""WITH {TERMS} SELECT id, string_agg(word, ', ' ORDER BY position) AS tags FROM ranked WHERE position <= 7
    GROUP BY id""",
)
def tags(spark, sf_dir):
    best = E.tags(_spaced(spark, sf_dir))
    return best.select("id", F.array_join("tags", ", ").alias("tags"))


@query(
    "tags_json",
    f"""WITH {TERMS} SELECT id, '{{"tags":[' || string_agg({P.json_string("word")}, ',' ORDER BY position)
      || '],"error_code":null}}' AS tags_json FROM ranked WHERE position <= 7 GROUP BY id""",
)
def tags_json(spark, sf_dir):
    best = E.tags(_spaced(spark, sf_dir))
    return best.select("id", jsonfmt.tags_json(F.col("tags"), F.lit(None).cast("string")).alias("tags_json"))


@query(
    "distinct_tags",
    f"""WITH RECURSIVE {TERMS}, vectors AS (
      SELECT id, position, word, CAST(embedding AS DOUBLE[]) AS v FROM ranked JOIN embeddings e
        ON e.vec_id = (id + position // 2) % (SELECT count(*) FROM embeddings)), fold AS (
      SELECT id, CAST(0 AS BIGINT) AS position, CAST([] AS VARCHAR[]) AS words, CAST([] AS DOUBLE[][]) AS vs
      FROM (SELECT DISTINCT id FROM vectors)
      UNION ALL
      SELECT f.id, v.position,
        CASE WHEN len(words) < 7 AND len(list_filter(vs, lambda o: list_cosine_similarity(o, v.v) > 0.8)) = 0
             THEN list_append(words, v.word) ELSE words END,
        CASE WHEN len(words) < 7 AND len(list_filter(vs, lambda o: list_cosine_similarity(o, v.v) > 0.8)) = 0
             THEN list_append(vs, v.v) ELSE vs END
      FROM fold f JOIN vectors v ON v.id = f.id AND v.position = f.position + 1 WHERE len(f.words) < 7)
    SELECT id, array_to_string(arg_max(words, position), ', ') AS tags FROM fold GROUP BY id""",
)
def distinct_tags(spark, sf_dir):
    """Greedy de-duplication; neighbouring candidates share a vector."""
    key = F.col("id") + F.floor(F.col("position") / 2).cast("long")
    picked = E.distinct_tags(E.tag_candidates(_spaced(spark, sf_dir)), lambda block: S.with_vectors(spark, sf_dir, block, key))
    return picked.select("id", F.array_join("tags", ", ").alias("tags"))


SENTENCES = f"""folded AS (SELECT doc_id AS id, {P.sentences("text")} AS st, {P.ERROR} AS error FROM documents), cut AS (
  SELECT id, error, {P.sentence_list("st")} AS s FROM folded)"""


@query(
    "summary_fallback",
    f"""WITH {SENTENCES} SELECT id, CASE WHEN error IS NULL THEN array_to_string(list_slice(s, 1, 3), ' ') ELSE '' END
      AS summary, CASE WHEN error IS NULL AND len(s) = 0 THEN 'content_too_short' ELSE error END AS error_code FROM cut""",
)
def summary_fallback(spark, sf_dir):
    return E.first_sentences(S.files(spark, sf_dir))


COMPONENTS = range(1, 65)
CENTRAL = f"""{SENTENCES}, sent AS (
  SELECT id, i - 1 AS idx, s[i] AS sentence FROM (
    SELECT id, s, unnest(range(1, len(s) + 1)) AS i FROM cut WHERE error IS NULL)), unit_table AS (
  SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_sum(list_transform(
         CAST(embedding AS DOUBLE[]), lambda y: y * y)))) AS u FROM embeddings), units AS (
  SELECT id, idx, sentence, u FROM sent
  JOIN unit_table e ON e.vec_id = (id * 7 + idx) % (SELECT count(*) FROM embeddings)), sums AS (
  SELECT id, [{", ".join(f"sum(u[{i}])" for i in COMPONENTS)}] AS s, count(*) AS n FROM units GROUP BY id), central AS (
  SELECT units.*, CASE WHEN n > 1 THEN (list_dot_product(u, s) - list_dot_product(u, u)) / (n - 1) ELSE 0 END AS c
  FROM units JOIN sums USING (id))"""


def _embedded_sentences(spark, sf_dir):
    cut = E.sentences(S.files(spark, sf_dir))
    return S.with_vectors(spark, sf_dir, cut, F.col("id") * 7 + F.col("sentence_index"))


@query("sentence_centrality", f"WITH {CENTRAL} SELECT id, CAST(idx AS INTEGER) AS sentence_index, round(c, 6) AS centrality FROM central")
def sentence_centrality(spark, sf_dir):
    scores = E.sentence_centrality(_embedded_sentences(spark, sf_dir))
    return scores.withColumn("centrality", F.round("centrality", 6))


@query(
    "summary_centrality",
    f"""WITH {CENTRAL}, top AS (
      SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(c, 9) DESC, idx) AS rn FROM central)
    SELECT id, string_agg(sentence, ' ' ORDER BY idx) AS summary FROM top WHERE rn <= 3 GROUP BY id""",
)
def summary_centrality(spark, sf_dir):
    return E.central_summary(_embedded_sentences(spark, sf_dir))
