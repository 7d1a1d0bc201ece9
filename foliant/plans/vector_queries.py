"""Vector, hybrid and question queries over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import jsonfmt
from foliant.functions import vectors as V
from foliant.operators import fulltext, hybrid, nearest, rag
from foliant.operators.blockmax import best_files
from foliant.plans import sqlparts as P
from foliant.plans.registry import query
from foliant.plans.search_queries import documents_index
from foliant.sources import tables as S
from foliant.sources.searchable import stored, vector_index

SINGLE, SHORT, PHRASE = "eau", "le un", "enpare reheer stion under"
DIGITS = 6


def _embedded(spark, sf_dir):
    return S.embedded_chunks(spark, sf_dir, keep=("file_path", "file_name"))


def _hits(spark, sf_dir, text: str, k: int):
    return nearest.similarity_search(vector_index(spark, sf_dir), text, S.query_vector(spark, sf_dir), k).hits


VECTOR_SQL = f"array_to_string(list_transform(V, lambda x: printf('%.{DIGITS}f', x + 0.0)), ',')"


def _spelled(vector):
    """All components of a vector in one string."""
    return F.array_join(F.transform(vector, lambda x: F.format_string(f"%.{DIGITS}f", x.cast("double") + F.lit(0.0))), ",")


@query(
    "index_scan",
    f"""WITH {P.FILES}, {P.EMBEDDED} SELECT file_id, chunk_index, file_path, chunk_offset,
      md5({VECTOR_SQL.replace("V", "CAST(embedding AS DOUBLE[])", 1)}) AS vector_md5 FROM embedded""",
)
def index_scan(spark, sf_dir):
    """Vectors joined with their chunk and file; the digest covers all components."""
    return _embedded(spark, sf_dir).select(
        "file_id", "chunk_index", "file_path", "chunk_offset", F.md5(_spelled(F.col("embedding"))).alias("vector_md5")
    )


@query(
    "cosine_scores",
    f"""WITH {P.QUERY_VECTOR} SELECT vec_id, round({P.COSINE}, {DIGITS}) AS cosine FROM embeddings, qv""",
)
def cosine_scores(spark, sf_dir):
    score = V.cosine_against(F.col("embedding"), S.query_vector(spark, sf_dir))
    return S.vector_table(spark, sf_dir).select("vec_id", F.round(score, DIGITS).alias("cosine"))


@query(
    "cosine_prefix",
    f"""WITH {P.QUERY_VECTOR} SELECT vec_id, round(list_cosine_similarity(CAST(embedding[1:n] AS DOUBLE[]), q[1:n]), {DIGITS})
      AS cosine FROM (SELECT *, CASE WHEN label % 2 = 0 THEN 16 ELSE 64 END AS n FROM embeddings), qv""",
)
def cosine_prefix(spark, sf_dir):
    """Vectors of unequal width meet the query on their common prefix."""
    width = F.when(F.col("label") % 2 == 0, 16).otherwise(64)
    cut = S.vector_table(spark, sf_dir).select("vec_id", F.slice("embedding", 1, width).alias("v"))
    q = F.array(*[F.lit(x) for x in S.query_vector(spark, sf_dir)])
    return cut.select("vec_id", F.round(V.cosine_prefix(F.col("v"), q), DIGITS).alias("cosine"))


@query(
    "calibrated_scores",
    f"""WITH {P.QUERY_VECTOR} SELECT vec_id,
      round(least(1.0, greatest(0.0, ({P.COSINE} - 0.42) / 0.43)), {DIGITS}) AS semantic FROM embeddings, qv""",
)
def calibrated_scores(spark, sf_dir):
    score = V.calibrate(V.cosine_against(F.col("embedding"), S.query_vector(spark, sf_dir)))
    return S.vector_table(spark, sf_dir).select("vec_id", F.round(score, DIGITS).alias("semantic"))


@query(
    "hybrid_scores",
    f"""WITH {P.scored(PHRASE)} SELECT file_id, chunk_index, round(lexical, {DIGITS}) AS lexical,
      round(score, {DIGITS}) AS score FROM scored""",
)
def hybrid_scores(spark, sf_dir):
    scored = hybrid.score_chunks(_embedded(spark, sf_dir), PHRASE, S.query_vector(spark, sf_dir))
    return scored.select(
        "file_id", "chunk_index", F.round("lexical", DIGITS).alias("lexical"), F.round("score", DIGITS).alias("score")
    )


def _hits_sql(text: str, k: int) -> str:
    return f"""WITH {P.hits(text, k)} SELECT file_path, file_name, chunk_index, chunk_snippet, chunk_offset,
      round(score, {DIGITS}) AS score FROM hits ORDER BY rank"""


def _shown(hits):
    return hits.select(
        "file_path", "file_name", "chunk_index", "chunk_snippet", "chunk_offset", F.round("score", DIGITS).alias("score")
    )


@query("hybrid_single_token", _hits_sql(SINGLE, 20))
def hybrid_single_token(spark, sf_dir):
    return _shown(_hits(spark, sf_dir, SINGLE, 20))


@query("hybrid_short_tokens", _hits_sql(SHORT, 20))
def hybrid_short_tokens(spark, sf_dir):
    return _shown(_hits(spark, sf_dir, SHORT, 20))


@query("hybrid_phrase", _hits_sql(PHRASE, 20))
def hybrid_phrase(spark, sf_dir):
    return _shown(_hits(spark, sf_dir, PHRASE, 20))


@query(
    "similar_files",
    f"""WITH {P.FILES}, {P.EMBEDDED}, probe AS (SELECT id FROM files WHERE id = (SELECT max(id) FROM files)), own AS (
      SELECT unnest(range(1, len(embedding) + 1)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v
      FROM embedded WHERE file_id = (SELECT id FROM probe)), qv AS (
      SELECT list(m ORDER BY pos) AS q FROM (SELECT pos, avg(v) AS m FROM own GROUP BY pos)), near AS (
      SELECT *, round({P.COSINE}, 9) AS score FROM embedded, qv
      WHERE file_id <> (SELECT id FROM probe)), best AS (
      SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY score DESC, chunk_index) AS rn FROM near)
    SELECT file_path, file_name, chunk_index, {P.truncate("chunk_text", 200)} AS chunk_snippet, chunk_offset,
      round(score, {DIGITS}) AS score FROM best WHERE rn = 1 ORDER BY best.score DESC, file_id, chunk_index LIMIT 10""",
)
def similar_files(spark, sf_dir):
    files = S.files(spark, sf_dir)
    probe = files.agg(F.max_by("file_path", "id")).first()[0]
    return _shown(nearest.similar_files(vector_index(spark, sf_dir), probe, 10).hits)


@query(
    "nearest_files",
    f"""WITH {P.FILES}, {P.EMBEDDED}, {P.QUERY_VECTOR}, near AS (
      SELECT *, round(least(1.0, greatest(-1.0, {P.COSINE})), 9) AS score FROM embedded, qv), best AS (
      SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY score DESC, chunk_index) AS rn FROM near)
    SELECT file_path, file_name, chunk_index, {P.truncate("chunk_text", 200)} AS chunk_snippet, chunk_offset,
      round(score, {DIGITS}) AS score FROM best WHERE rn = 1 ORDER BY best.score DESC, file_id, chunk_index LIMIT 25""",
)
def nearest_files(spark, sf_dir):
    """Pure vector search: only clusters that can still win are read."""
    q = S.query_vector(spark, sf_dir)
    return _shown(nearest.search(vector_index(spark, sf_dir), q, nearest.by_cosine(q), 25).hits)


@query(
    "similar_files_all",
    f"""WITH {P.FILES}, {P.EMBEDDED}, parts AS (
      SELECT file_id, unnest(range(1, len(embedding) + 1)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embedded),
    means AS (SELECT file_id, pos, avg(v) AS m FROM parts GROUP BY file_id, pos),
    centred AS (SELECT file_id AS own_id, list(m ORDER BY pos) AS q FROM means GROUP BY file_id),
    near AS (
      SELECT own_id, file_id, chunk_index, round(least(1.0, greatest(-1.0, {P.COSINE})), 9) AS score
      FROM centred, embedded WHERE own_id <> file_id),
    best AS (SELECT own_id, file_id, max(score) AS score, arg_min(chunk_index, (-score, chunk_index)) AS chunk_index FROM near GROUP BY own_id, file_id),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY own_id ORDER BY score DESC, file_id) AS INTEGER) AS rank FROM best)
    SELECT own_id AS file_id, rank, file_id AS other_id, chunk_index, round(score, {DIGITS}) AS score FROM ranked WHERE rank <= 5""",
)
def similar_files_all(spark, sf_dir):
    """The five most similar files of every file."""
    found = nearest.all_similar_files(vector_index(spark, sf_dir), stored(spark), 5)
    return found.withColumn("score", F.round("score", DIGITS))


@query(
    "mean_vector",
    f"""WITH {P.FILES}, {P.EMBEDDED}, parts AS (
      SELECT file_id, unnest(range(1, len(embedding) + 1)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embedded),
    means AS (SELECT file_id, pos, avg(v) AS m FROM parts GROUP BY file_id, pos),
    norms AS (SELECT file_id, sqrt(sum(m * m)) AS n FROM means GROUP BY file_id)
    SELECT file_id, CAST(pos - 1 AS INTEGER) AS pos, round(CASE WHEN n > 0 THEN m / n ELSE m END, {DIGITS}) + 0.0 AS value
    FROM means JOIN norms USING (file_id)""",
)
def mean_vector(spark, sf_dir):
    means = V.mean_vector(S.embedded_chunks(spark, sf_dir), "embedding", "file_id")
    return means.select("file_id", F.posexplode("mean_vector").alias("pos", "value")).withColumn(
        "value", F.round("value", DIGITS) + F.lit(0.0)
    )


@query(
    "l2_normalize",
    f"""WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * (label + 1)) AS v FROM embeddings)
    SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, round(v[i] / sqrt(list_sum(list_transform(v, lambda x: x * x))), {DIGITS}) + 0.0 AS value
    FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM n)""",
)
def l2_normalize(spark, sf_dir):
    scaled = F.zip_with("embedding", F.array_repeat(F.col("label") + 1, F.size("embedding")), lambda x, s: x.cast("double") * s)
    rows = S.vector_table(spark, sf_dir).select("vec_id", scaled.alias("v"))
    return rows.select("vec_id", F.posexplode(V.unit_vector(F.col("v"))).alias("pos", "value")).withColumn(
        "value", F.round("value", DIGITS) + F.lit(0.0)
    )


@query(
    "blob_roundtrip",
    f"""SELECT vec_id, CAST(len(embedding) * 4 AS INTEGER) AS n_bytes,
      round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), {DIGITS}) AS total FROM embeddings""",
)
def blob_roundtrip(spark, sf_dir):
    blobs = S.vector_table(spark, sf_dir).select("vec_id", V.to_blob(F.col("embedding")).alias("blob"))
    return blobs.select(
        "vec_id",
        F.octet_length("blob").alias("n_bytes"),
        F.round(F.aggregate(V.from_blob(F.col("blob")), F.lit(0.0), lambda a, x: a + x.cast("double")), DIGITS).alias("total"),
    )


# --------------------------------------------------------------------------
# questions

STUB = """'Showing the ' || least(3, n) || ' most relevant snippet(s) found (out of ' || n || '):' || chr(10) ||
  array_to_string(list_transform(list_slice(frags, 1, 3), lambda f, i: CASE WHEN TRIMMED = '' THEN '' ELSE
    chr(10) || i || '. ' || (CUT) || chr(10) END), '')""".replace("TRIMMED", P.trim("f")).replace(
    "CUT", P.truncate(P.trim("f"), 300)
)


def _answer_sql(parts: str) -> str:
    """CTEs from ``parts`` (rank, file_path, part, chunk_snippet, chunk_offset) to ``answered``."""
    sep = "chr(10) || chr(10) || '---' || chr(10) || chr(10)"
    return f"""{parts}, joined AS (
      SELECT count(*) AS n, coalesce(string_agg(part, {sep} ORDER BY rank), '') AS context,
        coalesce(list({{'file_path': file_path, 'chunk_snippet': chunk_snippet, 'chunk_offset': chunk_offset}} ORDER BY rank), [])
        AS sources FROM parts), split AS (SELECT *, string_split(context, {sep}) AS frags FROM joined), answered AS (
      SELECT CASE WHEN n > 0 THEN {STUB} ELSE '' END AS answer, context, sources,
        CASE WHEN n = 0 THEN 'no_relevant_chunks' END AS error_code FROM split)"""


SOURCES_JSON = f"""'[' || array_to_string(list_transform(sources, lambda s: '{{"file_path":' || {P.json_string("s.file_path")}
  || ',"chunk_snippet":' || {P.json_string("s.chunk_snippet")} || ',"chunk_offset":' || s.chunk_offset || '}}'), ',') || ']'"""
RESULT_JSON = f"""'{{"answer":' || {P.json_string("answer")} || ',"sources":' || {SOURCES_JSON} || ',"error_code":' ||
  CASE WHEN error_code IS NULL THEN 'null' ELSE {P.json_string("error_code")} END || '}}'"""

SNIPPET_PARTS = """parts AS (SELECT rank, file_path, chunk_text AS part, chunk_snippet, chunk_offset FROM hits
  WHERE score >= 0.05)"""
FULL_PARTS = """parts AS (SELECT h.rank, h.file_path, 'File: ' || h.file_path || chr(10) || c.chunk_text AS part,
  h.chunk_snippet, h.chunk_offset FROM hits h JOIN chunks c ON c.file_id = h.file_id AND c.chunk_index = h.chunk_index)"""


def _fallback_parts(name: str, source: str, order: str, k: int) -> str:
    return f"""{name} AS (SELECT row_number() OVER (ORDER BY {order}) AS rank, file_path,
      'File: ' || file_path || chr(10) || content AS part, {P.truncate("content", 200)} AS chunk_snippet,
      CAST(0 AS BIGINT) AS chunk_offset FROM (
        SELECT *, coalesce(nullif(text_content, ''), nullif(description, ''), '') AS content
        FROM {source} ORDER BY {order} LIMIT {k}))"""


def _fts_parts(question: str, k: int) -> str:
    phrases = [(p.tokens, p.prefix) for p in fulltext.parse_keywords(question)]
    return f"""{P.bm25(phrases, fulltext.UNWEIGHTED, False)}, matched AS (
      SELECT f.*, round(rank, 12) AS rank FROM ranked JOIN files f ON f.id = ranked.id), """ + _fallback_parts(
        "parts", "matched", "rank, id", k
    )


QUESTION, NAME_QUESTION = "Which documents mention eauxan or leaux?", "find zzqx c1_"

NAME_PARTS = f"""{P.FILES}, firsts AS (
  SELECT *, CASE WHEN translate(file_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%zzqx%' THEN 0
                 WHEN translate(file_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%c1_%' THEN 1
            END AS keyword FROM files), named AS (
  SELECT * FROM firsts WHERE keyword = (SELECT min(keyword) FROM firsts)), """ + _fallback_parts("parts", "named", "id", 5)

ANSWERED = "SELECT md5(answer) AS answer_md5, md5(context) AS context_md5, CAST(len(sources) AS INTEGER) AS n_sources, error_code FROM answered"


def _digest(answered):
    return answered.select(
        F.md5("answer").alias("answer_md5"),
        F.md5("context").alias("context_md5"),
        F.size("sources").alias("n_sources"),
        "error_code",
    )


@query("rag_snippets", f"WITH {_answer_sql(P.hits(SHORT, 5) + ', ' + SNIPPET_PARTS)} {ANSWERED}")
def rag_snippets(spark, sf_dir):
    return _digest(rag.answer(rag.snippet_context(_hits(spark, sf_dir, SHORT, 5))))


def _full(spark, sf_dir, text: str, k: int):
    return rag.full_context(_hits(spark, sf_dir, text, k))


@query("rag_full_context", f"WITH {_answer_sql(P.hits(PHRASE, 5) + ', ' + FULL_PARTS)} {ANSWERED}")
def rag_full_context(spark, sf_dir):
    return _digest(rag.answer(_full(spark, sf_dir, PHRASE, 5)))


SHOW_PARTS = "SELECT rank, file_path, md5(part) AS part_md5, chunk_snippet, chunk_offset FROM parts"


def _parts(context):
    return context.select("rank", "file_path", F.md5("part").alias("part_md5"), "chunk_snippet", "chunk_offset")


def _fallback(spark, sf_dir, question: str):
    """Keyword search over the stored index, then file names by their trigrams."""
    index = documents_index(spark, sf_dir)
    by_keyword = lambda phrases, k: best_files(index, phrases, k, fulltext.UNWEIGHTED, False, digits=12)
    return rag.indexed_fallback(S.files(spark, sf_dir), question, 5, by_keyword, index.names, index.grams)


@query("rag_fallback_fts", f"WITH {_fts_parts(QUESTION, 5)} {SHOW_PARTS}")
def rag_fallback_fts(spark, sf_dir):
    return _parts(_fallback(spark, sf_dir, QUESTION))


@query("rag_fallback_like", f"WITH {NAME_PARTS} {SHOW_PARTS}")
def rag_fallback_like(spark, sf_dir):
    return _parts(_fallback(spark, sf_dir, NAME_QUESTION))


def _cascade(spark, sf_dir, text: str, question: str):
    return rag.first_available(
        lambda: _full(spark, sf_dir, text, 5),
        lambda: _fallback(spark, sf_dir, question),
    )


@query("rag_cascade", f"WITH {_answer_sql(P.hits(SHORT, 5) + ', ' + FULL_PARTS)} {ANSWERED}")
def rag_cascade(spark, sf_dir):
    """Vectors first, keywords next, file names last; a step runs if those before found nothing."""
    return _digest(rag.answer(_cascade(spark, sf_dir, SHORT, SHORT)))


@query("rag_cascade_fallback", f"WITH {_answer_sql(NAME_PARTS)} {ANSWERED}")
def rag_cascade_fallback(spark, sf_dir):
    """A question whose vector search is empty: a single unknown word."""
    return _digest(rag.answer(_cascade(spark, sf_dir, "zzqxj", NAME_QUESTION)))


@query(
    "rag_no_match",
    f"WITH {_answer_sql(P.hits('zzqxj', 5) + ', ' + SNIPPET_PARTS)} {ANSWERED}",
)
def rag_no_match(spark, sf_dir):
    return _digest(rag.answer(rag.snippet_context(_hits(spark, sf_dir, "zzqxj", 5))))


@query("rag_stub_answer", f"WITH {_answer_sql(P.hits(PHRASE, 5) + ', ' + FULL_PARTS)} SELECT answer FROM answered")
def rag_stub_answer(spark, sf_dir):
    return rag.answer(_full(spark, sf_dir, PHRASE, 5)).select("answer")


@query(
    "rag_result_json",
    f"WITH {_answer_sql(P.hits(SHORT, 5) + ', ' + SNIPPET_PARTS)} SELECT {RESULT_JSON} AS result_json FROM answered",
)
def rag_result_json(spark, sf_dir):
    return rag.result_json(rag.answer(rag.snippet_context(_hits(spark, sf_dir, SHORT, 5))))


@query(
    "rag_stream_events",
    f"""WITH {_answer_sql(P.hits(SHORT, 5) + ', ' + SNIPPET_PARTS)}
    SELECT 0 AS seq, 'token' AS type, answer AS payload FROM answered WHERE answer <> ''
    UNION ALL SELECT 1, 'done', {RESULT_JSON} FROM answered""",
)
def rag_stream_events(spark, sf_dir):
    return rag.stream_events(rag.answer(rag.snippet_context(_hits(spark, sf_dir, SHORT, 5))))


@query(
    "similarity_json",
    f"""WITH {P.hits(SHORT, 5)} SELECT '[' || string_agg('{{"file_path":' || {P.json_string("file_path")} || ',"file_name":' ||
      {P.json_string("file_name")} || ',"chunk_snippet":' || {P.json_string("chunk_snippet")} || ',"chunk_offset":' || chunk_offset
      || ',"score":' || rtrim(rtrim(printf('%.4f', score), '0'), '.') || '}}', ',' ORDER BY rank) || ']' AS hits_json
    FROM hits""",
)
def similarity_json(spark, sf_dir):
    hits = _hits(spark, sf_dir, SHORT, 5).withColumn("score", F.round("score", 4))
    order = F.struct((-F.col("score")).alias("o"), "file_id", *[c for c in hits.columns if c != "file_id"])
    rows = hits.agg(F.array_sort(F.collect_list(order)).alias("hits"))  # at most five rows
    return rows.select(jsonfmt.similarity_json(F.col("hits")).alias("hits_json"))


@query(
    "rag_record_parse",
    f"""WITH {_answer_sql(P.hits(SHORT, 5) + ', ' + SNIPPET_PARTS)} SELECT md5(answer) AS answer_md5,
      array_to_string(list_transform(sources, lambda s: s.file_path || ':' || s.chunk_offset), ',') AS sources, error_code FROM answered""",
)
def rag_record_parse(spark, sf_dir):
    """Answer records read back from their JSON."""
    encoded = rag.result_json(rag.answer(rag.snippet_context(_hits(spark, sf_dir, SHORT, 5))))
    parsed = encoded.select(jsonfmt.parse_rag_result(F.col("result_json")).alias("r"))
    places = F.transform("r.sources", lambda s: F.concat_ws(":", s["file_path"], s["chunk_offset"].cast("string")))
    return parsed.select(F.md5("r.answer").alias("answer_md5"), F.array_join(places, ",").alias("sources"), "r.error_code")


@query(
    "vector_json",
    """SELECT vec_id, md5('[' || array_to_string(list_transform(embedding, lambda x:
      rtrim(rtrim(printf('%.2f', round(CAST(x AS DOUBLE), 2) + 0.0), '0'), '.')), ',') || ']') AS json_md5 FROM embeddings""",
)
def vector_json(spark, sf_dir):
    rounded = F.transform("embedding", lambda x: F.round(x.cast("double"), 2) + F.lit(0.0))
    return S.vector_table(spark, sf_dir).select("vec_id", F.md5(jsonfmt.vector_json(rounded)).alias("json_md5"))
