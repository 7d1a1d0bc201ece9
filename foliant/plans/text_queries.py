"""Scalar text functions and chunking over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import jsonfmt, paths, prompts
from foliant.functions import text as X
from foliant.operators.chunking import chunk_files
from foliant.operators.hybrid import lexical_score
from foliant.plans import sqlparts as P
from foliant.plans.registry import query
from foliant.sources import extract
from foliant.sources import tables as S

# File types handed out to documents in turn, to exercise the type rules.
TYPES = ("txt", "pdf", "docx", "png", "mp3", "mp4", "webp", "exe", "MD", "")
# Latin letters and the Cyrillic ones that stand in for them.
LATIN, CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопярстувюыез"

TYPED = f"""typed AS (
  SELECT doc_id, '/in/' || source || '/doc_' || doc_id || CASE WHEN t = '' THEN '' ELSE '.' || t END AS path,
         n_chars * 4000 AS size_bytes, text
  FROM (SELECT *, ({P.array(TYPES)})[1 + n_chars % {len(TYPES)}] AS t FROM documents))"""
EXT = "lower(regexp_extract(path, '[^/]\\.([^./]+)$', 1))"


def typed_files(spark, sf_dir) -> DataFrame:
    """Documents as files of mixed types; sizes scale with the text."""
    kind = F.get(F.array(*[F.lit(t) for t in TYPES]), (F.col("n_chars") % len(TYPES)).cast("int"))
    dotted = F.when(kind == "", "").otherwise(F.concat(F.lit("."), kind))
    return S.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.lit("/in/"), F.col("source"), F.lit("/doc_"), F.col("doc_id").cast("string"), dotted).alias("path"),
        (F.col("n_chars") * 4000).alias("size_bytes"),
        "text",
    )


def _docs(spark, sf_dir) -> DataFrame:
    return S.table(spark, sf_dir, "documents")


@query(
    "embedding_text",
    f"""WITH {P.FILES_TRANSCRIPT} SELECT id, md5({P.trim("concat_ws(chr(10), nullif(description, ''), nullif(tags, ''), "
    "nullif(text_content, ''), nullif(transcript_text, ''))")}) AS text_md5 FROM files""",
)
def embedding_text(spark, sf_dir):
    files = S.files(spark, sf_dir, transcripts=True)
    joined = X.embedding_text(*[F.col(c) for c in ("description", "tags", "text_content", "transcript_text")])
    return files.select("id", F.md5(joined).alias("text_md5"))


@query(
    "meaningful_text",
    f"""SELECT conv_id, turn, length({P.trim("text")}) > 3 AND regexp_matches(text, '[a-zA-Zа-яА-ЯёЁ]') AS meaningful
    FROM conversations""",
)
def meaningful_text(spark, sf_dir):
    turns = S.table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", X.is_meaningful(F.col("text")).alias("meaningful"))


def _language_sql(sample: str) -> str:
    return f"""SELECT doc_id, CASE WHEN n > 0 AND 2 * c > n THEN 'ru' ELSE 'en' END AS language FROM (
      SELECT doc_id, length(regexp_replace({sample}, '[^\\p{{L}}]', '', 'g')) AS n,
             length(regexp_replace({sample}, '[^Ѐ-ӿ]', '', 'g')) AS c
      FROM (SELECT doc_id, CASE WHEN source < 'src5' THEN translate(lower(text), '{LATIN}', '{CYRILLIC}')
                                ELSE text END AS text FROM documents))"""


def _mixed_script(spark, sf_dir) -> DataFrame:
    """Documents, those of some sources spelled in Cyrillic letters."""
    spelled = F.translate(F.lower("text"), LATIN, CYRILLIC)
    return _docs(spark, sf_dir).select(
        "doc_id", F.when(F.col("source") < "src5", spelled).otherwise(F.col("text")).alias("text")
    )


@query("doc_language", _language_sql("text"))
def doc_language(spark, sf_dir):
    return _mixed_script(spark, sf_dir).select("doc_id", X.detect_language(F.col("text")).alias("language"))


@query(
    "question_language",
    """SELECT conv_id, turn, CASE WHEN n > 0 AND 2 * c > n THEN 'ru' ELSE 'en' END AS language FROM (
      SELECT conv_id, turn, length(regexp_replace(text, '[^\\p{L}]', '', 'g')) AS n,
             length(regexp_replace(text, '[^Ѐ-ӿ]', '', 'g')) AS c FROM conversations WHERE role = 'user')""",
)
def question_language(spark, sf_dir):
    asked = S.table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    return asked.select("conv_id", "turn", X.detect_language(F.col("text")).alias("language"))


@query(
    "file_extension",
    f"""WITH {TYPED} SELECT path, regexp_extract(path, '[^/]+$', 0) AS file_name, {EXT} AS ext FROM typed""",
)
def file_extension(spark, sf_dir):
    p = F.col("path")
    return typed_files(spark, sf_dir).select(p, paths.base_name(p).alias("file_name"), paths.extension(p).alias("ext"))


@query(
    "content_type",
    f"""WITH {TYPED} SELECT path,
      CASE WHEN {EXT} IN {P.in_list(paths.AUDIO_EXTENSIONS)} THEN 'audio'
           WHEN {EXT} IN {P.in_list(paths.VIDEO_EXTENSIONS)} THEN 'video' ELSE 'unsupported' END AS media_type,
      CASE WHEN {EXT} IN {P.in_list(paths.OCR_IMAGE_EXTENSIONS)} THEN 'image'
           WHEN {EXT} = 'pdf' THEN 'scan_pdf' ELSE 'unsupported' END AS ocr_type FROM typed""",
)
def content_type(spark, sf_dir):
    p = F.col("path")
    return typed_files(spark, sf_dir).select(
        p, paths.media_content_type(p).alias("media_type"), paths.ocr_content_type(p).alias("ocr_type")
    )


LIMIT_MB = 50
LIMIT = LIMIT_MB * 1024 * 1024


@query(
    "extraction_validation",
    f"""WITH {TYPED} SELECT path,
      CASE WHEN {EXT} = '' THEN 'unsupported' WHEN size_bytes > {LIMIT} THEN {EXT}
           WHEN {EXT} IN ('pdf', 'docx') THEN {EXT} WHEN {EXT} IN {P.in_list(paths.TEXT_EXTENSIONS)} THEN 'text'
           ELSE 'unsupported' END AS content_type,
      CASE WHEN {EXT} = '' THEN 'unsupported_format' WHEN size_bytes > {LIMIT} THEN 'file_too_large'
           WHEN {EXT} IN ('pdf', 'docx') OR {EXT} IN {P.in_list(paths.TEXT_EXTENSIONS)} THEN NULL
           ELSE 'unsupported_format' END AS error_code FROM typed""",
)
def extraction_validation(spark, sf_dir):
    checked = extract.check_extraction(F.col("path"), F.col("size_bytes"), F.lit(True), LIMIT_MB)
    return typed_files(spark, sf_dir).select("path", checked.alias("c")).select("path", "c.*")


def _recognition_sql(types: list[tuple[str, tuple]], missing: str) -> str:
    kind = "CASE " + " ".join(f"WHEN {EXT} IN {P.in_list(e)} THEN '{n}'" for n, e in types) + " ELSE 'unsupported' END"
    return f"""WITH {TYPED}, kinds AS (SELECT path, size_bytes, {kind} AS content_type FROM typed)
    SELECT path, content_type, CASE WHEN content_type = 'unsupported' THEN 'unsupported_format'
           WHEN size_bytes > {LIMIT} THEN 'file_too_large' ELSE '{missing}' END AS error_code FROM kinds"""


@query(
    "transcription_validation",
    _recognition_sql([("audio", paths.AUDIO_EXTENSIONS), ("video", paths.VIDEO_EXTENSIONS)], "not_implemented"),
)
def transcription_validation(spark, sf_dir):
    checked = extract.check_transcription(F.col("path"), F.col("size_bytes"), F.lit(True), LIMIT_MB)
    return (
        typed_files(spark, sf_dir)
        .select("path", checked.alias("c"))
        .select("path", "c.content_type", F.coalesce("c.error_code", F.lit("not_implemented")).alias("error_code"))
    )


@query(
    "ocr_validation",
    _recognition_sql([("image", paths.OCR_IMAGE_EXTENSIONS), ("scan_pdf", ("pdf",))], "ocr_failed"),
)
def ocr_validation(spark, sf_dir):
    checked = extract.check_ocr(F.col("path"), F.col("size_bytes"), F.lit(True), LIMIT_MB)
    return (
        typed_files(spark, sf_dir)
        .select("path", checked.alias("c"))
        .select("path", "c.content_type", F.coalesce("c.error_code", F.lit("ocr_failed")).alias("error_code"))
    )


@query("normalize_lexical", f"SELECT doc_id, md5({P.normalize('text')}) AS text_md5 FROM documents")
def normalize_lexical(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(X.normalize_lexical(F.col("text"))).alias("text_md5"))


@query(
    "tokenize_lexical",
    f"""SELECT token, count(*) AS n FROM (
      SELECT unnest(list_filter(regexp_split_to_array({P.normalize('text')}, '\\s+'), lambda t: t <> '')) AS token
      FROM documents) GROUP BY token""",
)
def tokenize_lexical(spark, sf_dir):
    tokens = X.split_ws(X.normalize_lexical(F.col("text")))
    words = _docs(spark, sf_dir).select(F.explode(tokens).alias("token"))
    return words.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


WORDS = f"""words AS (
  SELECT DISTINCT translate(w, '{LATIN}', '{CYRILLIC}') AS word FROM (
    SELECT unnest(regexp_extract_all(lower(text), '[\\p{{L}}]+')) AS w FROM documents))"""


def _cyrillic_words(spark, sf_dir) -> DataFrame:
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("\\p{L}+"), 0))
    return _docs(spark, sf_dir).select(words.alias("w")).distinct().select(F.translate("w", LATIN, CYRILLIC).alias("word")).distinct()


@query(
    "stem_ru",
    f"""WITH {WORDS} SELECT word, CASE WHEN length(word) <= 3 OR NOT regexp_matches(word, '[Ѐ-ӿ]') THEN word
      WHEN regexp_extract(word, '{P.SUFFIX_PATTERN}', 1) = '' THEN word
      ELSE regexp_extract(word, '{P.SUFFIX_PATTERN}', 1) END AS stem FROM words""",
)
def stem_ru(spark, sf_dir):
    return _cyrillic_words(spark, sf_dir).select("word", X.stem_ru(F.col("word")).alias("stem"))


@query(
    "stem_ru_keep_case",
    f"""WITH {WORDS}, cut AS (
      SELECT word, regexp_replace(word, '(?i)(?:{"|".join(X.RU_SUFFIXES)})$', '') AS stem
      FROM (SELECT translate(substring(word, 1, 1), '{CYRILLIC}', '{CYRILLIC.upper()}') || substring(word, 2) AS word FROM words))
    SELECT word, CASE WHEN length(word) <= 3 OR NOT regexp_matches(word, '[Ѐ-ӿ]') OR length(stem) < 3 THEN word
      ELSE stem END AS stem FROM cut""",
)
def stem_ru_keep_case(spark, sf_dir):
    capital = F.concat(F.translate(F.substring("word", 1, 1), CYRILLIC, CYRILLIC.upper()), F.substring("word", 2, 1_000_000))
    words = _cyrillic_words(spark, sf_dir).select(capital.alias("word"))
    return words.select("word", X.stem_ru_keep_case(F.col("word")).alias("stem"))


LEXICAL_QUERY = "eaux en la"


@query(
    "lexical_score",
    f"""WITH {P.FILES}, n AS (
      SELECT id, {P.normalize('file_name')} AS name_n, {P.normalize('text_content')} AS body_n FROM files)
    SELECT id, round({P.lexical(LEXICAL_QUERY)}, 6) AS score FROM n""",
)
def lexical_scores(spark, sf_dir):
    score = lexical_score(LEXICAL_QUERY, F.col("file_name"), F.col("text_content"))
    return S.files(spark, sf_dir).select("id", F.round(score, 6).alias("score"))


KEYWORDS = f"""list_filter(
  regexp_split_to_array(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_\\-]', ' ', 'g'), ' +'),
  lambda w: length(w) >= 3 AND w NOT IN {P.STOPWORDS})"""


@query(
    "query_keywords",
    f"""SELECT item_id, array_to_string(list_filter(k, lambda w, i: list_position(k, w) = i), ' ') AS keywords
    FROM (SELECT item_id, {KEYWORDS} AS k FROM benchmark)""",
)
def query_keywords(spark, sf_dir):
    words = X.query_keywords(F.col("text"))
    return S.table(spark, sf_dir, "benchmark").select("item_id", F.array_join(words, " ").alias("keywords"))


@query(
    "keyword_terms",
    """SELECT user_id, array_to_string(list_filter(t, lambda w, i: i = 1 OR w <> t[i - 1]), ' ') AS terms FROM (
      SELECT user_id, flatten(list_transform(k, lambda w: list_concat([w],
        CASE WHEN contains(w, '_') THEN list_filter(string_split(w, '_'), lambda p: length(p) >= 3)
             ELSE CAST([] AS VARCHAR[]) END))) AS t
      FROM (SELECT user_id, [event_type || '_' || event_type, event_type, 'user_' || user_id] AS k
            FROM (SELECT DISTINCT user_id, event_type FROM events)))""",
)
def keyword_terms(spark, sf_dir):
    pairs = S.table(spark, sf_dir, "events").select("user_id", "event_type").distinct()
    kind = F.col("event_type")
    words = F.array(F.concat_ws("_", kind, kind), kind, F.concat(F.lit("user_"), F.col("user_id").cast("string")))
    return pairs.select("user_id", F.array_join(X.keyword_terms(words), " ").alias("terms"))


@query(
    "pluralize",
    """SELECT doc_id, CASE WHEN n_chars % 100 BETWEEN 11 AND 14 THEN 'фрагментов' WHEN n_chars % 10 = 1 THEN 'фрагмент'
      WHEN n_chars % 10 BETWEEN 2 AND 4 THEN 'фрагмента' ELSE 'фрагментов' END AS word FROM documents""",
)
def pluralize(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.pluralize_fragment(F.col("n_chars")).alias("word"))


@query(
    "chunk_text",
    f"""WITH {P.FILES}, {P.chunks()}
    SELECT file_id, chunk_index, md5(chunk_text) AS chunk_md5, chunk_offset FROM chunks""",
)
def chunk_text(spark, sf_dir):
    return S.chunks(spark, sf_dir).select("file_id", "chunk_index", F.md5("chunk_text").alias("chunk_md5"), "chunk_offset")


@query(
    "chunk_text_clamped",
    """WITH s AS (SELECT conv_id, turn, text, least(500, length(text)) AS size FROM conversations WHERE length(text) > 0),
    t AS (SELECT *, size - least(50, size - 1) AS step FROM s),
    u AS (SELECT *, unnest(range(CAST(ceil(length(text) / CAST(step AS DOUBLE)) AS INTEGER))) AS i FROM t)
    SELECT conv_id, turn, CAST(i AS INTEGER) AS chunk_index, md5(substring(text, i * step + 1, size)) AS chunk_md5,
           CAST(i * step AS BIGINT) AS chunk_offset FROM u""",
)
def chunk_text_clamped(spark, sf_dir):
    turns = S.table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "id")
    cut = chunk_files(turns, "text", clamped=True, keep=("turn",))
    return cut.select(
        F.col("file_id").alias("conv_id"), "turn", "chunk_index", F.md5("chunk_text").alias("chunk_md5"), "chunk_offset"
    )


@query(
    "split_paragraphs",
    f"""SELECT doc_id, CAST(i - 1 AS INTEGER) AS paragraph, md5(p[i]) AS text_md5 FROM (
      SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (
        SELECT doc_id, list_filter(list_transform(string_split(replace(text, chr(10), chr(10) || chr(10)),
          chr(10) || chr(10)), lambda x: {P.trim("x")}), lambda x: x <> '') AS p FROM documents))""",
)
def split_paragraphs(spark, sf_dir):
    spaced = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    parts = _docs(spark, sf_dir).select("doc_id", F.posexplode(X.split_paragraphs(spaced)).alias("paragraph", "p"))
    return parts.select("doc_id", "paragraph", F.md5("p").alias("text_md5"))


@query(
    "split_sentences",
    f"""WITH folded AS (SELECT doc_id, {P.sentences("text")} AS st FROM documents), done AS (
      SELECT doc_id, {P.sentence_list("st")} AS s FROM folded)
    SELECT doc_id, CAST(i - 1 AS INTEGER) AS sentence_index, md5(s[i]) AS text_md5 FROM (
      SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM done)""",
)
def split_sentences(spark, sf_dir):
    cut = X.split_sentences(F.col("text"))
    parts = _docs(spark, sf_dir).select("doc_id", F.posexplode(cut).alias("sentence_index", "s"))
    return parts.select("doc_id", "sentence_index", F.md5("s").alias("text_md5"))


@query("truncate_snippet", f"SELECT doc_id, {P.truncate('text', 200)} AS snippet FROM documents")
def truncate_snippet(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.truncate(F.col("text"), 200).alias("snippet"))


@query(
    "tag_list",
    f"""SELECT doc_id, array_to_string(list_slice(list_filter(list_transform(string_split(text, ','),
      lambda x: {P.trim("x")}), lambda x: strlen(x) >= 3), 1, 7), ', ') AS tags FROM documents""",
)
def tag_list(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.join_tags(X.parse_tag_list(F.col("text"))).alias("tags"))


NAMES = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in prompts.LANGUAGE_NAMES.items()) + " ELSE 'English' END"


@query(
    "summary_prompt",
    f"""SELECT doc_id, md5('<|im_start|>system' || chr(10) || replace({P.lit(prompts.SUMMARY_PROMPT)}, '%s', {NAMES})
      || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || 'Document:' || chr(10) || text
      || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)) AS prompt_md5 FROM documents""",
)
def summary_prompt(spark, sf_dir):
    system = prompts.system_prompt(prompts.SUMMARY_PROMPT, F.col("lang"))
    user = prompts.document_prompt(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.md5(prompts.chat_prompt(system, user)).alias("prompt_md5"))


@query(
    "json_strings",
    f"""SELECT doc_id, md5('{{"summary":' || {P.json_string("text")} || ',"error_code":null}}') AS json_md5
    FROM documents""",
)
def json_strings(spark, sf_dir):
    return _docs(spark, sf_dir).select(
        "doc_id", F.md5(jsonfmt.summary_json(F.col("text"), F.lit(None).cast("string"))).alias("json_md5")
    )


@query("json_parse", "SELECT doc_id, 2 AS n, md5(text) AS first_md5, source AS second FROM documents")
def json_parse(spark, sf_dir):
    encoded = jsonfmt.json_array(F.array(jsonfmt.json_string(F.col("text")), jsonfmt.json_string(F.col("source"))))
    parsed = jsonfmt.parse_string_array(encoded)
    return _docs(spark, sf_dir).select("doc_id", parsed.alias("p")).select(
        "doc_id", F.size("p").alias("n"), F.md5(F.get("p", F.lit(0))).alias("first_md5"), F.get("p", F.lit(1)).alias("second")
    )


@query(
    "event_times",
    """SELECT event_id, epoch_us(ts) // 1000 AS occurred_at_ms, epoch_us(ts) // 1000000 AS indexed_at,
      make_timestamp(epoch_us(ts) // 1000 * 1000) AS occurred_at FROM events""",
)
def event_times(spark, sf_dir):
    events = S.file_events(spark, sf_dir)
    return events.select(
        "event_id",
        F.col("ts_ms").alias("occurred_at_ms"),
        F.floor(F.col("ts_ms") / 1000).cast("long").alias("indexed_at"),
        F.timestamp_millis("ts_ms").cast("timestamp_ntz").alias("occurred_at"),
    )
