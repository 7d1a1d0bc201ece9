"""SQL building blocks shared by the twins (DuckDB dialect)."""

from __future__ import annotations

from foliant.functions.text import QUERY_STOPWORDS, RU_SUFFIXES, TAG_STOPWORDS, WHITESPACE, fold_table


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def array(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


_FROM, _TO = fold_table()
WS = "".join(f"chr({ord(c)})||" for c in WHITESPACE)[:-2]


def trim(expr: str) -> str:
    return f"trim({expr}, {WS})"


def fold(expr: str) -> str:
    return f"translate(lower({expr}), {lit(_FROM)}, {lit(_TO)})"


def truncate(expr: str, n: int) -> str:
    return f"CASE WHEN length({expr}) > {n} THEN substring({expr}, 1, {n}) || '…' ELSE {expr} END"


DOC_PATH = "'/docs/' || source || '/' || doc_id || '.txt'"
DOC_NAME = "lang || '_' || source || '_' || doc_id || '.txt'"

FILES = f"""files AS (
  SELECT doc_id AS id, {DOC_PATH} AS file_path, {DOC_NAME} AS file_name, source AS description,
         text AS text_content, '' AS transcript_text, lang || ', ' || source AS tags, 0 AS needs_review,
         1700000000 + doc_id AS indexed_at
  FROM documents)"""

FILES_REVIEW = f"""files AS (
  SELECT d.doc_id AS id, '/docs/' || source || '/' || d.doc_id || '.txt' AS file_path,
         lang || '_' || source || '_' || d.doc_id || '.txt' AS file_name, source AS description,
         text AS text_content, '' AS transcript_text, lang || ', ' || source AS tags,
         CASE WHEN quality = 0 THEN 1 ELSE 0 END AS needs_review, 1700000000 + d.doc_id AS indexed_at
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""

# Every turn of a conversation is a recording of its own, with its words as transcript.
TURN_PATH = "'/calls/' || conv_id || '/' || turn || '.mp3'"
FILES_TRANSCRIPT = f"""files AS (
  SELECT doc_id AS id, {DOC_PATH} AS file_path, {DOC_NAME} AS file_name, source AS description,
         text AS text_content, '' AS transcript_text, lang || ', ' || source AS tags, 0 AS needs_review,
         1700000000 + doc_id AS indexed_at
  FROM documents
  UNION ALL
  SELECT -1 - (conv_id * 1000000 + turn), {TURN_PATH}, turn || '.mp3', role, '', text, '', 0, 1700000000 + conv_id
  FROM conversations)"""

PAGES = """pages_as_files AS (
  SELECT '/pages/' || page_id || '.html' AS file_path, page_id || '.html' AS file_name, url AS description,
         html AS text_content FROM pages)"""

INCOMING = f"""{PAGES}, incoming AS (
  SELECT '/docs/' || source || '/' || d.doc_id || '.txt' AS file_path,
         lang || '_' || source || '_' || d.doc_id || '.txt' AS file_name,
         'quality ' || quality || ' toxic ' || toxic AS description, CAST(NULL AS VARCHAR) AS text_content
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id
  UNION ALL SELECT * FROM pages_as_files)"""

LISTING = f"""{PAGES}, listing AS (
  SELECT {DOC_PATH} AS file_path, {DOC_NAME} AS file_name FROM documents d
  WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)
  UNION ALL SELECT file_path, file_name FROM pages_as_files)"""


def chunks(source: str = "files", size: int = 500, overlap: int = 50, text: str = "text_content") -> str:
    """CTE ``chunks`` over a relation with (id, text)."""
    step = size - overlap
    return f"""chunks AS (
  SELECT id AS file_id, file_path, file_name, CAST(i AS INTEGER) AS chunk_index,
         substring({text}, i * {step} + 1, {size}) AS chunk_text,
         CAST(strlen(substring({text}, 1, i * {step})) AS BIGINT) AS chunk_offset
  FROM (SELECT *, unnest(range(CAST(ceil(length({text}) / {step}.0) AS INTEGER))) AS i FROM {source}))"""


EMBEDDED = f"""{chunks()}, embedded AS (
  SELECT c.*, e.embedding FROM chunks c
  JOIN embeddings e ON e.vec_id = (c.file_id * 31 + c.chunk_index) % (SELECT count(*) FROM embeddings))"""

# Query vector: mean of the vectors labelled 0, six decimals.
QUERY_VECTOR = """qv AS (
  SELECT list(round(m, 6) ORDER BY pos) AS q FROM (
    SELECT pos, avg(v) AS m FROM (
      SELECT unnest(range(1, len(embedding) + 1)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v
      FROM embeddings WHERE label = 0) GROUP BY pos))"""

COSINE = "list_cosine_similarity(CAST(embedding AS DOUBLE[]), q)"


def normalize(expr: str) -> str:
    return f"regexp_replace(lower({expr}), '[^\\p{{L}}\\p{{N}}_\\-\\s]', ' ', 'g')"


def lexical(query: str, name: str = "name_n", body: str = "body_n") -> str:
    """Lexical score of a lower-case query of plain Latin words."""
    parts = [
        f"CASE WHEN contains({name}, {lit(t)}) THEN 0.8 WHEN contains({body}, {lit(t)}) THEN 0.4 ELSE 0.0 END"
        for t in query.split()
        if len(t) >= 2
    ]
    if len(query) >= 4:
        parts.append(
            f"CASE WHEN contains({name}, {lit(query)}) THEN 0.3 WHEN contains({body}, {lit(query)}) THEN 0.15"
            " ELSE 0.0 END"
        )
    total = " + ".join(f"CAST({p} AS DOUBLE)" for p in parts)
    return f"least(1.0, greatest(0.0, {total}))"


def scored(query: str) -> str:
    """CTEs up to ``scored``: every chunk with its partial and hybrid scores."""
    from foliant.operators.hybrid import hybrid_weights

    ws, wl = hybrid_weights(query.split())
    return f"""{FILES}, {EMBEDDED}, {QUERY_VECTOR}, cosines AS (
  SELECT embedded.* EXCLUDE (embedding), least(1.0, greatest(-1.0, {COSINE})) AS cosine,
         {normalize('file_name')} AS name_n, {normalize('chunk_text')} AS body_n
  FROM embedded, qv), scored AS (
  SELECT * EXCLUDE (name_n, body_n), least(1.0, greatest(0.0, (cosine - 0.42) / 0.43)) AS semantic,
         {lexical(query)} AS lexical,
         round(least(1.0, greatest(0.0, CAST({ws} AS DOUBLE) * least(1.0, greatest(0.0, (cosine - 0.42) / 0.43))
               + CAST({wl} AS DOUBLE) * {lexical(query)})), 9) AS score
  FROM cosines)"""


def hits(query: str, k: int) -> str:
    """CTEs up to ``hits``: the similarity search result with its ``rank``."""
    single = len(query.split()) <= 1
    gate = "WHERE lexical > 0" if single else ""
    keep = "" if single else "WHERE score >= greatest(round((SELECT max(score) FROM scored) * 0.82, 9), 0.15)"
    return f"""{scored(query)}, kept AS (SELECT * FROM scored {gate or keep}), best AS (
  SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY score DESC, chunk_index) AS rn FROM kept), hits AS (
  SELECT file_id, chunk_index, file_path, file_name, {truncate('chunk_text', 200)} AS chunk_snippet, chunk_text, chunk_offset,
         score, row_number() OVER (ORDER BY score DESC, file_id, chunk_index) AS rank
  FROM best WHERE rn = 1 ORDER BY score DESC, file_id, chunk_index LIMIT {k})"""


COLUMNS = ("file_name", "description", "text_content", "transcript_text", "tags")


def tokens(expr: str) -> str:
    return f"regexp_extract_all({fold(expr)}, '[\\p{{L}}\\p{{N}}]+')"


POSTINGS = """postings AS (
  SELECT id, col, CAST(pos - 1 AS INTEGER) AS pos, token FROM (
    SELECT id, col, unnest(range(1, len(toks) + 1)) AS pos, unnest(toks) AS token FROM (""" + " UNION ALL ".join(
    f"SELECT id, {i} AS col, {tokens(c)} AS toks FROM files" for i, c in enumerate(COLUMNS)
) + ")))"


def bm25(phrases: list[tuple[tuple[str, ...], bool]], weights: dict[str, float], require_all: bool, base: str = FILES) -> str:
    """CTEs up to ``ranked`` (id, rank) for phrases of (tokens, prefix)."""
    branches = []
    for p, (words, prefix) in enumerate(phrases):
        joins, tests = "", []
        for i, word in enumerate(words):
            alias = f"p{i}"
            if i:
                joins += f" JOIN postings {alias} ON {alias}.id = p0.id AND {alias}.col = p0.col AND {alias}.pos = p0.pos + {i}"
            last = prefix and i == len(words) - 1
            tests.append(f"starts_with({alias}.token, {lit(word)})" if last else f"{alias}.token = {lit(word)}")
        weight = "CASE p0.col " + " ".join(
            f"WHEN {i} THEN {float(weights.get(c, 0.0))}" for i, c in enumerate(COLUMNS)
        ) + " END"
        branches.append(
            f"SELECT p0.id, {p} AS phrase, CAST(sum({weight}) AS DOUBLE) AS f FROM postings p0{joins}"
            f" WHERE {' AND '.join(tests)} GROUP BY p0.id"
        )
    having = f"HAVING count(*) = {len(phrases)}" if require_all else ""
    return f"""{base}, {POSTINGS}, lengths AS (
  SELECT files.id, count(token) AS n FROM files LEFT JOIN postings ON postings.id = files.id GROUP BY files.id), corpus AS (
  SELECT CAST(count(*) AS DOUBLE) AS rows, CAST(sum(n) AS DOUBLE) / count(*) AS mean FROM lengths), hit AS (
  {' UNION ALL '.join(branches)}), idf AS (
  SELECT phrase, CASE WHEN ln((rows - count(*) + 0.5) / (count(*) + 0.5)) > 0
                      THEN ln((rows - count(*) + 0.5) / (count(*) + 0.5)) ELSE 1e-6 END AS idf
  FROM hit, corpus GROUP BY phrase, rows), ranked AS (
  SELECT hit.id, -sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / mean))) AS rank
  FROM hit JOIN idf USING (phrase) JOIN lengths ON lengths.id = hit.id, corpus GROUP BY hit.id {having})"""


SUFFIX_PATTERN = f"^(.{{3,}}?)(?:{'|'.join(RU_SUFFIXES)})$"
STOPWORDS = in_list(QUERY_STOPWORDS)
TAG_STOPS = in_list(TAG_STOPWORDS)

ERROR = f"""CASE WHEN {trim("text")} = '' THEN 'empty_content'
       WHEN strlen({trim("text")}) < 50 THEN 'content_too_short' END"""


def sentences(expr: str) -> str:
    """State after a fold over terminator-delimited pieces: finished sentences, each behind chr(1), and the rest."""
    pieces = f"regexp_extract_all({expr}, '[^.!?]*[.!?]|[^.!?]+')"
    states = f"list_transform({pieces}, lambda p: {{'buf': p, 'done': ''}})"
    full = f"regexp_matches(x.buf, '[.!?]$') AND strlen({trim('acc.buf || x.buf')}) > 10"
    return (
        f"list_reduce({states}, lambda acc, x: CASE WHEN {full} THEN"
        f" {{'buf': '', 'done': acc.done || chr(1) || {trim('acc.buf || x.buf')}}}"
        f" ELSE {{'buf': acc.buf || x.buf, 'done': acc.done}} END, {{'buf': '', 'done': ''}})"
    )


def sentence_list(state: str) -> str:
    """The list of sentences out of a final state."""
    rest = trim(f"{state}.buf")
    return (
        f"list_filter(string_split({state}.done || CASE WHEN strlen({rest}) > 10 THEN chr(1) || {rest} ELSE '' END, chr(1)),"
        " lambda x: x <> '')"
    )


def json_string(expr: str) -> str:
    out = expr
    for char, escape in (("\\", "\\\\"), ('"', '\\"')):
        out = f"replace({out}, {lit(char)}, {lit(escape)})"
    for code, escape in ((10, "\\n"), (13, "\\r"), (9, "\\t")):
        out = f"replace({out}, chr({code}), {lit(escape)})"
    return f"""'"' || {out} || '"'"""


FILE_EVENTS = """file_events AS (
  SELECT event_id, '/watch/' || user_id || '_' || event_type AS path,
         CASE WHEN event_type = 'error' THEN 'remove' ELSE 'add' END AS op, epoch_us(ts) // 1000 AS ts_ms, user_id, event_type,
         value, ts FROM events)"""
