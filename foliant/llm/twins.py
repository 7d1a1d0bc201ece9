"""DuckDB forms of the queries of this package that SQL can express."""

from __future__ import annotations

from foliant.llm import sharding

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: One row with ``tab``, the table of CRC-32, made by its rule.
CRC_TABLE = (
    "SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0],"
    " lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab"
)


def crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, beside ``CRC_TABLE``."""
    data = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {data}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


def _field(name: str) -> str:
    return f"CASE WHEN {name} IS NULL THEN '-' ELSE strlen({name}::VARCHAR)::VARCHAR || ':' || {name}::VARCHAR END"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(f"({_field(c)})" for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


def _levels(name: str, leaves: str) -> str:
    """All nodes over ``leaves`` (tree, pos, hash, n)."""
    return f"""{name} AS (
  SELECT 0 AS level, tree, pos, hash, n FROM {leaves}
  UNION ALL
  SELECT level + 1, tree, pos // 2, sha256(string_agg(hash, '' ORDER BY pos)), (n + 1) // 2
  FROM {name} WHERE n > 1 GROUP BY level, tree, pos // 2, n)"""


def _folds(name: str, start: str, nodes: str) -> str:
    """Steps from ``start`` (r, tree, pos, cur) to the top, over siblings in ``nodes``."""
    return f"""{name} AS (
  SELECT 0 AS level, r, tree, pos, cur FROM {start}
  UNION ALL
  SELECT f.level + 1, f.r, f.tree, f.pos // 2,
    sha256(CASE WHEN s.hash IS NULL THEN f.cur WHEN f.pos % 2 = 1 THEN s.hash || f.cur ELSE f.cur || s.hash END)
  FROM {name} f JOIN {nodes} o ON o.tree = f.tree AND o.level = f.level AND o.pos = f.pos AND o.n > 1
  LEFT JOIN {nodes} s ON s.tree = f.tree AND s.level = f.level AND s.pos = xor(f.pos, 1))"""


def _siblings(start: str, nodes: str) -> str:
    return f"""SELECT l.r, coalesce(string_agg(s.hash, '' ORDER BY s.level), '') AS hashes
  FROM {start} l LEFT JOIN {nodes} s ON s.tree = l.tree AND s.n > 1 AND s.pos = xor(l.pos >> s.level, 1)
  GROUP BY l.r"""


MERKLE = f"""
WITH RECURSIVE crc AS ({CRC_TABLE}),
hashed AS (
  SELECT doc_id, CASE WHEN lang IS NULL THEN '-' ELSE '=' || lang END AS tree, {_leaf("n_chars")} AS hash,
    CASE WHEN {crc32("doc_id::VARCHAR")} % 7 = 0 AND n_chars IS NOT NULL THEN {_leaf("(n_chars + 1)")} END AS altered
  FROM documents, crc),
leaves AS (
  SELECT row_number() OVER () AS r, *, count(*) OVER (PARTITION BY tree) AS n,
    row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, hash) - 1 AS pos
  FROM hashed),
{_levels("nodes", "leaves")},
subroots AS (
  SELECT '^' AS tree, tree AS own, hash, count(*) OVER () AS n, row_number() OVER (ORDER BY tree) - 1 AS pos
  FROM nodes WHERE n = 1),
{_levels("tops", "subroots")},
{_folds("lower_fold", "(SELECT r, tree, pos, coalesce(altered, hash) AS cur FROM leaves)", "nodes")},
halfway AS (
  SELECT r, '^' AS tree, s.pos, f.cur FROM (SELECT r, tree, arg_max(cur, level) AS cur FROM lower_fold GROUP BY r, tree) f
  JOIN subroots s ON s.own = f.tree),
{_folds("upper_fold", "halfway", "tops")},
folded AS (SELECT r, arg_max(cur, level) AS folded_root FROM upper_fold GROUP BY r),
below AS ({_siblings("leaves", "nodes")}),
above AS ({_siblings("halfway", "tops")})
SELECT l.doc_id, l.hash AS leaf, s.hash AS subroot, t.hash AS root, sha256(b.hashes || a.hashes) AS proof_sha256,
  f.folded_root, f.folded_root = t.hash AS verified, l.pos::BIGINT AS position
FROM leaves l JOIN subroots s ON s.own = l.tree JOIN tops t ON t.n = 1
JOIN below b ON b.r = l.r JOIN above a ON a.r = l.r JOIN folded f ON f.r = l.r
"""


def feistel_shards(shards: int = sharding.SHARDS, key: bytes = sharding.KEY) -> str:
    first, second = sharding.PRIMES
    turned = "SELECT pos, n, a, b, x // b AS l, x % b AS r FROM walk WHERE step = 0 OR x >= n"
    for i, (c0, c1, c2) in enumerate(sharding.Permutation(1, key).constants()):
        added = f"((r % {first}) * {c0} + {c1}) % {first} % {second} * {c2} % {second}"
        turned = f"SELECT pos, n, a, b, r AS l, (l + {added}) % {'b' if i % 2 else 'a'} AS r FROM ({turned})"
    return f"""
WITH RECURSIVE crc AS ({CRC_TABLE}),
sized AS (SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size, {crc32("coalesce(text, '')")} AS text_crc32 FROM documents, crc),
ranked AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS pos, count(*) OVER () AS n FROM sized),
sides AS (SELECT *, (n + a - 1) // a AS b FROM (SELECT *, floor(sqrt(n - 1))::BIGINT + 1 AS a FROM ranked)),
walk AS (
  SELECT 0 AS step, pos, n, a, b, pos AS x FROM sides
  UNION ALL
  SELECT 1, pos, n, a, b, l * b + r FROM ({turned}))
SELECT s.doc_id, s.size::BIGINT AS size, s.text_crc32, '{sharding.LAW}' AS law, (w.x % {shards})::INTEGER AS shard,
  w.x // {shards} AS slot, NULL::INTEGER AS grown_shard, s.pos AS row_number, w.x AS place
FROM sides s JOIN walk w ON w.pos = s.pos AND w.step = 1 AND w.x < w.n
"""


DIVERGENCE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
terms AS (
  SELECT r, lang, source, translate(raw, '{_UPPER}', '{_LOWER}') AS term
  FROM (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS raw FROM d)),
kept AS (SELECT lang, term FROM terms GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
sizes AS (SELECT lang, count(k.term) AS v FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept k USING (lang) GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
counts AS (SELECT lang, source, term, count(*) AS n FROM terms JOIN kept USING (lang, term) GROUP BY lang, source, term),
cells AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total,
    sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, k.term) AS m, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang) AS spoken
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
shares AS (
  SELECT lang, source, term, n, (1 + 1000000000::HUGEINT * (n + 5) // (total + 5 * v))::BIGINT AS p,
    (1 + 1000000000::HUGEINT * (m + 5) // (spoken + 5 * v))::BIGINT AS q
  FROM cells JOIN sizes USING (lang)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(x.p - y.p)) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY a.lang, a.source, b.source),
found AS (
  SELECT lang, source, 'pair' AS part, item, coalesce(value, 0)::BIGINT AS value FROM pairs
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM found)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""

SQL = {
    "op11_merkle_manifest": MERKLE,
    "op12_feistel_shards": feistel_shards(),
    "op13_source_divergence": DIVERGENCE,
}
