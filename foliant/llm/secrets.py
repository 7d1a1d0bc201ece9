"""Secret scans with multipart credential linking.

Base findings (always kept, leftmost and non-overlapping per kind, spans in code
points, end exclusive):

* assign: a value of 6 or more characters given to a name such as ``api_key``;
  the span covers the whole match,
* access: ``AKIA`` and capitals or digits, 20 or more characters,
* hex: 24 or more characters of ``0-9a-f``.

Weak candidates say little alone: an access identifier, a secret-like word (long,
letters and digits mixed) or an endpoint (a host name, address or URL).  They
are linked by an interval join within scopes.  A scope is a paragraph (text
between blank lines), whatever its length.  How weak a candidate is decides how
it joins: the value of a name, as in JSON or INI entries, and a bare word whose
neighbouring characters change between capitals, small letters and digits in a
share of at least ``MIXED_LEAST`` join with every part of their scope.  Bare
words below it, which may be product names or slugs, need a part within
``REACH`` code points.  A weak secret is reported only
beside an identifier or an endpoint, an endpoint only beside a secret, an
identifier that is no base finding only beside a secret.  The join is a search
in sorted positions, so it takes n log n time for any number of parts in a scope
and lists no pairs.  Parts that overlap a base finding are that finding.

A URL is cut at the base findings and keys it holds: values of its query, user
data before the host, and parts of its path other than words and numbers joined
by hyphens.  Its other pieces are endpoints.  Host names may have any top-level
domain in one case of letters.  Every pattern is linear in the text, whatever its bytes.

Null and empty texts have no findings.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.arrays import sliced

REACH = 200
MIXED_LEAST = 0.2


def _either(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_either, ("password", "passwd", "secret", "token"))) + "|" + _either("api") + "_?" + _either("key")
ASSIGN = re.compile(rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Other names that give an identifier, and values that look like keys.
IDENTIFIER = re.compile(r"\b(?:access_?key(?:_?id)?|client_?id|account|user(?:name)?|login)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9@._-]{3,})", re.A | re.I)
KEY_LIKE = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{16,}(?![A-Za-z0-9+/_=-])")
URL = re.compile(r"https?://(?=[A-Za-z0-9.-])")
URL_END = re.compile(r"[\s\"'<>]|\Z")
#: Runs that may hold a host name, its last label and its port.
RUN = re.compile(r"(?<![A-Za-z0-9.-])[A-Za-z0-9-]*+\.[A-Za-z0-9.-]*+")
TOP_LEVEL = re.compile(r"[a-z]{2,63}|[A-Z]{2,63}|[Xx][Nn]--[A-Za-z0-9-]{2,59}")
PORT = re.compile(r":[0-9]+")
ADDRESS = re.compile(r"\b(?=([0-9]{1,3}(?:\.[0-9]{1,3}){3}:[0-9]+\b))", re.A)
#: A URL's user data and host, the words behind them, and parts of a path that are words.
AUTHORITY = re.compile(r"https?://(?:([^\s\"'<>/?#]*)@)?[^\s\"'<>/?#@]*")
URL_VALUE = re.compile(r"(?<==)[A-Za-z0-9+/_%~.-]{16,}=*|(?<![A-Za-z0-9+_%~-])[A-Za-z0-9+_%~-]{16,}+=*+(?![^/?#&;,:@.)\]}|!$*(])")
URL_USER = re.compile(r"[^:@]{16,}")
MIXED = re.compile(r"(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])")
TITLE = re.compile(r"(?:[A-Za-z]+|[0-9]+)(?:[-_+~]+(?:[A-Za-z]+|[0-9]+))*")
BREAK = re.compile(r"\n[ \t\r]*\n")
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    return out + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


class Places:
    """Disjoint spans in order, asked for one that lies near another."""

    def __init__(self, spans: list[Span]):
        spans = sorted(spans)
        self.starts = [s for s, _, _ in spans]
        self.ends = [e for _, e, _ in spans]

    def near(self, start: int, end: int, scope: tuple[int, int], reach: int | None = None) -> bool:
        """Is there a span within reach and scope?  Without a reach, the whole scope counts."""
        low, high = scope if reach is None else (max(scope[0], start - reach), min(scope[1], end + reach))
        i = bisect_left(self.ends, low + 1)
        return i < len(self.starts) and self.starts[i] < high

    def within(self, start: int, end: int) -> list[Span]:
        """The spans that overlap another."""
        i, out = bisect_right(self.ends, start), []
        while i < len(self.starts) and self.starts[i] < end:
            out.append((self.starts[i], self.ends[i], "taken"))
            i += 1
        return out

    def touches(self, start: int, end: int) -> bool:
        i = bisect_right(self.ends, start)
        return i < len(self.starts) and self.starts[i] < end


def merged(spans: list[Span]) -> list[Span]:
    """Union of spans as disjoint ones that do not touch; the kind of the first stays."""
    out: list[Span] = []
    for s, e, kind in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]), out[-1][2])
        else:
            out.append((s, e, kind))
    return out


def url_keys(url: str) -> list[tuple[int, int]]:
    """Spans of the key-like parts of a URL."""
    head = AUTHORITY.match(url)
    out = [(head.start(1) + m.start(), head.start(1) + m.end()) for m in URL_USER.finditer(head[1] or "") if MIXED.match(m[0])]
    return out + path_keys(url, head.end())


def path_keys(url: str, at: int) -> list[tuple[int, int]]:
    """Those behind a place."""
    found = (m for m in URL_VALUE.finditer(url[at:]) if MIXED.match(m[0]))
    return [(at + m.start(), at + m.end()) for m in found if url[at + m.start() - 1] == "=" or not TITLE.fullmatch(m[0])]


def hosts(text: str) -> list[Span]:
    """Host names: labels joined by single dots up to the last that can be a top-level domain, with a port behind it."""
    out = []
    for m in RUN.finditer(text):
        at = m.start()
        begin, end = None, None
        # a name begins at the run, and behind an empty label or one that ends in a hyphen
        free = not (at and text[at - 1] == "_")
        for label in (*m[0].split("."), ""):
            stop = at + len(label)
            if not label:
                if end is not None:
                    port = PORT.match(text, end)
                    out.append((begin, port.end() if port else end, "endpoint"))
                begin, end, free = None, None, True
            elif begin is None:
                begin = at if free else None
                free = label[-1] == "-"
            elif TOP_LEVEL.fullmatch(label) and text[stop : stop + 1] != "_":
                end = stop
            at = stop + 1
    return out


def endpoints_of(text: str) -> list[Span]:
    """URLs, host names and addresses with a port, leftmost and non-overlapping."""
    found = [(m.start(), 0, m.end()) for m in URL.finditer(text)] if "://" in text else []
    found += [(s, 1, e) for s, e, _ in hosts(text)] + [(m.start(1), 2, m.end(1)) for m in ADDRESS.finditer(text)]
    out, at = [], 0
    for s, kind, e in sorted(found):
        if s >= at:
            e = e if kind else URL_END.search(text, e).start()
            out.append((s, e, "endpoint"))
            at = e
    return out


def mixed_share(word: str) -> float:
    """How often neighbouring letters and digits of a word differ in kind: capital, small, digit."""
    kinds = [0 if c.isdigit() else 1 if c.isupper() else 2 for c in word if c.isalnum()]
    return sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(1, len(kinds) - 1)


def cut_urls(endpoints: list[Span], text: str, taken: Places) -> tuple[list[Span], list[Span]]:
    """Endpoints without the base findings and keys that URLs hold, and these keys."""
    whole, keys = [], []
    for s, e, kind in endpoints:
        if "://" not in text[s : min(e, s + 8)]:
            if not taken.touches(s, e):
                whole.append((s, e, kind))
            continue
        own = [(s + a, s + b, "secret") for a, b in url_keys(text[s:e]) if not taken.touches(s + a, s + b)]
        keys += own
        at = s
        for a, b, _ in merged(own + taken.within(s, e)):
            if at < a:
                whole.append((at, a, kind))
            at = max(at, b)
        if at < e:
            whole.append((at, e, kind))
    return whole, keys


def is_value(text: str, start: int, end: int) -> bool:
    """Is the word the value of a name, as in ``"name": "word"`` or ``name=word``?"""
    word = text[start:end]
    if "=" in word.strip("="):
        return True
    at = start - 1
    if at >= 0 and text[at] in "\"'":
        at -= 1
    while at >= 0 and text[at].isspace():
        at -= 1
    return at >= 0 and text[at] in ":=" and not word.startswith("//")


def linked_spans(text: str, base: list[Span]) -> list[Span]:
    """Weak candidates whose complementary parts co-occur."""
    taken = Places(merged(base))
    free = lambda found: [x for x in found if not taken.touches(x[0], x[1])]
    endpoints, keys = cut_urls(endpoints_of(text), text, taken) if "." in text or "://" in text else ([], [])
    marked = ":" in text or "=" in text
    identifiers = free([(m.start(), m.end(), "identifier") for m in IDENTIFIER.finditer(text)]) if marked else []
    if not (endpoints or identifiers or any(k == "access" for _, _, k in base)):
        return []
    secrets = free([(m.start(), m.end(), "secret") for m in KEY_LIKE.finditer(text)])
    other = Places(merged(endpoints + identifiers + keys))
    # a word that starts within a host name goes on as the path of a URL
    for s, e, _ in secrets:
        for _, end, _ in other.within(s, e)[-1:]:
            keys += [(s + a, s + b, "secret") for a, b in path_keys(text[s:e], end - s)]
    secrets = [x for x in secrets if not other.touches(x[0], x[1])]
    values = Places([x for x in secrets if is_value(text, x[0], x[1]) or mixed_share(text[x[0] : x[1]]) >= MIXED_LEAST])
    secrets += keys
    strong_secret = Places(merged([x for x in base if x[2] in ("assign", "hex")] + secrets))
    anchors = Places(merged(endpoints + identifiers + [x for x in base if x[2] == "access"]))
    breaks = [m.start() for m in BREAK.finditer(text)]

    def scope(start: int) -> tuple[int, int]:
        i = bisect_right(breaks, start)
        return (breaks[i - 1] if i else 0, breaks[i] if i < len(breaks) else len(text))

    out = [x for x in secrets if anchors.near(x[0], x[1], scope(x[0]), None if values.touches(x[0], x[1]) else REACH)]
    for x in endpoints + identifiers:
        own = scope(x[0])
        if strong_secret.near(x[0], x[1], own, REACH) or values.near(x[0], x[1], own):
            out.append(x)
    return out


def findings(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans and linked spans of one text."""
    text = text or ""
    base = base_spans(text)
    return base, linked_spans(text, base)


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, counts of the base kinds, digest of the base spans, all spans, number of linked ones."""
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked"]

    def run(batches):
        for batch in sliced(batches, "text"):
            rows = [[] for _ in names[1:]]
            for text in batch.column("text").to_pylist():
                base, linked = findings(text)
                kinds = [k for _, _, k in base]
                made = [kinds.count(k) for k in KINDS[:3]]
                made += [hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + linked), len(linked)]
                for row, value in zip(rows, made, strict=True):
                    row.append(value)
            kinds = [pa.int64()] * 3 + [pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(r, k) for r, k in zip(rows, kinds, strict=True))], names=names
            )

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long"
    )


def masked(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every finding replaced by ``mask``; ``n_chars``, where present, is counted anew."""
    counts = "n_chars" in docs.columns

    def run(batches):
        for batch in sliced(batches, text_col):
            texts = batch.column(text_col).to_pylist()
            changed = []
            for i, text in enumerate(texts):
                base, linked = findings(text)
                if base or linked:
                    parts, at = [], 0
                    for s, e, _ in merged(base + linked):
                        parts += [text[at:s], mask]
                        at = e
                    texts[i] = "".join([*parts, text[at:]])
                    changed.append(i)
            for name in (text_col, "n_chars") if changed and counts else (text_col,) if changed else ():
                at = batch.schema.get_field_index(name)
                field = batch.schema.field(at)
                values = texts
                if name == "n_chars":
                    values = batch.column(name).to_pylist()
                    for i in changed:
                        values[i] = len(texts[i])
                batch = batch.set_column(at, field, pa.array(values, field.type))
            yield batch

    return docs.mapInArrow(run, docs.schema)
