"""Exact JSON text of the records handed to callers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The escapes that have a short form.
_SHORT_ESCAPES = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"))
_LONG_ESCAPES = tuple((chr(c), f"\\u{c:04x}") for c in range(0x20) if chr(c) not in "\n\r\t")
_C1_ESCAPES = tuple((chr(c), f"\\u{c:04x}") for c in range(0x7F, 0xA0))


def _replace_all(text: Column, pairs) -> Column:
    return reduce(lambda acc, p: F.replace(acc, F.lit(p[0]), F.lit(p[1])), pairs, text)


def json_string(text: Column, all_controls: bool = False) -> Column:
    """Quoted JSON string; non-ASCII characters stay as they are.

    ``all_controls`` also escapes U+007F to U+009F, as summary, tag and
    recognition records do.
    """
    short = _replace_all(text, _SHORT_ESCAPES)
    escapes = _LONG_ESCAPES + (_C1_ESCAPES if all_controls else ())
    pattern = "[\\x00-\\x1f\\x7f-\\x9f]" if all_controls else "[\\x00-\\x1f]"
    full = F.when(short.rlike(pattern), _replace_all(short, escapes)).otherwise(short)
    return F.concat(F.lit('"'), full, F.lit('"'))


def json_nullable(text: Column) -> Column:
    return F.coalesce(json_string(text), F.lit("null"))


def json_number(value: Column) -> Column:
    """Decimal notation without exponent or trailing zeros."""
    plain = F.format_string("%.17f", value)
    wide = F.when(
        (F.abs(value) >= 1e-3) & (F.abs(value) < 1e7), value.cast("string")
    ).otherwise(plain)
    return F.regexp_replace(F.regexp_replace(wide, "(\\.[0-9]*?)0+$", "$1"), "\\.$", "")


def json_array(items: Column) -> Column:
    """JSON array out of an array of already encoded items."""
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def json_object(**fields: Column) -> Column:
    parts: list[Column] = []
    for i, (name, encoded) in enumerate(fields.items()):
        parts += [F.lit(("," if i else "{") + f'"{name}":'), encoded]
    return F.concat(*parts, F.lit("}"))


def rag_result_json(answer: Column, sources: Column, error_code: Column) -> Column:
    """Answer record; ``sources`` is an array of (file_path, chunk_snippet, chunk_offset)."""
    items = F.transform(
        sources,
        lambda s: json_object(
            file_path=json_string(s["file_path"]),
            chunk_snippet=json_string(s["chunk_snippet"]),
            chunk_offset=s["chunk_offset"].cast("string"),
        ),
    )
    return json_object(answer=json_string(answer), sources=json_array(items), error_code=json_nullable(error_code))


def similarity_json(hits: Column) -> Column:
    """Array of similarity hits as JSON."""
    items = F.transform(
        hits,
        lambda h: json_object(
            file_path=json_string(h["file_path"]),
            file_name=json_string(h["file_name"]),
            chunk_snippet=json_string(h["chunk_snippet"]),
            chunk_offset=h["chunk_offset"].cast("string"),
            score=json_number(h["score"]),
        ),
    )
    return json_array(items)


def vector_json(vector: Column) -> Column:
    return json_array(F.transform(vector, json_number))


def summary_json(summary: Column, error_code: Column) -> Column:
    return json_object(summary=json_string(summary, all_controls=True), error_code=json_nullable(error_code))


def tags_json(tags: Column, error_code: Column) -> Column:
    return json_object(tags=json_array(F.transform(tags, lambda t: json_string(t, all_controls=True))), error_code=json_nullable(error_code))


def extraction_json(
    text: Column, content_type: Column, pages: Column, confidence: Column, error_code: Column
) -> Column:
    """Recognition result as JSON, confidence with four decimals."""
    return json_object(
        text=json_string(text, all_controls=True),
        content_type=json_string(content_type),
        pages_processed=pages.cast("string"),
        confidence=F.coalesce(F.format_string("%.4f", confidence), F.lit("null")),
        error_code=json_nullable(error_code),
    )


_ITEM = '"([^"\\\\]*+(?:\\\\.[^"\\\\]*+)*+)"'
_LIST = f"(?s)^\\s*\\[[\\s,]*+(?:{_ITEM.replace('(', '(?:', 1)}[\\s,]*+)*+\\]\\s*$"


def parse_string_array(text: Column) -> Column:
    """Strings of a JSON array, null when the text is not one.

    Lenient about commas; unknown escapes keep their backslash.
    """

    def unescape(item: Column) -> Column:
        # Splitting at escaped backslashes first keeps "\\n" from reading as a newline.
        parts = F.transform(
            F.split(item, "\\\\\\\\"),
            lambda p: _replace_all(p, (('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"))),
        )
        return F.array_join(parts, "\\")

    items = F.regexp_extract_all(text, F.lit("(?s)" + _ITEM), 1)
    return F.when(text.rlike(_LIST), F.transform(items, unescape))


RAG_RECORD = (
    "struct<answer:string,sources:array<struct<file_path:string,chunk_snippet:string,chunk_offset:bigint>>,error_code:string>"
)


def parse_rag_result(text: Column) -> Column:
    """Answer record out of its JSON, null when it is none."""
    return F.from_json(text, RAG_RECORD)
