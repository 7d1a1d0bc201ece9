"""Text functions as Column expressions.

Functions named ``*_literal`` are their driver-side twins for query strings,
which are known while the plan is being built.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Code points with the Unicode White_Space property.
WHITESPACE = "".join(
    map(chr, (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
)
_WS_CLASS = WHITESPACE
ALNUM = r"\p{IsAlphabetic}\p{N}"

# Character class of an index token: letters, numbers, private use.
TOKEN_CLASS = r"\p{L}\p{N}\p{Co}"
TOKEN_PATTERN = f"[{TOKEN_CLASS}]+"

# Inflectional endings, longest first.
RU_SUFFIXES = (
    "ями", "ого", "его", "ому", "ему", "ами", "ыми", "ими", "ние", "ний", "ные", "ный", "ная", "ное", "ную", "ной",
    "ном", "ных", "ях", "ам", "ом", "ем", "ей", "ов", "ые", "ие", "ую", "юю", "ой", "им", "ым", "ах", "а", "я", "о",
    "е", "и", "ы", "у", "ю",
)

# Words never used as retrieval keywords.
QUERY_STOPWORDS = (
    "the", "and", "are", "was", "for", "you", "your", "can", "its", "with", "from", "into", "between", "through",
    "during", "before", "after", "above", "below", "also", "just", "only", "have", "has", "had", "been", "will",
    "would", "could", "should", "may", "might", "this", "that", "these", "those", "which", "what", "when", "who",
    "how", "where", "please", "show", "find", "tell", "give", "list", "folder", "file", "document",
    "это", "или", "все", "мне", "мой", "моя", "моё", "где", "файл", "папка", "какой", "какая", "какое", "который",
    "которая", "которое", "которые", "пожалуйста", "покажи", "найди", "список",
)

# Words never used as tags.
TAG_STOPWORDS = (
    "the", "and", "for", "are", "but", "not", "you", "all", "can", "had", "her", "was", "one", "our", "out", "has",
    "have", "been", "from", "that", "this", "with", "they", "will", "what", "when", "where", "which", "their",
    "there", "these", "those", "then", "than", "them", "each", "would", "make", "like", "just", "over", "such",
    "into", "some", "could", "other", "about", "more", "also", "very", "should", "being", "does", "doing", "done",
    "only", "after", "before",
    "это", "как", "что", "для", "или", "при", "все", "его", "они", "она", "был", "уже", "еще", "ещё", "так", "тоже",
    "другой", "другие", "между", "через", "после", "перед", "более", "менее", "также", "может", "будет", "были",
    "быть", "если", "только", "когда", "где", "там", "тут", "чтобы", "потому", "очень", "самый", "свой", "который",
    "которая", "которое", "которые",
    "http", "https", "www", "com", "org", "net",
)

# Least sizes in the enrichment steps.
MIN_CONTENT_BYTES = 50
MIN_WORD_BYTES = 3
MIN_SENTENCE_BYTES = 10


# --------------------------------------------------------------------------
# folding and trimming


@lru_cache(maxsize=1)
def fold_table() -> tuple[str, str]:
    """``translate`` arguments that strip Latin diacritics.

    Derived from Unicode decompositions: a lower-case letter that splits into
    an ASCII letter and a single mark maps to that letter.  The combining marks
    themselves have no counterpart, so ``translate`` deletes them.
    """
    source, target = [], []
    for code in range(0xC0, 0x1F00):
        char = chr(code)
        parts = unicodedata.decomposition(char).split()
        if len(parts) != 2 or parts[0].startswith("<") or char.lower() != char:
            continue
        base, mark = (chr(int(p, 16)) for p in parts)
        if base.isascii() and base.isalpha() and unicodedata.combining(mark):
            source.append(char)
            target.append(base)
    marks = "".join(chr(c) for c in range(0x300, 0x332))
    return "".join(source) + marks, "".join(target)


def fold_for_index(text: Column) -> Column:
    """Lower case without Latin diacritics, the form index tokens are cut from."""
    source, target = fold_table()
    return F.translate(F.lower(text), source, target)


def fold_for_index_literal(text: str) -> str:
    source, target = fold_table()
    table = {ord(c): (target[i] if i < len(target) else None) for i, c in enumerate(source)}
    return text.lower().translate(table)


def fold_ascii_case(text: Column) -> Column:
    """Lower-case A-Z only; other scripts keep their case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def trim_ws(text: Column) -> Column:
    """Trim Unicode white space, not only blanks."""
    return F.btrim(text, F.lit(WHITESPACE))


def split_ws(text: Column) -> Column:
    return F.filter(F.split(text, f"[{_WS_CLASS}]+"), lambda t: t != "")


def truncate(text: Column, max_chars: int, ellipsis: str = "…") -> Column:
    """First ``max_chars`` characters, marked with an ellipsis when cut."""
    return F.when(F.char_length(text) > max_chars, F.concat(F.substring(text, 1, max_chars), F.lit(ellipsis))).otherwise(
        text
    )


# --------------------------------------------------------------------------
# lexical matching


def normalize_lexical(text: Column) -> Column:
    """Lower case with punctuation other than ``_`` and ``-`` turned into blanks."""
    return F.regexp_replace(F.lower(text), f"[^{ALNUM}_\\-{_WS_CLASS}]", " ")


def normalize_lexical_literal(text: str) -> str:
    return "".join(c if c.isalnum() or c in "_-" or c.isspace() else " " for c in text.lower())


def normalized_pattern(needle: str) -> str:
    """Regex finding a normalised needle in a text that is lower-cased only.

    A blank of the needle stands for a blank or any character that
    normalisation turns into one.
    """
    blank = f"[^{ALNUM}_\\-{_WS_CLASS.replace(' ', '')}]"
    return "".join(blank if c == " " else re.escape(c) for c in needle)


_STEM_PATTERN = f"^(.{{3,}}?)(?:{'|'.join(RU_SUFFIXES)})$"
_CYRILLIC = "[\\u0400-\\u04ff]"


def stem_ru(word: Column) -> Column:
    """Strip the longest ending that leaves at least three letters.

    The lazy stem group makes the regex prefer the shortest admissible stem,
    which is the longest admissible ending.
    """
    lower = F.lower(word)
    stem = F.regexp_extract(lower, _STEM_PATTERN, 1)
    return F.when(~word.rlike(_CYRILLIC) | (F.char_length(word) <= 3), word).otherwise(
        F.when(stem != "", stem).otherwise(lower)
    )


def stem_ru_literal(word: str) -> str:
    if not re.search(_CYRILLIC, word) or len(word) <= 3:
        return word
    match = re.match(_STEM_PATTERN, word.lower())
    return match.group(1) if match else word.lower()


_KEEP_CASE_PATTERN = f"(?iu)(?:{'|'.join(RU_SUFFIXES)})$"


def stem_ru_keep_case(word: Column) -> Column:
    """Variant that keeps case and gives up when the stem gets too short."""
    stem = F.regexp_replace(word, _KEEP_CASE_PATTERN, "")
    return F.when(
        ~word.rlike(_CYRILLIC) | (F.char_length(word) <= 3) | (F.char_length(stem) < 3), word
    ).otherwise(stem)


def stem_ru_keep_case_literal(word: str) -> str:
    if not re.search(_CYRILLIC, word) or len(word) <= 3:
        return word
    stem = re.sub(f"(?:{'|'.join(RU_SUFFIXES)})$", "", word, flags=re.IGNORECASE)
    return word if len(stem) < 3 else stem


# --------------------------------------------------------------------------
# query keywords


def query_keywords(question: Column) -> Column:
    """Distinct keywords of a question, in order of first use."""
    spaced = F.regexp_replace(F.lower(question), f"[^{ALNUM}_\\-]", " ")
    stop = F.array(*[F.lit(w) for w in QUERY_STOPWORDS])
    words = F.filter(F.split(spaced, " +"), lambda w: (F.char_length(w) >= 3) & ~F.array_contains(stop, w))
    return F.array_distinct(words)


def query_keywords_literal(question: str) -> list[str]:
    spaced = "".join(c if c.isalnum() or c in "_-" else " " for c in question.lower())
    words = (w for w in spaced.split() if len(w) >= 3 and w not in QUERY_STOPWORDS)
    return list(dict.fromkeys(words))


def keyword_terms(keywords: Column) -> Column:
    """Index terms of keywords: each word, plus the parts of ``_``-joined ones.

    Only adjacent repeats are dropped; a later repeat counts twice in ranking.
    """
    expanded = F.flatten(
        F.transform(
            keywords,
            lambda w: F.when(
                F.contains(w, F.lit("_")),
                F.concat(F.array(w), F.filter(F.split(w, "_"), lambda p: F.char_length(p) >= 3)),
            ).otherwise(F.array(w)),
        )
    )
    empty = F.array().cast("array<string>")
    return F.aggregate(
        expanded,
        empty,
        lambda out, t: F.when((F.size(out) > 0) & (F.try_element_at(out, F.lit(-1)) == t), out).otherwise(
            F.array_append(out, t)
        ),
    )


def keyword_terms_literal(keywords: list[str]) -> list[str]:
    out: list[str] = []
    for word in keywords:
        out.append(word)
        if "_" in word:
            out.extend(p for p in word.split("_") if len(p) >= 3)
    return [t for i, t in enumerate(out) if i == 0 or t != out[i - 1]]


# --------------------------------------------------------------------------
# sentences, paragraphs, words


_TERMINATOR = re.compile("[.!?]")


def sentences_literal(text: str) -> list[str]:
    """Cut after ``.``, ``!`` or ``?`` once the trimmed piece exceeds ten bytes; a trailing piece follows the same rule."""
    out, start = [], 0
    for end in [*(m.end() for m in _TERMINATOR.finditer(text)), len(text)]:
        sentence = text[start:end].strip(WHITESPACE)
        if len(sentence.encode()) > MIN_SENTENCE_BYTES:
            out.append(sentence)
            start = end
    return out


def split_sentences(text: Column) -> Column:
    """Sentences of a text in one pass, null for null."""

    @F.arrow_udf("array<string>")
    def cut(column: pa.Array) -> pa.Array:
        rows = [None if t is None else sentences_literal(t) for t in column.to_pylist()]
        return pa.array(rows, pa.list_(pa.string()))

    return cut(text)


def split_paragraphs(text: Column) -> Column:
    """Non-empty trimmed blocks separated by a blank line."""
    return F.filter(F.transform(F.split(text, "\n\n"), trim_ws), lambda p: p != "")


def tag_words(text: Column) -> Column:
    """Words of three bytes or more that are not plain numbers."""
    words = F.regexp_extract_all(F.lower(text), F.lit(f"([{ALNUM}-]+)"), 1)
    return F.filter(words, lambda w: (F.octet_length(w) >= MIN_WORD_BYTES) & ~w.rlike("^[0-9]+$"))


# --------------------------------------------------------------------------
# language and wording


def detect_language(text: Column) -> Column:
    """``ru`` when more than half of the letters are Cyrillic, else ``en``."""
    cyrillic = F.regexp_count(text, F.lit(_CYRILLIC))
    letters = F.regexp_count(text, F.lit("\\p{IsAlphabetic}"))
    return F.when((letters > 0) & (cyrillic * 2 > letters), "ru").otherwise("en")


def detect_language_literal(text: str) -> str:
    letters = sum(c.isalpha() for c in text)
    cyrillic = sum("Ѐ" <= c <= "ӿ" for c in text)
    return "ru" if letters > 0 and cyrillic * 2 > letters else "en"


def pluralize_fragment(n: Column) -> Column:
    """Russian plural of "fragment" for a count."""
    teens = (n % 100).between(11, 14)
    return (
        F.when(teens, "фрагментов")
        .when(n % 10 == 1, "фрагмент")
        .when((n % 10).between(2, 4), "фрагмента")
        .otherwise("фрагментов")
    )


def is_meaningful(text: Column) -> Column:
    """More than three characters after trimming, at least one of them a letter."""
    return (F.char_length(trim_ws(text)) > 3) & text.rlike("[a-zA-Zа-яА-ЯёЁ]")


def parse_tag_list(raw: Column, max_tags: int = 7) -> Column:
    """Tags out of a comma-separated model answer."""
    trimmed = F.transform(F.split(raw, ","), trim_ws)
    return F.slice(F.filter(trimmed, lambda t: F.octet_length(t) >= MIN_WORD_BYTES), 1, max_tags)


def join_tags(tags: Column) -> Column:
    return F.array_join(tags, ", ")


def first_text(text: Column, description: Column) -> Column:
    """Stored text, else the description, else an empty string."""
    return F.coalesce(F.nullif(text, F.lit("")), F.nullif(description, F.lit("")), F.lit(""))


def embedding_text(description: Column, tags: Column, text: Column, transcript: Column) -> Column:
    """What gets embedded: the non-empty parts on separate lines, null when none."""
    parts = [F.nullif(c, F.lit("")) for c in (description, tags, text, transcript)]
    return F.nullif(trim_ws(F.concat_ws("\n", *parts)), F.lit(""))
