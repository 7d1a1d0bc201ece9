"""Prompt texts for a pluggable generative model, and the model-free answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.text import trim_ws, truncate

CONTEXT_SEPARATOR = "\n\n---\n\n"

# Language names used in prompts.
LANGUAGE_NAMES = {
    "en": "English",
    "ru": "Russian",
    "de": "German",
    "es": "Spanish",
    "pt": "Portuguese",
    "fr": "French",
    "zh": "Chinese",
    "ja": "Japanese",
}

# System prompts.
RAG_PROMPT = (
    "You are a helpful document assistant. Answer the user's question based ONLY on the provided context from their "
    "files. If the context does not contain enough information, say so. Answer strictly in %s. Be concise and accurate."
)
SUMMARY_PROMPT = (
    "You are a document summarizer. Write a brief 1-3 sentence summary of the provided document content. "
    "Answer strictly in %s. Be concise."
)
TAGS_PROMPT = (
    "You are a document tagger. Generate 3-7 relevant tags for the provided document content. "
    "Output ONLY a comma-separated list of tags, nothing else. Tags should be in %s."
)
CHATML = "<|im_start|>system\n%s<|im_end|>\n<|im_start|>user\n%s<|im_end|>\n<|im_start|>assistant\n"


def language_name(code: Column) -> Column:
    """Language of a BCP-47 tag by its primary subtag, English when unknown."""
    primary = F.substring_index(code, "-", 1)
    names = F.create_map(*[F.lit(x) for pair in LANGUAGE_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, primary), F.lit("English"))


def system_prompt(template: str, code: Column) -> Column:
    return F.format_string(template, language_name(code))


def document_prompt(text: Column) -> Column:
    return F.concat(F.lit("Document:\n"), text)


def chat_prompt(system: Column, user: Column) -> Column:
    return F.format_string(CHATML, system, user)


def stub_answer(context: Column, source_count: Column, max_fragments: int = 3, max_chars: int = 300) -> Column:
    """Answer made of the first fragments of the context, used when no model is loaded."""
    fragments = F.split(context, F.lit("\\Q" + CONTEXT_SEPARATOR + "\\E"))
    shown = F.slice(fragments, 1, max_fragments)
    lines = F.transform(
        shown,
        lambda f, i: F.when(
            trim_ws(f) != "",
            F.concat(F.lit("\n"), (i + 1).cast("string"), F.lit(". "), truncate(trim_ws(f), max_chars), F.lit("\n")),
        ).otherwise(""),
    )
    header = F.format_string(
        "Showing the %d most relevant snippet(s) found (out of %d):\n", F.size(shown), source_count.cast("int")
    )
    return F.concat(header, F.array_join(lines, ""))
