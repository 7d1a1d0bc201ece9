"""File names, extensions and content types as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions by content type.
TEXT_EXTENSIONS = (
    "txt", "md", "markdown", "rst", "log", "csv", "tsv", "json", "xml", "yaml", "yml", "toml", "ini", "cfg", "conf",
    "properties", "rs", "dart", "py", "js", "ts", "java", "kt", "c", "cpp", "h", "hpp", "cs", "go", "rb", "php",
    "swift", "sh", "bash", "ps1", "bat", "cmd", "html", "htm", "css", "scss", "sass", "less", "sql", "graphql",
    "proto", "env",
)
RICH_EXTENSIONS = ("pdf", "docx")
AUDIO_EXTENSIONS = ("wav", "mp3", "m4a", "ogg", "flac", "aac", "wma")
VIDEO_EXTENSIONS = ("mp4", "mkv", "webm", "avi", "mov", "wmv")
OCR_IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "tiff", "tif", "bmp")
QUEUE_IMAGE_EXTENSIONS = OCR_IMAGE_EXTENSIONS + ("webp",)


def base_name(path: Column) -> Column:
    """Last path segment; a bare ``/`` stays as it is."""
    stripped = F.regexp_replace(path, "/+$", "")
    return F.when(stripped == "", path).otherwise(F.element_at(F.split(stripped, "/"), -1))


def extension(path: Column) -> Column:
    """Lower-case suffix after the last dot of the name, ``''`` when absent.

    A name whose only dot comes first (``.env``) has no extension.
    """
    return F.lower(F.regexp_extract(path, "[^/]\\.([^./]+)$", 1))


def mb_to_bytes(megabytes: int) -> int:
    return megabytes * 1024 * 1024


def is_hidden_or_system(name: Column, skip_hidden: bool = True) -> Column:
    """Names a folder scan leaves out.

    The start-up scan skips dot-files and any case of ``desktop.ini``;
    reconciliation (``skip_hidden=False``) skips the exact name only.
    """
    if skip_hidden:
        return F.startswith(name, F.lit(".")) | (F.lower(name) == "desktop.ini")
    return name == "desktop.ini"


def media_content_type(path: Column) -> Column:
    ext = extension(path)
    return (
        F.when(ext.isin(*AUDIO_EXTENSIONS), "audio").when(ext.isin(*VIDEO_EXTENSIONS), "video").otherwise("unsupported")
    )


def ocr_content_type(path: Column) -> Column:
    ext = extension(path)
    return (
        F.when(ext.isin(*OCR_IMAGE_EXTENSIONS), "image").when(ext == "pdf", "scan_pdf").otherwise("unsupported")
    )


def is_media_file(path: Column) -> Column:
    return media_content_type(path) != "unsupported"


def is_ocr_supported(path: Column) -> Column:
    return ocr_content_type(path) != "unsupported"


def is_format_supported(path: Column, formats: tuple[str, ...]) -> Column:
    return extension(path).isin(*formats)
