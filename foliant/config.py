"""Feature flags, resource limits and tier policy.

Plain values resolved on the driver: they choose the shape of a plan or end up
in it as literals.
"""

from __future__ import annotations

from dataclasses import dataclass

# Content features that can be switched.
FEATURES = (
    "office_docs",
    "ocr",
    "transcription",
    "embeddings",
    "semantic_similarity",
    "rag",
    "auto_summary",
    "auto_tags",
)


@dataclass(frozen=True)
class ContentLimits:
    max_concurrent_jobs: int
    max_file_size_mb: int
    max_media_minutes: int
    max_pages_per_pdf: int


@dataclass(frozen=True)
class AppConfig:
    resource_saver: bool = False
    office_docs: bool = True
    ocr: bool = False
    transcription: bool = False
    embeddings: bool = True
    semantic_similarity: bool = True
    rag: bool = True
    auto_summary: bool = False
    auto_tags: bool = False
    max_concurrent_jobs: int = 2
    max_file_size_mb: int = 50
    max_media_minutes: int = 60
    max_pages_per_pdf: int = 100

    def is_enabled(self, feature: str) -> bool:
        """Whether a feature is on once the resource saver has had its say."""
        if feature not in FEATURES:
            raise ValueError(f"unknown feature {feature}")
        if self.resource_saver:
            return feature == "office_docs" and self.office_docs
        if feature == "semantic_similarity":
            return self.semantic_similarity and self.embeddings
        return getattr(self, feature)

    @property
    def effective_limits(self) -> ContentLimits:
        if self.resource_saver:
            return SAVER_LIMITS
        return ContentLimits(
            self.max_concurrent_jobs, self.max_file_size_mb, self.max_media_minutes, self.max_pages_per_pdf
        )


# Limits in resource-saver mode.
SAVER_LIMITS = ContentLimits(
    max_concurrent_jobs=1, max_file_size_mb=10, max_media_minutes=0, max_pages_per_pdf=30
)

RESOURCE_SAVER_PRESET = AppConfig(
    resource_saver=True,
    embeddings=False,
    semantic_similarity=False,
    rag=False,
    max_concurrent_jobs=1,
    max_file_size_mb=10,
    max_media_minutes=0,
    max_pages_per_pdf=30,
)

# Free-tier and pro-tier limits and formats.
FREE_MAX_FILES = 100
FREE_MAX_FILE_BYTES = 10 * 1024 * 1024
FREE_MAX_RESULTS = 20
FREE_FORMATS = ("txt", "md", "pdf", "docx")
PRO_MAX_FILE_BYTES = 100 * 1024 * 1024
PRO_FORMATS = (
    "txt", "md", "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "rtf", "odt", "html", "json", "xml", "csv",
)
BASE_FEATURES = ("basic_search", "basic_indexing", "basic_notifications", "dark_theme")
PRO_FEATURES = (
    "content_search",
    "advanced_search",
    "semantic_search",
    "unlimited_indexing",
    "content_indexing",
    "custom_notifications",
    "ui_customization",
    "export_results",
    "external_integrations",
)


@dataclass(frozen=True)
class Tier:
    pro: bool = False
    hardware_constrained: bool = False

    def features(self) -> frozenset[str]:
        if self.pro and not self.hardware_constrained:
            return frozenset(BASE_FEATURES + PRO_FEATURES)
        return frozenset(BASE_FEATURES)

    def limit(self, limit_id: str) -> int | None:
        """Numeric limit by its id, ``None`` when there is none."""
        free = {
            "max_indexed_files": FREE_MAX_FILES,
            "max_file_size": FREE_MAX_FILE_BYTES,
            "max_search_results": FREE_MAX_RESULTS,
            "max_watched_directories": 1,
        }
        pro = {"max_file_size": PRO_MAX_FILE_BYTES, "max_watched_directories": 10}
        return (pro if self.pro else free).get(limit_id)

    def can_perform(self, feature: str, current_count: int | None = None, limit_id: str | None = None) -> bool:
        """Feature gate, then the count limit named ``limit_id`` (default: the feature itself)."""
        if feature not in self.features():
            return False
        limit = self.limit(limit_id or feature)
        return self.pro or current_count is None or limit is None or current_count < limit

    @property
    def formats(self) -> tuple[str, ...]:
        return PRO_FORMATS if self.pro else FREE_FORMATS

    @property
    def max_file_bytes(self) -> int:
        return PRO_MAX_FILE_BYTES if self.pro else FREE_MAX_FILE_BYTES
