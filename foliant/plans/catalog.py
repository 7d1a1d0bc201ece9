"""All registered queries."""

from __future__ import annotations

from foliant.plans import (  # noqa: F401  (importing registers)
    enrich_queries,
    event_queries,
    extract_queries,
    index_queries,
    search_queries,
    text_queries,
    vector_queries,
)
from foliant.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
