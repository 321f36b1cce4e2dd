"""The registered queries over the driver's tables, with their oracle SQL."""

from __future__ import annotations

from . import lookups, more_queries, search_queries, source_queries, text_queries  # noqa: F401
from .bindings import ORACLES, QUERIES
from .search_queries import flagship

__all__ = ["ORACLES", "QUERIES", "flagship"]
