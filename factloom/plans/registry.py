"""All registered queries and their DuckDB counterparts."""

from __future__ import annotations

from . import matching_queries, passage_queries, review_queries  # noqa: F401  (they register)
from .queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
