"""Everything that is registered, in one place."""

from __future__ import annotations

from questloom.plans import answer_queries, record_queries, retrieval_queries, sql_surface, wide_queries  # noqa: F401
from questloom.plans.registry import CHECKS, QUERIES
from questloom.session import ship_package

__all__ = ["CHECKS", "QUERIES"]

ship_package()
