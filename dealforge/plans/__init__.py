"""Registered queries and their oracle SQL."""

from dealforge.plans import function_queries, head_queries, import_queries, normalize_queries, presentation_queries, report_queries, stream_queries  # noqa: F401
from dealforge.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
