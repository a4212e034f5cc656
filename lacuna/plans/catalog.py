"""All registered queries over the library's operators, and their SQL."""

from lacuna.plans import case_queries, class_queries, landed_queries, record_queries, search_queries  # noqa: F401
from lacuna.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
