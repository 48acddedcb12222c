"""All queries of the domain; importing a module registers its queries."""

from larkspur.plans import edge_queries, label_queries, report_queries, review_queries, sheet_queries  # noqa: F401
from larkspur.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
