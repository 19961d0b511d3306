"""Every registered query with the SQL it is compared to."""

from checks import report_queries, source_queries, stored_queries  # noqa: F401  (they fill the registry)
from checks.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
