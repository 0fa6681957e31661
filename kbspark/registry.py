"""Queries of the knowledge-base operators over the driver's tables, and the SQL that must give the same rows."""

from .plans import exports  # noqa: F401  registers its queries
from .plans.queries import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
