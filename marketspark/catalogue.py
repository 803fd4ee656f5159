"""All queries of the engine, with the SQL of those that SQL can say."""

from __future__ import annotations

from marketspark import queries_records  # noqa: F401  registers its queries
from marketspark.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
