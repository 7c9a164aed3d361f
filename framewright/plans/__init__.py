"""The engine's registered queries."""

from .registry import flagship, oracle_sql, queries

__all__ = ["flagship", "oracle_sql", "queries"]
