"""The query catalogue."""

from tessera.plans.catalog import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
