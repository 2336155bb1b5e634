"""What __spark_entry__ takes from this package."""

from __future__ import annotations

from tavuflow.llm.queries import queries

__all__ = ["oracle_sql", "queries"]


def oracle_sql() -> dict[str, str]:
    from tavuflow.llm.oracle import SQL

    return dict(SQL)
