"""How a module names its queries and the SQL that equals them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def registry():
    """``(QUERIES, ORACLES, query)`` of one module; ``@query(name, sql)`` enters a builder into both."""
    queries: dict = {}
    oracles: dict[str, str] = {}

    def query(name: str, sql: str | None = None):
        def register(build):
            queries[name] = build
            if sql is not None:
                oracles[name] = sql
            return build

        return register

    return queries, oracles, query


def r6(column) -> Column:
    return F.round(column, 6)
