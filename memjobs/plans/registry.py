"""A pair of tables, queries and oracles, and the decorator that fills them."""

from __future__ import annotations


def registry():
    queries, oracles = {}, {}

    def query(name: str, sql: str | None = None):
        def add(f):
            queries[name] = f
            if sql:
                oracles[name] = sql
            return f

        return add

    return queries, oracles, query
