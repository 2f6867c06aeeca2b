"""Queries of this subpackage: name to plan builder (spark, sf_dir), and name to DuckDB SQL."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


from . import queries, queries_search  # noqa: E402, F401
