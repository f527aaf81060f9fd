"""All queries of the library, by name, with DuckDB SQL for those that SQL can express."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame."""

    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put
