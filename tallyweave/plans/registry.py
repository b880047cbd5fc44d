"""Where queries register, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Current chunks and current links, as the operators see them.
LIVE = """live AS (SELECT * FROM chunks WHERE deleted_at IS NULL AND id IS NOT NULL AND repo IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY repo, id ORDER BY indexed_at DESC NULLS LAST, path ASC NULLS LAST, start_line ASC NULLS LAST) = 1)"""
CURRENT = """cur AS (SELECT * FROM links QUALIFY row_number() OVER (PARTITION BY repo, src_chunk_id, kind, name, line
    ORDER BY indexed_at ASC NULLS FIRST, norm ASC NULLS LAST, dst_chunk_id ASC NULLS LAST, via ASC NULLS LAST, path ASC NULLS LAST) = 1)"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add
