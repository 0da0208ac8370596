"""Registry of named queries over the driver tables, each paired with the
equivalent DuckDB SQL (the correctness oracle) when SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from precedent.plans import (  # noqa: F401
        q_documents,
        q_enrich,
        q_harvest,
        q_quality,
        q_report,
        q_responses,
        q_retrieve,
        q_stream,
    )
