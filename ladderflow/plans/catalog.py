"""Registry of the library's queries, each with the SQL it is checked against.

A query is registered by ``@query(name, ids, sql)``: ids are those of the operator inventory, sql is DuckDB SQL for the
same rows, or None where SQL cannot express the operator (then a test holds it against known values).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
IDS: dict[str, tuple[str, ...]] = {}


def query(name: str, ids: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name], IDS[name] = fn, tuple(ids.split())
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def load() -> None:
    """Imports every module that registers queries."""
    from ladderflow.plans import (  # noqa: F401
        arbitrage_queries,
        book_queries,
        feed_queries,
        graph_queries,
        link_queries,
        pipeline_queries,
        risk_queries,
        signal_queries,
        source_queries,
        state_queries,
        stats_queries,
        text_queries,
    )
