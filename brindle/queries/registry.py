"""name -> (query, oracle SQL).  Modules of this package register themselves on import."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def load() -> tuple[dict[str, Query], dict[str, str]]:
    from . import benchmark, relational, scalar  # noqa: F401

    return QUERIES, ORACLES
