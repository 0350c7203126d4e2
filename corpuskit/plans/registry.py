"""Registry of named queries: the Spark plan and its DuckDB restatement.

Each query reads the test tables of one scale-factor directory (or views
Spark derives from them) in full.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: QueryFn
    sql: str | None  # None: not expressible in SQL, rows-only check


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql)
        return fn
    return deco


def all_queries() -> dict[str, QueryFn]:
    _load()
    return {k: q.build for k, q in REGISTRY.items()}


def all_sql() -> dict[str, str]:
    _load()
    return {k: q.sql for k, q in REGISTRY.items() if q.sql is not None}


def _load() -> None:
    # importing the query modules fills REGISTRY
    from . import (queries_eval, queries_io, queries_metrics, queries_prep,  # noqa: F401
                   queries_tokens, queries_vectors)
