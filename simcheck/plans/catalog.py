"""Registry of named queries: a Spark builder and (optionally) its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from simcheck.plans import (q_text, q_vectors, q_scoring, q_sparse, q_pairs,  # noqa: F401
                                q_locate, q_ingest, q_eval, q_sources, q_ml, q_stream,
                                q_reports)
