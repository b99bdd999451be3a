"""The registered queries: each applies operators to the given tables, with the DuckDB statement that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.adapters import sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, run: Query, base: str = "", oracle: str | None = None) -> None:
    QUERIES[name] = run
    if oracle:
        ORACLES[name] = sql(base, oracle) if base else oracle
