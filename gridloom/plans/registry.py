"""Named queries, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def r6(value: Column | str, alias: str | None = None) -> Column:
    """Six decimals; the nudge keeps short decimal fractions off the rounding edge."""
    col = F.col(value) if isinstance(value, str) else value
    out = F.round(col + F.lit(1e-9), 6)
    return out.alias(alias or value) if alias or isinstance(value, str) else out
