"""Named queries with the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name; a name can be taken once."""

    def add(f: Query) -> Query:
        n = name or f.__name__
        if n in QUERIES:
            raise ValueError(f"query {n!r} is registered already")
        QUERIES[n] = f
        if sql:
            SQL[n] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    """Rounded to six places, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)
