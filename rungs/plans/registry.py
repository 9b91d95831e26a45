"""The registered queries, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .testdata import Ladder, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(text: str | None = None, *ctes: str) -> Callable:
    """Registers a function of the ladder tables under its name, and the SQL beside it."""

    def add(f: Callable[[Ladder], DataFrame]) -> Callable[[Ladder], DataFrame]:
        QUERIES[f.__name__] = lambda spark, folder: f(Ladder(spark, folder))
        if text is not None:
            SQL[f.__name__] = sql(text, *ctes)
        return f

    return add


def pct(count: str, total: str, digits: int = 2) -> str:
    """SQL of a share in percent, rounded half up by whole numbers."""
    scale = 10**digits
    return f"CAST((({count}) * {200 * scale} + ({total})) // (2 * ({total})) AS DOUBLE) / {scale}"
