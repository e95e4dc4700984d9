"""Registered queries over the driver's tables, each with the SQL that it is compared with where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    """``df`` with these columns, or all doubles, rounded for a comparison; operators never round."""
    names = names or tuple(n for n, k in df.dtypes if k == "double")
    return df.withColumns({n: F.round(n, places) for n in names})


def load() -> None:
    from graindeck.queries import decisions, gates, manifests, quality, relational, runlog, scans, selection, streams, vectors  # noqa: F401
