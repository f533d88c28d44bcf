"""How queries are named: a Query has the Spark function and, where SQL can say it, the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def entries(queries: dict[str, Query]) -> tuple[dict[str, Callable], dict[str, str]]:
    """(callables, SQL) by name."""
    return {n: q.run for n, q in queries.items()}, {n: q.sql for n, q in queries.items() if q.sql}
