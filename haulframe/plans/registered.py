"""Where the registered queries and their SQL are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from haulframe.plans import fixtures

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(sql: str):
    """Registers a query under its function's name. The SQL sees the tables of fixtures.SQL."""

    def add(run: Query) -> Query:
        QUERIES[run.__name__] = run
        SQL[run.__name__] = f"WITH {fixtures.SQL.strip()}{sql if sql.lstrip().startswith(',') else chr(10) + sql}"
        return run

    return add
