"""Filters, ordered pages, totals and point reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Page sizes.
PAGE, MOST = 50, 200
AUDIT_PAGE, AUDIT_MOST = 100, 500


def page(df: DataFrame, order: list[Column], limit: int = PAGE, offset: int = 0, most: int = MOST) -> DataFrame:
    """One ordered page. order must end with a unique key, or ties make pages overlap.

    Spark plans this as one TakeOrderedAndProject: each task keeps limit + offset rows, nothing is sorted whole.
    """
    if limit < 0 or offset < 0:
        raise ValueError("limit and offset can't be negative")
    if limit > most:
        raise ValueError(f"limit can't exceed {most}")
    return df.orderBy(*order).offset(offset).limit(limit)


def total(df: DataFrame, name: str = "total") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def with_status(df: DataFrame, status: str | None, column: str = "status") -> DataFrame:
    """Rows of that status in upper case; all rows for None or an empty string."""
    return df.where(F.col(column) == F.upper(F.lit(status))) if status else df


def by_key(df: DataFrame, column: str, value: object) -> DataFrame:
    """The row with a unique key: one or none."""
    return df.where(F.col(column) == F.lit(value)).limit(1)


def any_row(df: DataFrame) -> DataFrame:
    return df.select("id").limit(1)


def newest(df: DataFrame) -> list[Column]:
    """Latest first, ties by id."""
    return [F.desc_nulls_last("created_at"), F.asc("id")]
