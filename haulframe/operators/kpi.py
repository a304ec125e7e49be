"""Dashboard and summary: one conditional-aggregate pass per table, joined as single rows."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulframe.functions.text import utc
from haulframe.operators import views

# What counts as pending and as active, and how many deliveries the dashboard lists.
PENDING_INVOICE = ("PENDING", "PENDING_APPROVAL", "DRAFT")
ACTIVE_DELIVERY = ("SCHEDULED", "ASSIGNED", "IN_TRANSIT")
UPCOMING = 5


def count_where(condition: Column, name: str) -> Column:
    return F.count_if(condition).alias(name)


def total_of(column: str | Column, name: str) -> Column:
    """Sum of a double column, 0 without rows; each amount is rounded to cents and these are added as decimals, so that partitioning can't change the result."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.sum(c.cast("decimal(18,2)")).cast("double"), F.lit(0.0)).alias(name)


def bundle(*rows: DataFrame) -> DataFrame:
    """Aggregates of one row each side by side; a cross join of single rows."""
    return reduce(lambda a, b: a.crossJoin(b), rows)


def overdue(now: Column, due: str = "due_date", status: str = "status") -> Column:
    """Due before today (in UTC) and not paid; rows without a due date never are."""
    return (F.col(due) < F.to_date(utc(now))) & (F.col(status) != "PAID")


def within_a_day(now: Column, at: str = "scheduled_at") -> Column:
    """In the 24 hours from now, the end excluded."""
    # in UTC a day has 24 hours, also where the session's zone changes its clocks
    return (utc(F.col(at)) >= utc(now)) & (utc(F.col(at)) < utc(now) + F.expr("INTERVAL 1 DAY"))


def upcoming(deliveries: DataFrame, now: Column, n: int = UPCOMING) -> DataFrame:
    return deliveries.where(F.col("scheduled_at") >= now).orderBy("scheduled_at", "id").limit(n)


def dashboard_counts(vendors: DataFrame, invoices: DataFrame, deliveries: DataFrame, documents: DataFrame, now: datetime | Column) -> DataFrame:
    """The dashboard's seven counts as one row. now is UTC and the caller's, so that reruns agree."""
    at = now if isinstance(now, Column) else F.lit(now)
    return bundle(
        vendors.agg(F.count(F.lit(1)).alias("vendors"), count_where(F.col("status") == "ACTIVE", "active_vendors")),
        invoices.agg(count_where(F.col("status").isin(*PENDING_INVOICE), "pending_invoices"), count_where(overdue(at), "overdue_invoices")),
        deliveries.agg(count_where(within_a_day(at), "deliveries_today"), count_where(F.col("status").isin(*ACTIVE_DELIVERY), "active_deliveries")),
        documents.agg(count_where(F.col("status") == "REVIEW_REQUIRED", "documents_for_review")),
    )


def dashboard(vendors: DataFrame, invoices: DataFrame, deliveries: DataFrame, documents: DataFrame, purchases: DataFrame, vehicles: DataFrame, drivers: DataFrame, now: datetime | Column) -> DataFrame:
    """The counts and the next deliveries, as one row."""
    at = now if isinstance(now, Column) else F.lit(now)
    listed = views.deliveries(upcoming(deliveries, at), vendors, purchases, vehicles, drivers)
    ordered = F.array_sort(F.collect_list(F.struct("scheduled_at", "id", F.struct(*listed.columns).alias("delivery"))))
    counts = dashboard_counts(vendors, invoices, deliveries, documents, at)
    return bundle(counts, listed.agg(F.transform(ordered, lambda x: x["delivery"]).alias("upcoming_deliveries")))


def summary(vendors: DataFrame, vehicles: DataFrame, approvals: DataFrame, invoices: DataFrame, payments: DataFrame) -> DataFrame:
    """Five figures; the totals take every status and leave out tax."""
    return bundle(
        vendors.agg(F.count(F.lit(1)).alias("vendors")),
        vehicles.agg(count_where(F.col("status") == "ACTIVE", "active_vehicles")),
        approvals.agg(count_where(F.col("status") == "PENDING", "pending_approvals")),
        invoices.agg(total_of("amount", "invoice_total")),
        payments.agg(total_of("amount", "paid_total")),
    )
