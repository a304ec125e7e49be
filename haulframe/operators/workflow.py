"""State transitions of invoices, approvals and documents: all outputs come from one snapshot, so they agree."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulframe.functions import text
from haulframe.operators import validation as v
from haulframe.operators.changes import audit
from haulframe.schemas import TABLES, evolve


def submit_state(status: Column) -> Column:
    """An invoice's status after a submission: drafts wait for approval, others stay."""
    return F.when(status == "DRAFT", "PENDING_APPROVAL").otherwise(status)


def submit_error(found: Column, status: Column) -> Column:
    """404 without an invoice, 409 unless it is a draft, else null."""
    return F.when(~found, v.MISSING).when(status != "DRAFT", v.CONFLICT)


def _first(requests: DataFrame, key: str) -> DataFrame:
    """The first request for each key (by seq); later ones find the state changed."""
    return requests.groupBy(key).agg(F.min_by(F.struct(*requests.columns), "seq").alias("r")).select("r.*")


def submit_invoices(invoices: DataFrame, requests: DataFrame, now: datetime, actor: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Invoices, new approvals, audit rows and answered requests (with error_code).

    requests: seq, invoice_id and approval_id (drawn by the caller). Of several for one invoice the first counts.
    """
    state = invoices.select(F.col("id").alias("__id"), F.col("status").alias("__status"))
    asked = requests.join(state, F.col("invoice_id") == F.col("__id"), "left")
    first = _first(requests, "invoice_id").select(F.col("invoice_id").alias("__first"), F.col("seq").alias("__seq"))
    asked = asked.join(first, F.col("invoice_id") == F.col("__first"), "left")
    error = F.coalesce(submit_error(F.col("__id").isNotNull(), F.col("__status")), F.when(F.col("seq") > F.col("__seq"), v.CONFLICT))
    answered = asked.withColumn("error_code", error).drop("__id", "__status", "__first", "__seq")
    good = answered.where("error_code IS NULL")
    approvals = evolve(good.select(F.col("approval_id").alias("id"), F.lit(now).alias("created_at"), F.lit("invoice").alias("resource_type"), F.col("invoice_id").alias("resource_id"), F.lit(actor).alias("requested_by"), F.lit("PENDING").alias("status")), TABLES["approvals"])
    marked = good.select(F.col("invoice_id").alias("__done"))
    moved = invoices.join(marked, F.col("id") == F.col("__done"), "left").withColumn("status", F.when(F.col("__done").isNotNull(), submit_state(F.col("status"))).otherwise(F.col("status"))).select(*invoices.columns)
    return moved, approvals, audit(good, actor, "SUBMIT", "invoices", now, "invoice_id"), answered


def decide(approvals: DataFrame, invoices: DataFrame, requests: DataFrame, now: datetime, actor: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Approvals, invoices, audit rows and answered requests (with error_code).

    requests: seq, approval_id, decision (APPROVED or REJECTED), comment. Only pending approvals can be
    decided; an invoice follows its approval, and only then is there an audit row.
    """
    state = approvals.select(F.col("id").alias("__id"), F.col("status").alias("__status"))
    asked = v.add_errors(requests.join(state, F.col("approval_id") == F.col("__id"), "left"), [
        v.required("decision"), *v.field_rules("approvals"), (F.col("__id").isNull(), v.MISSING, "approval not found"), (F.col("__status") != "PENDING", v.CONFLICT, "approval is already decided"),
    ]).drop("__id", "__status")
    first = _first(asked.where("error_code IS NULL"), "approval_id").select(F.col("approval_id").alias("__first"), F.col("seq").alias("__seq"))
    asked = asked.join(first, F.col("approval_id") == F.col("__first"), "left")
    answered = v.add_errors(asked, [(F.col("seq") > F.col("__seq"), v.CONFLICT, "approval is already decided")]).drop("__first", "__seq")
    made = answered.where("error_code IS NULL").select(F.col("approval_id").alias("__a"), F.col("decision").alias("__d"), F.col("comment").alias("__c"))
    both = approvals.join(made, F.col("id") == F.col("__a"), "left")
    done = F.col("__a").isNotNull()
    decided = both.withColumns({
        "status": F.when(done, F.col("__d")).otherwise(F.col("status")), "approver_id": F.when(done, F.lit(actor)).otherwise(F.col("approver_id")),
        "comment": F.when(done, F.col("__c")).otherwise(F.col("comment")), "decided_at": F.when(done, F.lit(now)).otherwise(F.col("decided_at")),
    })
    of_invoice = decided.where(done & (F.col("resource_type") == "invoice")).select(F.col("resource_id").alias("__i"), F.col("__d").alias("__decision"), F.col("created_at").alias("__at"), F.col("id").alias("__by"))
    last = of_invoice.groupBy("__i").agg(F.max_by("__decision", F.struct("__at", "__by")).alias("__decision"))
    moved = invoices.join(last, F.col("id") == F.col("__i"), "left").withColumn("status", F.coalesce("__decision", "status")).select(*invoices.columns)
    logged = of_invoice.join(invoices.select(F.col("id").alias("__i")), "__i", "left_semi")
    approved = audit(logged.where("__decision = 'APPROVED'"), actor, "APPROVED", "invoices", now, "__i")
    rejected = audit(logged.where("__decision = 'REJECTED'"), actor, "REJECTED", "invoices", now, "__i")
    return decided.select(*approvals.columns), moved, approved.unionByName(rejected), answered


def record_extraction(documents: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with their extracted fields, waiting for review, and a quarantine of those that failed.

    texts: id, text and error (null where extraction worked). Failed documents keep their state.
    """
    got = texts.select(F.col("id").alias("__id"), F.col("text").alias("__text"), F.col("error").alias("__error"))
    both = documents.join(got, F.col("id") == F.col("__id"), "left")
    done = F.col("__id").isNotNull() & F.col("__error").isNull()
    fields = F.to_json(text.extracted_fields(F.col("document_type"), F.coalesce("__text", F.lit(""))))
    moved = both.withColumns({"extracted_fields": F.when(done, fields).otherwise(F.col("extracted_fields")), "status": F.when(done, "REVIEW_REQUIRED").otherwise(F.col("status"))})
    return moved.select(*documents.columns), both.where("__error IS NOT NULL").select(*documents.columns, F.col("__error").alias("error"))


def confirm(documents: DataFrame, reviews: DataFrame, now: datetime, actor: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents with the reviewed fields, audit rows and unknown ids. reviews: seq, id, fields (JSON); the last review of a document counts."""
    last = reviews.groupBy("id").agg(F.max_by("fields", "seq").alias("__fields"), F.lit(True).alias("__there"))
    both = documents.join(last, "id", "left")
    done = F.coalesce(F.col("__there"), F.lit(False))
    moved = both.withColumns({"extracted_fields": F.when(done, F.col("__fields")).otherwise(F.col("extracted_fields")), "status": F.when(done, "CONFIRMED").otherwise(F.col("status")), "review_confirmed_at": F.when(done, F.lit(now)).otherwise(F.col("review_confirmed_at"))})
    known = reviews.join(documents.select("id"), "id", "left_semi")
    missing = reviews.join(documents.select("id"), "id", "left_anti").withColumn("error_code", F.lit(v.MISSING))
    return moved.select(*documents.columns), audit(known.select("id").distinct(), actor, "CONFIRM_EXTRACTION", "documents", now), missing
