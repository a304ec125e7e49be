"""Registered queries of the write path, of users and of uploaded files, each with its SQL."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haulframe.functions import access, text
from haulframe.operators import changes, kpi, paging, workflow
from haulframe.plans import fixtures as f
from haulframe.plans.registered import register
from haulframe.schemas import TABLES, evolve
from haulframe.sources import files, tables

_CLOCK = datetime(1998, 6, 1, tzinfo=timezone.utc)


def _str(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _half(c: Column) -> Column:
    return F.floor(c / 2).cast("bigint")


def _answers(made: DataFrame, rejected: DataFrame, *columns: str) -> DataFrame:
    """Created rows and rejected requests by id, with the columns and the error."""
    good = made.select("id", *columns, F.lit(None).cast("int").alias("error_code"))
    return good.union(rejected.select("id", *columns, F.col("error_code").cast("int")))


def _string_ids(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


@register("""
, batch AS (
    SELECT c_custkey AS seq, CASE WHEN c_custkey % 7 = 0 THEN 'V' || (c_custkey % 50 + 1) WHEN c_custkey % 11 = 0 THEN 'X' ELSE 'N' || (c_custkey // 2) END AS vendor_code,
        CASE WHEN c_custkey % 17 <> 0 THEN c_name END AS legal_name, CASE WHEN c_custkey % 13 = 0 THEN 'nobody' ELSE 'a' || c_custkey || '@example.org' END AS email,
        CASE WHEN c_custkey % 19 = 0 THEN 'G' || (c_custkey % 30) END AS gstin FROM customer),
fields AS (SELECT *, length(vendor_code) < 2 OR legal_name IS NULL OR email = 'nobody' AS bad, vendor_code IN (SELECT vendor_code FROM vendors) AS taken FROM batch),
codes AS (SELECT *, taken OR (NOT bad AND row_number() OVER (PARTITION BY vendor_code, bad OR taken ORDER BY seq) > 1) AS lost FROM fields),
tax AS (SELECT *, gstin IN (SELECT 'G' || id FROM vendors) AS tax_taken, bad OR lost AS gone FROM codes),
told AS (SELECT *, gstin IS NOT NULL AND (tax_taken OR row_number() OVER (PARTITION BY gstin, gone OR tax_taken ORDER BY seq) > 1) AS tax_lost FROM tax)
SELECT 'n' || seq AS id, vendor_code, 'DRAFT' AS status, CASE WHEN bad THEN 422 WHEN lost OR tax_lost THEN 409 END::INTEGER AS error_code FROM told
""")
def create_vendors(spark: SparkSession, d: str) -> DataFrame:
    """New vendors: bad fields, codes and tax numbers that exist or that two requests want."""
    c, key = f.table(spark, d, "customer"), F.col("c_custkey")
    batch = c.select(
        key.alias("seq"), _str("n", key).alias("id"), F.when(key % 7 == 0, _str("V", key % 50 + 1)).when(key % 11 == 0, "X").otherwise(_str("N", _half(key))).alias("vendor_code"),
        F.when(key % 17 != 0, F.col("c_name")).alias("legal_name"), F.when(key % 13 == 0, "nobody").otherwise(_str("a", key, "@example.org")).alias("email"), F.when(key % 19 == 0, _str("G", key % 30)).alias("gstin"),
    )
    made, rejected, _ = changes.create(batch, f.vendor_rows(spark, d), "vendors", _CLOCK, "u1")
    return _answers(made, rejected, "vendor_code", "status")


@register("""
, batch AS (
    SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 5 = 0 THEN 'INV-' || o_orderkey ELSE 'NI-' || (o_orderkey // 2) END AS invoice_number,
        CASE WHEN o_orderkey % 11 = 0 THEN 0.0 ELSE o_totalprice END AS amount, CASE WHEN o_orderkey % 13 = 0 THEN -1.0 END AS tax_amount FROM orders),
judged AS (SELECT *, amount <= 0 OR coalesce(tax_amount, 0) < 0 AS bad, invoice_number IN (SELECT invoice_number FROM invoices) AS taken FROM batch)
SELECT 'n' || seq AS id, invoice_number, coalesce(tax_amount, 0.0)::DOUBLE AS tax_amount, 'DRAFT' AS status,
    CASE WHEN bad THEN 422 WHEN taken OR row_number() OVER (PARTITION BY invoice_number, bad OR taken ORDER BY seq) > 1 THEN 409 END::INTEGER AS error_code FROM judged
""")
def create_invoices(spark: SparkSession, d: str) -> DataFrame:
    """The generic creation: defaults, field rules, one unique key."""
    key = F.col("o_orderkey")
    batch = f.table(spark, d, "orders").select(
        key.alias("seq"), _str("n", key).alias("id"), F.when(key % 5 == 0, _str("INV-", key)).otherwise(_str("NI-", _half(key))).alias("invoice_number"), _str(key % 120).alias("vendor_id"), F.to_date("o_orderdate").alias("invoice_date"),
        F.when(key % 11 == 0, 0.0).otherwise(F.col("o_totalprice")).alias("amount"), F.when(key % 13 == 0, -1.0).alias("tax_amount"),
    )
    made, rejected, _ = changes.create(batch, f.invoices(spark, d), "invoices", _CLOCK, "u1")
    return _answers(made, rejected, "invoice_number", "tax_amount", "status")


@register("""
, batch AS (SELECT o_orderkey AS seq, 'R' || (o_orderkey // 3) AS reference, CASE WHEN o_orderkey % 9 = 0 THEN -1.0 WHEN o_orderkey % 14 = 0 THEN NULL ELSE o_totalprice END AS amount FROM orders),
judged AS (SELECT *, coalesce(amount, 0) <= 0 AS bad FROM batch)
SELECT 'n' || seq AS id, reference, 'PENDING' AS status, CASE WHEN bad THEN 422 WHEN row_number() OVER (PARTITION BY reference, bad ORDER BY seq) > 1 THEN 409 END::INTEGER AS error_code FROM judged
""")
def create_payments(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    batch = f.table(spark, d, "orders").select(
        key.alias("seq"), _str("n", key).alias("id"), _str(key).alias("invoice_id"), _str("R", F.floor(key / 3).cast("bigint")).alias("reference"), F.to_date("o_orderdate").alias("paid_on"),
        F.when(key % 9 == 0, -1.0).when(key % 14 == 0, F.lit(None)).otherwise(F.col("o_totalprice")).alias("amount"),
    )
    made, rejected, _ = changes.create(batch, spark.createDataFrame([], TABLES["payments"].schema), "payments", _CLOCK, "u1")
    return _answers(made, rejected, "reference", "status")


@register("""
, batch AS (SELECT p_partkey AS seq, CASE WHEN p_partkey % 3 = 0 THEN 'KA' || lpad(p_partkey::VARCHAR, 8, '0') WHEN p_partkey % 10 = 1 THEN 'KA1' ELSE 'MH' || lpad((p_partkey // 2)::VARCHAR, 8, '0') END AS plate FROM part),
judged AS (SELECT *, plate = 'KA1' AS bad, plate IN (SELECT registration_number FROM vehicles) AS taken FROM batch)
SELECT 'n' || seq AS id, plate AS registration_number, 'ACTIVE' AS status, CASE WHEN bad THEN 422 WHEN taken OR row_number() OVER (PARTITION BY plate, bad OR taken ORDER BY seq) > 1 THEN 409 END::INTEGER AS error_code FROM judged
""")
def create_vehicles(spark: SparkSession, d: str) -> DataFrame:
    """Plates are normalized before they are checked."""
    key = F.col("p_partkey")
    plate = F.when(key % 3 == 0, _str("ka-", F.lpad(key.cast("string"), 8, "0"))).when(key % 10 == 1, "ka 1").otherwise(_str(" mh.", F.lpad(_half(key).cast("string"), 8, "0")))
    batch = f.table(spark, d, "part").select(key.alias("seq"), _str("n", key).alias("id"), _str(key % 150).alias("vendor_id"), plate.alias("registration_number"), F.lit("TRUCK").alias("vehicle_type"))
    made, rejected, _ = changes.create(batch, f.vehicles(spark, d), "vehicles", _CLOCK, "u1")
    return _answers(made, rejected, "registration_number", "status")


@register("""
, batch AS (SELECT c_custkey AS seq, 'L' || (c_custkey // 2) AS license_number, CASE WHEN c_custkey % 8 <> 0 THEN c_mktsegment END AS phone FROM customer)
SELECT 'n' || seq AS id, license_number, 'ACTIVE' AS status, CASE WHEN phone IS NULL THEN 422 WHEN row_number() OVER (PARTITION BY license_number, phone IS NULL ORDER BY seq) > 1 THEN 409 END::INTEGER AS error_code FROM batch
""")
def create_drivers(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    batch = f.table(spark, d, "customer").select(key.alias("seq"), _str("n", key).alias("id"), F.lit("v").alias("vendor_id"), F.col("c_name").alias("full_name"), F.when(key % 8 != 0, F.col("c_mktsegment")).alias("phone"), _str("L", _half(key)).alias("license_number"))
    made, rejected, _ = changes.create(batch, spark.createDataFrame([], TABLES["drivers"].schema), "drivers", _CLOCK, "u1")
    return _answers(made, rejected, "license_number", "status")


@register("""
, batch AS (SELECT c_custkey AS seq, CASE c_custkey % 5 WHEN 0 THEN 'u' || c_custkey || '@example.org' WHEN 1 THEN 'no mail' ELSE 'new' || (c_custkey // 2) || '@example.org' END AS email, CASE WHEN c_custkey % 2 = 0 THEN 'FINANCE' ELSE 'OPERATOR' END AS role FROM customer),
judged AS (SELECT *, email = 'no mail' AS bad, seq % 5 = 0 AS taken FROM batch)
SELECT 'n' || seq AS id, email, role, CASE WHEN bad THEN 422 WHEN taken OR row_number() OVER (PARTITION BY email, bad OR taken ORDER BY seq) > 1 THEN 409 END::INTEGER AS error_code FROM judged
""")
def register_users(spark: SparkSession, d: str) -> DataFrame:
    """Registrations; the answer to a good one is id, email and role."""
    key = F.col("c_custkey")
    mail = F.when(key % 5 == 0, _str("u", key, "@example.org")).when(key % 5 == 1, "no mail").otherwise(_str("new", _half(key), "@example.org"))
    batch = f.table(spark, d, "customer").select(key.alias("seq"), _str("n", key).alias("id"), mail.alias("email"), F.col("c_name").alias("full_name"), F.lit("h").alias("password_hash"), F.when(key % 2 == 0, "FINANCE").alias("role"))
    made, rejected, log = changes.create(batch, f.user_rows(spark, d), "users", _CLOCK, "u1")
    return _answers(access.registered(made), rejected, "email", "role").unionByName(log.select("id", F.lit("").alias("email"), F.lit("").alias("role"), F.lit(0).alias("error_code")))


@register("""
, batch AS (
    SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 5 = 0 THEN 'PO-' || o_orderkey ELSE 'NP-' || (o_orderkey // 3) END AS purchase_number, o_orderkey % 130 AS vendor_id, CASE WHEN o_orderkey % 9 = 0 THEN -1.0 ELSE 2.0 END AS quantity FROM orders),
judged AS (SELECT *, quantity < 0 AS bad, purchase_number IN (SELECT purchase_number FROM purchases) AS taken, vendor_id IN (SELECT id FROM vendors) AS there FROM batch),
told AS (SELECT *, min(CASE WHEN there AND NOT bad AND NOT taken THEN seq END) OVER (PARTITION BY purchase_number) AS first FROM judged)
SELECT 'n' || seq AS id, purchase_number, 'OPEN' AS status, CASE WHEN bad THEN 422 WHEN taken OR seq > first THEN 409 WHEN NOT there THEN 422 END::INTEGER AS error_code FROM told
""")
def create_purchases(spark: SparkSession, d: str) -> DataFrame:
    """Numbers that exist or that several want, and vendors that don't exist."""
    key = F.col("o_orderkey")
    number = F.when(key % 5 == 0, _str("PO-", key)).otherwise(_str("NP-", F.floor(key / 3).cast("bigint")))
    batch = f.table(spark, d, "orders").select(key.alias("seq"), _str("n", key).alias("id"), number.alias("purchase_number"), _str(key % 130).alias("vendor_id"), F.when(key % 9 == 0, -1.0).otherwise(2.0).alias("quantity"), F.lit("open").alias("status"))
    made, rejected, _ = changes.create_purchases(batch, f.purchases(spark, d), f.vendor_rows(spark, d), _CLOCK, "u1")
    return _answers(made, rejected, "purchase_number", "status")


@register("""
, batch AS (
    SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 6 = 0 THEN 'D-' || o_orderkey || '-1' ELSE 'ND-' || (o_orderkey // 2) END AS delivery_number,
        CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE (o_orderkey % 130)::VARCHAR END AS given, CASE WHEN o_orderkey % 10 = 3 THEN 'none' ELSE o_orderkey::VARCHAR END AS purchase_id,
        CASE WHEN o_orderkey % 21 = 0 THEN '' ELSE 'dock' END AS destination FROM orders),
filled AS (SELECT batch.*, coalesce(nullif(given, ''), p.vendor_id::VARCHAR) AS vendor_id FROM batch LEFT JOIN purchases p ON p.id::VARCHAR = purchase_id),
judged AS (SELECT *, destination = '' AS bad, delivery_number IN (SELECT delivery_number FROM deliveries) AS taken, coalesce(vendor_id IN (SELECT id::VARCHAR FROM vendors), false) AS there FROM filled),
told AS (SELECT *, min(CASE WHEN there AND NOT bad AND NOT taken THEN seq END) OVER (PARTITION BY delivery_number) AS first FROM judged)
SELECT 'n' || seq AS id, delivery_number, vendor_id, 'ASSIGNED' AS status, CASE WHEN bad THEN 422 WHEN taken OR seq > first THEN 409 WHEN NOT there THEN 422 END::INTEGER AS error_code FROM told
""")
def create_deliveries(spark: SparkSession, d: str) -> DataFrame:
    """The vendor is the request's or its purchase's; other references may dangle."""
    key = F.col("o_orderkey")
    batch = f.table(spark, d, "orders").select(
        key.alias("seq"), _str("n", key).alias("id"), F.when(key % 6 == 0, _str("D-", key, "-1")).otherwise(_str("ND-", _half(key))).alias("delivery_number"),
        F.when(key % 4 == 0, F.lit(None)).when(key % 4 == 1, "").otherwise(_str(key % 130)).alias("vendor_id"), F.when(key % 10 == 3, "none").otherwise(_str(key)).alias("purchase_id"), F.lit("none").alias("vehicle_id"),
        F.when(key % 21 == 0, "").otherwise("dock").alias("destination"), F.col("o_orderdate").cast("timestamp").alias("scheduled_at"), F.lit("assigned").alias("status"),
    )
    made, rejected, _ = changes.create_deliveries(batch, f.deliveries(spark, d), _string_ids(f.purchases(spark, d), "id", "vendor_id"), f.vendor_rows(spark, d), _CLOCK, "u1")
    return _answers(made, rejected, "delivery_number", "vendor_id", "status")


def _after(moved: DataFrame, rejected: DataFrame, *columns: str) -> DataFrame:
    """Rows of the new snapshot, and the rejected requests below them by seq."""
    return moved.select("id", *columns, F.lit(None).cast("int").alias("error_code")).union(rejected.select(_str("request ", F.col("seq")), *(F.lit(None) for _ in columns), F.col("error_code").cast("int")))


@register("""
, asked AS (SELECT s_suppkey AS seq, CASE WHEN s_suppkey % 10 = 9 THEN -1 ELSE s_suppkey END AS id, s_suppkey % 3 AS kind, CASE WHEN s_suppkey % 3 = 0 THEN CASE WHEN s_suppkey % 2 = 0 THEN 'G' || (s_suppkey - 1) ELSE 'U' || (s_suppkey // 12) END END AS gstin FROM supplier),
told AS (SELECT *, id = -1 AS missing, kind = 0 AND gstin IN (SELECT 'G' || v.id FROM vendors v) AS taken FROM asked),
raced AS (SELECT *, min(CASE WHEN kind = 0 AND NOT missing AND NOT taken THEN seq END) OVER (PARTITION BY gstin) AS first FROM told),
done AS (SELECT *, CASE WHEN missing THEN 404 WHEN kind = 0 AND (taken OR seq > first) THEN 409 WHEN kind = 1 AND seq % 4 = 0 THEN 422 END AS code FROM raced)
SELECT v.id::VARCHAR AS id, v.vendor_code, CASE WHEN kind = 0 AND code IS NULL THEN done.gstin ELSE 'G' || v.id END AS gstin, CASE WHEN kind = 1 AND code IS NULL THEN 'ACTIVE2' ELSE v.status END AS status, NULL::INTEGER AS error_code
FROM vendors v LEFT JOIN done ON done.id = v.id UNION ALL SELECT 'request ' || seq, NULL, NULL, NULL, code::INTEGER FROM done WHERE code IS NOT NULL
""")
def update_vendors(spark: SparkSession, d: str) -> DataFrame:
    """Tax numbers of others, that several want, statuses set to a value or (refused) to null; the code can't be changed."""
    key = F.col("s_suppkey")
    asked = f.table(spark, d, "supplier").select(
        key.alias("seq"), F.when(key % 10 == 9, "-1").otherwise(_str(key)).alias("id"), F.lit("changed").alias("vendor_code"),
        F.when(key % 3 == 0, F.array(F.lit("gstin"))).when(key % 3 == 1, F.array(F.lit("status"), F.lit("vendor_code"))).otherwise(F.array().cast("array<string>")).alias("fields"),
        F.when(key % 2 == 0, _str("G", key - 1)).otherwise(_str("U", F.floor(key / 12).cast("bigint"))).alias("gstin"), F.when(key % 4 != 0, "ACTIVE2").alias("status"),
    )
    moved, rejected, _ = changes.update(f.vendor_rows(spark, d), asked, "vendors", _CLOCK, "u1")
    return _after(moved, rejected, "vendor_code", "gstin", "status")


@register("""
, asked AS (SELECT id AS seq, CASE WHEN id % 20 = 9 THEN -1 ELSE id END AS id, id % 3 AS kind, CASE WHEN id % 3 = 1 THEN CASE id % 4 WHEN 0 THEN 'PO-' || id WHEN 1 THEN 'PO-' || (id + 1) ELSE 'U' || (id // 24) END END AS number, id % 130 AS vendor FROM purchases),
told AS (SELECT a.*, a.id = -1 AS missing, kind = 1 AND p.id IS NOT NULL AND p.id <> a.id AS taken, kind <> 1 OR vendor = 0 OR vendor IN (SELECT id FROM vendors) AS there FROM asked a LEFT JOIN purchases p ON p.purchase_number = a.number),
raced AS (SELECT *, min(CASE WHEN kind = 1 AND NOT missing AND NOT taken AND there THEN seq END) OVER (PARTITION BY number) AS first FROM told),
done AS (SELECT *, CASE WHEN missing THEN 404 WHEN kind = 1 AND (taken OR seq > first) THEN 409 WHEN NOT there THEN 422 END AS code FROM raced)
SELECT p.id::VARCHAR AS id, CASE WHEN kind = 1 AND code IS NULL THEN number ELSE p.purchase_number END AS purchase_number, CASE WHEN kind = 1 AND code IS NULL THEN CASE WHEN vendor = 0 THEN '' ELSE vendor::VARCHAR END ELSE p.vendor_id::VARCHAR END AS vendor_id,
    CASE WHEN kind = 0 AND code IS NULL THEN 'CLOSED' ELSE p.status END AS status, CASE WHEN kind = 2 AND code IS NULL THEN NULL ELSE p.reference END AS reference, NULL::INTEGER AS error_code
FROM purchases p LEFT JOIN done ON done.id = p.id UNION ALL SELECT 'request ' || seq, NULL, NULL, NULL, NULL, code::INTEGER FROM done WHERE code IS NOT NULL
""")
def update_purchases(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of others, their own again, or that several want; vendors that don't exist; status and null."""
    base = _string_ids(f.purchases(spark, d), "id", "vendor_id")
    key = F.col("id").cast("bigint")
    asked = base.select(
        key.alias("seq"), F.when(key % 20 == 9, "-1").otherwise(F.col("id")).alias("id"),
        F.when(key % 3 == 0, F.array(F.lit("status"))).when(key % 3 == 1, F.array(F.lit("purchase_number"), F.lit("vendor_id"))).otherwise(F.array(F.lit("reference"))).alias("fields"),
        F.when(key % 4 == 0, _str("PO-", key)).when(key % 4 == 1, _str("PO-", key + 1)).otherwise(_str("U", F.floor(key / 24).cast("bigint"))).alias("purchase_number"),
        F.when(key % 130 == 0, "").otherwise(_str(key % 130)).alias("vendor_id"), F.lit("closed").alias("status"), F.lit(None).cast("string").alias("reference"),
    )
    moved, rejected, _ = changes.update(base, asked, "purchases", _CLOCK, "u1", vendors=f.vendor_rows(spark, d))
    return _after(moved, rejected, "purchase_number", "vendor_id", "status", "reference")


@register("""
, base AS (SELECT id AS n, 'E-' || id AS number, (id % 90 + 1)::VARCHAR AS vendor_id FROM purchases),
asked AS (SELECT n AS seq, n, n % 3 AS kind, CASE WHEN n % 7 = 0 THEN 'none' ELSE (n + 1)::VARCHAR END AS purchase_id, CASE WHEN n % 11 = 0 THEN 'none' ELSE (n % 1000 + 1)::VARCHAR END AS driver_id FROM base),
told AS (SELECT a.*, p.vendor_id::VARCHAR AS owner, p.id IS NOT NULL AS bought, v.id IS NOT NULL AS there, r.id IS NOT NULL AS drives
    FROM asked a LEFT JOIN purchases p ON p.id::VARCHAR = a.purchase_id LEFT JOIN vendors v ON v.id = p.vendor_id LEFT JOIN drivers r ON r.id::VARCHAR = a.driver_id),
done AS (SELECT *, CASE WHEN kind = 0 AND NOT bought THEN 422 WHEN kind = 0 AND NOT there THEN 422 WHEN kind = 1 AND NOT drives THEN 422 END AS code FROM told)
SELECT base.n::VARCHAR AS id, number AS delivery_number, CASE WHEN kind = 0 AND code IS NULL THEN owner ELSE vendor_id END AS vendor_id, CASE WHEN kind = 0 AND code IS NULL THEN purchase_id END AS purchase_id,
    CASE WHEN kind = 1 AND code IS NULL THEN driver_id END AS driver_id, CASE WHEN kind = 2 THEN 'none' END AS vehicle_id, CASE WHEN kind = 2 THEN 'IN_TRANSIT' ELSE 'SCHEDULED' END AS status, NULL::INTEGER AS error_code
FROM base JOIN done USING (n) UNION ALL SELECT 'request ' || seq, NULL, NULL, NULL, NULL, NULL, NULL, code::INTEGER FROM done WHERE code IS NOT NULL
""")
def update_deliveries(spark: SparkSession, d: str) -> DataFrame:
    """A named purchase must exist and brings its vendor, a driver must exist, the vehicle isn't checked."""
    p = f.purchases(spark, d)
    key = F.col("id")
    base = evolve(p.select(_str(key).alias("id"), _str("E-", key).alias("delivery_number"), _str(key % 90 + 1).alias("vendor_id"), F.lit("SCHEDULED").alias("status")), TABLES["deliveries"])
    asked = p.select(
        key.alias("seq"), _str(key).alias("id"), F.when(key % 3 == 0, F.array(F.lit("purchase_id"))).when(key % 3 == 1, F.array(F.lit("driver_id"))).otherwise(F.array(F.lit("vehicle_id"), F.lit("status"))).alias("fields"),
        F.when(key % 7 == 0, "none").otherwise(_str(key + 1)).alias("purchase_id"), F.when(key % 11 == 0, "none").otherwise(_str(key % 1000 + 1)).alias("driver_id"), F.lit("none").alias("vehicle_id"), F.lit("in_transit").alias("status"),
    )
    moved, rejected, _ = changes.update(base, asked, "deliveries", _CLOCK, "u1", f.vendor_rows(spark, d), _string_ids(p, "id", "vendor_id"), _string_ids(f.drivers(spark, d), "id"))
    return _after(moved, rejected, "delivery_number", "vendor_id", "purchase_id", "driver_id", "vehicle_id", "status")


@register("""
SELECT left(sha256('UPDATE|invoices|' || id || '|1998-06-01 00:00:00+00:00|' || id), 36) AS id, '1998-06-01 00:00:00' AS created_at, 'u1' AS actor_id, 'UPDATE' AS action, 'invoices' AS resource_type, id::VARCHAR AS resource_id,
    CASE WHEN id % 2 = 0 THEN '{"fields":["amount","status"]}' ELSE '{"fields":["due_date"]}' END AS details, CASE WHEN id % 2 = 0 THEN 1.5 ELSE amount END::DOUBLE AS amount, CASE WHEN id % 2 = 0 THEN 'anything' ELSE status END AS status
FROM invoices WHERE id % 2 = 1 OR id % 4 <> 0
""")
def update_invoices(spark: SparkSession, d: str) -> DataFrame:
    """The generic partial update with its audit rows; any status is taken, an amount must be above 0."""
    base = _string_ids(f.invoices(spark, d), "id")
    key = F.col("id").cast("bigint")
    asked = base.select(key.alias("seq"), "id", F.when(key % 2 == 0, F.array(F.lit("status"), F.lit("amount"))).otherwise(F.array(F.lit("due_date"))).alias("fields"), F.lit("anything").alias("status"), F.when(key % 4 == 0, 0.0).otherwise(1.5).alias("amount"), F.lit(None).cast("date").alias("due_date"))
    moved, _, log = changes.update(base, asked, "invoices", _CLOCK, "u1")
    return log.withColumn("created_at", text.utc(F.col("created_at")).cast("string")).join(moved.select(F.col("id").alias("resource_id"), "amount", "status"), "resource_id")


@register("""
SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 4 = 1 THEN 'CONFIRMED' WHEN doc_id % 10 = 0 THEN 'UPLOADED' ELSE 'REVIEW_REQUIRED' END AS status, CASE WHEN doc_id % 4 = 1 THEN '1' END AS reviewed,
    CASE WHEN doc_id % 4 <> 1 AND doc_id % 10 <> 0 THEN left(text, 10000) END AS text, doc_id % 4 = 1 AS confirmed, doc_id % 10 = 0 AS failed FROM documents
""")
def document_review(spark: SparkSession, d: str) -> DataFrame:
    """Extraction results are recorded, those that failed are set apart, and some documents are confirmed with reviewed fields."""
    raw = f.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    key = F.col("id").cast("bigint")
    docs = evolve(raw.select("id", F.lit("REPORT").alias("document_type"), F.lit("UPLOADED").alias("status")), TABLES["documents"])
    texts = raw.select("id", F.when(key % 10 != 0, F.col("text")).alias("text"), F.when(key % 10 == 0, "ValueError: no").alias("error"))
    moved, apart = workflow.record_extraction(docs, texts)
    first = raw.where(key % 4 == 1).select(key.alias("seq"), "id", F.lit('{"a":0}').alias("fields"))
    last = first.select((F.col("seq") + 10**9).alias("seq"), "id", F.lit('{"a":1}').alias("fields"))
    done, _, _ = workflow.confirm(moved, first.union(last), _CLOCK, "u1")
    failed = apart.select("id", F.lit(True).alias("failed"))
    return done.join(failed, "id", "left").select(
        "id", "status", F.get_json_object("extracted_fields", "$.a").alias("reviewed"), F.from_json("extracted_fields", "struct<text:string>")["text"].alias("text"),
        F.col("review_confirmed_at").isNotNull().alias("confirmed"), F.coalesce("failed", F.lit(False)).alias("failed"),
    )


@register("""
SELECT 'me' AS answer, c_custkey::VARCHAR AS id, 'u' || c_custkey || '@example.org' AS email, c_name AS name, CASE WHEN c_nationkey % 5 = 0 THEN 'ADMIN' ELSE 'OPERATOR' END AS role FROM customer WHERE c_custkey IN (1, 2, 3, 4, 5, 6) AND c_acctbal >= 0
UNION ALL SELECT 'login', c_custkey::VARCHAR, NULL, c_name, CASE WHEN c_nationkey % 5 = 0 THEN 'ADMIN' ELSE 'OPERATOR' END FROM customer WHERE c_custkey = 7
""")
def user_session(spark: SparkSession, d: str) -> DataFrame:
    """Who some tokens stand for (inactive and unknown users for nobody), and what a login answers."""
    users = f.user_rows(spark, d)
    found = [access.identity(access.active_user(users, subject)) for subject in ("1", "2", "3", "4", "5", "6", "nobody")]
    out = None
    for one in found:
        told = one.select(F.lit("me").alias("answer"), "id", "email", F.col("full_name").alias("name"), "role")
        out = told if out is None else out.unionByName(told)
    login = access.login_user(paging.by_key(users, "email", "u7@example.org")).select("user.*")
    return out.unionByName(login.select(F.lit("login").alias("answer"), "id", F.lit(None).cast("string").alias("email"), "name", "role"))


@register("""
SELECT 'seeded' AS kind, 'admin' AS id, 'ADMIN' AS role UNION ALL SELECT 'kept', c_custkey::VARCHAR, CASE WHEN c_nationkey % 5 = 0 THEN 'ADMIN' ELSE 'OPERATOR' END FROM customer UNION ALL SELECT 'any', '7', NULL
""")
def first_user(spark: SparkSession, d: str) -> DataFrame:
    """A first user is added where there is none, and only there; and the probe for any row."""
    users = f.user_rows(spark, d)
    admin = spark.range(1).select(F.lit("admin").alias("id"), F.lit("admin@example.org").alias("email"), F.lit("Admin").alias("full_name"), F.lit("ADMIN").alias("role"), F.lit(True).alias("is_active"))
    seeded = tables.seed_admin(users.where("false"), admin).select(F.lit("seeded").alias("kind"), "id", "role")
    kept = tables.seed_admin(users, admin).select(F.lit("kept").alias("kind"), "id", "role")
    probe = paging.any_row(users.where("id = '7'")).select(F.lit("any").alias("kind"), "id", F.lit(None).cast("string").alias("role"))
    return seeded.union(kept).union(probe)


@register("SELECT id, delivery_number, vendor_id::VARCHAR AS vendor_id, NULL::VARCHAR AS purchase_id, NULL::VARCHAR AS recipient, status FROM deliveries")
def older_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """A snapshot written before two columns were added is read with them as null."""
    old = f.deliveries(spark, d).drop("purchase_id", "recipient", "amount")
    return evolve(old, TABLES["deliveries"]).select("id", "delivery_number", "vendor_id", "purchase_id", "recipient", "status")


@register(r"""
, asked AS (SELECT doc_id, 'doc' || doc_id || (['.PDF', '.docx', '.Xlsx', '.txt', ''])[doc_id % 5 + 1] AS filename FROM documents)
SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 5 < 3 THEN 'u1/19980601000000_' || left(md5(doc_id::VARCHAR), 8) || '_' || filename END AS object_key, CASE WHEN doc_id % 5 < 3 THEN 'INVOICE' END AS document_type,
    CASE WHEN doc_id % 5 < 3 THEN 'UPLOAD' END AS action, CASE WHEN doc_id % 5 >= 3 THEN 415 END::INTEGER AS error_code FROM asked
""")
def upload_documents(spark: SparkSession, d: str) -> DataFrame:
    """Uploaded files get their object key, unsupported ones are refused."""
    kinds = F.array(*map(F.lit, (".PDF", ".docx", ".Xlsx", ".txt", "")))
    key = F.col("doc_id")
    batch = f.table(spark, d, "documents").select(key.alias("seq"), _str(key).alias("id"), F.concat(F.lit("doc"), key.cast("string"), F.get(kinds, (key % 5).cast("int"))).alias("filename"), F.lit("x/y").alias("content_type"), F.lit("invoice").alias("document_type"), F.md5(key.cast("string").cast("binary")).alias("token"))
    made, rejected, log = changes.upload_documents(batch, spark.createDataFrame([], TABLES["documents"].schema), _CLOCK, "u1")
    good = made.join(log.select(F.col("resource_id").alias("id"), "action"), "id", "left").select("id", "object_key", "document_type", "action", F.lit(None).cast("int").alias("error_code"))
    none = F.lit(None).cast("string")
    return good.union(rejected.select("id", none, none, none, F.col("error_code").cast("int")))


_COUNTS = ("vendors", "active_vendors", "pending_invoices", "overdue_invoices", "deliveries_today", "active_deliveries", "documents_for_review")


@register("""
, next AS (SELECT d.*, row_number() OVER (ORDER BY scheduled_at, id) AS nth FROM deliveries d, clock WHERE scheduled_at >= now),
listed AS (SELECT nth, n.delivery_number || '/' || coalesce(v.legal_name, '-') || '/' || coalesce(p.purchase_number, '-') || '/' || coalesce(c.registration_number, '-') || '/' || coalesce(r.full_name, '-') AS line
    FROM next n LEFT JOIN vendors v ON v.id = n.vendor_id LEFT JOIN purchases p ON p.id = n.purchase_id LEFT JOIN vehicles c ON c.id = n.vehicle_id LEFT JOIN drivers r ON r.id = n.driver_id WHERE nth <= 5)
SELECT (SELECT count(*) FROM vendors) AS vendors, (SELECT count(*) FROM vendors WHERE status = 'ACTIVE') AS active_vendors,
    (SELECT count(*) FROM invoices WHERE status IN ('PENDING', 'PENDING_APPROVAL', 'DRAFT')) AS pending_invoices,
    (SELECT count(*) FROM invoices, clock WHERE due_date < now::DATE AND status <> 'PAID') AS overdue_invoices,
    (SELECT count(*) FROM deliveries, clock WHERE scheduled_at >= now AND scheduled_at < now + INTERVAL 1 DAY) AS deliveries_today,
    (SELECT count(*) FROM deliveries WHERE status IN ('SCHEDULED', 'ASSIGNED', 'IN_TRANSIT')) AS active_deliveries,
    (SELECT count(*) FROM labels WHERE quality = 0) AS documents_for_review, (SELECT string_agg(line, ',' ORDER BY nth) FROM listed) AS upcoming_deliveries
""")
def dashboard_record(spark: SparkSession, d: str) -> DataFrame:
    """The dashboard as one record: seven counts and the next deliveries in order."""
    review = f.table(spark, d, "labels").select(F.when(F.col("quality") == 0, "REVIEW_REQUIRED").otherwise("CONFIRMED").alias("status"))
    one = kpi.dashboard(f.vendors(spark, d), f.invoices(spark, d), f.deliveries(spark, d), review, f.purchases(spark, d), f.vehicles(spark, d), f.drivers(spark, d), f.now())
    line = lambda x: F.concat_ws("/", x["delivery_number"], *(F.coalesce(x[c], F.lit("-")) for c in ("vendor_name", "purchase_number", "vehicle_number", "driver_name")))
    return one.select(*_COUNTS, F.array_join(F.transform("upcoming_deliveries", line), ",").alias("upcoming_deliveries"))


_WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _zip(entries: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in entries.items():
            z.writestr(name, content)
    return out.getvalue()


def _file(kind: int, key: int, name: str) -> bytes | None:
    """A Word file, a spreadsheet, another file, a broken one, or none."""
    if kind == 0:
        return _zip({"word/document.xml": f'<w:document xmlns:w="{_WORD}"><w:body><w:p><w:r><w:t>{name}</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:t>part {key}</w:t></w:r></w:p></w:body></w:document>'})
    if kind == 1:
        cells = f'<row r="1"><c r="A1" t="inlineStr"><is><t>{name}</t></is></c><c r="C1"><v>{key}</v></c></row><row r="2"><c r="A2" s="1"><v>45352</v></c></row>'
        return _zip({
            "xl/workbook.xml": f'<workbook xmlns="{_SHEET}" xmlns:r="{_RELATIONS}"><sheets><sheet name="S{key}" sheetId="1" r:id="rId1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships xmlns="x"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
            "xl/styles.xml": f'<styleSheet xmlns="{_SHEET}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>', "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{_SHEET}"><sheetData>{cells}</sheetData></worksheet>',
        })
    return {2: b"image", 3: b"broken"}.get(kind)


def _files(spark: SparkSession, d: str) -> DataFrame:
    """Documents of five kinds made of the parts, as sources.files.stored gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, names = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            made = [_file(k % 5, k, n) for k, n in zip(keys, names)]
            kinds = [f"p{k}" + (".docx", ".XLSX", ".png", ".docx", ".pdf")[k % 5] for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array([str(k) for k in keys]), pa.array(kinds), pa.array(made, pa.binary()), pa.array([m is not None for m in made])], names=["id", "filename", "content", "found"])

    return f.table(spark, d, "part").select("p_partkey", "p_name").mapInArrow(run, "id string, filename string, content binary, found boolean")


@register("""
SELECT p_partkey::VARCHAR AS id, CASE p_partkey % 5 WHEN 0 THEN p_name || chr(10) || chr(10) || 'part ' || p_partkey WHEN 1 THEN p_name || ' | ' || p_partkey || chr(10) || '2024-03-01 00:00:00' WHEN 2 THEN 'read 5' END AS text,
    CASE p_partkey % 5 WHEN 3 THEN 'BadZipFile' WHEN 4 THEN 'FileNotFoundError' END AS error FROM part
""")
def file_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts of Word files, spreadsheets and images (by a stand-in reader); broken and absent files are told apart."""
    readers = files.Readers(ocr=lambda content: f"read {len(content)}")
    return files.texts(_files(spark, d), readers).select("id", "text", F.regexp_extract("error", r"^(\w+):", 1).alias("e")).select("id", "text", F.when(F.col("e") != "", F.col("e")).alias("error"))


@register("""
SELECT p_partkey::VARCHAR AS id, CASE p_partkey % 5 WHEN 0 THEN 'document' WHEN 1 THEN 'spreadsheet' WHEN 2 THEN 'binary' END AS type, CASE p_partkey % 5 WHEN 0 THEN p_name || '|part ' || p_partkey END AS lines,
    CASE p_partkey % 5 WHEN 1 THEN 'S' || p_partkey END AS sheet, CASE p_partkey % 5 WHEN 1 THEN p_name || ',,' || p_partkey || ';2024-03-01 00:00:00,,' END AS rows, p_partkey % 5 > 2 AS failed FROM part
""")
def file_previews(spark: SparkSession, d: str) -> DataFrame:
    got = files.previews(_files(spark, d))
    rows = F.array_join(F.transform("rows", lambda r: F.array_join(r, ",")), ";")
    return got.select("id", "type", F.array_join("lines", "|").alias("lines"), "sheet", rows.alias("rows"), F.col("error").isNotNull().alias("failed"))
