"""The registered queries: the library's operators over the synthetic tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulframe.functions import text
from haulframe.operators import changes, kpi, paging, plates, validation, views, workflow
from haulframe.plans import fixtures as f
from haulframe.plans.registered import QUERIES, SQL, Query
from haulframe.plans.registered import register as _register

#: The clock of written rows.
_CLOCK = datetime(1998, 6, 1, tzinfo=timezone.utc)



def queries() -> dict[str, Query]:
    from haulframe.plans import writes  # noqa: F401  registers the queries of the write path

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)


_DELIVERY_SQL = """
SELECT d.id, d.delivery_number, d.vendor_id, v.legal_name AS vendor_name, d.purchase_id, p.purchase_number, d.vehicle_id, c.registration_number AS vehicle_number,
    d.driver_id, r.full_name AS driver_name, r.phone AS driver_phone, d.destination, d.recipient, d.scheduled_at, d.status, d.notes, d.created_at
FROM {} d LEFT JOIN vendors v ON v.id = d.vendor_id LEFT JOIN purchases p ON p.id = d.purchase_id
LEFT JOIN vehicles c ON c.id = d.vehicle_id LEFT JOIN drivers r ON r.id = d.driver_id
"""


def _lookups(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    return f.vendors(spark, d), f.purchases(spark, d), f.vehicles(spark, d), f.drivers(spark, d)


@_register(", cut AS (SELECT * FROM deliveries WHERE status = 'SCHEDULED' ORDER BY scheduled_at NULLS FIRST, id LIMIT 50 OFFSET 20)" + _DELIVERY_SQL.format("cut"))
def delivery_board(spark: SparkSession, d: str) -> DataFrame:
    """A page of the delivery list: filter, order, page, four lookups."""
    return views.delivery_page(f.deliveries(spark, d), *_lookups(spark, d), status="scheduled", limit=50, offset=20)[0]


@_register("SELECT count(*) AS total FROM deliveries WHERE status = 'SCHEDULED'")
def delivery_total(spark: SparkSession, d: str) -> DataFrame:
    return views.delivery_page(f.deliveries(spark, d), *_lookups(spark, d), status="scheduled")[1]


@_register(_DELIVERY_SQL.format("deliveries"))
def delivery_full(spark: SparkSession, d: str) -> DataFrame:
    """Every delivery with its four lookups."""
    return views.deliveries(f.deliveries(spark, d), *_lookups(spark, d))


@_register("""
SELECT vendor_code, legal_name, 'G' || id AS gstin, category::VARCHAR AS category, status, NULL::VARCHAR AS phone, NULL::VARCHAR AS email, NULL::VARCHAR AS address, NULL::VARCHAR AS bank_details, id::VARCHAR AS id
FROM vendors ORDER BY vendors.id % 97 DESC, vendors.id::VARCHAR LIMIT 50 OFFSET 10
""")
def vendor_page(spark: SparkSession, d: str) -> DataFrame:
    """The vendor list: the latest first, without their creation time."""
    return views.vendor_page(f.vendor_rows(spark, d), 50, 10)


@_register("SELECT id, vendor_code, legal_name, status FROM vendors WHERE id = 7")
def vendor_by_key(spark: SparkSession, d: str) -> DataFrame:
    return paging.by_key(f.vendors(spark, d), "id", 7).select("id", "vendor_code", "legal_name", "status")


@_register("SELECT id, vendor_code, legal_name, status FROM vendors WHERE vendor_code = 'V7'")
def vendor_by_code(spark: SparkSession, d: str) -> DataFrame:
    return paging.by_key(f.vendors(spark, d), "vendor_code", "V7").select("id", "vendor_code", "legal_name", "status")


@_register("SELECT c_custkey AS id, 'u' || c_custkey || '@example.org' AS email, c_name AS full_name, CASE WHEN c_nationkey % 5 = 0 THEN 'ADMIN' ELSE 'OPERATOR' END AS role, c_acctbal >= 0 AS is_active, TIMESTAMP '1998-06-01' AS created_at FROM customer")
def user_roster(spark: SparkSession, d: str) -> DataFrame:
    c = f.table(spark, d, "customer")
    users = c.select(F.col("c_custkey").alias("id"), F.concat(F.lit("u"), F.col("c_custkey").cast("string"), F.lit("@example.org")).alias("email"), F.col("c_name").alias("full_name"), F.sha2("c_name", 256).alias("password_hash"), F.when(F.col("c_nationkey") % 5 == 0, "ADMIN").otherwise("OPERATOR").alias("role"), (F.col("c_acctbal") >= 0).alias("is_active"), f.now().alias("created_at"))
    return views.roster(users)


@_register("SELECT event_id AS id, ts AS created_at, user_id AS actor_id, event_type AS action, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events ORDER BY ts DESC NULLS LAST, event_id LIMIT 100")
def audit_recent(spark: SparkSession, d: str) -> DataFrame:
    """The latest audit rows, with a field of their details."""
    log = f.table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.col("user_id").alias("actor_id"), F.col("event_type").alias("action"), F.col("props").alias("details"))
    return views.audit_page(log, 100).withColumn("k", F.get_json_object("details", "$.k").cast("bigint")).drop("details")


@_register("SELECT id, 'invoice' AS resource_type, id AS resource_id, requested_by, status, created_at FROM invoices")
def approval_list(spark: SparkSession, d: str) -> DataFrame:
    a = f.invoices(spark, d).select("id", F.lit("invoice").alias("resource_type"), F.col("id").alias("resource_id"), "requested_by", "status", "created_at")
    return views.newest_all(a)


@_register("SELECT id, invoice_number, due_date::VARCHAR AS due_date, amount, status, created_at, requested_by FROM invoices ORDER BY created_at DESC NULLS LAST, id LIMIT 200 OFFSET 50")
def invoice_page(spark: SparkSession, d: str) -> DataFrame:
    return views.newest_page(f.invoices(spark, d), 200, 50)[0].withColumn("due_date", F.col("due_date").cast("string"))


@_register("""
SELECT p.id, p.purchase_number, p.vendor_id, v.legal_name AS vendor_name, p.reference, p.quantity, p.total_amount, p.expected_date, p.status, p.notes, p.created_at
FROM (SELECT * FROM purchases ORDER BY expected_date NULLS LAST, created_at DESC NULLS LAST, id LIMIT 200 OFFSET 30) p LEFT JOIN vendors v ON v.id = p.vendor_id
""")
def purchase_page(spark: SparkSession, d: str) -> DataFrame:
    return views.purchase_page(f.purchases(spark, d), f.vendors(spark, d), None, 200, 30)[0]


@_register("SELECT p.id, p.purchase_number, p.vendor_id, v.legal_name AS vendor_name, p.expected_date FROM purchases p LEFT JOIN vendors v ON v.id = p.vendor_id")
def purchase_full(spark: SparkSession, d: str) -> DataFrame:
    """Every purchase with its vendor; some vendors dangle."""
    return views.purchases(f.purchases(spark, d), f.vendors(spark, d)).select("id", "purchase_number", "vendor_id", "vendor_name", "expected_date")


@_register("SELECT count(*) AS total FROM purchases WHERE status = 'P'")
def purchase_status_total(spark: SparkSession, d: str) -> DataFrame:
    return paging.total(paging.with_status(f.purchases(spark, d), "p"))


@_register("""
SELECT (SELECT count(*) FROM vendors) AS vendors, (SELECT count(*) FROM vendors WHERE status = 'ACTIVE') AS active_vendors,
    (SELECT count(*) FROM invoices WHERE status IN ('PENDING', 'PENDING_APPROVAL', 'DRAFT')) AS pending_invoices,
    (SELECT count(*) FROM invoices, clock WHERE due_date < now::DATE AND status <> 'PAID') AS overdue_invoices,
    (SELECT count(*) FROM deliveries, clock WHERE scheduled_at >= now AND scheduled_at < now + INTERVAL 1 DAY) AS deliveries_today,
    (SELECT count(*) FROM deliveries WHERE status IN ('SCHEDULED', 'ASSIGNED', 'IN_TRANSIT')) AS active_deliveries,
    (SELECT count(*) FROM labels WHERE quality = 0) AS documents_for_review
""")
def dashboard_counts(spark: SparkSession, d: str) -> DataFrame:
    review = f.table(spark, d, "labels").select(F.when(F.col("quality") == 0, "REVIEW_REQUIRED").otherwise("CONFIRMED").alias("status"))
    return kpi.dashboard_counts(f.vendors(spark, d), f.invoices(spark, d), f.deliveries(spark, d), review, f.now())


@_register(", cut AS (SELECT deliveries.* FROM deliveries, clock WHERE scheduled_at >= now ORDER BY scheduled_at, id LIMIT 5)" + _DELIVERY_SQL.format("cut"))
def dashboard_upcoming(spark: SparkSession, d: str) -> DataFrame:
    return views.deliveries(kpi.upcoming(f.deliveries(spark, d), f.now()), *_lookups(spark, d))


@_register("""
SELECT (SELECT count(*) FROM vendors) AS vendors, (SELECT count(*) FROM vehicles WHERE status = 'ACTIVE') AS active_vehicles,
    (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS pending_approvals,
    (SELECT coalesce(sum(amount::DECIMAL(18, 2))::DOUBLE, 0.0) FROM invoices) AS invoice_total, (SELECT coalesce(sum(amount::DECIMAL(18, 2))::DOUBLE, 0.0) FROM deliveries) AS paid_total
""")
def report_summary(spark: SparkSession, d: str) -> DataFrame:
    approvals = f.table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "P", "PENDING").otherwise("APPROVED").alias("status"))
    return kpi.summary(f.vendors(spark, d), f.vehicles(spark, d), approvals, f.invoices(spark, d), f.deliveries(spark, d))


@_register("SELECT count(*) AS n, coalesce(sum(amount), 0.0)::DOUBLE AS invoice_total FROM invoices WHERE status = 'VOID'")
def empty_sum(spark: SparkSession, d: str) -> DataFrame:
    return f.invoices(spark, d).where("status = 'VOID'").agg(F.count(F.lit(1)).alias("n"), kpi.total_of("amount", "invoice_total"))


@_register(r"""
SELECT doc_id, array_to_string(list_transform(found, lambda x: regexp_replace(x, '[^A-Z0-9]', '', 'g')), ',') AS candidates, len(found)::BIGINT AS n
FROM (SELECT doc_id, regexp_extract_all(upper(text), '[A-Z]{2}\s?\d{1,2}\s?[A-Z]{1,3}\s?\d{4}') AS found FROM documents) WHERE len(found) > 0
""")
def plate_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Documents in which a registration number can be read."""
    found = text.registration_candidates(F.col("text"), unicode=False)
    docs = f.table(spark, d, "documents").select("doc_id", found.alias("found")).where(F.size("found") > 0)
    return docs.select("doc_id", F.array_join("found", ",").alias("candidates"), F.size("found").cast("bigint").alias("n"))


@_register("""
SELECT p_partkey AS id, plate, length(plate) BETWEEN 8 AND 11 AS valid
FROM (SELECT p_partkey, regexp_replace(upper(p_brand || '-' || p_size), '[^A-Z0-9]', '', 'g') AS plate FROM part)
""")
def plate_normalize(spark: SparkSession, d: str) -> DataFrame:
    plate = text.normalize_registration(F.concat_ws("-", "p_brand", F.col("p_size").cast("string")))
    return f.table(spark, d, "part").select(F.col("p_partkey").alias("id"), plate.alias("plate")).withColumn("valid", text.registration_valid(F.col("plate")))


@_register("""
, asked AS (
    SELECT c_custkey AS request, regexp_replace(upper(CASE WHEN c_custkey % 10 = 0 THEN 'ka-1' ELSE 'ka-' || left(lpad((c_custkey * 3)::VARCHAR, 8, '0'), 4) || ' ' || right(lpad((c_custkey * 3)::VARCHAR, 8, '0'), 4) END), '[^A-Z0-9]', '', 'g') AS plate FROM customer)
SELECT request, plate AS registration_number, c.id AS vehicle_id, v.id AS vendor_id, v.legal_name AS vendor_name,
    CASE WHEN length(plate) NOT BETWEEN 8 AND 11 THEN 422 WHEN c.id IS NULL THEN 404 END::INTEGER AS error_code
FROM asked LEFT JOIN vehicles c ON c.registration_number = plate AND length(plate) BETWEEN 8 AND 11 LEFT JOIN vendors v ON v.id = c.vendor_id
""")
def plate_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Requests with messy spellings, unreadable and unknown plates among them; some vehicles' vendors dangle."""
    digits = F.lpad((F.col("c_custkey") * 3).cast("string"), 8, "0")
    messy = F.when(F.col("c_custkey") % 10 == 0, "ka-1").otherwise(F.concat(F.lit("ka-"), F.substring(digits, 1, 4), F.lit(" "), F.substring(digits, 5, 4)))
    asked = f.table(spark, d, "customer").select(F.col("c_custkey").alias("request"), messy.alias("registration_number"))
    found = plates.look_up(asked, f.vehicles(spark, d), f.vendors(spark, d))
    return found.select("request", "registration_number", F.col("vehicle.id").alias("vehicle_id"), F.col("vendor.id").alias("vendor_id"), F.col("vendor.legal_name").alias("vendor_name"), F.col("error_code").cast("int").alias("error_code"))


@_register("""
, seen AS (
    SELECT p_partkey AS image, CASE p_partkey % 4 WHEN 0 THEN 'no plate' WHEN 1 THEN 'seen ka 01 ab 1234 and KA02C0007' ELSE 'KA' || lpad((p_partkey % 100)::VARCHAR, 2, '0') || 'Z' || lpad(p_partkey::VARCHAR, 4, '0') END AS t FROM part),
cars AS (SELECT c_custkey AS id, 'KA' || lpad((c_custkey % 100)::VARCHAR, 2, '0') || 'Z' || lpad(c_custkey::VARCHAR, 4, '0') AS plate FROM customer),
found AS (SELECT image, list_transform(regexp_extract_all(upper(t), '[A-Z]{2}\\s?\\d{1,2}\\s?[A-Z]{1,3}\\s?\\d{4}'), lambda x: regexp_replace(x, '[^A-Z0-9]', '', 'g')) AS c FROM seen)
SELECT image, array_to_string(c, ',') AS candidates, c[1] AS registration_number, cars.id AS vehicle_id, cars.id IS NOT NULL AS matched,
    CASE WHEN len(c) = 0 THEN 422 END::INTEGER AS error_code FROM found LEFT JOIN cars ON plate = c[1]
""".replace("\\\\", "\\"))
def plate_recognize(spark: SparkSession, d: str) -> DataFrame:
    """Texts read from images: the first candidate decides, an unknown one is only unmatched."""
    key = F.col("p_partkey")
    read = F.when(key % 4 == 0, "no plate").when(key % 4 == 1, "seen ka 01 ab 1234 and KA02C0007").otherwise(F.concat(F.lit("KA"), F.lpad((key % 100).cast("string"), 2, "0"), F.lit("Z"), F.lpad(key.cast("string"), 4, "0")))
    images = f.table(spark, d, "part").select(key.alias("image"), read.alias("text"))
    c = F.col("c_custkey")
    cars = f.table(spark, d, "customer").select(c.alias("id"), F.lit(0).cast("bigint").alias("vendor_id"), F.concat(F.lit("KA"), F.lpad((c % 100).cast("string"), 2, "0"), F.lit("Z"), F.lpad(c.cast("string"), 4, "0")).alias("registration_number"))
    found = plates.recognize(images, cars, f.vendors(spark, d))
    return found.select("image", F.array_join("candidates", ",").alias("candidates"), "registration_number", F.col("vehicle.id").alias("vehicle_id"), "matched", F.col("error_code").cast("int").alias("error_code"))


@_register(r"""
, parts AS (SELECT doc_id, text, list_filter(list_transform(regexp_split_to_array(text, '\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]'), lambda x: regexp_replace(x, '^[\s\x0b\x1c-\x1f\x{85}\p{Z}]+|[\s\x0b\x1c-\x1f\x{85}\p{Z}]+$', '', 'g')), lambda x: length(x) > 0) AS ls FROM documents)
SELECT doc_id, 'REPORT' AS document_type, left(text, 10000) AS text, least(len(ls), 20)::BIGINT AS n_preview, ls[1] AS first_line FROM parts
""")
def doc_extract(spark: SparkSession, d: str) -> DataFrame:
    """What a document's extraction stores: its type, the text up to the limit, the first lines."""
    fields = text.extracted_fields(F.lit("REPORT"), F.col("text"))
    got = f.table(spark, d, "documents").select("doc_id", fields.alias("e"))
    return got.select("doc_id", "e.document_type", "e.text", F.size("e.preview_lines").cast("bigint").alias("n_preview"), F.get("e.preview_lines", F.lit(0)).alias("first_line"))


@_register(r"""
, named AS (SELECT doc_id, 'doc' || doc_id || (['.PDF', '.docx', '.Xlsx', '.txt', ''])[doc_id % 5 + 1] AS filename FROM documents)
SELECT doc_id, filename, lower(regexp_extract(filename, '[^/](\.[^./]+)$', 1)) AS suffix, lower(regexp_extract(filename, '[^/](\.[^./]+)$', 1)) IN ('.pdf', '.jpg', '.jpeg', '.png', '.webp', '.docx', '.xlsx') AS supported FROM named
""")
def doc_extension(spark: SparkSession, d: str) -> DataFrame:
    from haulframe.sources.files import supported

    kinds = F.array(*map(F.lit, (".PDF", ".docx", ".Xlsx", ".txt", "")))
    named = f.table(spark, d, "documents").select("doc_id", F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.get(kinds, (F.col("doc_id") % 5).cast("int"))).alias("filename"))
    return named.withColumns({"suffix": text.suffix(F.col("filename")), "supported": supported(F.col("filename"))})


@_register("SELECT id, vendor_id FROM (SELECT id, CASE WHEN line = 1 THEN vendor_id + 100000 ELSE vendor_id END AS vendor_id FROM deliveries) d WHERE NOT EXISTS (SELECT 1 FROM vendors v WHERE v.id = d.vendor_id)")
def fk_violations(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries whose vendor doesn't exist; the first lines are given wrong ones."""
    rows = f.deliveries(spark, d).select("id", F.when(F.col("line") == 1, F.col("vendor_id") + 100000).otherwise(F.col("vendor_id")).alias("vendor_id"))
    return validation.violations(rows, "vendor_id", f.vendors(spark, d))


@_register("""
, batch AS (SELECT id AS seq, 'PO-' || (id + CASE WHEN id % 3 = 0 THEN 0 ELSE 10000000 - id % 2 END) AS purchase_number FROM purchases),
ranked AS (SELECT b.*, p.id IS NOT NULL AS taken, row_number() OVER (PARTITION BY b.purchase_number, p.id IS NULL ORDER BY seq) AS nth FROM batch b LEFT JOIN purchases p USING (purchase_number))
SELECT seq, purchase_number, CASE WHEN taken OR nth > 1 THEN 409 END::INTEGER AS error_code FROM ranked
""")
def unique_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """A batch of new purchases: numbers that exist, and numbers that two requests want."""
    p = f.purchases(spark, d)
    key = F.col("id")
    number = F.concat(F.lit("PO-"), (key + F.when(key % 3 == 0, 0).otherwise(10000000 - key % 2)).cast("string"))
    batch = validation.add_errors(p.select(key.alias("seq"), number.alias("purchase_number")), [])
    found = validation.unique(batch, "purchase_number", p, "seq", "purchase_number already exists")
    return found.select("seq", "purchase_number", F.col("error_code").cast("int").alias("error_code"))


@_register("SELECT d.id, d.purchase_id, CASE WHEN d.line % 2 = 0 THEN p.vendor_id ELSE d.vendor_id END AS vendor_id FROM deliveries d LEFT JOIN purchases p ON p.id = d.purchase_id")
def vendor_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries without a vendor take their purchase's."""
    some = f.deliveries(spark, d).select("id", "purchase_id", F.when(F.col("line") % 2 != 0, F.col("vendor_id").cast("string")).alias("vendor_id"))
    owners = f.purchases(spark, d).select("id", F.col("vendor_id").cast("string").alias("vendor_id"))
    return changes.fill_vendor(some, owners).withColumn("vendor_id", F.col("vendor_id").cast("bigint"))


@_register("""
SELECT id, purchase_number, CASE WHEN id % 4 = 0 THEN NULL WHEN id % 4 = 1 THEN 'fast' ELSE reference END AS reference,
    CASE WHEN id % 4 = 1 THEN 'CLOSED' ELSE status END AS status, total_amount FROM purchases
""")
def patch_mask(spark: SparkSession, d: str) -> DataFrame:
    """Partial updates: set to null, set to a value, left alone; the last request for a row wins."""
    p = f.purchases(spark, d).select("id", "purchase_number", "reference", "status", "total_amount")
    first = p.where("id % 4 < 2").select("id", F.lit(1).alias("seq"), F.lit("slow").alias("reference"), F.lit(None).cast("string").alias("status"), F.array(F.lit("reference")).alias("fields"))
    nulled = p.where("id % 4 = 0").select("id", F.lit(2).alias("seq"), F.lit(None).cast("string").alias("reference"), F.lit("X").alias("status"), F.array(F.lit("reference")).alias("fields"))
    valued = p.where("id % 4 = 1").select("id", F.lit(2).alias("seq"), F.lit("fast").alias("reference"), F.lit("CLOSED").alias("status"), F.array(F.lit("reference"), F.lit("status")).alias("fields"))
    return changes.patch(p, first.union(nulled).union(valued), ["reference", "status"])


@_register("SELECT id, purchase_number FROM purchases WHERE id % 5 <> 0")
def delete_apply(spark: SparkSession, d: str) -> DataFrame:
    p = f.purchases(spark, d).select(F.col("id").cast("string").alias("id"), "purchase_number")
    gone = p.where("CAST(id AS BIGINT) % 5 = 0").select("id")
    left, _, _ = changes.delete(p, gone, "purchases", _CLOCK, "u1")
    return left.select(F.col("id").cast("bigint").alias("id"), "purchase_number")


@_register("""
SELECT id, CASE WHEN amount <= 0 THEN 'amount is too small' WHEN tax < 0 THEN 'tax_amount is too small' END AS error_message, CASE WHEN amount <= 0 OR tax < 0 THEN 422 END::INTEGER AS error_code
FROM (SELECT id, CASE WHEN id % 11 = 0 THEN 0.0 ELSE amount END AS amount, CASE WHEN id % 13 = 0 THEN -1.0 ELSE 0.0 END AS tax FROM invoices)
""")
def validate_invoice(spark: SparkSession, d: str) -> DataFrame:
    """The first failing rule of each row."""
    key = F.col("id")
    rows = f.invoices(spark, d).select("id", F.when(key % 11 == 0, 0.0).otherwise(F.col("amount")).alias("amount"), F.when(key % 13 == 0, -1.0).otherwise(0.0).alias("tax_amount"))
    return validation.add_errors(rows, validation.field_rules("invoices")).select("id", "error_message", F.col("error_code").cast("int").alias("error_code"))


def _submissions(spark: SparkSession, d: str):
    inv = f.invoices(spark, d).withColumn("id", F.col("id").cast("string"))
    asked = inv.select(F.col("id").cast("bigint").alias("seq"), F.when(F.col("id").cast("bigint") % 50 == 0, F.lit("none")).otherwise(F.col("id")).alias("invoice_id"), F.concat(F.lit("A-"), "id").alias("approval_id"))
    return inv, workflow.submit_invoices(inv, asked, _CLOCK, "u1")


@_register("""
SELECT i.id, CASE WHEN status = 'DRAFT' AND i.id % 50 <> 0 THEN 'PENDING_APPROVAL' ELSE status END AS status,
    CASE WHEN i.id % 50 = 0 THEN 404 WHEN status <> 'DRAFT' THEN 409 END::INTEGER AS error_code FROM invoices i
""")
def submit_invoice(spark: SparkSession, d: str) -> DataFrame:
    """All invoices are submitted; some requests name none. States afterwards, and the answer to each request."""
    _, (moved, _, _, answered) = _submissions(spark, d)
    answers = answered.select(F.col("seq").alias("id"), F.col("error_code").cast("int").alias("error_code"))
    return moved.select(F.col("id").cast("bigint").alias("id"), "status").join(answers, "id")


@_register("""
, logged AS (
    SELECT 'SUBMIT' AS action, 'invoices' AS resource_type, id AS resource_id, '|' || id AS request FROM invoices WHERE status = 'DRAFT' AND id % 50 <> 0
    UNION ALL SELECT 'DELETE', 'purchases', id, '' FROM purchases WHERE id % 5 = 0)
SELECT left(sha256(action || '|' || resource_type || '|' || resource_id || '|1998-06-01 00:00:00+00:00' || request), 36) AS id, '1998-06-01 00:00:00' AS created_at,
    'u1' AS actor_id, action, resource_type, resource_id, NULL::VARCHAR AS details FROM logged
""")
def audit_emit(spark: SparkSession, d: str) -> DataFrame:
    """The audit rows of a submission and of a delete batch."""
    _, (_, _, log, _) = _submissions(spark, d)
    p = f.purchases(spark, d).select(F.col("id").cast("string").alias("id"))
    _, _, deleted = changes.delete(p, p.where("CAST(id AS BIGINT) % 5 = 0"), "purchases", _CLOCK, "u1")
    both = log.unionByName(deleted)
    return both.withColumns({"resource_id": F.col("resource_id").cast("bigint"), "created_at": text.utc(F.col("created_at")).cast("string")})


@_register("""
SELECT i.id, CASE WHEN i.id % 6 = 0 THEN i.status WHEN i.id % 6 = 1 THEN 'REJECTED' WHEN i.status = 'PENDING_APPROVAL' THEN 'APPROVED' ELSE i.status END AS invoice_status,
    CASE WHEN i.id % 6 = 1 OR i.status = 'PENDING_APPROVAL' THEN CASE WHEN i.id % 6 = 1 THEN 'REJECTED' ELSE 'APPROVED' END ELSE 'APPROVED' END AS approval_status
FROM (SELECT id, status FROM invoices WHERE status = 'PENDING_APPROVAL') i
""")
def decide_approval(spark: SparkSession, d: str) -> DataFrame:
    """Pending invoices are decided; approvals of other resources leave the invoices alone."""
    inv = f.invoices(spark, d).where("status = 'PENDING_APPROVAL'").withColumn("id", F.col("id").cast("string"))
    n = F.col("id").cast("bigint")
    approvals = inv.select(F.concat(F.lit("A-"), "id").alias("id"), F.lit(_CLOCK).alias("created_at"), F.when(n % 6 == 0, "vendor").otherwise("invoice").alias("resource_type"), F.col("id").alias("resource_id"), F.lit("u1").alias("requested_by"), F.lit(None).cast("string").alias("approver_id"), F.lit("PENDING").alias("status"), F.lit(None).cast("string").alias("comment"), F.lit(None).cast("timestamp").alias("decided_at"))
    asked = inv.select(n.alias("seq"), F.concat(F.lit("A-"), "id").alias("approval_id"), F.when(n % 6 == 1, "REJECTED").otherwise("APPROVED").alias("decision"), F.lit("ok").alias("comment"))
    decided, moved, _, _ = workflow.decide(approvals, inv, asked, _CLOCK, "u2")
    states = decided.select(F.col("resource_id").cast("bigint").alias("id"), F.col("status").alias("approval_status"))
    return moved.select(F.col("id").cast("bigint").alias("id"), F.col("status").alias("invoice_status")).join(states, "id")


@_register("SELECT 'ok' AS status")
def health(spark: SparkSession, d: str) -> DataFrame:
    return views.health(spark)
