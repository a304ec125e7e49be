from datetime import date, datetime, timezone

import pytest
from test_views import frame

from haulframe.operators import changes, validation, workflow
from haulframe.schemas import TABLES
from pyspark.sql import functions as F

NOW = datetime(2024, 5, 1, tzinfo=timezone.utc)


def codes(df, key="seq"):
    return {r[key]: r["error_code"] for r in df.collect()}


def batch(spark, table, rows):
    names = list(dict.fromkeys(k for r in rows for k in r))
    kinds = {f.name: f.dataType.simpleString() for f in TABLES[table].schema} | {"seq": "int", "fields": "array<string>"}
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ", ".join(f"{n} {kinds[n]}" for n in names))


def test_create_vendors(spark):
    existing = frame(spark, "vendors", [{"id": "v1", "vendor_code": "AA", "legal_name": "Acme", "gstin": "G1", "status": "ACTIVE"}])
    asked = batch(spark, "vendors", [
        {"seq": 1, "id": "n1", "vendor_code": "AA", "legal_name": "Twice"}, {"seq": 2, "id": "n2", "vendor_code": "BB", "legal_name": "Fine", "email": "a@b.org"},
        {"seq": 3, "id": "n3", "vendor_code": "BB", "legal_name": "Late"}, {"seq": 4, "id": "n4", "vendor_code": "C", "legal_name": "Short code"},
        {"seq": 5, "id": "n5", "vendor_code": "DD", "legal_name": "Bad mail", "email": "nobody"}, {"seq": 6, "id": "n6", "vendor_code": "EE", "legal_name": "Taken tax id", "gstin": "G1"},
        {"seq": 7, "id": "n7", "vendor_code": "FF", "legal_name": None}, {"seq": 8, "id": "n8", "vendor_code": "GG", "legal_name": "Also fine"},
    ])
    rows, rejected, log = changes.create(asked, existing, "vendors", NOW, "u")
    assert sorted((r["id"], r["status"]) for r in rows.collect()) == [("n2", "DRAFT"), ("n8", "DRAFT")]
    assert codes(rejected) == {1: 409, 3: 409, 4: 422, 5: 422, 6: 409, 7: 422}
    assert [(r["action"], r["resource_type"], r["actor_id"]) for r in log.collect()] == [("CREATE", "vendors", "u")] * 2
    assert rows.schema.simpleString() == TABLES["vendors"].schema.simpleString() and log.schema.simpleString() == TABLES["audit_logs"].schema.simpleString()


def test_a_rejected_request_takes_no_key(spark):
    asked = batch(spark, "purchases", [{"seq": 1, "id": "a", "purchase_number": "1", "vendor_id": "v", "quantity": -1.0}, {"seq": 2, "id": "b", "purchase_number": "1", "vendor_id": "v"}])
    rows, rejected, _ = changes.create(asked, frame(spark, "purchases", []), "purchases", NOW, None)
    assert [r["id"] for r in rows.collect()] == ["b"] and codes(rejected) == {1: 422}


def test_create_vehicles_normalizes_plates(spark):
    asked = batch(spark, "vehicles", [{"seq": 1, "id": "a", "vendor_id": "v", "vehicle_type": "T", "registration_number": "ka-01 ab 1234"}, {"seq": 2, "id": "b", "vendor_id": "v", "vehicle_type": "T", "registration_number": "ka1"}])
    rows, rejected, _ = changes.create(asked, frame(spark, "vehicles", []), "vehicles", NOW, None)
    assert [r["registration_number"] for r in rows.collect()] == ["KA01AB1234"] and codes(rejected) == {2: 422}


def test_create_invoices_and_payments(spark):
    one = {"vendor_id": "v", "invoice_date": date(2024, 1, 1)}
    asked = batch(spark, "invoices", [{"seq": 1, "id": "a", "invoice_number": "1", "amount": 0.0, **one}, {"seq": 2, "id": "b", "invoice_number": "2", "amount": 1.0, "tax_amount": -1.0, **one}, {"seq": 3, "id": "c", "invoice_number": "3", "amount": 1.0, **one}, {"seq": 4, "id": "d", "invoice_number": "4", "amount": float("nan"), **one}])
    rows, rejected, _ = changes.create(asked, frame(spark, "invoices", []), "invoices", NOW, None)
    assert [(r["id"], r["tax_amount"], r["status"]) for r in rows.collect()] == [("c", 0.0, "DRAFT")] and codes(rejected) == {1: 422, 2: 422, 4: 422}


def test_create_users_leaves_no_audit(spark):
    asked = batch(spark, "users", [{"seq": 1, "id": "a", "email": "a@b.org", "full_name": "Ann", "password_hash": "h"}, {"seq": 2, "id": "b", "email": "a@b.org", "full_name": "Bob", "password_hash": "h"}])
    rows, rejected, log = changes.create(asked, frame(spark, "users", []), "users", NOW, None)
    assert [(r["role"], r["is_active"]) for r in rows.collect()] == [("OPERATOR", True)] and codes(rejected) == {2: 409} and log.isEmpty()


def test_create_purchases_and_deliveries(spark):
    vendors = frame(spark, "vendors", [{"id": "v1"}])
    purchases = frame(spark, "purchases", [{"id": "p1", "purchase_number": "1", "vendor_id": "v1"}])
    asked = batch(spark, "purchases", [{"seq": 1, "id": "a", "purchase_number": "1", "vendor_id": "none"}, {"seq": 2, "id": "b", "purchase_number": "2", "vendor_id": "none"}, {"seq": 3, "id": "c", "purchase_number": "3", "vendor_id": "v1", "status": "open"}])
    rows, rejected, _ = changes.create_purchases(asked, purchases, vendors, NOW, None)
    assert [(r["id"], r["status"], r["quantity"]) for r in rows.collect()] == [("c", "OPEN", 0.0)] and codes(rejected) == {1: 409, 2: 422}
    at = datetime(2024, 1, 1)
    asked = batch(spark, "deliveries", [
        {"seq": 1, "id": "a", "delivery_number": "1", "destination": "x", "scheduled_at": at, "vendor_id": None, "purchase_id": "p1"}, {"seq": 2, "id": "b", "delivery_number": "2", "destination": "x", "scheduled_at": at, "vendor_id": "", "purchase_id": "p1"},
        {"seq": 3, "id": "c", "delivery_number": "3", "destination": "x", "scheduled_at": at}, {"seq": 4, "id": "d", "delivery_number": "4", "destination": "", "scheduled_at": at, "vendor_id": "v1"},
        {"seq": 5, "id": "e", "delivery_number": "5", "destination": "x", "scheduled_at": at, "vendor_id": "v1", "vehicle_id": "none", "status": "assigned"},
    ])
    rows, rejected, _ = changes.create_deliveries(asked, frame(spark, "deliveries", []), purchases, vendors, NOW, None)
    assert sorted((r["id"], r["vendor_id"], r["status"]) for r in rows.collect()) == [("a", "v1", "SCHEDULED"), ("b", "v1", "SCHEDULED"), ("e", "v1", "ASSIGNED")]
    assert codes(rejected) == {3: 422, 4: 422}


def test_patch_sets_null_and_keeps_unset(spark):
    base = frame(spark, "vendors", [{"id": "1", "legal_name": "A", "phone": "1"}, {"id": "2", "legal_name": "B", "phone": "2"}, {"id": "3", "legal_name": "C", "phone": "3"}])
    asked = batch(spark, "vendors", [{"seq": 1, "id": "1", "fields": ["phone"], "phone": None, "legal_name": "ignored"}, {"seq": 2, "id": "2", "fields": ["phone"], "phone": "8"}, {"seq": 3, "id": "2", "fields": ["phone", "legal_name"], "phone": "9", "legal_name": "Z"}])
    got = {r["id"]: (r["legal_name"], r["phone"]) for r in changes.patch(base, asked, ["legal_name", "phone"]).collect()}
    assert got == {"1": ("A", None), "2": ("Z", "9"), "3": ("C", "3")}
    assert changes.patch(base, asked.withColumn("fields", F.array().cast("array<string>")), ["phone"]).exceptAll(base).isEmpty()


def test_update_vendors(spark):
    base = frame(spark, "vendors", [{"id": "1", "vendor_code": "A1", "legal_name": "Aa", "gstin": "G1", "status": "DRAFT"}, {"id": "2", "vendor_code": "B1", "legal_name": "Bb", "gstin": "G2", "status": "DRAFT"}])
    asked = batch(spark, "vendors", [
        {"seq": 1, "id": "1", "fields": ["gstin"], "gstin": "G2"}, {"seq": 2, "id": "1", "fields": ["gstin", "status"], "gstin": "G1", "status": "ACTIVE"}, {"seq": 3, "id": "9", "fields": ["status"], "status": "X"},
        {"seq": 4, "id": "2", "fields": ["legal_name"], "legal_name": "B"}, {"seq": 5, "id": "2", "fields": ["status"], "status": None}, {"seq": 6, "id": "2", "fields": ["vendor_code"], "status": None},
    ])
    rows, rejected, log = changes.update(base, asked, "vendors", NOW, "u")
    assert {r["id"]: (r["gstin"], r["status"], r["vendor_code"]) for r in rows.collect()} == {"1": ("G1", "ACTIVE", "A1"), "2": ("G2", "DRAFT", "B1")}
    assert codes(rejected) == {1: 409, 3: 404, 4: 422, 5: 422}
    assert sorted(r["details"] for r in log.collect()) == ['{"fields":["gstin","status"]}', '{"fields":[]}']


def test_update_deliveries_takes_the_purchases_vendor(spark):
    vendors, drivers = frame(spark, "vendors", [{"id": "v1"}, {"id": "v2"}]), frame(spark, "drivers", [{"id": "r1"}])
    purchases = frame(spark, "purchases", [{"id": "p1", "vendor_id": "v1"}])
    base = frame(spark, "deliveries", [{"id": str(i), "delivery_number": str(i), "vendor_id": "v2", "status": "SCHEDULED"} for i in range(5)])
    asked = batch(spark, "deliveries", [
        {"seq": 1, "id": "0", "fields": ["purchase_id", "vendor_id"], "purchase_id": "p1", "vendor_id": "v2"}, {"seq": 2, "id": "1", "fields": ["purchase_id"], "purchase_id": "none"},
        {"seq": 3, "id": "2", "fields": ["driver_id"], "driver_id": "none"}, {"seq": 4, "id": "3", "fields": ["vehicle_id", "status"], "vehicle_id": "none", "status": "assigned"},
        {"seq": 5, "id": "4", "fields": ["vendor_id"], "vendor_id": "none"},
    ])
    rows, rejected, log = changes.update(base, asked, "deliveries", NOW, "u", vendors, purchases, drivers)
    got = {r["id"]: (r["vendor_id"], r["purchase_id"], r["vehicle_id"], r["status"]) for r in rows.collect()}
    assert got["0"] == ("v1", "p1", None, "SCHEDULED") and got["3"] == ("v2", None, "none", "ASSIGNED")
    assert codes(rejected) == {2: 422, 3: 422, 5: 422}
    assert [r["details"] for r in log.collect()] == [None, None]


def test_delete(spark):
    base = frame(spark, "vendors", [{"id": "1"}, {"id": "2"}])
    left, missing, log = changes.delete(base, spark.createDataFrame([("1",), ("1",), ("9",)], "id string"), "vendors", NOW, "u")
    assert [r["id"] for r in left.collect()] == ["2"] and [r["id"] for r in missing.collect()] == ["9"]
    assert [(r["action"], r["resource_id"]) for r in log.collect()] == [("DELETE", "1")]


@pytest.mark.parametrize("address, good", [("a@b.org", True), ("a.b+c@d-e.co.uk", True), ("a@b", False), ("@b.org", False), ("a@@b.org", False), ("a..b@c.org", False), (None, True)])
def test_email(spark, address, good):
    df = spark.createDataFrame([(address,)], "email string")
    assert validation.add_errors(df, [validation.email("email")]).head()["error_code"] == (None if good else 422)


def test_submit(spark):
    invoices = frame(spark, "invoices", [{"id": "1", "status": "DRAFT"}, {"id": "2", "status": "PAID"}])
    asked = spark.createDataFrame([(1, "1", "a1"), (2, "1", "a2"), (3, "2", "a3"), (4, "9", "a4")], "seq int, invoice_id string, approval_id string")
    moved, approvals, log, answered = workflow.submit_invoices(invoices, asked, NOW, "u")
    assert {r["id"]: r["status"] for r in moved.collect()} == {"1": "PENDING_APPROVAL", "2": "PAID"}
    assert [(r["id"], r["resource_id"], r["status"], r["requested_by"]) for r in approvals.collect()] == [("a1", "1", "PENDING", "u")]
    assert codes(answered) == {1: None, 2: 409, 3: 409, 4: 404}
    assert [(r["action"], r["resource_id"]) for r in log.collect()] == [("SUBMIT", "1")]


def test_decide(spark):
    approvals = frame(spark, "approvals", [{"id": "a", "resource_type": "invoice", "resource_id": "1", "status": "PENDING"}, {"id": "b", "resource_type": "vendor", "resource_id": "1", "status": "PENDING"}, {"id": "c", "resource_type": "invoice", "resource_id": "gone", "status": "PENDING"}, {"id": "d", "resource_type": "invoice", "resource_id": "2", "status": "REJECTED"}])
    invoices = frame(spark, "invoices", [{"id": "1", "status": "PENDING_APPROVAL"}, {"id": "2", "status": "REJECTED"}])
    asked = spark.createDataFrame([(1, "a", "APPROVED", "ok"), (2, "a", "REJECTED", None), (3, "b", "REJECTED", None), (4, "c", "APPROVED", None), (5, "d", "APPROVED", None), (6, "z", "APPROVED", None), (7, "c", "MAYBE", None)], "seq int, approval_id string, decision string, comment string")
    decided, moved, log, answered = workflow.decide(approvals, invoices, asked, NOW, "u")
    assert {r["id"]: (r["status"], r["approver_id"]) for r in decided.collect()} == {"a": ("APPROVED", "u"), "b": ("REJECTED", "u"), "c": ("APPROVED", "u"), "d": ("REJECTED", None)}
    assert {r["id"]: r["status"] for r in moved.collect()} == {"1": "APPROVED", "2": "REJECTED"}
    assert [(r["action"], r["resource_id"]) for r in log.collect()] == [("APPROVED", "1")]
    assert codes(answered) == {1: None, 2: 409, 3: None, 4: None, 5: 409, 6: 404, 7: 422}


def test_documents_flow(spark):
    docs = frame(spark, "documents", [{"id": "1", "document_type": "INVOICE", "status": "UPLOADED"}, {"id": "2", "document_type": "INVOICE", "status": "UPLOADED"}, {"id": "3", "status": "UPLOADED"}])
    texts = spark.createDataFrame([("1", "a\n\nb", None), ("2", None, "ValueError: no")], "id string, text string, error string")
    moved, quarantine = workflow.record_extraction(docs, texts)
    got = {r["id"]: (r["status"], r["extracted_fields"]) for r in moved.collect()}
    assert got["1"] == ("REVIEW_REQUIRED", '{"document_type":"INVOICE","text":"a\\n\\nb","preview_lines":["a","b"]}') and got["2"] == ("UPLOADED", None)
    assert [(r["id"], r["error"]) for r in quarantine.collect()] == [("2", "ValueError: no")]
    reviews = spark.createDataFrame([(1, "1", "{}"), (2, "1", '{"a":1}'), (3, "9", "{}")], "seq int, id string, fields string")
    moved, log, missing = workflow.confirm(moved, reviews, NOW, "u")
    assert {r["id"]: (r["status"], r["extracted_fields"]) for r in moved.collect()}["1"] == ("CONFIRMED", '{"a":1}')
    assert log.count() == 1 and codes(missing) == {3: 404}


def test_upload(spark):
    asked = spark.createDataFrame([(1, "a", "A.PDF", "application/pdf", "invoice", "0123abcd-9"), (2, "b", "x.exe", "x", "invoice", "t"), (3, "c", None, "x", "invoice", "t"), (4, "d", "noext", "x", "invoice", "t")], "seq int, id string, filename string, content_type string, document_type string, token string")
    rows, rejected, log = changes.upload_documents(asked, frame(spark, "documents", []), NOW, "u")
    got = rows.collect()
    assert [(r["id"], r["document_type"], r["status"], r["owner_id"], r["object_key"]) for r in got] == [("a", "INVOICE", "UPLOADED", "u", "u/20240501000000_0123abcd_A.PDF")]
    assert codes(rejected) == {2: 415, 3: 415, 4: 415} and [(r["action"], r["resource_id"]) for r in log.collect()] == [("UPLOAD", "a")]


def test_expiring(spark):
    from haulframe.operators import compliance

    cars = frame(spark, "vehicles", [{"id": "1", "rc_expiry": date(2024, 5, 10), "insurance_expiry": date(2024, 4, 1)}, {"id": "2", "rc_expiry": date(2025, 1, 1)}])
    people = frame(spark, "drivers", [{"id": "3", "license_expiry": date(2024, 5, 1)}, {"id": "4"}])
    got = sorted((r["resource_id"], r["paper"], r["days_left"]) for r in compliance.expiring(cars, people, F.lit("2024-05-01").cast("date"), 30).collect())
    assert got == [("1", "insurance_expiry", -30), ("1", "rc_expiry", 9), ("3", "license_expiry", 0)]


def test_a_repeated_patch_is_no_conflict_and_each_has_its_audit_row(spark):
    base = frame(spark, "vendors", [{"id": "1", "vendor_code": "A1", "legal_name": "Aa", "gstin": "G1", "status": "DRAFT"}, {"id": "2", "vendor_code": "B1", "legal_name": "Bb", "gstin": "G2", "status": "DRAFT"}])
    asked = batch(spark, "vendors", [
        {"seq": 1, "id": "1", "fields": ["gstin"], "gstin": "G3"}, {"seq": 2, "id": "1", "fields": ["gstin"], "gstin": "G3"}, {"seq": 3, "id": "2", "fields": ["gstin"], "gstin": "G3"},
        {"seq": 4, "id": "2", "fields": ["gstin"], "gstin": "G1"},
    ])
    rows, rejected, log = changes.update(base, asked, "vendors", NOW, "u")
    assert {r["id"]: r["gstin"] for r in rows.collect()} == {"1": "G3", "2": "G2"} and codes(rejected) == {3: 409, 4: 409}
    assert len({r["id"] for r in log.collect()}) == 2
    again, none, _ = changes.update(rows, asked.where("seq < 3"), "vendors", NOW, "u")
    assert none.isEmpty() and again.where("gstin = 'G3'").count() == 1


def test_login_needs_a_long_password(spark):
    df = spark.createDataFrame([(1, "a@b.org", "1234567"), (2, "a@b.org", "12345678"), (3, "nobody", "12345678"), (4, "a@b.org", None)], "seq int, email string, password string")
    assert codes(validation.add_errors(df, validation.field_rules("login"))) == {1: 422, 2: None, 3: 422, 4: 422}
