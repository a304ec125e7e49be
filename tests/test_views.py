from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from haulframe.operators import kpi, paging, plates, views
from haulframe.schemas import TABLES, evolve, with_defaults

NOW = datetime(2024, 5, 1, 12, 0, 0)


def frame(spark, table, rows):
    """Rows as dicts, with the table's schema; what they don't name is null."""
    schema = TABLES[table].schema
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)


@pytest.fixture(scope="module")
def world(spark):
    return {
        "vendors": frame(spark, "vendors", [{"id": "v1", "vendor_code": "A", "legal_name": "Acme", "status": "ACTIVE", "created_at": NOW}, {"id": "v2", "vendor_code": "B", "legal_name": "Bell", "status": "DRAFT", "created_at": NOW}]),
        "vehicles": frame(spark, "vehicles", [{"id": "c1", "vendor_id": "v1", "registration_number": "KA01AB1234", "status": "ACTIVE"}, {"id": "c2", "vendor_id": "gone", "registration_number": "KA02C0007", "status": "IDLE"}]),
        "drivers": frame(spark, "drivers", [{"id": "r1", "full_name": "Dee", "phone": "5"}]),
        "purchases": frame(spark, "purchases", [
            {"id": "p1", "purchase_number": "1", "vendor_id": "v1", "expected_date": date(2024, 5, 3), "created_at": datetime(2024, 1, 1), "status": "OPEN"},
            {"id": "p2", "purchase_number": "2", "vendor_id": "gone", "created_at": datetime(2024, 1, 2), "status": "OPEN"},
            {"id": "p3", "purchase_number": "3", "vendor_id": "v2", "expected_date": date(2024, 5, 3), "created_at": datetime(2024, 1, 5), "status": "DRAFT"},
        ]),
        "deliveries": frame(spark, "deliveries", [
            {"id": "d1", "delivery_number": "1", "vendor_id": "v1", "purchase_id": "p1", "vehicle_id": "c1", "driver_id": "r1", "scheduled_at": NOW, "status": "SCHEDULED"},
            {"id": "d2", "delivery_number": "2", "vendor_id": "gone", "purchase_id": "", "scheduled_at": datetime(2024, 5, 2, 12), "status": "ASSIGNED"},
            {"id": "d3", "delivery_number": "3", "vendor_id": "v2", "scheduled_at": datetime(2024, 4, 1), "status": "DELIVERED"},
            {"id": "d4", "delivery_number": "4", "vendor_id": "v2", "vehicle_id": "none", "scheduled_at": datetime(2024, 5, 2, 11, 59), "status": "IN_TRANSIT"},
        ]),
        "invoices": frame(spark, "invoices", [
            {"id": "i1", "amount": 10.0, "due_date": date(2024, 4, 30), "status": "PENDING"}, {"id": "i2", "amount": 20.0, "due_date": date(2024, 5, 1), "status": "DRAFT"},
            {"id": "i3", "amount": 30.0, "due_date": date(2024, 1, 1), "status": "PAID"}, {"id": "i4", "amount": 40.5, "due_date": date(2024, 1, 1), "status": "REJECTED"}, {"id": "i5", "amount": 1.0, "status": "APPROVED"},
        ]),
        "documents": frame(spark, "documents", [{"id": "x1", "status": "REVIEW_REQUIRED"}, {"id": "x2", "status": "UPLOADED"}]),
        "payments": frame(spark, "payments", []),
        "approvals": frame(spark, "approvals", [{"id": "a1", "status": "PENDING", "created_at": NOW}, {"id": "a2", "status": "APPROVED", "created_at": datetime(2024, 6, 1)}]),
    }


def lookups(w):
    return w["vendors"], w["purchases"], w["vehicles"], w["drivers"]


def test_delivery_view_keeps_every_row(world):
    rows = {r["id"]: r for r in views.deliveries(world["deliveries"], *lookups(world)).collect()}
    assert len(rows) == 4
    assert (rows["d1"]["vendor_name"], rows["d1"]["purchase_number"], rows["d1"]["vehicle_number"], rows["d1"]["driver_name"], rows["d1"]["driver_phone"]) == ("Acme", "1", "KA01AB1234", "Dee", "5")
    assert rows["d2"]["vendor_name"] is None and rows["d2"]["purchase_number"] is None
    assert rows["d4"]["vehicle_number"] is None and rows["d4"]["vehicle_id"] == "none"
    assert len(views.deliveries(world["deliveries"], *lookups(world)).columns) == 17


def test_delivery_page(world):
    page, total = views.delivery_page(world["deliveries"], *lookups(world), status="assigned")
    assert [r["id"] for r in page.collect()] == ["d2"] and total.head()["total"] == 1
    page, total = views.delivery_page(world["deliveries"], *lookups(world), status="", limit=2, offset=1)
    assert [r["id"] for r in page.collect()] == ["d1", "d4"] and total.head()["total"] == 4


def test_purchase_page_puts_dateless_ones_last(world):
    page, total = views.purchase_page(world["purchases"], world["vendors"])
    assert [(r["id"], r["vendor_name"]) for r in page.collect()] == [("p3", "Bell"), ("p1", "Acme"), ("p2", None)]
    assert total.head()[0] == 3


@pytest.mark.parametrize("limit, offset", [(-1, 0), (0, -1), (201, 0)])
def test_page_bounds(world, limit, offset):
    with pytest.raises(ValueError):
        paging.page(world["vendors"], [F.asc("id")], limit, offset)


def test_pages_are_a_partition(spark):
    df = spark.range(57).select("id", (F.col("id") % 3).alias("created_at"))
    whole = [r["id"] for r in df.orderBy(*paging.newest(df)).collect()]
    assert [r["id"] for o in range(0, 60, 10) for r in paging.page(df, paging.newest(df), 10, o).collect()] == whole


def test_other_lists(spark, world):
    assert "created_at" not in views.vendor_page(world["vendors"]).columns
    assert [r["id"] for r in views.newest_all(world["approvals"]).collect()] == ["a2", "a1"]
    assert views.newest_page(world["payments"])[1].head()[0] == 0
    users = frame(spark, "users", [{"id": "2", "full_name": "B", "password_hash": "x"}, {"id": "1", "full_name": "A", "password_hash": "x"}])
    roster = views.roster(users)
    assert [r["id"] for r in roster.collect()] == ["1", "2"] and "password_hash" not in roster.columns
    assert views.audit_page(frame(spark, "audit_logs", [{"id": "1"}]), 500).count() == 1
    with pytest.raises(ValueError):
        views.audit_page(frame(spark, "audit_logs", []), 501)
    assert paging.any_row(world["payments"]).isEmpty() and not paging.any_row(world["vendors"]).isEmpty()
    assert views.health(spark).head()[0] == "ok"


def test_dashboard(world):
    got = kpi.dashboard(world["vendors"], world["invoices"], world["deliveries"], world["documents"], world["purchases"], world["vehicles"], world["drivers"], NOW).head()
    assert {k: got[k] for k in got.asDict() if k != "upcoming_deliveries"} == {"vendors": 2, "active_vendors": 1, "pending_invoices": 2, "overdue_invoices": 2, "deliveries_today": 2, "active_deliveries": 3, "documents_for_review": 1}
    assert [x["id"] for x in got["upcoming_deliveries"]] == ["d1", "d4", "d2"]


def test_summary_of_nothing_is_zero(world):
    got = kpi.summary(world["vendors"], world["vehicles"], world["approvals"], world["invoices"], world["payments"]).head().asDict()
    assert got == {"vendors": 2, "active_vehicles": 1, "pending_approvals": 1, "invoice_total": 101.5, "paid_total": 0.0}


def test_plates(spark, world):
    asked = spark.createDataFrame([("ka-01 ab 1234",), ("ka 02 c 0007",), ("KA99Z9999",), ("x",), (None,)], "registration_number string")
    got = [(r["registration_number"], r["vehicle"] and r["vehicle"]["id"], r["vendor"] and r["vendor"]["legal_name"], r["error_code"]) for r in plates.look_up(asked, world["vehicles"], world["vendors"]).collect()]
    assert sorted(got, key=str) == sorted([("KA01AB1234", "c1", "Acme", None), ("KA02C0007", "c2", None, None), ("KA99Z9999", None, None, 404), ("X", None, None, 422), (None, None, None, 422)], key=str)
    images = spark.createDataFrame([(1, "see KA01AB1234", "image/png"), (2, "KA99Z9999", "image/png"), (3, None, "image/png"), (4, "KA01AB1234", "text/plain")], "n int, text string, kind string")
    got = {r["n"]: (r["registration_number"], r["matched"], r["error_code"], r["candidates"]) for r in plates.recognize(images, world["vehicles"], world["vendors"], content_type="kind").collect()}
    assert got[1] == ("KA01AB1234", True, None, ["KA01AB1234"]) and got[2][1:3] == (False, None) and got[3][2] == 422 and got[4][2] == 415


def test_schema_evolution(spark):
    old = spark.createDataFrame([("d", "x")], "id string, unknown string")
    new = evolve(old, TABLES["deliveries"])
    assert new.schema == TABLES["deliveries"].schema and new.head()["recipient"] is None
    assert with_defaults(spark.createDataFrame([(None,), ("X",)], "status string"), TABLES["vendors"]).collect() == [("DRAFT",), ("X",)]
