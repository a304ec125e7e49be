import pytest
from pyspark.sql import functions as F

from haulframe.functions import access, text


def values(spark, column, rows, kind="string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], f"x {kind}").select(column).collect()]


def test_registration_numbers(spark):
    assert values(spark, text.normalize_registration(F.col("x")), ["ka 01 ab-1234", "", None]) == ["KA01AB1234", "", None]
    plate = text.normalize_registration(F.col("x"))
    assert values(spark, text.registration_valid(plate), ["KA01AB1234", "KA1", "KA01ABC12345", None]) == [True, False, False, False]


def test_candidates_keep_order_and_repeats(spark):
    found = text.registration_candidates(F.col("x"))
    rows = ["ka01ab1234 then KA 02 C 0007 and ka01ab1234", "KA01\nAB1234", "xKA01AB12345", "none", "KA٠١AB١٢٣٤", None]
    assert values(spark, found, rows) == [["KA01AB1234", "KA02C0007", "KA01AB1234"], ["KA01AB1234"], ["KA01AB1234"], [], ["KAAB"], None]


@pytest.mark.parametrize("name", ["A.PDF", "x.tar.docx", "noext", ".pdf", "d.ir/noext", "d/.pdf", "a.b/c.Xlsx", "x."])
def test_suffix_is_that_of_a_path(spark, name):
    from pathlib import PurePosixPath

    expected = PurePosixPath(name).suffix.lower()
    assert values(spark, text.suffix(F.col("x")), [name]) == ["" if expected == "." else expected]


def test_lines_and_fields(spark):
    rows = ["a\n\n \tb \r\nc\x0bd\x1ee\x85f g", "", "\n\n"]
    assert values(spark, text.lines(F.col("x")), rows) == [[p.strip() for p in r.splitlines() if p.strip()] for r in rows]
    long = "\n".join(f"line {i}" for i in range(30)) + "é" * 20_000
    got = values(spark, text.extracted_fields(F.lit("INVOICE"), F.col("x")), [long])[0]
    assert got["text"] == long[:10_000]
    assert got["preview_lines"] == [f"line {i}" for i in range(20)]


def test_object_key(spark):
    key = text.object_key(F.lit("u1"), F.lit("2024-03-01 04:05:06").cast("timestamp"), F.lit("0123abcd-4567"), F.col("x"))
    assert values(spark, key, ["a.pdf"]) == ["u1/20240301040506_0123abcd_a.pdf"]


def test_roles():
    assert access.allowed("audit", "ADMIN") and not access.allowed("audit", "OPERATOR")
    assert access.allowed("read", "GUEST") and not access.allowed("read", None)
    assert access.allowed("health", None)
    with pytest.raises(PermissionError):
        access.require("write_payments", "OPERATOR")
    with pytest.raises(KeyError):
        access.allowed("unknown", "ADMIN")


def test_users(spark):
    users = spark.createDataFrame([("1", "a@x.org", "A", "h", "ADMIN", True), ("2", "b@x.org", "B", "h", "ADMIN", False)], "id string, email string, full_name string, password_hash string, role string, is_active boolean")
    assert access.active_user(users, "1").count() == 1 and access.active_user(users, "2").count() == 0
    assert access.identity(users).columns == ["id", "email", "full_name", "role"]
    assert access.login_user(users.where("id = '1'")).head()["user"].asDict() == {"id": "1", "name": "A", "role": "ADMIN"}
    assert access.registered(users).columns == ["id", "email", "role"]


@pytest.mark.parametrize("zone", ["UTC", "Asia/Kolkata", "America/New_York"])
def test_days_and_keys_are_those_of_utc(spark, zone):
    from datetime import datetime, timezone

    from haulframe.operators import kpi

    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        for now in (F.lit(datetime(2024, 3, 1, 20, tzinfo=timezone.utc)), F.lit("2024-03-01 20:00:00").cast("timestamp_ntz")):
            assert values(spark, text.object_key(F.lit("u"), now, F.lit("0123abcd"), F.col("x")), ["a"]) == ["u/20240301200000_0123abcd_a"]
            due = spark.createDataFrame([("2024-02-29",), ("2024-03-01",)], "d string").select(F.col("d").cast("date").alias("due_date"), F.lit("DRAFT").alias("status"))
            assert due.where(kpi.overdue(now)).count() == 1
            start = datetime(2024, 3, 10, 2, tzinfo=timezone.utc)  # a day of 23 hours in New York
            at = spark.createDataFrame([(1710036000 + h * 3600,) for h in (0, 23, 24)], "s bigint").select(F.timestamp_seconds("s").alias("scheduled_at"))
            assert at.where(kpi.within_a_day(F.lit(start))).count() == 2
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_totals_are_of_cents(spark):
    from haulframe.operators import kpi

    df = spark.createDataFrame([(0.005,), (0.1,), (0.2,)], "a double")
    assert df.agg(kpi.total_of("a", "t")).head()[0] == 0.31
