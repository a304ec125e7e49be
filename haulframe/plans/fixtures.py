"""The library's tables played by the synthetic ones, with what these lack (nulls, dangling keys) made in the query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haulframe.schemas import TABLES, evolve

#: The clock of all registered queries.
NOW = "1998-06-01 00:00:00"


def now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.col("s_suppkey").alias("id"), _text("V", F.col("s_suppkey")).alias("vendor_code"), F.col("s_name").alias("legal_name"), F.col("s_nationkey").alias("category"),
        F.when(F.col("s_acctbal") >= 0, "ACTIVE").otherwise("DRAFT").alias("status"), F.col("s_acctbal").alias("balance"),
    )


def vendor_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vendors with all columns of their table, ids as text."""
    made = vendors(spark, sf_dir).withColumns({"created_at": F.timestamp_seconds(F.col("id") % 97 * 86400), "gstin": _text("G", F.col("id")), "category": F.col("category").cast("string"), "id": F.col("id").cast("string")})
    return evolve(made, TABLES["vendors"])


def user_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    made = c.select(
        key.cast("string").alias("id"), _text("u", key, "@example.org").alias("email"), F.col("c_name").alias("full_name"), F.sha2("c_name", 256).alias("password_hash"),
        F.when(F.col("c_nationkey") % 5 == 0, "ADMIN").otherwise("OPERATOR").alias("role"), (F.col("c_acctbal") >= 0).alias("is_active"),
    )
    return evolve(made, TABLES["users"])


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    return o.select(
        key.alias("id"), _text("PO-", key).alias("purchase_number"), (key % 120).alias("vendor_id"), F.col("o_orderpriority").alias("reference"), F.lit(1.0).alias("quantity"),
        F.col("o_totalprice").alias("total_amount"), F.when(key % 7 != 0, F.col("o_orderdate")).alias("expected_date"), F.col("o_orderstatus").alias("status"),
        F.lit(None).cast("string").alias("notes"), F.col("o_orderdate").alias("created_at"),
    )


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    return o.select(
        key.alias("id"), _text("INV-", key).alias("invoice_number"), F.when(key % 7 != 0, F.to_date("o_orderdate")).alias("due_date"), F.col("o_totalprice").alias("amount"),
        F.when(status == "O", "DRAFT").when(status == "P", "PENDING_APPROVAL").otherwise("PAID").alias("status"), F.col("o_orderdate").alias("created_at"), F.col("o_custkey").alias("requested_by"),
    )


def vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("id"), (F.col("p_partkey") % 150).alias("vendor_id"), _text("KA", F.lpad(F.col("p_partkey").cast("string"), 8, "0")).alias("registration_number"),
        F.when(F.col("p_size") > 25, "ACTIVE").otherwise("IDLE").alias("status"),
    )


def drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("full_name"), F.col("c_mktsegment").alias("phone"))


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("bigint"))
    return li.select(
        key.alias("id"), _text("D-", F.col("l_orderkey"), "-", F.col("l_linenumber")).alias("delivery_number"), F.col("l_suppkey").alias("vendor_id"), F.col("l_orderkey").alias("purchase_id"),
        F.when(F.col("l_linenumber") != 1, F.col("l_partkey")).alias("vehicle_id"), (F.col("l_orderkey") % 1600).alias("driver_id"), F.col("l_returnflag").alias("destination"),
        F.lit(None).cast("string").alias("recipient"), F.col("l_shipdate").alias("scheduled_at"), F.when(F.col("l_linestatus") == "O", "SCHEDULED").otherwise("DELIVERED").alias("status"),
        F.lit(None).cast("string").alias("notes"), F.col("l_shipdate").alias("created_at"), F.col("l_extendedprice").alias("amount"), F.col("l_quantity").alias("quantity"), F.col("l_linenumber").alias("line"),
    )


#: The same tables for the SQL of the registered queries.
SQL = f"""
vendors AS (
    SELECT s_suppkey AS id, 'V' || s_suppkey AS vendor_code, s_name AS legal_name, s_nationkey AS category,
        CASE WHEN s_acctbal >= 0 THEN 'ACTIVE' ELSE 'DRAFT' END AS status, s_acctbal AS balance FROM supplier),
purchases AS (
    SELECT o_orderkey AS id, 'PO-' || o_orderkey AS purchase_number, o_orderkey % 120 AS vendor_id, o_orderpriority AS reference, 1.0::DOUBLE AS quantity,
        o_totalprice AS total_amount, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate END AS expected_date, o_orderstatus AS status,
        NULL::VARCHAR AS notes, o_orderdate AS created_at FROM orders),
invoices AS (
    SELECT o_orderkey AS id, 'INV-' || o_orderkey AS invoice_number, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate::DATE END AS due_date, o_totalprice AS amount,
        CASE o_orderstatus WHEN 'O' THEN 'DRAFT' WHEN 'P' THEN 'PENDING_APPROVAL' ELSE 'PAID' END AS status, o_orderdate AS created_at, o_custkey AS requested_by FROM orders),
vehicles AS (
    SELECT p_partkey AS id, p_partkey % 150 AS vendor_id, 'KA' || lpad(p_partkey::VARCHAR, 8, '0') AS registration_number,
        CASE WHEN p_size > 25 THEN 'ACTIVE' ELSE 'IDLE' END AS status FROM part),
drivers AS (SELECT c_custkey AS id, c_name AS full_name, c_mktsegment AS phone FROM customer),
deliveries AS (
    SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * 100)::BIGINT) AS id, 'D-' || l_orderkey || '-' || l_linenumber AS delivery_number,
        l_suppkey AS vendor_id, l_orderkey AS purchase_id, CASE WHEN l_linenumber <> 1 THEN l_partkey END AS vehicle_id, l_orderkey % 1600 AS driver_id, l_returnflag AS destination,
        NULL::VARCHAR AS recipient, l_shipdate AS scheduled_at, CASE WHEN l_linestatus = 'O' THEN 'SCHEDULED' ELSE 'DELIVERED' END AS status,
        NULL::VARCHAR AS notes, l_shipdate AS created_at, l_extendedprice AS amount, l_quantity AS quantity, l_linenumber AS line FROM lineitem),
clock AS (SELECT TIMESTAMP '{NOW}' AS now)
"""
