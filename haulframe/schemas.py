"""The eleven tables: types, defaults, keys and references. Spark enforces none of the constraints; see operators.validation."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Table:
    name: str
    columns: str  # DDL of the columns after id and created_at
    defaults: dict[str, object] = field(default_factory=dict)
    unique: tuple[str, ...] = ()
    references: dict[str, str] = field(default_factory=dict)  # column: table whose id it holds
    required: tuple[str, ...] = ()

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(f"id string, created_at timestamp, {self.columns}")


TABLES = {
    t.name: t
    for t in (
        Table("users", "email string, full_name string, password_hash string, role string, is_active boolean", {"role": "OPERATOR", "is_active": True}, ("email",), {}, ("email", "full_name", "password_hash")),
        Table("vendors", "vendor_code string, legal_name string, gstin string, category string, status string, phone string, email string, address string, bank_details string", {"status": "DRAFT"}, ("vendor_code", "gstin"), {}, ("vendor_code", "legal_name", "status")),
        Table("vehicles", "vendor_id string, registration_number string, vehicle_type string, make string, model string, rc_expiry date, insurance_expiry date, status string", {"status": "ACTIVE"}, ("registration_number",), {"vendor_id": "vendors"}, ("vendor_id", "registration_number", "vehicle_type", "status")),
        Table("drivers", "vendor_id string, vehicle_id string, full_name string, phone string, license_number string, license_expiry date, status string", {"status": "ACTIVE"}, ("license_number",), {"vendor_id": "vendors", "vehicle_id": "vehicles"}, ("vendor_id", "full_name", "phone", "license_number", "status")),
        Table("invoices", "vendor_id string, invoice_number string, invoice_date date, due_date date, amount double, tax_amount double, status string, document_id string", {"tax_amount": 0.0, "status": "DRAFT"}, ("invoice_number",), {"vendor_id": "vendors", "document_id": "documents"}, ("vendor_id", "invoice_number", "invoice_date", "amount", "tax_amount", "status")),
        Table("purchases", "purchase_number string, vendor_id string, reference string, quantity double, total_amount double, expected_date date, status string, notes string", {"quantity": 0.0, "total_amount": 0.0, "status": "DRAFT"}, ("purchase_number",), {"vendor_id": "vendors"}, ("purchase_number", "vendor_id", "quantity", "total_amount", "status")),
        Table("deliveries", "delivery_number string, vendor_id string, purchase_id string, vehicle_id string, driver_id string, destination string, recipient string, scheduled_at timestamp, status string, notes string", {"status": "SCHEDULED"}, ("delivery_number",), {"vendor_id": "vendors", "purchase_id": "purchases", "vehicle_id": "vehicles", "driver_id": "drivers"}, ("delivery_number", "vendor_id", "destination", "scheduled_at", "status")),
        Table("payments", "invoice_id string, amount double, paid_on date, reference string, status string", {"status": "PENDING"}, ("reference",), {"invoice_id": "invoices"}, ("invoice_id", "amount", "paid_on", "reference", "status")),
        Table("approvals", "resource_type string, resource_id string, requested_by string, approver_id string, status string, comment string, decided_at timestamp", {"status": "PENDING"}, (), {"requested_by": "users", "approver_id": "users"}, ("resource_type", "resource_id", "requested_by", "status")),
        Table("documents", "filename string, object_key string, content_type string, document_type string, status string, owner_id string, extracted_fields string, review_confirmed_at timestamp", {"status": "UPLOADED"}, ("object_key",), {"owner_id": "users"}, ("filename", "object_key", "content_type", "document_type", "status", "owner_id")),
        Table("audit_logs", "actor_id string, action string, resource_type string, resource_id string, details string", {}, (), {}, ("action", "resource_type", "resource_id")),
    )
}


def evolve(df: DataFrame, table: Table) -> DataFrame:
    """df with the table's columns: those it lacks are null, those the table doesn't know go."""
    have = {c.lower() for c in df.columns}
    return df.select(*((F.col(f.name) if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in table.schema))


def with_defaults(df: DataFrame, table: Table) -> DataFrame:
    """Absent or null columns that have a default get it."""
    have = {c.lower() for c in df.columns}
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in have else F.lit(v) for c, v in table.defaults.items()})
