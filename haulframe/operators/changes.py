"""Creates, partial updates and deletes of whole batches, with their audit rows.

Every function takes a snapshot and a batch and gives back frames; nothing is written. A batch has a
column ``seq`` that orders its requests, and new rows bring their ``id`` (drawn by the caller, so a
retried task can't draw another one). Requests are checked against the snapshot and the earlier requests
of the batch that have no error of their own, and of several for one row each field's last one counts;
a unique value that the snapshot holds is free for others from the next batch on.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulframe.functions import text
from haulframe.functions.text import UPLOADS
from haulframe.operators import validation as v
from haulframe.schemas import TABLES, evolve, with_defaults


def audit(rows: DataFrame, actor: str | None, action: str, resource: str, now: datetime, resource_id: str = "id", fields: str | None = None) -> DataFrame:
    """An audit row for each row; details name the changed fields where a column has them."""
    details = F.to_json(F.struct(F.col(fields).alias("fields"))) if fields else F.lit(None).cast("string")
    # several requests of a batch may be about one row
    request = [F.col("seq").cast("string")] if "seq" in rows.columns else []
    made = rows.select(
        F.sha2(F.concat_ws("|", F.lit(action), F.lit(resource), F.col(resource_id), F.lit(str(now)), *request), 256).substr(1, 36).alias("id"),
        F.lit(now).alias("created_at"), F.lit(actor).alias("actor_id"), F.lit(action).alias("action"), F.lit(resource).alias("resource_type"), F.col(resource_id).alias("resource_id"), details.alias("details"),
    )
    return evolve(made, TABLES["audit_logs"])


def normalize(batch: DataFrame, table: str) -> DataFrame:
    """What is changed in a row before it is checked: plates for vehicles, upper-case status for purchases and deliveries."""
    if table == "vehicles" and "registration_number" in batch.columns:
        plate = F.col("registration_number")
        return batch.withColumn("registration_number", F.when(text.present(plate).isNotNull(), text.normalize_registration(plate)).otherwise(plate))
    if table in ("purchases", "deliveries") and "status" in batch.columns:
        return batch.withColumn("status", F.upper("status"))
    return batch


def _finish(checked: DataFrame, table: str, now: datetime, actor: str | None, audited: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    good = checked.where("error_code IS NULL")
    rows = evolve(good.withColumn("created_at", F.lit(now)), TABLES[table])
    log = audit(good, actor, "CREATE", table, now)
    return rows, checked.where("error_code IS NOT NULL"), log if audited else log.limit(0)


def create(batch: DataFrame, existing: DataFrame, table: str, now: datetime, actor: str | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New rows, rejected requests and audit rows. Fields first, then each unique key; the first request wins.

    With two unique keys the second is only contested by rows that the first has left.
    """
    t = TABLES[table]
    made = normalize(with_defaults(batch, t), table)
    have = {c.lower() for c in made.columns}
    made = made.withColumns({f.name: F.lit(None).cast(f.dataType) for f in t.schema if f.name not in have})
    made = v.add_errors(made, [*(v.required(c) for c in t.required), *v.field_rules(table)])
    for key in t.unique:
        made = v.unique(made, key, existing, "seq", f"{key} already exists")
    return _finish(made, table, now, actor, table != "users")


def create_purchases(batch: DataFrame, existing: DataFrame, vendors: DataFrame, now: datetime, actor: str | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As create, and the vendor must exist."""
    t = TABLES["purchases"]
    made = v.add_errors(normalize(with_defaults(evolve_batch(batch, "purchases"), t), "purchases"), [*(v.required(c) for c in t.required), *v.field_rules("purchases")])
    made = v.exists(made, "vendor_id", vendors)
    made = v.unique(made, "purchase_number", existing, "seq", "purchase_number already exists", fit=F.col("__there"))
    made = v.add_errors(made, [(~F.col("__there"), v.INVALID, "vendor not found")]).drop("__there")
    return _finish(made, "purchases", now, actor)


def evolve_batch(batch: DataFrame, table: str) -> DataFrame:
    """The batch with all columns of the table besides its own, absent ones null."""
    have = {c.lower() for c in batch.columns}
    return batch.withColumns({f.name: F.lit(None).cast(f.dataType) for f in TABLES[table].schema if f.name not in have})


def fill_vendor(deliveries: DataFrame, purchases: DataFrame) -> DataFrame:
    """Deliveries without a vendor take that of their purchase; an empty string counts as none."""
    owner = purchases.select(F.col("id").alias("__purchase"), F.col("vendor_id").alias("__vendor"))
    both = deliveries.join(owner, F.col("purchase_id") == F.col("__purchase"), "left")
    return both.withColumn("vendor_id", F.coalesce(text.present(F.col("vendor_id")), F.col("__vendor"))).drop("__purchase", "__vendor")


def create_deliveries(batch: DataFrame, existing: DataFrame, purchases: DataFrame, vendors: DataFrame, now: datetime, actor: str | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As create; the vendor may come from the purchase and must exist. Other references may dangle."""
    t = TABLES["deliveries"]
    made = normalize(with_defaults(evolve_batch(batch, "deliveries"), t), "deliveries")
    made = v.exists(fill_vendor(made, purchases), "vendor_id", vendors)
    rules = [*(v.required(c) for c in t.required if c != "vendor_id"), *v.field_rules("deliveries")]
    made = v.add_errors(made, rules)
    made = v.unique(made, "delivery_number", existing, "seq", "delivery_number already exists", fit=F.col("__there"))
    made = v.add_errors(made, [(~F.col("__there"), v.INVALID, "vendor not found")]).drop("__there")
    return _finish(made, "deliveries", now, actor)


def folded(changes: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """One change per row: of each field the last one that names it in its ``fields``, null included."""
    last = [F.max_by(F.struct(F.col(c).alias("v")), F.when(F.array_contains("fields", c), F.col("seq"))).alias(f"__{c}") for c in columns]
    named_at_all = [F.when(F.bool_or(F.array_contains("fields", c)), F.lit(c)) for c in sorted(columns)]
    return changes.groupBy(key).agg(*last, F.array_compact(F.array(*named_at_all)).alias("fields"))


def patch(base: DataFrame, changes: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """base with the changes' fields set: fields that no change names stay, named ones are set also to null."""
    one = folded(changes, columns, key).withColumnRenamed(key, "__key").withColumnRenamed("fields", "__fields")
    both = base.join(one, F.col(key) == F.col("__key"), "left")
    there = F.col("__key").isNotNull()
    picked = [F.when(there & F.array_contains("__fields", c), F.col(f"__{c}.v")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns]
    return both.select(*picked)


def update(base: DataFrame, changes: DataFrame, table: str, now: datetime, actor: str | None, vendors: DataFrame | None = None, purchases: DataFrame | None = None, drivers: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The new snapshot, rejected changes and audit rows of PATCH requests.

    A change must name an existing row; its fields are checked as on creation, required ones can't be
    set to null, and unique keys are only contested by requests about other rows. For deliveries a named purchase
    must exist and gives its vendor; vendor and driver must exist; the vehicle is not checked.
    """
    t = TABLES[table]
    fixed = {"id", "created_at"} | ({"vendor_code"} if table == "vendors" else {"invoice_id"} if table == "payments" else set())
    columns = [f.name for f in t.schema if f.name not in fixed and f.name in changes.columns]
    asked = normalize(changes, table).withColumn("fields", F.array_intersect("fields", F.array(*map(F.lit, columns))))
    # fields that aren't named say nothing
    asked = asked.withColumns({c: F.when(F.array_contains("fields", c), F.col(c)) for c in columns})
    old = base.select(F.col("id").alias("__id"))
    asked = asked.join(old, F.col("id") == F.col("__id"), "left")
    missing = (F.col("__id").isNull(), v.MISSING, f"{table} row not found")
    nulls = [(F.array_contains("fields", c) & F.col(c).isNull(), v.INVALID, f"{c} can't be null") for c in t.required if c in columns]
    known = {r for r in columns}
    rules = [r for c, r in _rules_by_column(table) if c in known]
    asked = v.add_errors(asked, [missing, *nulls, *rules])
    later: list[v.Rule] = []  # checked after the unique keys
    if purchases is not None and "purchase_id" in columns:
        owner = purchases.select(F.col("id").alias("__purchase"), F.col("vendor_id").alias("__vendor"))
        named = F.array_contains("fields", "purchase_id") & text.present(F.col("purchase_id")).isNotNull()
        asked = asked.join(owner, F.col("purchase_id") == F.col("__purchase"), "left")
        later.append((named & F.col("__purchase").isNull(), v.INVALID, "purchase not found"))
        if "vendor_id" not in columns:
            asked, columns = asked.withColumn("vendor_id", F.lit(None).cast("string")), [*columns, "vendor_id"]
        asked = asked.withColumn("vendor_id", F.when(named, F.col("__vendor")).otherwise(F.col("vendor_id")))
        asked = asked.withColumn("fields", F.when(named, F.array_union("fields", F.array(F.lit("vendor_id")))).otherwise(F.col("fields")))
    for other, column in ((vendors, "vendor_id"), (drivers, "driver_id")):
        if other is not None and column in columns:
            asked = v.exists(asked, column, other, name=f"__{column}")
            named = F.array_contains("fields", column) & text.present(F.col(column)).isNotNull()
            later.append((named & ~F.col(f"__{column}"), v.INVALID, f"{column} not found"))
    fit = v.first_error(later).isNull()
    for key in t.unique:
        if key in columns:
            asked = v.unique(asked, key, base, "seq", f"{key} already exists", "id", fit)
    asked = v.add_errors(asked, later).drop("__id", "__purchase", "__vendor", "__vendor_id", "__driver_id")
    good = asked.where("error_code IS NULL")
    detailed = table not in ("purchases", "deliveries")
    log = audit(good.withColumn("fields", F.array_sort("fields")), actor, "UPDATE", table, now, fields="fields" if detailed else None)
    return patch(base, good, columns), asked.where("error_code IS NOT NULL"), log


def _rules_by_column(table: str) -> list[tuple[str, v.Rule]]:
    """Field rules with the column that each is about: the first word of its message."""
    return [(r[2].split()[0], r) for r in v.field_rules(table)]


def upload_documents(batch: DataFrame, existing: DataFrame, now: datetime, actor: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New document rows for files that have landed, rejected ones and audit rows.

    batch: seq, id, filename, content_type, document_type, token (a UUID that the caller draws). A file whose
    suffix is not on the allow-list is 415. The object key says where the file belongs; storing the bytes
    is the landing job's, and nothing here builds a path to be opened.
    """
    keyed = batch.withColumns({
        "document_type": F.upper("document_type"), "owner_id": F.lit(actor), "status": F.lit("UPLOADED"),
        "object_key": text.object_key(F.lit(actor), F.lit(now), F.col("token"), F.col("filename")),
    })
    made = v.add_errors(evolve_batch(keyed, "documents"), [
        (~text.suffix(F.col("filename")).isin(*UPLOADS) | F.col("filename").isNull(), v.UNSUPPORTED, "file type is not supported"), *(v.required(c) for c in TABLES["documents"].required),
    ])
    made = v.unique(made, "object_key", existing, "seq", "object_key already exists")
    good = made.where("error_code IS NULL")
    rows = evolve(good.withColumn("created_at", F.lit(now)), TABLES["documents"])
    return rows, made.where("error_code IS NOT NULL"), audit(good, actor, "UPLOAD", "documents", now)


def delete(base: DataFrame, ids: DataFrame, table: str, now: datetime, actor: str | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The snapshot without the rows, the ids that name none, and audit rows. Rows that refer to them stay."""
    keys = ids.select("id").distinct()
    gone = keys.join(base.select("id"), "id", "left_semi")
    missing = keys.join(base.select("id"), "id", "left_anti").withColumns({"error_code": F.lit(v.MISSING), "error_message": F.lit(f"{table} row not found")})
    return base.join(keys, "id", "left_anti"), missing, audit(gone, actor, "DELETE", table, now)
