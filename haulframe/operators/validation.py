"""Write validation as columns: the first failing rule of a row gives its error_code and error_message."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulframe.functions.text import present

INVALID, CONFLICT, MISSING, UNSUPPORTED = 422, 409, 404, 415

#: A failing condition, the code and the message.
Rule = tuple[Column, int, str]

_EMAIL = r"^[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+$"


def length(column: str, least: int | None = None, most: int | None = None) -> Rule:
    """A text's length; null passes."""
    n = F.length(column)
    bad = [c for c in (n < least if least is not None else None, n > most if most is not None else None) if c is not None]
    return reduce(lambda a, b: a | b, bad), INVALID, f"{column} has a wrong length"


def above(column: str, bound: float, equal: bool) -> Rule:
    """A number above the bound, or equal to it where that's allowed; null passes, NaN doesn't."""
    c = F.col(column)
    return (c < bound if equal else c <= bound) | F.isnan(c), INVALID, f"{column} is too small"


def email(column: str) -> Rule:
    return ~F.col(column).rlike(_EMAIL) | F.col(column).rlike(r"\.\.|^\.|\.@"), INVALID, f"{column} is no e-mail address"


def required(column: str) -> Rule:
    return F.col(column).isNull(), INVALID, f"{column} is missing"


def one_of(column: str, *values: str) -> Rule:
    return ~F.col(column).isin(*values), INVALID, f"{column} is none of {', '.join(values)}"


def field_rules(table: str) -> list[Rule]:
    """The rules for single fields of a table's rows, in order."""
    return {
        "login": lambda: [required("email"), email("email"), required("password"), length("password", 8)],
        "users": lambda: [email("email"), length("full_name", 2, 150)],
        "vendors": lambda: [length("vendor_code", 2, 30), length("legal_name", 2, 200), length("gstin", most=15), email("email")],
        "invoices": lambda: [above("amount", 0, False), above("tax_amount", 0, True)],
        "payments": lambda: [above("amount", 0, False)],
        "purchases": lambda: [length("purchase_number", 1, 80), length("reference", most=120), above("quantity", 0, True), above("total_amount", 0, True)],
        "deliveries": lambda: [length("delivery_number", 1, 80), length("destination", 1, 250), length("recipient", most=150)],
        "vehicles": lambda: [(~F.length("registration_number").between(8, 11), INVALID, "registration_number is invalid")],
        "approvals": lambda: [one_of("decision", "APPROVED", "REJECTED")],
    }.get(table, list)()


def first_error(rules: list[Rule]) -> Column:
    """Struct (code, message) of the first failing rule; null if all pass."""
    errors = [F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(message).alias("message"))) for bad, code, message in rules]
    return F.coalesce(*errors) if errors else F.lit(None).cast("struct<code:int,message:string>")


def add_errors(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """df with error_code and error_message; rows that have an error keep it."""
    found = first_error(rules)
    if "error_code" not in df.columns:
        return df.withColumn("__error", found).withColumns({"error_code": F.col("__error.code"), "error_message": F.col("__error.message")}).drop("__error")
    clear = F.col("error_code").isNull()
    return df.withColumn("__error", found).withColumns({"error_code": F.when(clear, F.col("__error.code")).otherwise(F.col("error_code")), "error_message": F.when(clear, F.col("__error.message")).otherwise(F.col("error_message"))}).drop("__error")


def exists(df: DataFrame, column: str, other: DataFrame, other_column: str = "id", name: str = "__there") -> DataFrame:
    """df with a boolean: whether the column's value is among other's. Joins distinct keys, so no row is multiplied."""
    keys = other.select(F.col(other_column).alias(f"{name}_key")).where(F.col(f"{name}_key").isNotNull()).distinct()
    return df.join(keys, F.col(column) == F.col(f"{name}_key"), "left").withColumn(name, F.col(f"{name}_key").isNotNull()).drop(f"{name}_key")


def violations(df: DataFrame, column: str, other: DataFrame, other_column: str = "id") -> DataFrame:
    """Rows whose reference is set but dangles."""
    keys = other.select(F.col(other_column).alias("__key"))
    return df.where(present(F.col(column).cast("string")).isNotNull()).join(keys, F.col(column) == F.col("__key"), "left_anti")


def unique(df: DataFrame, column: str, existing: DataFrame, order: str, message: str, about: str | None = None, fit: Column | None = None) -> DataFrame:
    """Adds a conflict to rows whose value existing rows hold, or an earlier row of df without an error; null never conflicts.

    about names the column with the id of the existing row that a row of df changes: neither that row's own
    value nor an earlier request about the same row is a conflict. A value that an existing row holds stays
    taken for the whole batch, even if a request of the batch gives it up. Rows that aren't fit, as they will
    fail a later rule, take no value from others.
    """
    if about is None:
        taken = F.col("__taken")
        marked = exists(df, column, existing, column, "__taken")
    else:
        holders = existing.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("__held")).agg(F.min("id").alias("__least"), F.max("id").alias("__most"))
        marked = df.join(holders, F.col(column) == F.col("__held"), "left")
        taken = F.col("__held").isNotNull() & ((F.col("__least") != F.col(about)) | (F.col("__most") != F.col(about)))
    marked = add_errors(marked, [(taken, CONFLICT, message)]).drop("__taken", "__held", "__least", "__most")
    # rows that take part in the race; the others get a key of their own, so they gather nowhere
    runs = F.col("error_code").isNull() & F.col(column).isNotNull()
    key = F.struct(F.when(runs, F.col(column)).alias("v"), F.when(~runs, F.col(order)).alias("o"))
    earliest = F.struct(F.col(order).alias("o"), F.col(about or order).alias("by"))
    marked = marked.withColumn("__first", F.min(F.when(F.lit(True) if fit is None else fit, earliest)).over(Window.partitionBy(key)))
    late = (F.col(order) > F.col("__first.o")) & (F.col(about or order) != F.col("__first.by"))
    return add_errors(marked, [(runs & late, CONFLICT, message)]).drop("__first")
