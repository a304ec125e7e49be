"""Who may run what: the role matrix as data, checked before a plan is built."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ANY = frozenset(("ADMIN", "OPERATOR", "FINANCE", "APPROVER", "*"))
PUBLIC = frozenset(("public",))

# Roles by operation; "*" is any active user.
ROLES: dict[str, frozenset[str]] = {
    "read": ANY,
    "documents": ANY,
    "plates": ANY,
    "dashboard": ANY,
    "submit_invoice": ANY,
    "identity": ANY,
    "write_vendors": frozenset(("ADMIN", "OPERATOR")),
    "write_vehicles": frozenset(("ADMIN", "OPERATOR")),
    "write_drivers": frozenset(("ADMIN", "OPERATOR")),
    "write_purchases": frozenset(("ADMIN", "OPERATOR")),
    "write_deliveries": frozenset(("ADMIN", "OPERATOR")),
    "write_invoices": frozenset(("ADMIN", "OPERATOR", "FINANCE")),
    "write_payments": frozenset(("ADMIN", "FINANCE")),
    "delete": frozenset(("ADMIN",)),
    "approvals": frozenset(("ADMIN", "APPROVER", "FINANCE")),
    "report_summary": frozenset(("ADMIN", "FINANCE", "APPROVER")),
    "users": frozenset(("ADMIN",)),
    "register": frozenset(("ADMIN",)),
    "audit": frozenset(("ADMIN",)),
    "login": PUBLIC,
    "health": PUBLIC,
}


def allowed(operation: str, role: str | None) -> bool:
    """Whether an active user's role (None: no user) may run the operation."""
    roles = ROLES[operation]
    return roles is PUBLIC or role is not None and ("*" in roles or role in roles)


def require(operation: str, role: str | None) -> None:
    if not allowed(operation, role):
        raise PermissionError(f"{operation} is not open to {role or 'anonymous callers'}")


def active_user(users: DataFrame, subject: str) -> DataFrame:
    """The user of a verified token, if active: one row or none."""
    return users.where((F.col("id") == subject) & F.col("is_active")).limit(1)


def identity(user: DataFrame) -> DataFrame:
    return user.select("id", "email", "full_name", "role")


def login_user(user: DataFrame) -> DataFrame:
    """The nested user record that a login answers with; verifying the password is the caller's."""
    return user.select(F.struct("id", F.col("full_name").alias("name"), "role").alias("user"))


def registered(user: DataFrame) -> DataFrame:
    return user.select("id", "email", "role")
