"""Text expressions: registration numbers, file suffixes, extracted fields. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The registration pattern, what may be uploaded, and the limits that callers rely on.
UPLOADS = (".pdf", ".jpg", ".jpeg", ".png", ".webp", ".docx", ".xlsx")
REGISTRATION = r"[A-Z]{2}\s?\d{1,2}\s?[A-Z]{1,3}\s?\d{4}"
REGISTRATION_LENGTH = (8, 11)
TEXT_LIMIT = 10_000
PREVIEW_LINES = 20

#: White space at the ends of a line, also that beyond ASCII.
_ENDS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def utc(c: Column) -> Column:
    """The wall time in UTC of a timestamp, whatever the session's zone; one without a zone is UTC already."""
    since = F.make_dt_interval(secs=(F.unix_micros(c.cast("timestamp")) / F.lit(1_000_000).cast("decimal(20,0)")).cast("decimal(18,6)"))
    return F.when(F.typeof(c) == "timestamp", F.lit("1970-01-01").cast("timestamp_ntz") + since).otherwise(c.cast("timestamp_ntz"))


def present(c: Column) -> Column:
    """c, or null where it is an empty string."""
    return F.nullif(c, F.lit(""))


def normalize_registration(c: Column) -> Column:
    """Upper case, letters A-Z and digits only."""
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")


def registration_valid(normalized: Column) -> Column:
    return F.coalesce(F.length(normalized).between(*REGISTRATION_LENGTH), F.lit(False))


def registration_candidates(text: Column, unicode: bool = True) -> Column:
    """All matches in order of appearance, repeats included, without spaces; unicode also takes digits and spaces beyond ASCII."""
    pattern = ("(?U)" if unicode else "") + f"({REGISTRATION})"
    found = F.regexp_extract_all(F.upper(text), F.lit(pattern), F.lit(1))
    return F.transform(found, lambda x: F.regexp_replace(x, "[^A-Z0-9]", ""))


def suffix(filename: Column) -> Column:
    """Lower-cased last suffix of a file name with its dot; empty for none, also for names that only begin with a dot."""
    return F.lower(F.regexp_extract(filename, r"[^/](\.[^./]+)$", 1))


def lines(text: Column) -> Column:
    """Lines of a text, trimmed, without blank ones."""
    trimmed = F.transform(F.split(text, r"\R|[\x1c-\x1e]"), lambda x: F.regexp_replace(x, _ENDS, ""))
    return F.filter(trimmed, lambda x: F.length(x) > 0)


def extracted_fields(document_type: Column, text: Column) -> Column:
    """The struct that a document's extraction yields."""
    return F.struct(document_type.alias("document_type"), F.left(text, F.lit(TEXT_LIMIT)).alias("text"), F.slice(lines(text), 1, PREVIEW_LINES).alias("preview_lines"))


def object_key(owner: Column, uploaded_at: Column, token: Column, filename: Column) -> Column:
    """Where an upload is stored: owner/yyyyMMddHHmmss_<8 hex digits>_filename, the time in UTC; the token is a UUID that the caller draws."""
    return F.concat(owner, F.lit("/"), F.regexp_replace(F.substring(utc(uploaded_at).cast("string"), 1, 19), "[^0-9]", ""), F.lit("_"), F.substring(F.replace(token, F.lit("-"), F.lit("")), 1, 8), F.lit("_"), filename)
