"""Vehicle look-up by registration number, for tables of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulframe.functions import text

UNREADABLE, UNKNOWN = 422, 404
IMAGE_TYPES = ("image/jpeg", "image/png", "image/webp")


def _registry(vehicles: DataFrame, vendors: DataFrame) -> DataFrame:
    """Vehicles and their vendors as structs by plate."""
    v = vehicles.select(F.col("registration_number").alias("__plate"), F.col("vendor_id").alias("__vendor"), F.struct("*").alias("vehicle"))
    w = vendors.select(F.col("id").alias("__id"), F.struct("*").alias("vendor"))
    return v.join(w, F.col("__vendor") == F.col("__id"), "left").drop("__vendor", "__id")


def look_up(requests: DataFrame, vehicles: DataFrame, vendors: DataFrame, number: str = "registration_number") -> DataFrame:
    """Requests with the normalised plate, vehicle, vendor and error_code: null, 422 for a wrong length, 404 for an unknown plate."""
    plate = text.normalize_registration(F.col(number))
    asked = requests.withColumn(number, plate)
    known = _registry(vehicles, vendors)
    found = asked.join(known, F.when(text.registration_valid(F.col(number)), F.col(number)) == F.col("__plate"), "left").drop("__plate")
    code = F.when(~text.registration_valid(F.col(number)), UNREADABLE).when(F.col("vehicle").isNull(), UNKNOWN)
    return found.withColumn("error_code", code)


def recognize(images: DataFrame, vehicles: DataFrame, vendors: DataFrame, read_text: str = "text", content_type: str | None = None) -> DataFrame:
    """Recognised texts with candidates, the first one's plate, vehicle, vendor, matched and error_code.

    An unknown plate is no error here, only not matched; a text without a candidate is 422, another content type 415.
    """
    seen = images.withColumn("candidates", text.registration_candidates(F.coalesce(F.col(read_text), F.lit(""))))
    seen = seen.withColumn("registration_number", text.normalize_registration(F.get("candidates", F.lit(0))))
    valid = text.registration_valid(F.col("registration_number"))
    found = seen.join(_registry(vehicles, vendors), F.col("registration_number") == F.col("__plate"), "left").drop("__plate")
    code = F.when(~valid, UNREADABLE)
    if content_type is not None:
        code = F.when(~F.coalesce(F.col(content_type).isin(*IMAGE_TYPES), F.lit(False)), 415).otherwise(code)
    return found.withColumn("matched", F.col("vehicle").isNotNull()).withColumn("error_code", code)
