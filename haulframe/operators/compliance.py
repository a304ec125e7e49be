"""Extension: papers of vehicles and drivers that have run out or soon will."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAPERS = {"vehicles": ("rc_expiry", "insurance_expiry"), "drivers": ("license_expiry",)}


def expiring(vehicles: DataFrame, drivers: DataFrame, today: Column, days: int = 30) -> DataFrame:
    """resource_type, resource_id, paper, expires_on, days_left of papers that end within so many days; null dates never do."""
    parts = []
    for name, df in (("vehicles", vehicles), ("drivers", drivers)):
        papers = F.explode(F.array(*(F.struct(F.lit(p).alias("paper"), F.col(p).alias("expires_on")) for p in PAPERS[name])))
        parts.append(df.select(F.lit(name).alias("resource_type"), F.col("id").alias("resource_id"), papers.alias("p")).select("resource_type", "resource_id", "p.*"))
    every = reduce(DataFrame.unionByName, parts)
    return every.withColumn("days_left", F.datediff("expires_on", today)).where(F.col("days_left") <= days)
