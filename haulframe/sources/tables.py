"""Reading and publishing table snapshots.

A snapshot is a folder of Parquet files, never changed once published. ``publish`` writes a new one and
then names it in a one-row pointer table, so readers see the old state or the new one, and a writer
that dies leaves only a folder that nothing points to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulframe.schemas import TABLES, evolve


def read(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table's snapshot with its declared columns; columns added since it was written are null."""
    return evolve(spark.read.parquet(path), TABLES[table])


def read_declared(spark: SparkSession, path: str, table: str) -> DataFrame:
    """As read, for folders without a file yet: the schema is given, not looked up."""
    return spark.read.schema(TABLES[table].schema).parquet(path)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple | None = None, partitions: int = 8, **options: str) -> DataFrame:
    """A table of a live database, read in key ranges when bounds are given, else by one connection."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if key and bounds:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    return evolve(reader.load(), TABLES[table])


def append(rows: DataFrame, path: str, table: str) -> None:
    evolve(rows, TABLES[table]).write.mode("append").parquet(path)


def publish(snapshots: dict[str, DataFrame], root: str, version: str) -> None:
    """Writes all tables under one version, then the pointer: the tables of a transition change together."""
    for name, df in snapshots.items():
        evolve(df, TABLES[name]).write.mode("errorifexists").parquet(f"{root}/{name}/{version}")
    spark = next(iter(snapshots.values())).sparkSession
    rows = spark.createDataFrame([(name, version) for name in snapshots], "table_name string, version string").withColumn("published_at", F.current_timestamp())
    rows.coalesce(1).write.mode("append").parquet(f"{root}/_pointers")


def current(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The snapshot that the latest pointer names."""
    pointer = spark.read.parquet(f"{root}/_pointers").where(F.col("table_name") == table).orderBy(F.desc("published_at"), F.desc("version")).select("version").head()
    if pointer is None:
        return spark.createDataFrame([], TABLES[table].schema)
    return read(spark, f"{root}/{table}/{pointer[0]}", table)


def seed_admin(users: DataFrame, row: DataFrame) -> DataFrame:
    """users, or the given first row if there is none; no row is drawn to the driver."""
    none = users.limit(1).agg(F.count(F.lit(1)).alias("__n")).where("__n = 0")
    return users.unionByName(evolve(row, TABLES["users"]).join(F.broadcast(none), how="cross").drop("__n"))
