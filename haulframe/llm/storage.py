"""Cutting lineage in the folder that all executors share, and sizing of hash buckets."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that one hash bucket stands for; a task of the counting step holds one bucket at a time.
BUCKET_TEXT_BYTES = 8 << 20


#: Arrow batches of the registered queries; Spark's own limit of 64 MB is held several times over in each worker and in the JVM.
ARROW_BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's limit of bytes in an Arrow batch; what is computed stays the same."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int("".join(c for c in spark.conf.get(key) if c.isdigit())) > ARROW_BATCH_BYTES:
        spark.conf.set(key, str(ARROW_BATCH_BYTES))


def materialise(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the cluster's checkpoint folder, so that lost executors cost no recomputation.

    The folder is the session's ``spark.checkpoint.dir``; only where none is set, and Spark runs on this
    machine alone (tests, a laptop), a temporary one is made.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if shared is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="haulframe-checkpoint-"))
    return df.checkpoint(eager=True)


def bucket_count(df: DataFrame, text: str, least: int = 16) -> int:
    """A power of two that grows with the text, so that what a bucket holds does not."""
    total = df.agg(F.sum(F.octet_length(text))).head()[0] or 0
    n = least
    while n * BUCKET_TEXT_BYTES < total:
        n *= 2
    return n


def free_name(wanted: str, taken: list[str]) -> str:
    """wanted, lengthened until no column in taken has it (Spark compares names without case)."""
    low = {x.lower() for x in taken}
    while wanted.lower() in low:
        wanted += "_"
    return wanted
