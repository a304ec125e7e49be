"""Extension: text extraction of files as they arrive, by a file-source stream. The batch form is sources.files.texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from haulframe.sources.files import Readers, texts

_BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def arriving(spark: SparkSession, folder: str, most_files: int = 1000) -> DataFrame:
    """New files below a folder, at most so many in a micro-batch."""
    return spark.readStream.format("binaryFile").schema(_BINARY).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", most_files).load(folder)


def extract_stream(files: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, readers: Readers | None = None, once: bool = False) -> StreamingQuery:
    """Runs sink(texts, batch id) on each micro-batch; ids are paths. A failed batch is read again from the checkpoint."""
    ready = files.select(F.col("path").alias("id"), F.col("path").alias("filename"), "content", F.lit(True).alias("found"))
    writer = ready.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: sink(texts(df, readers), n))
    return (writer.trigger(availableNow=True) if once else writer).start()
