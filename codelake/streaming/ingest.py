"""New source files as a stream: each batch is parsed and appended to the fact tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extraction
from ..sources.tree import decoded

BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def watch(spark: SparkSession, folder: str, target: str, checkpoint: str, suffix: str = "*"):
    """A query that parses files as they appear under ``folder`` and writes symbols, imports and
    diagnostics below ``target``. A batch that is run again overwrites its own folder, so each file
    counts once. Spark's file source skips names that start with ``_`` or ``.``."""
    files = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true").option("pathGlobFilter", suffix).load(folder)

    def add(batch: DataFrame, number: int) -> None:
        text = decoded(batch).withColumn("file_ord", F.lit(0))
        parsed = extraction.parse_files(text).persist()
        for name in ("symbols", "imports", "diagnostics"):
            getattr(extraction, name)(parsed).write.mode("overwrite").parquet(f"{target}/{name}/batch={number}")
        parsed.unpersist()

    return files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, at: str, by: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events by window and key, of a stream or a table; rows later than ``late`` are left out of a stream."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    return rows.groupBy(F.window(at, width), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), by, "n")
