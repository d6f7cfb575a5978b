"""Structured Streaming jobs: incremental file ingestion with a ledger, and windowed counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files of a folder as they come; the checkpoint of the query is the ledger of what was read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums per tumbling window and key; a window closes when the watermark has passed it."""
    at = F.col(time).cast("timestamp")
    return events.withColumn("_t", at).withWatermark("_t", late).groupBy(F.window("_t", width), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def session_counts(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Counts per session of a key, closed by a gap."""
    return events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late).groupBy(F.session_window("_t", gap), key).agg(F.count(F.lit(1)).alias("n"))


def ingest_once(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append all that is new to a Parquet table, exactly once, and stop."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append what the watermark has closed to a Parquet table, and stop when all files are read."""
    return rows.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
