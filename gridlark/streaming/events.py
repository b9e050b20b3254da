"""Structured Streaming over event logs: windowed counts, sessions, idempotent batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, folder: str, schema, per_trigger: int = 8) -> DataFrame:
    """A folder of Parquet files as a bounded-rate stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def windowed(events: DataFrame, ts: str, by: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by event-time window; rows later than the watermark are dropped."""
    w = events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), by)
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, ts: str, by: str, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    w = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), by)
    return w.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def first_seen(events: DataFrame, ts: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """Rows whose keys were not seen within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def append_once(stream: DataFrame, folder: str, checkpoint: str, run: str):
    """A query that writes each micro-batch into its own folder by (run, batch): a batch that is retried replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/run={run}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
