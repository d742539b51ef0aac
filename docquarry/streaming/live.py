"""Streaming extensions (not among the batch operators' own semantics): counts by window, and last record by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.sources.scratch import scratch_path


def window_counts(events: DataFrame, late: str = "1 hour", size: str = "1 hour") -> DataFrame:
    """Counts and sums by event type and tumbling window; rows later than the watermark may go."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type")
    return counted.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def drain(spark: SparkSession, stream: DataFrame, what: str) -> DataFrame:
    """Runs a stream over what is there now, and gives the last complete result."""
    path = scratch_path(spark, what)

    def save(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out")

    stream.writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out")
