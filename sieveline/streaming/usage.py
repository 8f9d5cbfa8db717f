"""Usage reports over a stream of calls: tumbling windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_usage(calls: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Calls, errors and total duration per tool and window; works on batch and streaming frames.

    ``calls(ts, tool, value, is_error)``. In append mode a window is written once the watermark passes it.
    """
    timed = calls.withColumn("ts", F.col("ts").cast("timestamp"))
    if calls.isStreaming:
        timed = timed.withWatermark("ts", late)
    return (
        timed.groupBy(F.window("ts", width).alias("w"), "tool")
        .agg(F.count(F.lit(1)).alias("calls"), F.count_if("is_error").alias("errors"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("window_start"), "tool", "calls", "errors", F.round("total", 4).alias("total"))
    )


def drain(spark: SparkSession, stream: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all that is there, writes closed windows to Parquet, and reads them back."""
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(folder)
    )
    query.awaitTermination()
    return spark.read.parquet(folder)
