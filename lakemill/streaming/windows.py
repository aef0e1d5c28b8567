"""Windowed aggregation of an event stream: an extension, as the model engine has no streams.

The same function serves batch and stream; on a stream the watermark bounds the state and late rows are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, time: str, keys: list[str], value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count and sum of value by keys and time window."""
    rows = events.withColumn("_at", F.col(time).cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("_at", late)
    out = rows.groupBy(F.window("_at", width), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("begin"), *keys, "n", "total")
