"""Streams: new rows scored against frozen centers, and a stream that ends in JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from granary.operators.grouping import distances


def scored(stream: DataFrame, vector: str, centers: list[list[float]]) -> DataFrame:
    """The rows with ``group_no`` and ``dist``; stateless, so it holds for batches and streams alike."""
    nearest = F.element_at(distances(vector, centers), 1)
    held = stream.where(F.col(vector).isNotNull()).withColumn("_near", nearest)
    return held.withColumn("group_no", F.col("_near.group_no")).withColumn("dist", F.col("_near.dist")).drop("_near")


def sizes_by_window(stream: DataFrame, time: str, window: str, late: str, *groups: str) -> DataFrame:
    """Rows by window of event time and group; rows later than the watermark are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), *groups).agg(F.count("*").alias("n"))


def into_jsonl(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the stream to JSON lines exactly once; a restart goes on where it stopped."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
