"""Windowed counters over event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rate_windows(events: DataFrame, subject: str = "user_id", width: str = "60 seconds", late: str = "120 seconds", limit: int = 120) -> DataFrame:
    """(subject, window_start, n, over): requests in fixed windows; a window is final once the watermark has passed it."""
    marked = events.withWatermark("ts", late)
    return marked.groupBy(subject, F.window("ts", width)).agg(F.count("*").alias("n")).select(subject, F.col("window.start").alias("window_start"), "n", (F.col("n") > limit).alias("over"))


def first_seen(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """Events without those whose key came before within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def velocity(members: DataFrame, width: str, slide: str, late: str = "1 day") -> DataFrame:
    """(cluster_id, window_end, n): members added in sliding windows."""
    marked = members.withWatermark("added_at", late)
    return marked.groupBy("cluster_id", F.window("added_at", width, slide)).agg(F.count("*").alias("n")).select("cluster_id", F.col("window.end").alias("window_end"), "n")


