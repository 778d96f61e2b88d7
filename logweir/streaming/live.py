"""Counts over a stream of entries."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.functions.levels import status_class


def live_counts(
    entries: DataFrame, width: str = "1 hour", lateness: str = "10 minutes"
) -> DataFrame:
    """Entries per time window, level and status class. Entries later than ``lateness``
    behind the newest one may be left out once their window is closed."""
    timed = entries.where(F.col("timestamp").isNotNull()).withWatermark("timestamp", lateness)
    return (
        timed.groupBy(
            F.window("timestamp", width).alias("window"),
            F.lower("level").alias("level"),
            status_class(F.col("status")).alias("status_class"),
        )
        .agg(F.count("*").alias("count"))
        .select(
            F.col("window.start").alias("window_start"), "level", "status_class", "count"
        )
    )


def untimed_counts(entries: DataFrame) -> DataFrame:
    """Entries without a time, which belong to no window, per level."""
    untimed = entries.where(F.col("timestamp").isNull())
    return untimed.groupBy(F.lower("level").alias("level")).agg(F.count("*").alias("count"))
