"""Reads that arrive as a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Reads come again up to so much later; state older than that is dropped.
LATENESS = "60 days"


def first_deliveries(stream: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Each read of the stream once, when it is first delivered; repeats within the lateness are dropped.

    Rows without a read_idx or loaded_at cannot be told apart and are left out.
    """
    timed = stream.where("read_idx IS NOT NULL AND loaded_at IS NOT NULL").withColumn("loaded_at", F.col("loaded_at").cast("timestamp"))
    return timed.withWatermark("loaded_at", lateness).dropDuplicatesWithinWatermark(["read_idx"])


def running_totals(stream: DataFrame, window: str = "1 day", lateness: str = LATENESS) -> DataFrame:
    """Reads and bases of every sample and day of delivery, kept up to date as files arrive."""
    timed = stream.where("loaded_at IS NOT NULL").withColumn("loaded_at", F.col("loaded_at").cast("timestamp")).withWatermark("loaded_at", lateness)
    grouped = timed.groupBy(F.window("loaded_at", window).alias("day"), "sample_label")
    return grouped.agg(F.count(F.lit(1)).alias("deliveries"), F.sum(F.length("seq")).alias("bases")).select(F.col("day.start").alias("day"), "sample_label", "deliveries", "bases")
