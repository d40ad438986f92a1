"""The request log's time buckets as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def over_time(stream: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(bucket, n, refused, mean_cost) of each window, final once the watermark has passed it."""
    timed = stream.withColumn("at", F.col("timestamp").cast("timestamp")).withWatermark("at", late)
    got = timed.groupBy(F.window("at", width)).agg(F.count("*").alias("n"), F.sum("refused").alias("refused"), F.avg("cost_usd").alias("mean_cost"))
    return got.select(F.col("window.start").alias("bucket"), "n", "refused", "mean_cost")
