"""Spend and token rate per tumbling window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_spend(events: DataFrame, width: str = "1 minute", by: tuple[str, ...] = ("model",)) -> DataFrame:
    """Calls, tokens and spend per window and key; the same function serves both modes.

    The keys are aggregated per task before the shuffle.
    """
    return events.groupBy(F.window("ts", width).alias("window"), *by).agg(
        F.count("*").alias("calls"),
        F.sum("total_tokens").alias("tokens"),
        F.sum("cost_total_usd").alias("spend"),
    )


def windowed_spend_stream(
    events: DataFrame, width: str = "1 minute", by: tuple[str, ...] = ("model",), lateness: str = "10 minutes"
) -> DataFrame:
    """Windows of a stream, emitted once the watermark has passed them."""
    return windowed_spend(events.withWatermark("ts", lateness), width, by)


def over_quota(windows: DataFrame, quotas: DataFrame, key: str = "model") -> DataFrame:
    """Windows with their token quota and whether they used more."""
    return windows.join(quotas, key, "left").withColumn(
        "over_quota", F.coalesce(F.col("tokens") > F.col("quota"), F.lit(False))
    )
