"""Aggregates that grow by batches: stored partial sums, merged when they are read.

A batch adds one small row per day and key that it holds, whatever the number of its events, and
touches no other row. Late events correct their day because their partial row belongs to it. A
batch that is repeated takes its own place (`sources.runs`). Folding merges the batches so far.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.sources import runs

TABLE = "partials"
SPEND_KEYS = ("provider", "model", "route")
# Sketches of 2^12 cells tell distinct numbers within about 2 %.
SKETCH_BITS = 12


def spend_partials(events: DataFrame, by: Sequence[str] = SPEND_KEYS, distinct: str = "tenant") -> DataFrame:
    """Per day and key: calls, tokens, spend, and a sketch of the distinct values of `distinct`."""
    return events.groupBy(F.to_date("ts").alias("day"), *by).agg(
        F.count("*").alias("calls"),
        F.sum("total_tokens").alias("tokens"),
        F.sum("cost_total_usd").alias("spend"),
        F.hll_sketch_agg(F.col(distinct).cast("string"), SKETCH_BITS).alias("sketch"),
    )


def _merged(partials: DataFrame, by: Sequence[str], sketch: Column) -> DataFrame:
    return partials.groupBy("day", *by).agg(
        F.sum("calls").alias("calls"),
        F.sum("tokens").alias("tokens"),
        F.sum("spend").alias("spend"),
        sketch,
    )


def _as_stored(partials: DataFrame) -> DataFrame:
    """Sums widen with every merge; stored ones keep one type, so that batches read alike."""
    return partials.withColumns({
        "calls": F.col("calls").cast("long"),
        "tokens": F.col("tokens").cast("long"),
        "spend": F.col("spend").cast("decimal(38,10)"),
    }).repartition("day")


def append(
    spark: SparkSession, path: str, batch: str, events: DataFrame,
    by: Sequence[str] = SPEND_KEYS, distinct: str = "tenant",
) -> None:
    """Adds a batch of events. The same batch again replaces what it added before.

    A batch may hold nulls in any key (null is a key of its own) and no events at all. An event
    without a time counts for the null day.
    """
    rows = _as_stored(spend_partials(events, by, distinct))
    runs.commit(spark, path, batch, {TABLE: rows}, partition_by=["day"])


def rollup(
    spark: SparkSession, path: str, by: Sequence[str] = SPEND_KEYS,
    first: str | None = None, last: str | None = None,
) -> DataFrame:
    """Calls, tokens, spend and distinct values per day and key, over all batches.

    `by` may be any part of the stored keys. Days from `first` to `last` (dates as text) read
    the folders of these days only.
    """
    rows = runs.read(spark, path, TABLE)
    if first is not None:
        rows = rows.filter(F.col("day") >= F.lit(first).cast("date"))
    if last is not None:
        rows = rows.filter(F.col("day") <= F.lit(last).cast("date"))
    return _merged(rows, by, F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_values"))


def fold(spark: SparkSession, path: str, name: str, by: Sequence[str] = SPEND_KEYS) -> list[str]:
    """Merges all visible batches into one run; readers see either them or it. Returns them.

    The batches are named by the marker table, a row per batch. They are closed afterwards:
    what still comes in for one goes into a batch of a new name.
    """
    folded = sorted(r.run for r in runs.visible(spark, path).select("run").collect())
    rows = runs.read(spark, path, TABLE, with_run=True).filter(F.col("run").isin(folded))
    merged = _merged(rows, by, F.hll_union_agg("sketch").alias("sketch"))
    runs.commit(spark, path, name, {TABLE: _as_stored(merged)}, partition_by=["day"], replaces=folded)
    return folded
