"""Ranks and positions that stay spread out when one group holds most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int | Column, rank: str = "rank"
) -> DataFrame:
    """The first `k` rows of every group under a total order, ranked from 1.

    With an integer `k` Spark keeps at most `k` rows of a group per task before the
    shuffle, so a hot group moves `k` rows per task, not all its rows.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def positions(
    df: DataFrame, keys: Sequence[str], order: str, name: str = "position", width: int = 10_000
) -> DataFrame:
    """Row number from 1 within `keys` by the integer column `order`.

    Groups are cut into ranges of `width` order values: each range is counted, the
    counts are summed up over the few ranges of a group, and rows are numbered only
    within their range. No task ever sorts a whole hot group.
    """
    keys = list(keys)
    ranged = df.withColumn("_range", F.floor(F.col(order) / F.lit(width)))
    per_range = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        *keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    within = Window.partitionBy(*keys, "_range").orderBy(order)
    return (
        ranged.withColumn("_row", F.row_number().over(within))
        .join(offsets, [*keys, "_range"])
        .withColumn(name, (F.col("_before") + F.col("_row")).cast("long"))
        .drop("_range", "_row", "_before")
    )


def is_small(df: DataFrame, max_rows: int) -> bool:
    """Whether a count, stopped at the limit, finds at most `max_rows` rows."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """`df` with a broadcast hint when its size is proven."""
    return F.broadcast(df) if is_small(df, max_rows) else df
