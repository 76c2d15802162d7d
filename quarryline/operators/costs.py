"""Cost ledger: pricing, event rows, rollups, budgets, retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions import text as fx
from quarryline.session import materialise

# USD per token.
UNIT_PRICE_IN = "0.000015"
UNIT_PRICE_OUT = "0.000060"
_PRICE = "decimal(12,6)"
EVENTS_PER_RANGE = 100_000


def price(column: Column | None, default: str) -> Column:
    fallback = F.lit(default).cast(_PRICE)
    return fallback if column is None else F.coalesce(column.cast(_PRICE), fallback)


def _usd(amount: Column) -> Column:
    return F.round(amount, 4).cast("decimal(12,4)")


def call_costs(
    prompt_tokens: Column,
    completion_tokens: Column,
    price_in: Column | None = None,
    price_out: Column | None = None,
) -> tuple[Column, Column, Column]:
    """In, out and total cost, each rounded half up to four places from exact decimals."""
    exact_in = F.coalesce(prompt_tokens, F.lit(0)).cast("decimal(18,0)") * price(price_in, UNIT_PRICE_IN)
    exact_out = F.coalesce(completion_tokens, F.lit(0)).cast("decimal(18,0)") * price(
        price_out, UNIT_PRICE_OUT
    )
    return _usd(exact_in), _usd(exact_out), _usd(exact_in + exact_out)


def priced_events(calls: DataFrame) -> DataFrame:
    """Ledger rows of model calls: prices, costs and the token total filled in."""
    given_in = F.col("unit_price_in_usd") if "unit_price_in_usd" in calls.columns else None
    given_out = F.col("unit_price_out_usd") if "unit_price_out_usd" in calls.columns else None
    cost_in, cost_out, total = call_costs(
        F.col("prompt_tokens"), F.col("completion_tokens"), given_in, given_out
    )
    filled = {
        "total_tokens": F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0)),
        "unit_price_in_usd": price(given_in, UNIT_PRICE_IN),
        "unit_price_out_usd": price(given_out, UNIT_PRICE_OUT),
        "cost_in_usd": cost_in,
        "cost_out_usd": cost_out,
        "cost_total_usd": total,
    }
    return calls.withColumns(filled)


def answer_calls(answers: DataFrame) -> DataFrame:
    """Priced rows of answer calls, tokens estimated as blank-separated words."""
    estimated = answers.withColumn("prompt_tokens", fx.word_count(F.col("prompt"))).withColumn(
        "completion_tokens", fx.word_count(F.col("answer"))
    )
    return priced_events(estimated)


def step_events(manifests: DataFrame) -> DataFrame:
    """Ledger rows of ingest runs: one per run and document, completed or failed."""
    failed = F.col("error").isNotNull()
    done = F.map_from_arrays(
        F.array(F.lit("document_type"), F.lit("chunk_count"), F.lit("steps_completed")),
        F.array(
            F.col("document_type"),
            F.coalesce("chunk_count", F.lit(0)).cast("string"),
            F.col("steps_completed").cast("string"),
        ),
    )
    broken = F.map_from_arrays(
        F.array(F.lit("error"), F.lit("document_type")), F.array(F.col("error"), F.col("document_type"))
    )
    return manifests.select(
        F.col("run_id").alias("request_id"),
        "document_id",
        F.lit("etl").alias("provider"),
        F.lit("pipeline").alias("model"),
        F.lit("etl.process_document").alias("route"),
        F.when(failed, "failed").otherwise("completed").alias("status"),
        F.col("latency_ms"),
        F.when(failed, broken).otherwise(done).alias("metadata"),
    )


def rollup(events: DataFrame, by: Sequence[str] = ("provider", "model", "route"), period: str = "day") -> DataFrame:
    """Calls, tokens and spend per period and key."""
    return (
        events.groupBy(F.date_trunc(period, "ts").alias("period"), *by)
        .agg(*_totals())
    )


def rollup_subtotals(events: DataFrame, by: Sequence[str] = ("model", "route")) -> DataFrame:
    """Spend with subtotals over the given keys; null means "all"."""
    return events.rollup(*by).agg(*_totals())


def _totals() -> list[Column]:
    return [
        F.count("*").alias("calls"),
        F.sum("total_tokens").alias("tokens"),
        F.sum("cost_total_usd").alias("spend"),
    ]


def _ranged(events: DataFrame, tenant: str) -> DataFrame:
    """Events with their month and `_range`: ranges of (tenant, ts, id) of about equal size, stored.

    The cut is by the whole order of a tenant's events, so neither a tenant with a third of all
    events nor a minute with all of one tenant's fills a task.
    """
    ranges = max(1, -(-events.count() // EVENTS_PER_RANGE))
    placed = events.withColumn("month", F.date_trunc("month", "ts"))
    dealt = placed.repartitionByRange(ranges, tenant, "ts", "id").withColumn("_range", F.spark_partition_id())
    return materialise(dealt, "spend-ranges")


def _range_sums(ranged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Spend per key and range, with the key's spend in the ranges before: a row per range."""
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.groupBy(*keys, "_range")
        .agg(F.sum("cost_total_usd").alias("spent"))
        .withColumn("spent_before", F.coalesce(F.sum("spent").over(before), F.lit(0)))
    )


def running_spend(events: DataFrame, tenant: str = "tenant") -> DataFrame:
    """Month-to-date spend of the tenant after each event, by (ts, id).

    A scan in two levels: ranges of events are summed, the sums of a tenant's ranges are added up
    in order, and events are ordered within their range only.
    """
    keys = [tenant, "month"]
    ranged = _ranged(events, tenant)
    sums = _range_sums(ranged, keys).select(*keys, "_range", "spent_before")
    within = Window.partitionBy(*keys, "_range").orderBy("ts", "id").rowsBetween(
        Window.unboundedPreceding, 0
    )
    return (
        ranged.withColumn("_within", F.sum("cost_total_usd").over(within))
        .join(sums, [*keys, "_range"])
        .withColumn("burn", F.col("spent_before") + F.col("_within"))
        .drop("spent_before", "_within", "_range")
    )


def budget_breaches(events: DataFrame, caps: DataFrame, tenant: str = "tenant") -> DataFrame:
    """Month spend against the tenant's cap, with the first event that went over it.

    Costs are not negative, so only the events of the one range that crosses the cap are ordered
    one by one.
    """
    keys = [tenant, "month"]
    ranged = _ranged(events, tenant)
    sums = _range_sums(ranged, keys).join(caps, tenant)
    over = F.col("spent_before") + F.col("spent") > F.col("cap")
    totals = sums.groupBy(*keys, "cap").agg(
        F.sum("spent").alias("spent"), F.min(F.when(over, F.col("_range"))).alias("_range")
    )
    crossing = totals.filter(F.col("_range").isNotNull()).join(
        sums.select(*keys, "_range", "spent_before"), [*keys, "_range"]
    )
    within = Window.partitionBy(*keys).orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    first = (
        ranged.select(*keys, "_range", "ts", "id", "cost_total_usd")
        .join(crossing.select(*keys, "_range", "cap", "spent_before"), [*keys, "_range"])
        .withColumn("burn", F.col("spent_before") + F.sum("cost_total_usd").over(within))
        .filter(F.col("burn") > F.col("cap"))
        .groupBy(*keys)
        .agg(F.min_by("id", F.struct("ts", "id")).alias("breach_id"), F.min("ts").alias("breach_ts"))
    )
    return totals.drop("_range").join(first, keys, "left").withColumn(
        "breached", F.col("breach_id").isNotNull()
    )


def retain(rows: DataFrame, cutoff: Column, column: str = "ts") -> DataFrame:
    """Rows at or after the cutoff."""
    return rows.filter(F.col(column) >= cutoff)
