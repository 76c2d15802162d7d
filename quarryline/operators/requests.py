"""Idempotent job requests: one per key within the time to live, the first one wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.session import materialise

# Fixed value.
TTL_SECONDS = 3600
# Requests of a run that are gone through in one row.
FOLDED_REQUESTS = 2000


def idempotency_key(task: Column, args: Column) -> Column:
    """`idem:<task>:<sha256>` of the arguments as JSON with sorted keys."""
    ordered = F.map_from_entries(F.array_sort(F.map_entries(args)))
    return F.concat(F.lit("idem:"), task, F.lit(":"), F.sha2(F.to_json(ordered), 256))


def accept_first(
    requests: DataFrame,
    ttl_seconds: int = TTL_SECONDS,
    id_column: str = "request_id",
    folded: int = FOLDED_REQUESTS,
) -> DataFrame:
    """Adds `accepted`: whether the request starts work or repeats an accepted one.

    A request is accepted when the last *accepted* one of its key is at least the time
    to live older. Requests (id_column, key, ts) are first summed up per key and
    time-to-live slot; where a slot begins at least one time to live after the slot
    before it, a new independent run of slots starts, whose first request is accepted.
    Runs of one slot need nothing more. Those of at most `folded` requests are gone through in
    order, within a row. In longer ones at most one time per slot is accepted, and the time after an accepted one follows from it alone: the first that is a time to live
    later. These steps are found slot by slot, then doubled until they span the longest
    run, so a key that is never at rest is dealt out by its times.
    """
    ttl = ttl_seconds * 1_000_000
    timed = requests.select(
        F.col(id_column).alias("_id"), "key", F.unix_micros(F.col("ts").cast("timestamp")).alias("_at")
    ).withColumn("_slot", F.floor(F.col("_at") / F.lit(ttl)))
    slots = timed.groupBy("key", "_slot").agg(
        F.min(F.struct("_at", "_id")).alias("_first"), F.max("_at").alias("_last"), F.count("*").alias("_rows")
    )
    by_slot = Window.partitionBy("key").orderBy("_slot")
    starts = F.coalesce(F.col("_first._at") - F.lag("_last").over(by_slot) >= ttl, F.lit(True))
    in_run = Window.partitionBy("key", "_run")
    runs = (
        slots.withColumn("_starts", starts.cast("int"))
        .withColumn("_run", F.sum("_starts").over(by_slot.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumns({"_slots": F.count("*").over(in_run), "_requests": F.sum("_rows").over(in_run)})
    )
    runs = materialise(runs, "request-runs")
    short = (F.col("_slots") > 1) & (F.col("_requests") <= folded)
    accepted = (
        runs.filter("_slots = 1")
        .select(F.col("_first._id").alias("_id"))
        .unionByName(_folded(timed, runs.filter(short), ttl))
    )
    long = runs.filter((F.col("_slots") > 1) & ~short)
    longest = long.agg(F.max("_slots")).first()[0] or 0
    if longest:
        times = materialise(
            timed.join(long.select("key", "_slot"), ["key", "_slot"], "left_semi")
            .groupBy("key", "_slot", "_at")
            .agg(F.min("_id").alias("_id")),
            "request-times",
        )
        chosen = _chains(times, long, ttl, longest)
        accepted = accepted.unionByName(times.join(chosen, ["key", "_at"]).select("_id"))
    won = accepted.select(F.col("_id").alias(id_column), F.lit(True).alias("_won"))
    return (
        requests.join(won, id_column, "left")
        .withColumn("accepted", F.coalesce("_won", F.lit(False)))
        .drop("_won")
    )


def _folded(timed: DataFrame, runs: DataFrame, ttl: int) -> DataFrame:
    """Accepted ids of short runs: each run's requests in order, in one row."""
    kind = timed.schema["_id"].dataType.simpleString()
    in_order = F.array_sort(F.collect_list(F.struct("_at", "_id")))
    start = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast(f"array<{kind}>").alias("ids"))

    def step(state: Column, request: Column) -> Column:
        opens = state["last"].isNull() | (request["_at"] - state["last"] >= ttl)
        return F.struct(
            F.when(opens, request["_at"]).otherwise(state["last"]).alias("last"),
            F.when(opens, F.concat(state["ids"], F.array(request["_id"]))).otherwise(state["ids"]).alias("ids"),
        )

    return (
        timed.join(runs.select("key", "_slot", "_run"), ["key", "_slot"])
        .groupBy("key", "_run")
        .agg(in_order.alias("_requests"))
        .select(F.explode(F.aggregate("_requests", start, step, lambda s: s["ids"])).alias("_id"))
    )


def _steps(times: DataFrame, runs: DataFrame, ttl: int) -> DataFrame:
    """(key, _at, _next): the first time of the key's run at least a time to live later.

    It lies in the next slot, or else is the first of the slot after; only the times of two
    neighbouring slots meet.
    """
    by_run = Window.partitionBy("key", "_run").orderBy("_slot")
    ahead = runs.select(
        "key",
        "_slot",
        (F.lead("_slot").over(by_run) == F.col("_slot") + 1).alias("_near"),
        F.lead("_first._at", 1).over(by_run).alias("_one"),
        F.lead("_first._at", 2).over(by_run).alias("_two"),
    )
    asked = times.select(
        "key",
        (F.col("_slot") + 1).alias("_slot"),
        (F.col("_at") + ttl).alias("_value"),
        F.lit(None).cast("long").alias("_time"),
        F.col("_at").alias("_from"),
    )
    known = times.select(
        "key", "_slot", F.col("_at").alias("_value"), F.col("_at").alias("_time"), F.lit(None).cast("long").alias("_from")
    )
    later = (
        Window.partitionBy("key", "_slot")
        .orderBy(F.col("_value").desc(), F.col("_time").desc_nulls_last())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    found = (
        known.unionByName(asked)
        .withColumn("_found", F.min("_time").over(later))
        .filter(F.col("_from").isNotNull())
        .select("key", (F.col("_slot") - 1).alias("_slot"), F.col("_from").alias("_at"), "_found")
    )
    # Without a next slot in a row the run's next one begins late enough by itself.
    step = F.when(F.col("_near"), F.coalesce("_found", "_two")).otherwise(F.col("_one"))
    return found.join(ahead, ["key", "_slot"]).select("key", "_at", step.alias("_next")).filter("_next IS NOT NULL")


def _chains(times: DataFrame, runs: DataFrame, ttl: int, longest: int) -> DataFrame:
    """(key, _at) of all times that steps reach from the first of their run.

    After a round every step is twice as long and twice as much is reached, so a run of n
    slots takes log2(n) rounds.
    """
    first = Window.partitionBy("key", "_run").orderBy("_slot")
    reached = (
        runs.withColumn("_n", F.row_number().over(first))
        .filter("_n = 1")
        .select("key", F.col("_first._at").alias("_at"))
    )
    steps = materialise(_steps(times, runs, ttl), "request-steps")
    span = 1
    while span < longest:
        onward = reached.join(steps, ["key", "_at"]).select("key", F.col("_next").alias("_at"))
        reached = materialise(reached.unionByName(onward).distinct(), "request-reached")
        span *= 2
        if span < longest:
            second = steps.select("key", F.col("_at").alias("_next"), F.col("_next").alias("_then"))
            steps = materialise(
                steps.join(second, ["key", "_next"]).select("key", "_at", F.col("_then").alias("_next")),
                "request-steps",
            )
    return reached
