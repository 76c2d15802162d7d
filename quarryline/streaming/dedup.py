"""Suppressing repeated requests in a stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from quarryline.operators.requests import TTL_SECONDS, accept_first
from quarryline.session import remove

KEEP_SECONDS = 24 * 3600

_ACCEPTED = "key string, request_id long, ts timestamp"


def drop_repeats(requests: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """First row per key within the watermark; late rows are dropped.

    State is kept until the watermark passes, so a key may stay closed for longer than
    one time to live after its first row. `accept_first_stream` and `accept_first_keyed` are exact.
    """
    return requests.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["key"])


def accept_first_stream(
    requests: DataFrame,
    target: str,
    checkpoint: str,
    ttl_seconds: int = TTL_SECONDS,
    keep_seconds: int = KEEP_SECONDS,
) -> StreamingQuery:
    """Stores accepted requests (key, request_id, ts) of all available input, then stops.

    Beside its accepted rows a batch stores the last accepted time of every key. The next batch
    drops rows closer than the time to live to it, then applies the batch operator to the rest,
    so a hot key is handled as it is there; no earlier output is read. A batch writes its own
    numbered folders with overwrite and reads those of the number before: a repeated batch
    replaces itself. Rows that arrive after a later one of their key was accepted count as
    repeats of it. Keys at rest for `keep_seconds` before the newest row are forgotten; input may
    come that much out of order.
    """
    ttl = F.expr(f"INTERVAL {int(ttl_seconds)} SECONDS")
    keep = F.expr(f"INTERVAL {int(max(keep_seconds, ttl_seconds))} SECONDS")

    def state_path(number: int) -> str:
        return f"{target}/_state/batch={number}"

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("key", "request_id", F.col("ts").cast("timestamp").alias("ts"))
        last = spark.createDataFrame([], "key string, last timestamp")
        if number > 0:
            last = spark.read.schema(last.schema).parquet(state_path(number - 1))
            rows = (
                rows.join(last, "key", "left")
                .filter(F.col("last").isNull() | (F.col("ts") >= F.col("last") + ttl))
                .drop("last")
            )
        accepted = accept_first(rows, ttl_seconds).filter("accepted").drop("accepted")
        folder = f"{target}/batch={number}"
        accepted.select("key", "request_id", "ts").write.mode("overwrite").parquet(folder)
        fresh = spark.read.schema(_ACCEPTED).parquet(folder).select("key", F.col("ts").alias("last"))
        known = last.unionByName(fresh).groupBy("key").agg(F.max("last").alias("last"))
        newest = known.agg(F.max("last")).first()[0]
        known.filter(F.col("last") > F.lit(newest) - keep).write.mode("overwrite").parquet(state_path(number))
        if number > 1:
            remove(spark, state_path(number - 2))

    return (
        requests.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


class _FirstPerTime(StatefulProcessor):
    """Keeps the last accepted time of a key until the watermark is a time to live past it."""

    def __init__(self, ttl_seconds: int):
        self.ttl = ttl_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", StructType([StructField("at", LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # Two numbers of every row of the key in this batch.
        parts = [(p["at"].to_numpy(np.int64), p["request_id"].to_numpy(np.int64)) for p in rows]
        at, ids = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((ids, at))
        at, ids = at[order], ids[order]
        before = self.last.get()[0] if self.last.exists() else None
        taken = []
        place = 0 if before is None else int(np.searchsorted(at, before + self.ttl))
        while place < len(at):
            taken.append(place)
            place = int(np.searchsorted(at, at[place] + self.ttl))
        if taken:
            newest = int(at[taken[-1]])
            if before is not None:
                self.handle.deleteTimer(self._expiry(before))
            self.last.update((newest,))
            self.handle.registerTimer(self._expiry(newest))
            yield pd.DataFrame({"key": [key[0]] * len(taken), "request_id": ids[taken], "at": at[taken]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def _expiry(self, at: int) -> int:
        return (at + self.ttl) // 1000 + 1

    def close(self) -> None:
        pass


def accept_first_keyed(
    requests: DataFrame, ttl_seconds: int = TTL_SECONDS, lateness: str = "1 hour"
) -> DataFrame:
    """Accepted requests (key, request_id, ts) as a stream of its own, with state per key.

    The state is one time per key. A timer clears it once the watermark has passed that time by
    the time to live: whatever still comes is accepted without it. Rows later than `lateness` are
    dropped; all others follow the batch rule within each batch, in order of time, then id. The
    rows that a key has in one batch meet in one task, two numbers each; `accept_first_stream`
    deals them out. Needs a state store that holds columns (RocksDB).
    """
    rows = requests.select("key", "request_id", F.col("ts").cast("timestamp").alias("ts"))
    timed = rows.withWatermark("ts", lateness).withColumn("at", F.unix_micros("ts"))
    found = timed.groupBy("key").transformWithStateInPandas(
        _FirstPerTime(ttl_seconds), "key string, request_id long, at long", "append", "eventtime"
    )
    return found.select("key", "request_id", F.timestamp_micros("at").alias("ts"))


def accepted_rows(spark: SparkSession, target: str) -> DataFrame:
    """Everything accepted so far, with the number of its batch."""
    return spark.read.schema(f"{_ACCEPTED}, batch long").option("basePath", target).parquet(
        f"{target}/batch=*"
    )
