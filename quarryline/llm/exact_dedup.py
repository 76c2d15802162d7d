"""Exact duplicates by composable polynomial fingerprints, checked chunk by chunk."""

from __future__ import annotations

import hashlib
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import arrow_map, byte_values, keep_rows, text_mark, written

PRIMES = (2147483647, 2147483629)
BASES = (1111111121, 1987654331)
# Sums of a block stay below 2^53, so float64 products of 8-bit and 31-bit numbers are exact.
BLOCK = 8192
# Bytes hashed, and bytes compared, at a time.
CHUNK = 1 << 20

Print = tuple[int, int, int]  # length, value under either prime
EMPTY: Print = (0, 0, 0)


@cache
def _powers() -> np.ndarray:
    columns = []
    for p, r in zip(PRIMES, BASES):
        column = [1]
        for _ in range(BLOCK - 1):
            column.append(column[-1] * r % p)
        columns.append(column[::-1])
    return np.array(columns, np.float64).T.copy()


def combine(left: Print, right: Print) -> Print:
    """Fingerprint of two strings put together: the left value moves up by the right length."""
    return (
        left[0] + right[0],
        *((a * pow(r, right[0], p) + b) % p for a, b, p, r in zip(left[1:], right[1:], PRIMES, BASES)),
    )


def chunk_print(data: bytes) -> Print:
    """Fingerprint of one chunk: blocks by one matrix product, then combined."""
    if not data:
        return EMPTY
    head = len(data) % BLOCK
    digits = np.frombuffer(data, np.uint8)
    parts = []
    if head:
        values = (digits[:head].astype(np.float64) + 1) @ _powers()[BLOCK - head :]
        parts.append((head, *(int(v) % p for v, p in zip(values, PRIMES))))
    if len(data) > head:
        values = (digits[head:].astype(np.float64) + 1).reshape(-1, BLOCK) @ _powers()
        parts += [(BLOCK, *(int(v) % p for v, p in zip(row, PRIMES))) for row in values]
    return reduce(combine, parts)


def fingerprint(data: bytes, chunk: int = CHUNK) -> Print:
    """Fingerprint of a string of any length from those of its chunks, however it is cut."""
    return reduce(combine, (chunk_print(data[i : i + chunk]) for i in range(0, len(data), chunk)), EMPTY)


def packed(value: Print) -> int:
    return value[1] << 31 | value[2]


def same(left: bytes, right: bytes, chunk: int = CHUNK) -> bool:
    """Chunkwise comparison that stops at the first difference."""
    if len(left) != len(right):
        return False
    a, b = memoryview(left), memoryview(right)
    return all(a[i : i + chunk] == b[i : i + chunk] for i in range(0, len(left), chunk))


def prints(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, fingerprint, n_bytes, sha256, mark) of every text with A-Z lower-cased."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t.lower() for t in byte_values(batch.column(1))]
        values = [fingerprint(t) for t in texts]
        return pa.record_batch(
            [
                batch.column(0),
                pa.array([packed(v) for v in values], pa.int64()),
                pa.array([v[0] for v in values], pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
                batch.column(2),
            ],
            ["id", "fingerprint", "n_bytes", "sha256", "mark"],
        )

    rows = docs.select(
        F.col(id_column).cast("long").alias("id"),
        F.col(text_column).alias("text"),
        text_mark(text_column).alias("mark"),
    )
    return arrow_map(rows, run, "id long, fingerprint long, n_bytes long, sha256 string, mark long")


def _bodies(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t.lower() for t in byte_values(batch.column(1))]
        return pa.record_batch(
            [
                batch.column(0),
                pa.array([packed(fingerprint(t)) for t in texts], pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array(texts, pa.binary()),
            ],
            ["id", "fingerprint", "n_bytes", "body"],
        )

    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    return arrow_map(rows, run, "id long, fingerprint long, n_bytes long, body binary")


KEY = ["fingerprint", "n_bytes"]


def clashes(docs: DataFrame, groups: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Keys of `groups` (fingerprint, n_bytes, keep_id) under which two different texts fell.

    Each text of a group is compared with that of the group's largest id. The join meets one
    row per group, so a group with a third of all rows is split among tasks.
    """
    bodies = _bodies(docs, id_column, text_column)
    # Met by id as well, leaders are found without bringing a whole group together.
    is_leader = (bodies.id.eqNullSafe(groups.keep_id)) & (bodies.fingerprint == groups.fingerprint)
    leaders = (
        bodies.join(groups, is_leader & (bodies.n_bytes == groups.n_bytes))
        .select(bodies.fingerprint, bodies.n_bytes, bodies.body.alias("leader"))
        .dropDuplicates(KEY)
    )

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, leader = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        differs = pa.array([not same(a, b) for a, b in zip(own, leader)], pa.bool_())
        return batch.select([0, 1]).filter(differs)

    pairs = _bodies(docs, id_column, text_column).join(leaders, KEY).select(*KEY, "body", "leader")
    return arrow_map(pairs, run, "fingerprint long, n_bytes long").distinct()


def exact_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(id, keep_id, group_size, kept, sha256, mark, fingerprint, n_bytes): one row per row of `docs`.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts
    the row with the largest id stays; null ids lose against any other (a group of null ids
    only has a null `keep_id`). Repeated rows of one id share their decision. Texts with equal
    fingerprints are compared; where two differ, the whole SHA-256 parts their groups.
    """
    rows = written(prints(docs, id_column, text_column), "prints")
    groups = rows.groupBy(*KEY).agg(F.count("*").alias("size"), F.max("id").alias("keep_id"))
    shared = groups.where("size > 1").select(*KEY, "keep_id")
    apart = written(clashes(docs, shared, id_column, text_column), "clashes")
    part = F.when(F.col("apart"), F.col("sha256")).otherwise(F.lit(""))
    rows = rows.join(apart.withColumn("apart", F.lit(True)), KEY, "left").withColumn("part", part)
    final = rows.groupBy(*KEY, "part").agg(F.count("*").alias("group_size"), F.max("id").alias("keep_id"))
    return rows.join(final, [*KEY, "part"]).select(
        "id",
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "sha256",
        "mark",
        *KEY,
    )


def without_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """The rows of `docs` that stay, with all their columns; of repeated rows one stays."""
    decided = exact_duplicates(docs, id_column, text_column).where("kept")
    stay = decided.groupBy("id", "sha256").agg(F.min("mark").alias("mark"))
    return keep_rows(docs, stay, id_column, text_column)
