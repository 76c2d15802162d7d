"""Tables kept in hash buckets, of which a change reads and rewrites only those it touches.

A table lies below `rows/bucket=n`; `layout` holds the column that is hashed and the number of
buckets. A change finds the buckets of the rows that come in, merges those buckets alone, writes
the result aside and then overwrites their partitions. Nothing else is read or written. A run that
fails before the overwrite has changed nothing; one that fails within it is put right by running
the change again, since every change is idempotent and what it read lies aside.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, MapType, StructType

from quarryline.operators import catalog as cat
from quarryline.operators import index
from quarryline.session import fresh_path, remove

ROWS_PER_BUCKET = 1_000_000
# Rows of one bucket go to so many files at least, whatever share of them one key has.
FILES_PER_BUCKET = 1


def buckets_for(rows: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    """Buckets that hold about so many rows each."""
    return max(1, -(-rows // rows_per_bucket))


def bucket_of(column: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(column)), F.lit(buckets)).cast("int")


def create(
    rows: DataFrame, path: str, by: str, buckets: int | None = None, files_per_bucket: int = FILES_PER_BUCKET
) -> None:
    """Stores `rows` in buckets of the column `by`; the path must be new."""
    spark = rows.sparkSession
    buckets = buckets or buckets_for(rows.count())
    _dealt(rows.withColumn("bucket", bucket_of(by, buckets)), files_per_bucket).write.mode(
        "errorifexists"
    ).partitionBy("bucket").parquet(f"{path}/rows")
    layout = [(by, buckets, files_per_bucket, rows.schema.json())]
    spark.createDataFrame(layout, "by string, buckets int, files int, kind string").coalesce(1).write.parquet(
        f"{path}/layout"
    )


def _dealt(rows: DataFrame, files: int) -> DataFrame:
    """A bucket's rows together, or by a hash of the whole row in `files` parts."""
    hashed = [f.name for f in rows.schema.fields if not isinstance(f.dataType, MapType)]
    return rows.repartition("bucket", F.pmod(F.xxhash64(*hashed), F.lit(files)))


def _layout(spark: SparkSession, path: str):
    return spark.read.parquet(f"{path}/layout").first()


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table as it was given."""
    return _stored(spark, path).drop("bucket")


def _stored(spark: SparkSession, path: str) -> DataFrame:
    kind = StructType.fromJson(json.loads(_layout(spark, path).kind))
    return spark.read.schema(kind.add("bucket", IntegerType())).parquet(f"{path}/rows")


def touched(spark: SparkSession, path: str, keys: DataFrame) -> list[int]:
    """Buckets that the values of `keys` (the hashed column) lie in; at most all numbers."""
    layout = _layout(spark, path)
    found = keys.select(bucket_of(layout.by, layout.buckets).alias("bucket")).distinct().collect()
    return sorted(r.bucket for r in found)


def change(
    spark: SparkSession, path: str, keys: DataFrame, merge: Callable[[DataFrame], DataFrame]
) -> list[int]:
    """Replaces the rows of the buckets of `keys` by what `merge` makes of them.

    `merge` gets those rows only, and must leave every row in its bucket. Returns the buckets.
    """
    layout = _layout(spark, path)
    buckets = touched(spark, path, keys)
    if not buckets:
        return []
    part = _stored(spark, path).where(F.col("bucket").isin(buckets)).drop("bucket")
    merged = merge(part).withColumn("bucket", bucket_of(layout.by, layout.buckets))
    copy = fresh_path(spark, "changed-buckets")
    _dealt(merged, layout.files).write.parquet(copy)
    aside = spark.read.schema(merged.schema).parquet(copy)
    left = {r.bucket for r in aside.select("bucket").distinct().collect()}
    if not left <= set(buckets):
        raise ValueError("a changed row belongs to a bucket that the change does not touch")
    _dealt(aside, layout.files).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "bucket"
    ).parquet(f"{path}/rows")
    for bucket in set(buckets) - left:
        # Nothing is written for a bucket that has no rows left.
        remove(spark, f"{path}/rows/bucket={bucket}")
    remove(spark, copy)
    spark.catalog.refreshByPath(f"{path}/rows")
    return buckets


def upsert(spark: SparkSession, path: str, incoming: DataFrame, key: str = "chunk_id") -> list[int]:
    """Existing rows whose key does not come in, and all incoming rows (see `index.upsert`).

    The hashed column must follow from the key, as a chunk's document does.
    """
    by = _layout(spark, path).by
    return change(spark, path, incoming.select(by), lambda rows: index.upsert(rows, incoming, key))


def delete(spark: SparkSession, path: str, doomed: DataFrame) -> list[int]:
    """Without the rows whose hashed column is listed in `doomed`."""
    by = _layout(spark, path).by
    return change(spark, path, doomed.select(by), lambda rows: cat.delete(rows, doomed, by))


def update(spark: SparkSession, path: str, changes: DataFrame, now: Column | None = None) -> list[int]:
    """Applies `catalog.update` to the rows of the changed ids."""
    return change(spark, path, changes.select("id"), lambda rows: cat.update(rows, changes, now))


def delete_cascade(
    spark: SparkSession,
    doomed: DataFrame,
    catalog: str,
    dependants: list[str],
) -> dict[str, list[int]]:
    """Documents in `doomed` (column id) go from the stored catalog, and first what hangs on them.

    `dependants` are stored tables in buckets of document_id, outermost first: a run that fails
    on the way leaves no row without its document, and can be repeated.
    """
    of_document = doomed.select(F.col("id").alias("document_id"))
    out = {path: delete(spark, path, of_document) for path in dependants}
    out[catalog] = delete(spark, catalog, doomed.select("id"))
    return out
