"""Runs that write several tables and become visible at once.

Every run writes its tables below `<table>/run=<run>/attempt=<id>`, and last one marker row below
`_marks`. Readers take the rows of marked attempts only: of a run, the one marked last. So a run
that fails between two tables shows nothing, a repeated run takes its own place in one step, and
readers of the old attempt are not disturbed. A run may also take the place of other runs, which
is how small ones are folded into one.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

MARKS = "run string, attempt string, at long, replaces array<string>, kinds map<string,string>"
# So many attempts are named in the filter of a scan; more are looked up by a join.
NAMED_ATTEMPTS = 1000
_OWN = ("run", "attempt")


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def marks(spark: SparkSession, path: str) -> DataFrame:
    """All marker rows; empty before the first run."""
    if not _exists(spark, f"{path}/_marks"):
        return spark.createDataFrame([], MARKS)
    return spark.read.schema(MARKS).parquet(f"{path}/_marks")


def visible(spark: SparkSession, path: str) -> DataFrame:
    """Marker rows of the attempts that readers see: the last of each run that no other replaces."""
    marked = marks(spark, path)
    last = Window.partitionBy("run").orderBy(F.desc("at"), F.desc("attempt"))
    newest = marked.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")
    replaced = marked.select(F.explode("replaces").alias("run")).distinct()
    return newest.join(replaced, "run", "left_anti")


def commit(
    spark: SparkSession,
    path: str,
    run: str,
    tables: Mapping[str, DataFrame],
    *,
    partition_by: Sequence[str] = (),
    replaces: Sequence[str] = (),
) -> str:
    """Writes all `tables` of a run, then marks it; returns the id of this attempt.

    A run that another one has replaced is closed and cannot be written again, since its rows
    are counted there.
    """
    if not re.fullmatch(r"[\w.-]+", run):
        raise ValueError(f"a run is named by letters, digits, '_', '.', '-': {run!r}")
    if marks(spark, path).filter(F.array_contains("replaces", run)).limit(1).count():
        raise ValueError(f"run {run!r} has been folded into another one")
    for name, rows in tables.items():
        clash = {c.lower() for c in rows.columns} & set(_OWN)
        if clash:
            raise ValueError(f"table {name!r} has columns {sorted(clash)} that runs use themselves")
    attempt = uuid.uuid4().hex
    for name, rows in tables.items():
        rows.write.partitionBy(*partition_by).parquet(f"{path}/{name}/run={run}/attempt={attempt}")
    row = (run, attempt, time.time_ns(), list(replaces), {n: t.schema.json() for n, t in tables.items()})
    mark = spark.createDataFrame([row], MARKS).coalesce(1)
    mark.write.mode("append").parquet(f"{path}/_marks")
    return attempt


def read(spark: SparkSession, path: str, table: str, with_run: bool = False) -> DataFrame:
    """Rows of a table from all visible runs that hold it, with their run on demand."""
    holding = visible(spark, path).filter(F.map_contains_key("kinds", table))
    newest = holding.orderBy(F.desc("at")).select(F.col("kinds")[table].alias("kind")).first()
    if newest is None:
        raise ValueError(f"no marked run holds a table {table!r} below {path}")
    kind = StructType.fromJson(json.loads(newest.kind))
    full = StructType([*kind.fields]).add("run", StringType()).add("attempt", StringType())
    rows = spark.read.schema(full).parquet(f"{path}/{table}")
    seen = holding.select("attempt")
    named = [r.attempt for r in seen.limit(NAMED_ATTEMPTS + 1).collect()]
    if len(named) <= NAMED_ATTEMPTS:
        rows = rows.filter(F.col("attempt").isin(named))
    else:
        rows = rows.join(seen, "attempt", "left_semi")
    return rows.select(*kind.names, *(["run"] if with_run else []))

