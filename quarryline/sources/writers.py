"""Writing raw objects, chunk manifests, vectors, run manifests and ledger rows.

Every writer appends or writes to a new path; a path being read is never overwritten.
"""

from __future__ import annotations

import os
from zlib import crc32

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline import schemas
from quarryline.operators import chunk as ck
from quarryline.operators.index import upsert


def write_objects(files: DataFrame, path: str) -> None:
    """Accepted files partitioned by document."""
    files.write.mode("append").partitionBy("document_id").parquet(path)


# Folders that text objects are dealt over, so that a listing is shared out among tasks.
OBJECT_FOLDERS = 256


def write_texts(texts: DataFrame, path: str) -> None:
    """A text object per document and task below a new path; every row is ended by a line break.

    `texts` has document_id and content. An object is found by `object_owner`. On a local or
    mounted file system Spark's writer runs several programs per file to set its rights, and
    moves each file in the driver; there the tasks write the objects themselves. A task that
    runs twice writes the same objects again.
    """
    texts = texts.select("document_id", "content")
    folder = texts.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(texts.sparkSession._jsc.hadoopConfiguration())
    if system.getScheme() != "file":
        return texts.write.partitionBy("document_id").text(path)
    root = folder.toUri().getPath()

    def run(rows):
        number, held, out = TaskContext.get().partitionId(), None, None
        for document, content in rows:
            name = DEFAULT_OWNER if document is None else document
            if name != held:
                if out:
                    out.close()
                below = f"{root}/{crc32(name.encode()) % OBJECT_FOLDERS:03d}"
                os.makedirs(below, exist_ok=True)
                held, out = name, open(f"{below}/document_id={name}.{number}.txt", "wb")
            out.write((content or "").encode() + b"\n")
        if out:
            out.close()

    os.makedirs(root, exist_ok=True)
    texts.sortWithinPartitions("document_id").foreachPartition(run)


# What Spark calls the folder of rows without a document.
DEFAULT_OWNER = "__HIVE_DEFAULT_PARTITION__"


def object_owner(path: Column) -> Column:
    """The document of an object of `write_texts`."""
    return F.regexp_extract(path, r"document_id=([^/]+?)(\.\d+\.txt$|/)", 1)


def write_chunk_manifest(chunks: DataFrame, path: str) -> None:
    """Manifest as JSON lines: one head per document and one line per chunk."""
    ck.manifest_totals(chunks).write.mode("append").json(f"{path}/documents")
    ck.manifest_entries(chunks).write.mode("append").json(f"{path}/chunks")


def write_vectors(rows: DataFrame, path: str, files: int | None = None) -> None:
    """Vector rows partitioned by collection, spread by chunk id within it."""
    spread = rows if files is None else rows.repartition(files, "chunk_id")
    spread.write.mode("append").partitionBy("collection").parquet(path)


def rewrite_vectors(existing: DataFrame, incoming: DataFrame, new_path: str) -> DataFrame:
    """Upsert by chunk id into a new path; empty input rewrites nothing.

    Returns the table to use from now on.
    """
    if incoming.isEmpty():
        return existing
    merged = upsert(existing, incoming)
    write_vectors(merged, new_path)
    return existing.sparkSession.read.schema(merged.schema).parquet(new_path)


def run_manifests(
    documents: DataFrame, chunks: DataFrame, run_id: str, finished_at: Column, latency_ms: Column
) -> DataFrame:
    """One row per (run, document): result of every step, status, error, chunk count.

    `documents` has document_id, document_type, register_status and error.
    """
    totals = chunks.groupBy("document_id").agg(F.count("*").alias("_n"))
    count = F.coalesce(F.col("_n"), F.lit(0))
    failed = F.col("error").isNotNull()
    step = F.when(failed, "failed").otherwise("completed")
    embedded = F.when(failed, "failed").when(count == 0, "skipped").otherwise("completed")
    return documents.join(totals, "document_id", "left").select(
        F.lit(run_id).alias("run_id"),
        F.to_date(finished_at).alias("run_date"),
        "document_id",
        "document_type",
        F.struct(
            F.col("register_status").alias("register"),
            step.alias("parse"),
            step.alias("chunk"),
            embedded.alias("embed"),
            embedded.alias("index"),
        ).alias("steps"),
        F.when(failed, 1).otherwise(5).alias("steps_completed"),
        F.when(failed, "failed").otherwise("completed").alias("status"),
        "error",
        count.alias("chunk_count"),
        latency_ms.cast("long").alias("latency_ms"),
    )


def write_run_manifests(manifests: DataFrame, path: str) -> None:
    manifests.write.mode("append").partitionBy("run_date").json(path)


def ledger_rows(events: DataFrame) -> DataFrame:
    """Events under the ledger's schema; absent columns are null, metadata stays a map."""
    return events.select(
        *[
            (F.col(f.name) if f.name in events.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schemas.COST_EVENTS
        ]
    )


def append_costs(events: DataFrame, path: str) -> None:
    """Ledger rows by day, metadata as JSON text."""
    rows = ledger_rows(events).withColumn("metadata", F.to_json("metadata"))
    rows.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def append_rows(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)
