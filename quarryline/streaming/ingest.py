"""New documents through the batch functions, one micro-batch at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarryline.plans.corpus import ingest
from quarryline.schemas import PAGES
from quarryline.session import fresh_path

PAGE_BUCKETS = 64


def page_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Page rows as they arrive in a folder of Parquet files."""
    return (
        spark.readStream.schema(PAGES)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(path)
    )


def ingest_stream(
    pages: DataFrame,
    target: str,
    checkpoint: str,
    transform: Callable[[DataFrame], DataFrame] = ingest,
    files: int | None = None,
    buckets: int = PAGE_BUCKETS,
) -> StreamingQuery:
    """Parses, chunks, embeds and stores all available pages, then stops.

    Pages are kept by bucket of their document. A batch brings back all pages of the documents
    it touches, whichever batches they came in (of one page number the newest), and ingests
    those documents anew; only their buckets are read. It writes under its own number with
    overwrite, so a batch that is run again after a failure replaces itself. `latest_rows`
    keeps the rows that a document got last.
    """

    def store(batch: DataFrame, number: int) -> None:
        bucket = F.pmod(F.xxhash64("document_id"), F.lit(buckets)).cast("int")
        placed = batch.withColumn("bucket", bucket)
        placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/pages/batch={number}")
        session = batch.sparkSession
        arrived = _numbered(session, f"{target}/pages").filter(F.col("batch") == number)
        touched = arrived.select("bucket", "document_id").distinct()
        # At most `buckets` numbers, which become a partition filter.
        needed = sorted(r.bucket for r in touched.select("bucket").distinct().collect())
        stored = _numbered(session, f"{target}/pages").filter(
            F.col("bucket").isin(needed) & (F.col("batch") <= number)
        )
        columns = [c for c in batch.columns if c not in ("document_id", "page_no")]
        whole = (
            stored.join(touched, ["bucket", "document_id"], "left_semi")
            .groupBy("document_id", "page_no")
            .agg(F.max_by(F.struct(*columns), "batch").alias("_page"))
            .select("document_id", "page_no", "_page.*")
        )
        rows = transform(whole.select(*batch.columns))
        spread = rows if files is None else rows.repartition(files, "chunk_id")
        spread.write.mode("overwrite").parquet(f"{target}/rows/batch={number}")

    return (
        pages.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*")


def latest_rows(spark: SparkSession, target: str) -> DataFrame:
    """Rows of every document from the last batch that touched it; older ones are stale.

    Only ids and batch numbers are grouped, never the rows with their vectors.
    """
    last = _numbered(spark, f"{target}/pages").groupBy("document_id").agg(F.max("batch").alias("batch"))
    rows = _numbered(spark, f"{target}/rows")
    return rows.join(last, ["document_id", "batch"], "left_semi").drop("batch")


def run_available(spark: SparkSession, path: str, files_per_batch: int = 1000, **options) -> DataFrame:
    """Everything now in `path`, ingested incrementally; returns the resulting table."""
    target = fresh_path(spark, "ingest")
    stream = page_stream(spark, path, files_per_batch)
    ingest_stream(stream, target, fresh_path(spark, "ingest-checkpoint"), **options).awaitTermination()
    return latest_rows(spark, target)
