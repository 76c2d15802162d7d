"""Intake: upload checks, type from file name, catalog rows, duplicates, requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions import text as fx

# Fixed values.
SUPPORTED_MIME_TYPES = ("application/pdf",)
MAX_FILE_BYTES = 100 * 1024 * 1024
MAX_QUESTION_CHARS = 1000
TOP_K_RANGE = (1, 100)
CONTEXT_LIMIT_RANGE = (1, 20)
LIST_LIMIT_RANGE = (1, 200)
THRESHOLD_RANGE = (0.0, 1.0)


def validate_uploads(files: DataFrame) -> DataFrame:
    """Adds `reject_reason` (first failing rule, null when accepted) and `accepted`."""
    name = F.coalesce(F.col("filename"), F.lit(""))
    mime = F.coalesce(F.col("content_type"), F.lit(""))
    size = F.octet_length("content")
    reason = (
        F.when(name == "", "no_filename")
        .when(~F.lower(name).endswith(".pdf"), "unsupported_extension")
        .when((mime != "") & ~mime.isin(*SUPPORTED_MIME_TYPES), "unsupported_mime_type")
        .when(size > MAX_FILE_BYTES, "too_large")
        .when(F.coalesce(size, F.lit(0)) == 0, "empty_file")
    )
    return files.withColumn("reject_reason", reason).withColumn(
        "accepted", F.col("reject_reason").isNull()
    )


def split_accepted(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected rows of a checked table."""
    return checked.filter("accepted"), checked.filter("not accepted")


def document_type(filename: Column) -> Column:
    """Type from the file name; separators unified, doubled ones once."""
    name = F.lower(F.coalesce(filename, F.lit("")))
    for old, new in (("-", "_"), (" ", "_"), ("__", "_")):
        name = F.replace(name, F.lit(old), F.lit(new))
    return (
        F.when(name.contains("transcript"), "transcript")
        .when(name.contains("earnings") & name.contains("release"), "earnings_release")
        .when(name.contains("slide") | name.contains("deck"), "slide_deck")
        .otherwise("general")
    )


def catalog_rows(files: DataFrame) -> DataFrame:
    """Catalog rows of accepted files, status `uploaded`."""
    mime = F.coalesce(fx.truthy(F.col("content_type")), F.lit(fx.DEFAULT_MIME_TYPE))
    return files.select(
        F.col("document_id").alias("id"),
        "filename",
        F.col("filename").alias("original_filename"),
        mime.alias("content_type"),
        F.octet_length("content").cast("long").alias("file_size"),
        fx.checksum(F.col("content")).alias("checksum"),
        document_type(F.col("filename")).alias("doc_type"),
        F.lit("uploaded").alias("status"),
        storage_path(F.col("document_id"), F.col("filename")).alias("raw_path"),
        F.lit(None).cast("string").alias("processed_path"),
        F.lit(None).cast("int").alias("page_count"),
        F.create_map(
            F.lit("content_type"), mime, F.lit("original_filename"), F.col("filename")
        ).alias("processing_metadata"),
        F.lit(None).cast("string").alias("error_message"),
        F.col("arrived_at").alias("created_at"),
        F.col("arrived_at").alias("updated_at"),
    )


def storage_path(document_id: Column, filename: Column, prefix: str = "documents") -> Column:
    return F.concat_ws("/", F.lit(prefix), document_id, filename)


def reject_duplicates(rows: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """Marks each row `unique` or not by checksum; the earliest arrival wins.

    The winner per checksum is a map-side combined minimum, so a third of all rows
    being copies of one file costs one partial row per task. Winners are matched back
    on the unique row id. Checksums already in `catalog` never win.
    """
    first = rows.groupBy("checksum").agg(
        F.min(F.struct(F.col("created_at"), F.col("id"))).alias("first")
    )
    if catalog is not None:
        first = first.join(catalog.select("checksum"), "checksum", "left_anti")
    winners = first.select(F.col("first.id").alias("id"), F.lit(True).alias("_won"))
    return (
        rows.join(winners, "id", "left")
        .withColumn("unique", F.coalesce(F.col("_won"), F.lit(False)))
        .drop("_won")
    )


def register(documents: DataFrame, registered: DataFrame, force: bool = False) -> DataFrame:
    """Status `completed` for ids to process, `skipped` for ids already registered."""
    known = registered.select(F.col("id"), F.lit(True).alias("_known")).dropDuplicates(["id"])
    seen = F.coalesce(F.col("_known"), F.lit(False)) & F.lit(not force)
    return (
        documents.join(known, "id", "left")
        .withColumn("register_status", F.when(seen, "skipped").otherwise("completed"))
        .drop("_known")
    )


def file_metadata(files: DataFrame) -> DataFrame:
    """Name, extension, MIME type, size, readable size and checksum of every file."""
    name = F.col("filename")
    size = F.octet_length("content").cast("long")
    return files.select(
        "document_id",
        name,
        fx.file_extension(name).alias("extension"),
        fx.mime_type(name).alias("mime_type"),
        size.alias("size"),
        fx.format_bytes(size).alias("size_human"),
        fx.checksum(F.col("content")).alias("checksum"),
    )


def validate_requests(requests: DataFrame) -> DataFrame:
    """Strips `text` and names the first bound a request breaks.

    Columns `top_k`, `context_limit`, `list_limit`, `threshold` and `filename` are
    checked where the table has them; a null means "not given".
    """
    length = F.length("text")
    reason = F.when(F.col("text").isNull() | (length < 1), "text_too_short").when(
        length > MAX_QUESTION_CHARS, "text_too_long"
    )
    reason = reason.when(fx.is_blank(F.col("text")), "text_blank")
    for column, (low, high) in (
        ("top_k", TOP_K_RANGE),
        ("context_limit", CONTEXT_LIMIT_RANGE),
        ("list_limit", LIST_LIMIT_RANGE),
        ("threshold", THRESHOLD_RANGE),
    ):
        if column in requests.columns:
            reason = reason.when(~F.col(column).between(low, high), f"{column}_out_of_range")
    if "filename" in requests.columns:
        reason = reason.when(
            F.col("filename").isNotNull() & fx.is_blank(F.col("filename")), "filename_blank"
        )
    return (
        requests.withColumn("reject_reason", reason)
        .withColumn("accepted", F.col("reject_reason").isNull())
        .withColumn("text", fx.strip(F.col("text")))
    )
