"""Reading raw objects, page text, stored tables and vector collections."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline import schemas
from quarryline.functions import text as fx
from quarryline.functions.binding import bind
from quarryline.session import materialise

# Bytes of content that a task reads at a time, and about as many bytes and objects as it reads in all.
BYTES_AT_ONCE = 16 << 20
BYTES_PER_TASK, OBJECTS_PER_TASK = 256 << 20, 20_000
ENTRIES_AT_ONCE = 10_000


def raw_objects(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Objects below a folder: path, content, length, modificationTime.

    As Spark's reader has it, empty objects and hidden ones are left out. That reader holds the
    status of every object in the driver; a folder of a local or mounted file system is listed
    by the tasks, level by level, into a table, and its objects are opened where they are asked for.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.getScheme() != "file" or not system.exists(folder) or not system.getFileStatus(folder).isDirectory():
        return (
            spark.read.format("binaryFile")
            .option("pathGlobFilter", pattern)
            .option("recursiveFileLookup", "true")
            .load(path)
        )
    wanted = spark._jvm.org.apache.hadoop.fs.GlobPattern(pattern).compiled().pattern()
    name = F.element_at(F.split("path", "/"), -1)
    listing = _listing(spark, folder.toUri().getPath()).where("length > 0").where(name.rlike(rf"(?s)\A(?:{wanted})\z"))
    total = listing.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
    tasks = max(total.bytes // BYTES_PER_TASK, total.n // OBJECTS_PER_TASK, spark.sparkContext.defaultParallelism)
    return listing.repartition(max(1, min(tasks, total.n)), "path").select(
        F.concat(F.lit("file:"), "path").alias("path"),
        F.timestamp_millis("modified").alias("modificationTime"),
        "length",
        F.arrow_udf(_contents, "binary")("path").alias("content"),
    )


ENTRY = "path string, modified long, length long, folder boolean"


def _listing(spark: SparkSession, root: str) -> DataFrame:
    """Everything that is no folder below a local folder: a table for every level of folders."""
    cores, found, folders, count = spark.sparkContext.defaultParallelism, [], None, 1
    while count:
        if folders is None:
            folders = spark.createDataFrame([(root,)], "path string")
        dealt = folders.repartition(min(count, 4 * cores), "path")
        entries = materialise(dealt.mapInArrow(_entries, ENTRY), "listing")
        found.append(entries.where("not folder"))
        folders = entries.where("folder").select("path")
        count = folders.count()
    out = found[0]
    for level in found[1:]:
        out = out.unionByName(level)
    return out.drop("folder")


def _seen(name: str) -> bool:
    """Whether Spark's readers look at a file or go into a folder of that name."""
    hidden = name.startswith("_") and "=" not in name or name.startswith(".") or name.endswith("._COPYING_")
    return not hidden


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["path", "modified", "length", "folder"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_()]
    rows: list[tuple] = []

    def batch():
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    for folders in batches:
        for folder in folders.column(0).to_pylist():
            with os.scandir(folder) as entries:
                for entry in entries:
                    if not _seen(entry.name):
                        continue
                    try:
                        status, below = entry.stat(), entry.is_dir()
                    except FileNotFoundError:
                        # A link to nothing, or gone meanwhile.
                        continue
                    rows.append((entry.path, status.st_mtime_ns // 1_000_000, status.st_size, below))
                    if len(rows) == ENTRIES_AT_ONCE:
                        yield batch()
                        rows = []
    if rows:
        yield batch()


def _contents(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The bytes of every path, a bounded number at a time."""
    for paths in batches:
        held, size = [], 0
        for path in paths.to_pylist():
            with open(path, "rb") as file:
                held.append(file.read())
            size += len(held[-1])
            if size >= BYTES_AT_ONCE:
                yield pa.array(held, pa.binary())
                held, size = [], 0
        if held:
            yield pa.array(held, pa.binary())


def spread(table: DataFrame) -> DataFrame:
    """Spreads a table that is stored in fewer pieces than there are cores.

    Text work is bound by computing, so a few large files should not decide how many
    tasks do it. A table in many files is left as it is.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else table.repartition(cores)


def measured(objects: DataFrame) -> DataFrame:
    """Size and sha256 of every object's content (bytes or text)."""
    return objects.withColumn("size_bytes", F.octet_length("content").cast("long")).withColumn(
        "sha256", fx.checksum(F.col("content"))
    )


def present(wanted: DataFrame, listing: DataFrame) -> DataFrame:
    """`object_exists` for wanted paths against a listing; contents are not read."""
    known = listing.select("path").distinct().withColumn("_hit", F.lit(True))
    return (
        wanted.join(known, "path", "left")
        .withColumn("object_exists", F.coalesce("_hit", F.lit(False)))
        .drop("_hit")
    )


def page_files(spark: SparkSession, path: str, page_separator: str = "\f") -> DataFrame:
    """Text files as ordered pages; the file name without its suffix is the document id."""
    whole = spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_name"), r"(?s)^(.+?)(\.[^.]*)?\z", 1).alias("document_id"),
        "value",
    )
    return whole.select(
        "document_id", F.posexplode(F.split("value", page_separator)).alias("position", "text")
    ).select("document_id", (F.col("position") + 1).alias("page_no"), "text")


def pages_with_fallback(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Pages of the first reader; of the second for documents the first gave nothing for."""
    covered = primary.select("document_id").distinct()
    return primary.unionByName(secondary.join(covered, "document_id", "left_anti"))


def lines_as_pages(documents: DataFrame, lines_per_page: int = 5) -> DataFrame:
    """Long text cut into pages of a fixed number of lines, inside the row."""

    def paged(lines: Column) -> Column:
        count = F.ceil(F.size(lines) / lines_per_page).cast("int")
        return F.transform(
            F.sequence(F.lit(1), count),
            lambda p: F.array_join(F.slice(lines, (p - 1) * lines_per_page + 1, lines_per_page), "\n"),
        )

    pages = bind(F.split("text", "\n"), paged)
    return documents.select(
        "document_id", "document_type", F.posexplode(pages).alias("position", "text")
    ).select("document_id", "document_type", (F.col("position") + 1).alias("page_no"), "text")


def table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stored table under its fixed schema; nothing is inferred."""
    return spark.read.schema(schema).parquet(path)


def collection(vectors: DataFrame, name: str | None = None) -> DataFrame:
    """One collection of the vector table, the default one unless named.

    On a table written with `writers.write_vectors` this prunes partitions.
    """
    return vectors.filter(F.col("collection") == (name or schemas.DEFAULT_COLLECTION))
