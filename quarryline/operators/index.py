"""Index tables: term postings, LSH buckets, and the upsert into the vector table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import text as fx
from quarryline.functions import vectors as vx
from quarryline.functions.binding import bind
from quarryline.schemas import DEFAULT_COLLECTION

# Words an English full-text search leaves out.
STOP_WORDS = tuple(
    """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his
    himself she her hers herself it its itself they them their theirs themselves what which
    who whom this that these those am is are was were be been being have has had having do
    does did doing a an the and but if or because as until while of at by for with about
    against between into through during before after above below to from up down in out on
    off over under again further then once here there when where why how all any both each
    few more most other some such no nor not only own same so than too very s t can will
    just don should now
    """.split()
)

TERM_BUCKETS = 256
LSH_BITS = 8
LSH_SEED = 42
ROWS_PER_BUCKET = 1000


def lexemes(text: Column, stem: bool = False) -> Column:
    """Terms with their positions (stop words counted, then left out): array of structs.

    With `stem` the forms of an English word are one term.
    """
    numbered = F.transform(
        fx.search_tokens(text), lambda w, i: F.struct(w.alias("term"), (i + 1).alias("position"))
    )
    kept = F.filter(numbered, lambda t: ~t["term"].isin(*STOP_WORDS))
    if not stem:
        return kept
    return F.transform(kept, lambda t: F.struct(fx.stem(t["term"]).alias("term"), t["position"].alias("position")))


def chunk_postings(text: Column, stem: bool = False) -> Column:
    """Postings of one text: array of (term, tf, positions).

    Lexemes are sorted within the row and cut where the term changes, which is linear
    after the sort and needs no grouping.
    """

    def cut(ordered: Column, starts: Column) -> Column:
        return F.transform(
            starts,
            lambda s, i: bind(
                F.slice(ordered, s + 1, fx.run_length(ordered, starts, s, i)),
                lambda run: F.struct(
                    F.get(run, F.lit(0))["term"].alias("term"),
                    F.size(run).cast("long").alias("tf"),
                    F.transform(run, lambda t: t["position"]).alias("positions"),
                ),
            ),
        )

    return bind(
        F.array_sort(lexemes(text, stem)),
        lambda ordered: bind(
            fx.run_starts(ordered, lambda t: t["term"]), lambda starts: cut(ordered, starts)
        ),
    )


def postings(chunks: DataFrame, text: str = "content", stem: bool = False) -> DataFrame:
    """Full-text index: one row per (term, chunk) with tf and sorted positions.

    Terms are lower-cased words, with `stem` their stems (searches must then ask alike). A chunk's postings are built inside its
    own row, so building the index shuffles nothing and a frequent term fills no task.
    """
    keys = [c for c in ("chunk_id", "document_id", "sequence", "collection") if c in chunks.columns]
    return chunks.select(*keys, F.inline(chunk_postings(F.coalesce(F.col(text), F.lit("")), stem)))


def term_bucket(term: Column, buckets: int = TERM_BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def write_postings(
    table: DataFrame, path: str, buckets: int = TERM_BUCKETS, files_per_bucket: int = 4
) -> None:
    """Postings partitioned by term bucket; a hot term is spread over several files.

    `files_per_bucket` is the least number for a bucket of more rows than a task should sort:
    Spark splits larger parts, so no task's share grows with the table.
    """
    placed = table.withColumn("term_bucket", term_bucket(F.col("term"), buckets)).withColumn(
        "_salt", F.pmod(F.xxhash64("chunk_id"), F.lit(files_per_bucket))
    )
    dealt = placed.hint("rebalance", F.col("term_bucket"), F.col("_salt")).drop("_salt")
    dealt.sortWithinPartitions("term_bucket", "term").write.mode("errorifexists").partitionBy(
        "term_bucket"
    ).parquet(path)


def read_postings(
    spark: SparkSession, path: str, terms: DataFrame | None = None, buckets: int = TERM_BUCKETS
) -> DataFrame:
    """Postings; with a table of query `terms` only the buckets those need are scanned.

    There are at most `buckets` distinct numbers to broadcast.
    """
    table = spark.read.parquet(path)
    if terms is None:
        return table
    needed = terms.select(term_bucket(F.col("term"), buckets).alias("term_bucket")).distinct()
    return table.join(F.broadcast(needed), "term_bucket", "left_semi")


def bits_for(rows: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    """Bits for a corpus of that many rows: buckets grow with it, up to 65,536 of them."""
    return min(16, max(1, math.ceil(math.log2(max(1, rows) / rows_per_bucket)))) if rows > rows_per_bucket else 1


def with_buckets(vectors: DataFrame, bits: int = LSH_BITS, seed: int = LSH_SEED) -> DataFrame:
    """Nearest-neighbour index: the vector table with its random-hyperplane bucket."""
    present = vectors.filter(F.col("embedding").isNotNull())
    return present.withColumn("bucket", vx.bucket(F.col("embedding"), bits, seed))


def write_buckets(indexed: DataFrame, path: str, files_per_bucket: int = 4) -> None:
    """Index partitioned by collection and bucket; a hot bucket spreads over files."""
    salt = F.pmod(F.xxhash64("chunk_id"), F.lit(files_per_bucket))
    indexed.repartition("collection", "bucket", salt).write.mode("errorifexists").partitionBy(
        "collection", "bucket"
    ).parquet(path)


def vector_rows(chunks: DataFrame, collection: str = DEFAULT_COLLECTION) -> DataFrame:
    """Rows of the vector table: normalised text, metadata with the chunk's keys added.

    Keys of the chunk win over equal metadata keys.
    """
    own = F.create_map(
        F.lit("chunk_id"),
        F.col("chunk_id"),
        F.lit("document_id"),
        F.col("document_id"),
        F.lit("sequence"),
        F.col("sequence").cast("string"),
    )
    extra = F.map_filter(
        F.coalesce(F.col("metadata"), F.create_map().cast("map<string,string>")),
        lambda k, _: ~k.isin("chunk_id", "document_id", "sequence"),
    )
    return chunks.select(
        "chunk_id",
        "document_id",
        "sequence",
        F.lit(collection).alias("collection"),
        "model_name",
        F.col("content_normalized").alias("content"),
        F.map_concat(extra, own).alias("metadata"),
        "embedding",
    )


def upsert(existing: DataFrame, incoming: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Existing rows whose key does not come in, and all incoming rows.

    Of several incoming rows with one key the one with the greatest content hash stays, of equal
    ones that with the greatest metadata as sorted text, chosen by a combined aggregate.
    """
    columns = existing.columns
    order = [F.xxhash64(*[c for c in columns if c not in (key, "metadata")])]
    if "metadata" in columns:
        order.append(F.to_json(F.array_sort(F.map_entries("metadata"))))
    latest = (
        incoming.groupBy(key)
        .agg(
            F.max_by(
                F.struct(*[c for c in columns if c != key]),
                F.struct(*order),
            ).alias("_row")
        )
        .select(key, "_row.*")
    )
    kept = existing.join(latest.select(key), key, "left_anti")
    return kept.unionByName(latest)
