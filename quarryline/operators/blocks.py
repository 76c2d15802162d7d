"""Postings in blocks ordered by impact, and an exact top-k that skips most of them.

The postings of a term are sorted by descending frequency, then chunk id, and cut to blocks. What
a block's chunks can score at most follows from the frequency and the number of query terms, so a
search scores the first blocks of each query's rarest term, takes the score of the k-th chunk, and
then reads those blocks only that may hold a better one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.functions.ranking import broadcast_if_small, is_small, top_per_group
from quarryline.operators import fulltext
from quarryline.operators.index import TERM_BUCKETS, term_bucket
from quarryline.schemas import DEFAULT_COLLECTION
from quarryline.session import materialise

BLOCK_POSTINGS = 128
# Blocks of a query's rarest term that are scored before any bound is known.
FIRST_BLOCKS = 8
# Postings beyond those blocks that are scored at once rather than looked at for bounds: a pass of
# their own costs more than so many.
AT_ONCE = 2_000_000

ENTRY = "struct<chunk_id:string,document_id:string,sequence:int,positions:array<int>>"
BLOCK = f"term_bucket int, collection string, term string, tf long, first_chunk string, n int, entries array<{ENTRY}>"
ORDER = ("term_bucket", "collection", "term")


def blocks(postings: DataFrame, size: int = BLOCK_POSTINGS, buckets: int = TERM_BUCKETS) -> DataFrame:
    """One row per block of at most `size` postings of a term with equal frequency, by chunk id.

    Rows are dealt by ranges of the whole sort key, chunk id included: a term that every chunk
    holds is spread over many tasks, and each cuts its blocks as rows stream by. Pass a stored
    table, ranges are found in a pass of their own.
    """
    kinds = {"collection": "string", "document_id": "string", "sequence": "int"}
    filled = postings.withColumns(
        {c: (F.col(c) if c in postings.columns else F.lit(None)).cast(t) for c, t in kinds.items()}
    ).withColumn("term_bucket", term_bucket(F.col("term"), buckets))
    rows = filled.select(
        *ORDER, "tf", "chunk_id", "document_id", "sequence", F.col("positions").cast("array<int>").alias("positions")
    )
    order = [*ORDER, F.col("tf").desc(), "chunk_id"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _cut(batch, size)

    return ordered.mapInArrow(cut, BLOCK)


def _cut(batch: pa.RecordBatch, size: int) -> pa.RecordBatch:
    """Blocks of one sorted batch."""
    keys = [batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy() for c in ("collection", "term")]
    new = np.ones(batch.num_rows, bool)
    new[1:] = False
    for key in (*keys, batch.column("tf").to_numpy()):
        new[1:] |= key[1:] != key[:-1]
    places = np.arange(batch.num_rows)
    opens = np.flatnonzero((places - np.maximum.accumulate(np.where(new, places, 0))) % size == 0)
    offsets = np.append(opens, batch.num_rows)
    fields = ["chunk_id", "document_id", "sequence", "positions"]
    entries = pa.StructArray.from_arrays([batch.column(f) for f in fields], fields)
    heads = batch.take(pa.array(opens))
    columns = [*(heads.column(c) for c in (*ORDER, "tf", "chunk_id")), pa.array(np.diff(offsets).astype(np.int32))]
    lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), entries)
    return pa.record_batch([*columns, lists], [*ORDER, "tf", "first_chunk", "n", "entries"])


def write_blocks(table: DataFrame, path: str) -> None:
    """Blocks partitioned by term bucket, as a search prunes them."""
    table.write.mode("errorifexists").partitionBy("term_bucket").parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def is_blocked(table: DataFrame) -> bool:
    return "entries" in table.columns


def search(
    table: DataFrame,
    queries: DataFrame,
    k: int = 10,
    *,
    collection: str | None = DEFAULT_COLLECTION,
    buckets: int = TERM_BUCKETS,
    stem: bool = False,
    first_blocks: int = FIRST_BLOCKS,
    at_once: int = AT_ONCE,
) -> DataFrame:
    """The rows of `fulltext.search`, from a stored block table.

    The blocks beyond the first of each query are read in a second pass, and only those that may
    hold a better chunk, where they have more than `at_once` postings together.
    """
    terms = fulltext.query_terms(queries, stem=stem)
    if collection is not None:
        table = table.filter(F.col("collection") == collection)
    table = fulltext.pruned(table, terms, buckets)
    planned = materialise(planned_blocks(table, terms), "planned-blocks")
    best = [F.col("score").desc(), F.col("chunk_id")]
    beyond = F.col("place") > first_blocks
    if (planned.filter(beyond).agg(F.sum("n")).first()[0] or 0) <= at_once:
        return top_per_group(scored(table, terms, planned), ["query_id"], best, k)
    first = scored(table, terms, planned.filter(~beyond))
    first = materialise(top_per_group(first, ["query_id"], best, k), "first-hits")
    more = scored(table, terms, needed_blocks(planned.filter(beyond), first, k))
    return top_per_group(first.drop("rank").unionByName(more), ["query_id"], best, k)


def planned_blocks(table: DataFrame, terms: DataFrame) -> DataFrame:
    """The blocks of every query's rarest term, without entries, numbered from the greatest frequency.

    Queries with a term that occurs nowhere have none.
    """
    heads = table.join(
        broadcast_if_small(terms.select("term").distinct(), fulltext.MAX_BROADCAST_TERMS), "term", "left_semi"
    ).select("term", "tf", "first_chunk", "n")
    frequency = heads.groupBy("term").agg(F.sum("n").alias("df"))
    keys = ["query_id", "n_terms"] + (["document_id"] if "document_id" in terms.columns else [])
    rarest = (
        terms.join(frequency, "term", "left")
        .groupBy(*keys)
        .agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term")).alias("rarest"))
        .filter(F.col("rarest.df") > 0)
        .select(*keys, F.col("rarest.term").alias("term"))
    )
    order = [F.col("tf").desc(), F.col("first_chunk")]
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return rarest.join(heads, "term").withColumn("place", place)


def bound(n_terms, tf):
    """The most that a chunk can score whose rarest term occurs `tf` times.

    A cover weighs the default weight at most. Covers that share an occurrence of the rarest term
    begin with different terms, so there are at most `n_terms` to an occurrence.
    """
    return F.round(F.lit(fulltext.DEFAULT_WEIGHT) * n_terms * tf, fulltext.SCORE_DIGITS)


def needed_blocks(rest: DataFrame, first: DataFrame, k: int) -> DataFrame:
    """Blocks that may hold a chunk better than the k-th found: by bound, then by chunk id."""
    reached = first.filter(F.col("rank") == k).select(
        "query_id", F.col("score").alias("least"), F.col("chunk_id").alias("last")
    )
    most = bound(F.col("n_terms"), F.col("tf"))
    better = (most > F.col("least")) | ((most == F.col("least")) & (F.col("first_chunk") < F.col("last")))
    kept = rest.join(broadcast_if_small(reached, fulltext.MAX_BROADCAST_TERMS), "query_id", "left")
    return kept.filter(F.col("least").isNull() | better).drop("least", "last")


def scored(table: DataFrame, terms: DataFrame, chosen: DataFrame) -> DataFrame:
    """Chunks of the chosen blocks that hold all terms of their query, with their score."""
    keys = ["query_id", "chunk_id", "document_id", "sequence", "n_terms"]
    asked = chosen.drop("n", "place")
    if "document_id" in asked.columns:
        asked = asked.withColumnRenamed("document_id", "_only")
    hit = table.join(
        broadcast_if_small(asked, fulltext.MAX_BROADCAST_TERMS), ["term", "tf", "first_chunk"]
    )
    extra = ["_only"] if "_only" in asked.columns else []
    found = hit.select("query_id", "n_terms", *extra, F.inline("entries"))
    if extra:
        found = found.filter(F.col("_only").isNull() | (F.col("_only") == F.col("document_id")))
    places = found.filter("n_terms = 1").select(*keys, F.array("positions").alias("places"))
    several = terms.filter("n_terms > 1")
    if not several.isEmpty():
        pairs = materialise(found.filter("n_terms > 1").select(*keys), "block-candidates")
        small = is_small(several, fulltext.MAX_BROADCAST_TERMS)

        def held(asked: DataFrame) -> DataFrame:
            return table.join(F.broadcast(asked) if small else asked, "term")

        def read(asked: DataFrame) -> DataFrame:
            found = held(asked).select(*asked.columns, F.explode("entries").alias("entry"))
            return found.select(
                *asked.columns, F.col("entry.chunk_id").alias("chunk_id"), F.col("entry.positions").alias("positions")
            )

        def counted() -> DataFrame:
            return held(several.select("term").distinct()).groupBy("term").agg(F.sum("n").alias("df"))

        compound = fulltext.all_places(read, counted, several, pairs, keys, small)
        places = places.unionByName(compound)
    return places.select(
        "query_id", "chunk_id", "document_id", "sequence", fulltext.cover_density(F.col("places")).alias("score")
    )
