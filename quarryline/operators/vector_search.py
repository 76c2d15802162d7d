"""Nearest-neighbour search of a whole table of queries."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions import vectors as vx
from quarryline.functions.ranking import top_per_group
from quarryline.operators.index import LSH_BITS, LSH_SEED
from quarryline.schemas import DEFAULT_COLLECTION
from quarryline.session import materialise

# Queries shipped to every task at a time. At 1536 doubles each this is 50 MB.
MAX_SHIPPED_QUERIES = 4096
FIRST_FLIPS = 1
TARGET_RECALL = 0.95

_HIT = "query_id long, chunk_id string, document_id string, sequence int, distance double"
PAYLOAD = ["chunk_id", "document_id", "sequence"]


def _corpus(vectors: DataFrame, collection: str | None, model: str | None) -> DataFrame:
    if collection is not None:
        vectors = vectors.filter(F.col("collection") == collection)
    if "model_name" in vectors.columns:
        if model is not None:
            vectors = vectors.filter(F.col("model_name") == model)
        else:
            span = vectors.agg(F.min("model_name").alias("a"), F.max("model_name").alias("b")).first()
            if span.a != span.b:
                raise ValueError("the collection mixes embedding models; name one")
    return vectors.filter(F.col("embedding").isNotNull())


def _allowed(wanted: np.ndarray, documents: pa.Array) -> np.ndarray | None:
    """Pairs the per-query document filter lets through; None when no query filters."""
    filtered = np.array([w is not None for w in wanted])
    if not filtered.any():
        return None
    documents = documents.to_numpy(zero_copy_only=False)
    return ~filtered[:, None] | (wanted[:, None] == documents[None, :])


def knn(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    *,
    collection: str | None = None,
    model: str | None = None,
    max_shipped: int = MAX_SHIPPED_QUERIES,
) -> DataFrame:
    """Exact k nearest chunks per query by cosine distance, ranked from 1.

    `queries` has query_id, embedding and optionally document_id (a filter, applied
    before ranking). Up to `max_shipped` queries travel to the tasks that read the
    corpus; each task keeps k rows per query, so the corpus is never shuffled and no
    (query, chunk) table arises. More queries go in turn, in batches of that size, each
    of which reads the corpus once and stores its hits.
    """
    corpus = _corpus(vectors, collection, model)
    slim = corpus.select("chunk_id", "document_id", F.col("sequence").cast("int").alias("sequence"), "embedding")
    order = [F.col("distance").asc_nulls_last(), F.col("chunk_id")]

    def search(asked: pa.Table) -> DataFrame:
        return top_per_group(_knn_shipped(slim, asked, k), ["query_id"], order, k)

    ranked = in_batches(wanted_queries(queries), max_shipped, search)
    return ranked.withColumn("relevance", vx.relevance(F.col("distance")))


def wanted_queries(queries: DataFrame) -> DataFrame:
    return queries.filter(F.col("embedding").isNotNull()).select(
        F.col("query_id").cast("long").alias("query_id"),
        "embedding",
        (F.col("document_id") if "document_id" in queries.columns else F.lit(None))
        .cast("string")
        .alias("document_id"),
    )


def in_batches(
    queries: DataFrame, size: int, search: Callable[[pa.Table], DataFrame]
) -> DataFrame:
    """`search` of all queries, about `size` at a time on the driver.

    One batch is searched as it is; of several, each is stored before the next is fetched.
    """
    first = queries.limit(size + 1).toArrow()
    if first.num_rows <= size:
        return search(first)
    stored = materialise(queries, "queries")
    batches = 2 * -(-stored.count() // max(1, size))
    number = F.pmod(F.xxhash64("query_id"), F.lit(batches))
    found = None
    for batch in range(batches):
        asked = stored.filter(number == batch).toArrow()
        if asked.num_rows:
            hits = materialise(search(asked), "batch-hits")
            found = hits if found is None else found.unionByName(hits)
    return found


def _knn_shipped(corpus: DataFrame, queries: pa.Table, k: int) -> DataFrame:
    if not queries.num_rows:
        return corpus.sparkSession.createDataFrame([], _HIT)
    ids = queries["query_id"].to_numpy()
    rows = vx.unit_rows(vx.matrix(queries["embedding"].combine_chunks()))
    documents = np.array(queries["document_id"].to_pylist(), dtype=object)
    sent = corpus.sparkSession.sparkContext.broadcast((ids, rows, documents))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, query_rows, query_documents = sent.value
        nearest, all_queries = vx.Nearest(query_ids, query_rows, k), np.arange(len(query_ids))
        for batch in batches:
            if not batch.num_rows:
                continue
            points = vx.unit_rows(vx.matrix(batch.column("embedding"), query_rows.shape[1]))
            allowed = _allowed(query_documents, batch.column("document_id"))
            nearest.add(points, batch.select(PAYLOAD), all_queries, allowed)
        if (hits := nearest.hits(PAYLOAD)) is not None:
            yield hits

    return corpus.mapInArrow(search, _HIT)


def semantic_search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    *,
    collection: str | None = DEFAULT_COLLECTION,
    model: str | None = None,
    metadata_filter: Column | None = None,
) -> DataFrame:
    """knn after the metadata filter, with `distance` and six-decimal `score`."""
    if metadata_filter is not None:
        vectors = vectors.filter(metadata_filter)
    hits = knn(vectors, queries, k, collection=collection, model=model)
    return hits.withColumn("score", vx.similarity(F.col("distance")))


def predicate(column: str, operator: str, value) -> Column:
    """One comparison of a structured metadata filter."""
    field = F.col(column)
    if operator == "in":
        return field.isin(*value)
    comparisons = {
        "eq": lambda: field == value,
        "ne": lambda: field != value,
        "lt": lambda: field < value,
        "lte": lambda: field <= value,
        "gt": lambda: field > value,
        "gte": lambda: field >= value,
    }
    if operator not in comparisons:
        raise ValueError(f"unknown comparison: {operator}")
    return comparisons[operator]()


def metadata_predicate(*terms: tuple) -> Column:
    """All of (column, operator, value) must hold."""
    combined = F.lit(True)
    for column, operator, value in terms:
        combined = combined & predicate(column, operator, value)
    return combined


def buckets_within(marks: np.ndarray, radius: np.ndarray, bits: int) -> list[int]:
    """Buckets that differ from some signature in more than its lower and up to its upper radius."""
    every, needed = np.arange(1 << bits), np.zeros(1 << bits, dtype=bool)
    pairs = np.unique(np.column_stack([marks, radius]), axis=0)
    for mark, low, high in pairs:
        apart = np.bitwise_count(every ^ mark)
        needed |= (apart > low) & (apart <= high)
    return np.flatnonzero(needed).tolist()


def flips_needed(distance: float | None, bits: int, recall: float) -> int:
    """Bits to flip so that a neighbour at this distance is found with the given chance.

    A random hyperplane parts two vectors with probability angle / pi, so the number of
    differing bits is binomial.
    """
    if distance is None:
        return bits
    parted = math.acos(min(1.0, max(-1.0, 1.0 - distance))) / math.pi
    reached = 0.0
    for flips in range(bits + 1):
        reached += math.comb(bits, flips) * parted**flips * (1 - parted) ** (bits - flips)
        if reached >= recall:
            return flips
    return bits


def approximate_knn(
    indexed: DataFrame,
    queries: DataFrame,
    k: int,
    *,
    collection: str | None = None,
    model: str | None = None,
    bits: int = LSH_BITS,
    seed: int = LSH_SEED,
    flips: int = FIRST_FLIPS,
    recall: float = TARGET_RECALL,
    max_shipped: int = MAX_SHIPPED_QUERIES,
) -> DataFrame:
    """k nearest among the probed buckets, exact distances, full k for every query.

    `indexed` carries `bucket` (see `index.with_buckets`, with the same `bits`); probed
    buckets become a partition filter. The distance of the k-th chunk found in the nearest
    buckets tells how many more bits to flip for the expected `recall`; queries that need
    more buckets, or found fewer than k chunks, go on to those not read yet. A query's
    `document_id`, the collection and the model filter as in `knn`. More than `max_shipped`
    queries are searched in turn, in batches.
    """
    corpus = _corpus(indexed, collection, model)

    def search(shipped: pa.Table) -> DataFrame:
        if not shipped.num_rows:
            return corpus.sparkSession.createDataFrame([], f"{_HIT}, rank int")
        return _approximate(corpus, shipped, k, bits, seed, flips, recall)

    ranked = in_batches(wanted_queries(queries), max_shipped, search)
    return ranked.withColumn("relevance", vx.relevance(F.col("distance")))


def _approximate(
    indexed: DataFrame, shipped: pa.Table, k: int, bits: int, seed: int, flips: int, recall: float
) -> DataFrame:
    matrix = vx.matrix(shipped["embedding"].combine_chunks())
    marks = vx.signatures(matrix, bits, seed)
    asked = {
        query: (row, int(mark), document)
        for query, row, mark, document in zip(
            shipped["query_id"].to_pylist(),
            vx.unit_rows(matrix),
            marks,
            shipped["document_id"].to_pylist(),
        )
    }
    first = _probe(indexed, asked, {query: (-1, flips) for query in asked}, k, bits)
    reached = first.groupBy("query_id").agg(
        F.max(F.when(F.col("rank") == k, F.col("distance"))).alias("distance")
    )
    last = {row.query_id: row.distance for row in reached.collect()}
    needed = {query: flips_needed(last.get(query), bits, recall) for query in asked}
    more = {query: (flips, n) for query, n in needed.items() if n > flips}
    if not more:
        return first
    second = _probe(indexed, {q: asked[q] for q in more}, more, k, bits)
    order = [F.col("distance").asc_nulls_last(), F.col("chunk_id")]
    both = first.drop("rank").unionByName(second.drop("rank"))
    return top_per_group(both, ["query_id"], order, k)


def _probe(
    indexed: DataFrame, asked: dict, wanted: dict[int, tuple[int, int]], k: int, bits: int
) -> DataFrame:
    """Search of the buckets between two radii of every query; stored once."""
    ids = np.array(list(asked), dtype=np.int64)
    rows = np.array([row for row, *_ in asked.values()])
    documents = np.array([document for *_, document in asked.values()], dtype=object)
    marks = np.array([mark for _, mark, _ in asked.values()], dtype=np.int64)
    radius = np.array([wanted[query] for query in asked], dtype=np.int64)
    sent = indexed.sparkSession.sparkContext.broadcast((ids, rows, marks, radius, documents))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, query_rows, query_marks, query_radius, query_documents = sent.value
        nearest, all_queries = vx.Nearest(query_ids, query_rows, k), np.arange(len(query_ids))
        for batch in batches:
            if not batch.num_rows:
                continue
            points = vx.unit_rows(vx.matrix(batch.column("embedding"), query_rows.shape[1]))
            apart = np.bitwise_count(query_marks[:, None] ^ batch.column("bucket").to_numpy()[None, :])
            allowed = (apart > query_radius[:, :1]) & (apart <= query_radius[:, 1:])
            only = _allowed(query_documents, batch.column("document_id"))
            if only is not None:
                allowed &= only
            nearest.add(points, batch.select(PAYLOAD), all_queries, allowed)
        if (hits := nearest.hits(PAYLOAD)) is not None:
            yield hits

    slim = indexed.filter(F.col("bucket").isin(buckets_within(marks, radius, bits))).select(
        "chunk_id",
        "document_id",
        F.col("sequence").cast("int").alias("sequence"),
        "embedding",
        F.col("bucket").cast("int").alias("bucket"),
    )
    order = [F.col("distance").asc_nulls_last(), F.col("chunk_id")]
    ranked = top_per_group(slim.mapInArrow(search, _HIT), ["query_id"], order, k)
    return materialise(ranked, "probed-hits")
