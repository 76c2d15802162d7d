"""Search over an ingested corpus: index tables, then whole tables of questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.operators import embed, fusion
from quarryline.operators.index import TERM_BUCKETS
from quarryline.schemas import DEFAULT_COLLECTION


def embed_queries(
    queries: DataFrame, embedder: Callable[[Column], Column] = embed.default_embedder
) -> DataFrame:
    """Query vectors from the same model as the chunks."""
    return queries.withColumn("embedding", embedder(F.col("text")))


def search(
    vectors: DataFrame,
    postings: DataFrame,
    queries: DataFrame,
    catalog: DataFrame,
    k: int = fusion.FUSED_K,
    *,
    collection: str = DEFAULT_COLLECTION,
    buckets: int = TERM_BUCKETS,
    stem: bool = False,
) -> DataFrame:
    """Hybrid search results of every query, with document names, texts and metadata.

    `stem` is for postings, rows or blocks, that were built with it. Hits are at most k per query;
    their texts are matched on the unique chunk id.
    """
    hits = fusion.hybrid_search(
        vectors, postings, queries, k, collection=collection, buckets=buckets, stem=stem
    )
    shown = vectors.select("chunk_id", "content", "metadata")
    return fusion.result_rows(fusion.attach_names(hits.join(shown, "chunk_id", "left"), catalog))

