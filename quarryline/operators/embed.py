"""Attaching vectors to chunks, and the token estimates of embedding calls."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions import text as fx
from quarryline.functions.ranking import positions
from quarryline.functions.vectors import hash_embedding

# Tokens per word 1.3, kept as a fraction so that no rounding error
# can push a whole number below itself.
EMBED_BATCH = 100
TOKENS_PER_TEN_WORDS = 13
DEFAULT_DIM = 64
DEFAULT_MODEL = "feature-hash-64"


def default_embedder(text: Column) -> Column:
    """Deterministic stand-in for a hosted embedding model."""
    return hash_embedding(fx.search_tokens(text), DEFAULT_DIM)


def embed_chunks(
    chunks: DataFrame,
    embedder: Callable[[Column], Column] = default_embedder,
    model_name: str = DEFAULT_MODEL,
) -> DataFrame:
    """Adds `embedding` and `model_name`; any text-to-vector column function fits."""
    return chunks.withColumn("embedding", embedder(F.col("content"))).withColumn(
        "model_name", F.lit(model_name)
    )


def estimated_tokens(word_total: Column) -> Column:
    return F.floor(word_total * TOKENS_PER_TEN_WORDS / F.lit(10)).cast("long")


def token_estimates(chunks: DataFrame, batch_size: int = EMBED_BATCH) -> DataFrame:
    """Estimated tokens per document: whole tokens per batch of chunks, then summed."""
    placed = positions(
        chunks.select("document_id", "sequence", fx.word_count(F.col("content")).alias("words")),
        ["document_id"],
        "sequence",
    )
    batches = placed.groupBy(
        "document_id", F.floor((F.col("position") - 1) / batch_size).alias("batch")
    ).agg(F.sum("words").alias("words"), F.count("*").alias("chunks"))
    return batches.groupBy("document_id").agg(
        F.sum("chunks").alias("chunk_count"),
        F.count("*").alias("batch_count"),
        F.sum(estimated_tokens(F.col("words"))).alias("total_tokens"),
    )


def embed_statuses(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """`completed` for documents with chunks, `skipped` for those without."""
    totals = chunks.groupBy("document_id").agg(F.count("*").alias("_n"))
    return documents.join(totals, "document_id", "left").select(
        "document_id",
        F.when(F.col("_n").isNull(), "skipped").otherwise("completed").alias("embed_status"),
        F.coalesce("_n", F.lit(0)).alias("chunk_count"),
    )


def attach_description_vectors(descriptions: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vectors of slide descriptions, joined on (document_id, slide_number)."""
    return descriptions.filter(F.col("description").isNotNull()).join(
        vectors, ["document_id", "slide_number"]
    )


def description_token_estimates(descriptions: DataFrame) -> DataFrame:
    """Number of descriptions and one token estimate per document."""
    return (
        descriptions.filter(F.col("description").isNotNull())
        .groupBy("document_id")
        .agg(
            F.count("*").alias("description_count"),
            estimated_tokens(F.sum(fx.word_count(F.col("description")))).alias("total_tokens"),
        )
    )
