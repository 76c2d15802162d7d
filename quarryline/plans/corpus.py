"""Whole-corpus jobs: pages to parsed documents to chunks to vectors to index tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.operators import chunk, embed, index, parse
from quarryline.schemas import DEFAULT_COLLECTION

def parsed_documents(pages: DataFrame) -> DataFrame:
    """Parsed rows of all documents; the one shuffle brings a document's pages together."""
    return parse.parse_documents(parse.full_texts(pages))


def chunked(pages: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Chunks of all documents, each by the rules of its type whatever its length.

    Deck pages are slides and need no joining. Any other document's pages come together in
    one row. `shards.chunk_sharded` gives the same chunks where documents are too long for that;
    `chunk.chunk_page_shards` cuts by page range and knows nothing of turns, sections and tables.
    """
    is_deck = parse.route(F.col("document_type")) == "slides"
    slides = parse.slide_rows(pages.filter(is_deck))
    return chunk.chunk_documents(parsed_documents(pages.filter(~is_deck)), slides, tables)


def ingest(
    pages: DataFrame, tables: DataFrame | None = None, collection: str = DEFAULT_COLLECTION
) -> DataFrame:
    """Vector-table rows of all documents: parse, chunk, embed, index rows."""
    return index.vector_rows(embed.embed_chunks(chunked(pages, tables)), collection)
