"""Schemas and closed domains of the corpus tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values.
DOCUMENT_TYPES = ("transcript", "earnings_release", "slide_deck", "general")
DOCUMENT_STATUSES = (
    "uploaded",
    "processing",
    "processed",
    "chunked",
    "embedded",
    "indexed",
    "failed",
)
DEFAULT_COLLECTION = "rag_chunks_v1"


def _schema(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


_S, _I, _L, _D, _TS = (
    T.StringType(),
    T.IntegerType(),
    T.LongType(),
    T.DoubleType(),
    T.TimestampType(),
)
_MAP = T.MapType(_S, _S)
_MONEY = T.DecimalType(12, 6)

CATALOG = _schema(
    ("id", _S, False),
    ("filename", _S, False),
    ("original_filename", _S, True),
    ("content_type", _S, True),
    ("file_size", _L, True),
    ("checksum", _S, True),
    ("doc_type", _S, True),
    ("status", _S, True),
    ("raw_path", _S, True),
    ("processed_path", _S, True),
    ("page_count", _I, True),
    ("processing_metadata", _MAP, True),
    ("error_message", _S, True),
    ("created_at", _TS, True),
    ("updated_at", _TS, True),
)

PAGES = _schema(
    ("document_id", _S, False),
    ("document_type", _S, True),
    ("page_no", _I, False),
    ("text", _S, True),
)

CHUNKS = _schema(
    ("chunk_id", _S, False),
    ("document_id", _S, False),
    ("sequence", _I, False),
    ("content", _S, False),
    ("content_normalized", _S, False),
    ("token_count", _I, False),
    ("metadata", _MAP, True),
    ("collection", _S, True),
)

CHUNK_VECTORS = _schema(
    ("chunk_id", _S, False),
    ("document_id", _S, True),
    ("sequence", _I, True),
    ("collection", _S, True),
    ("model_name", _S, True),
    ("content", _S, True),
    ("metadata", _MAP, True),
    ("embedding", T.ArrayType(T.FloatType()), True),
)

CONVERSATIONS = _schema(
    ("id", _S, False),
    ("user_id", _S, True),
    ("title", _S, True),
    ("created_at", _TS, True),
    ("updated_at", _TS, True),
)

MESSAGES = _schema(
    ("id", _S, False),
    ("conversation_id", _S, False),
    ("role", _S, False),
    ("content", _S, False),
    ("tokens", _I, True),
    ("created_at", _TS, True),
)

COST_EVENTS = _schema(
    ("id", _S, False),
    ("ts", _TS, False),
    ("provider", _S, False),
    ("model", _S, False),
    ("route", _S, False),
    ("request_id", _S, False),
    ("correlation_id", _S, True),
    ("prompt_tokens", _L, True),
    ("completion_tokens", _L, True),
    ("total_tokens", _L, True),
    ("unit_price_in_usd", _MONEY, True),
    ("unit_price_out_usd", _MONEY, True),
    ("cost_in_usd", _MONEY, True),
    ("cost_out_usd", _MONEY, True),
    ("cost_total_usd", _MONEY, True),
    ("latency_ms", _L, True),
    ("status", _S, False),
    ("metadata", _MAP, True),
)
