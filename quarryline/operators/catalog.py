"""Document catalog: listing, lookup, update, delete with cascade, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions import text as fx
from quarryline.schemas import DOCUMENT_STATUSES, DOCUMENT_TYPES

# Statuses behind each predicate.
COMPLETE = ("indexed", "failed")
QUERYABLE = ("chunked", "embedded", "indexed")
CHUNKABLE = ("processed",)
EMBEDDABLE = ("chunked",)


def matching(rows: DataFrame, **filters) -> DataFrame:
    """Equality, or membership for lists; None is no filter; unknown columns raise."""
    for name, value in filters.items():
        if name not in rows.columns:
            raise ValueError(f"no such column: {name}")
        if value is None:
            continue
        column = F.col(name)
        many = isinstance(value, (list, tuple, set))
        rows = rows.filter(column.isin(*value) if many else column == value)
    return rows


def list_rows(
    rows: DataFrame, offset: int = 0, limit: int = 100, order_by: str | None = None, **filters
) -> DataFrame:
    """One page; `-field` sorts descending, ties by id."""
    found = matching(rows, **filters)
    if order_by:
        field = order_by.lstrip("-")
        if field not in rows.columns:
            raise ValueError(f"no such column: {field}")
        key = F.col(field).desc() if order_by.startswith("-") else F.col(field).asc()
        found = found.orderBy(key, F.col("id"))
    else:
        found = found.orderBy("id")
    return found.offset(offset).limit(limit)


def page_info(rows: DataFrame, offset: int = 0, limit: int = 100, **filters) -> DataFrame:
    """Page number, size, total and whether there is a next page: one row."""
    return (
        matching(rows, **filters)
        .agg(F.count("*").alias("total"))
        .select(
            "total",
            F.lit(offset // limit + 1).alias("page"),
            F.lit(limit).alias("page_size"),
            (F.col("total") > offset + limit).alias("has_next"),
        )
    )


def by_status(rows: DataFrame, status: str, offset: int = 0, limit: int = 100) -> DataFrame:
    return list_rows(rows, offset, limit, "created_at", status=status)


def by_type(rows: DataFrame, doc_type: str, offset: int = 0, limit: int = 100) -> DataFrame:
    return list_rows(rows, offset, limit, "created_at", doc_type=doc_type)


def look_up(rows: DataFrame, limit: int | None = None, **filters) -> DataFrame:
    """Rows by one field or several."""
    found = matching(rows, **filters)
    return found if limit is None else found.orderBy("id").limit(limit)


def exists(rows: DataFrame, **filters) -> bool:
    return not matching(rows, **filters).isEmpty()


def count(rows: DataFrame, **filters) -> int:
    return matching(rows, **filters).count()


def exists_many(wanted: DataFrame, rows: DataFrame, on: str) -> DataFrame:
    """`exists` flag for a whole table of wanted values."""
    known = rows.select(on).distinct().withColumn("_hit", F.lit(True))
    return wanted.join(known, on, "left").select(
        *wanted.columns, F.coalesce("_hit", F.lit(False)).alias("exists")
    )


def update(rows: DataFrame, changes: DataFrame, now: Column | None = None) -> DataFrame:
    """Applies the non-null fields of `changes` by id and refreshes `updated_at`."""
    fields = [c for c in changes.columns if c != "id"]
    unknown = set(fields) - set(rows.columns)
    if unknown:
        raise ValueError(f"no such columns: {sorted(unknown)}")
    stamped = changes.select("id", *[F.col(c).alias(f"_new_{c}") for c in fields], F.lit(True).alias("_hit"))
    joined = rows.join(stamped, "id", "left")
    moment = F.current_timestamp() if now is None else now
    out = []
    for name in rows.columns:
        if name in fields:
            out.append(F.coalesce(F.col(f"_new_{name}"), F.col(name)).alias(name))
        elif name == "updated_at":
            out.append(F.when(F.col("_hit"), moment).otherwise(F.col(name)).alias(name))
        else:
            out.append(F.col(name))
    return joined.select(*out)


def delete(rows: DataFrame, doomed: DataFrame, on: str = "id") -> DataFrame:
    """Rows left after deleting those whose `on` value is listed."""
    return rows.join(doomed.select(on).distinct(), on, "left_anti")


def deleted_count(rows: DataFrame, doomed: DataFrame, on: str = "id") -> DataFrame:
    return rows.join(doomed.select(on).distinct(), on, "left_semi").agg(F.count("*").alias("deleted"))


def delete_cascade(
    doomed: DataFrame,
    catalog: DataFrame,
    chunks: DataFrame,
    vectors: DataFrame,
    utterances: DataFrame | None = None,
    *,
    delete_chunks: bool = True,
    delete_embeddings: bool = True,
) -> dict[str, DataFrame]:
    """Every table without the documents in `doomed` (column id) and what hangs on them.

    Vectors hang on chunks. Switching chunks off keeps both; switching embeddings off
    keeps vectors.
    """
    ids = doomed.select("id").distinct()
    of_document = ids.withColumnRenamed("id", "document_id")
    tables = {"catalog": catalog.join(ids, "id", "left_anti"), "chunks": chunks, "vectors": vectors}
    if delete_chunks:
        tables["chunks"] = chunks.join(of_document, "document_id", "left_anti")
    if delete_chunks and delete_embeddings:
        gone = chunks.join(of_document, "document_id", "left_semi").select("chunk_id")
        tables["vectors"] = vectors.join(gone, "chunk_id", "left_anti")
    if utterances is not None:
        tables["utterances"] = utterances.join(of_document, "document_id", "left_anti")
    return tables


def delete_conversations(
    doomed: DataFrame, conversations: DataFrame, messages: DataFrame
) -> dict[str, DataFrame]:
    """Both tables without the conversations in `doomed` (column id) and their messages."""
    ids = doomed.select("id").distinct()
    of_conversation = ids.withColumnRenamed("id", "conversation_id")
    return {
        "conversations": conversations.join(ids, "id", "left_anti"),
        "messages": messages.join(of_conversation, "conversation_id", "left_anti"),
    }


def insert(rows: DataFrame, new: DataFrame) -> DataFrame:
    return rows.unionByName(new, allowMissingColumns=True)


def processing_stats(rows: DataFrame) -> DataFrame:
    """Documents per status and per type, zeros included, and in total: one pass."""
    counted = (
        rows.select(
            F.explode(
                F.array(
                    F.struct(F.lit("status").alias("dimension"), F.col("status").alias("value")),
                    F.struct(F.lit("type").alias("dimension"), F.col("doc_type").alias("value")),
                    F.struct(F.lit("total").alias("dimension"), F.lit("all").alias("value")),
                )
            ).alias("key")
        )
        .groupBy("key.dimension", "key.value")
        .agg(F.count("*").alias("n"))
    )
    kinds = (("status", DOCUMENT_STATUSES), ("type", DOCUMENT_TYPES), ("total", ("all",)))
    domain = rows.sparkSession.createDataFrame(
        [(kind, value) for kind, values in kinds for value in values], "dimension string, value string"
    )
    return domain.join(counted, ["dimension", "value"], "left").select(
        "dimension", "value", F.coalesce("n", F.lit(0)).alias("documents")
    )


def corpus_stats(catalog: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Totals over the three tables: one row, each table read once."""
    zero = F.lit(0).cast("long")
    names = ["total_documents", "processing", "completed", "failed", "chunks", "embeddings", "bytes"]

    def row(table: DataFrame, **values: Column) -> DataFrame:
        return table.agg(*[values.get(n, F.max(zero)).cast("long").alias(n) for n in names])

    parts = (
        row(
            catalog,
            total_documents=F.count("*"),
            processing=F.count_if(F.col("status") == "processing"),
            completed=F.count_if(F.col("status") == "indexed"),
            failed=F.count_if(F.col("status") == "failed"),
            bytes=F.sum("file_size"),
        )
        .unionByName(row(chunks, chunks=F.count("*")))
        .unionByName(row(vectors, embeddings=F.count("embedding")))
    )
    return parts.agg(*[F.coalesce(F.sum(n), zero).alias(n) for n in names])


def status_view(rows: DataFrame) -> DataFrame:
    """Catalog rows as status records with their predicates."""
    status = F.col("status")
    return rows.select(
        "id",
        "filename",
        "doc_type",
        "status",
        F.coalesce(fx.truthy(F.col("raw_path")), F.col("processed_path"), F.lit("")).alias("storage_path"),
        status.isin(*COMPLETE).alias("complete"),
        status.isin(*QUERYABLE).alias("queryable"),
        status.isin(*CHUNKABLE).alias("can_be_chunked"),
        status.isin(*EMBEDDABLE).alias("can_be_embedded"),
        fx.truthy(F.col("error_message")).alias("error"),
        (
            F.coalesce("processing_metadata", F.create_map().cast("map<string,string>"))
            if "processing_metadata" in rows.columns
            else F.create_map().cast("map<string,string>")
        ).alias("metadata"),
    )
