"""Checks: sources and sinks, intake, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.functions import text as fx
from quarryline.operators import chunk, embed, index, intake
from quarryline.plans.registry import Tables, check
from quarryline.session import fresh_path
from quarryline.sources import readers, store, writers

B = fx.BLANKS
WORD = f"[^{fx.BLANK_CLASS}]+"
DOC_TYPE_SQL = """
  CASE WHEN contains(n, 'transcript') THEN 'transcript'
       WHEN contains(n, 'earnings') AND contains(n, 'release') THEN 'earnings_release'
       WHEN contains(n, 'slide') OR contains(n, 'deck') THEN 'slide_deck' ELSE 'general' END"""
NORMAL_SQL = "replace(replace(replace(lower(filename), '-', '_'), ' ', '_'), '__', '_')"


def files(t: Tables):
    return t.files.withColumn("arrived_at", F.timestamp_seconds("arrived_s"))


@check(
    "sr1_object_digests",
    "SELECT document_id, strlen(content) + 1 AS size_bytes, sha256(content || chr(10)) AS sha256 FROM files",
    longs="size_bytes",
)
def sr1(t):
    objects = readers.raw_objects(t.spark, _folder(t.files), "*.txt")
    return readers.measured(objects.withColumn("document_id", _owner())).select("document_id", "size_bytes", "sha256")


def _folder(files):
    """A folder with a text object per document, ended by a line break."""
    path = fresh_path(files.sparkSession, "objects")
    writers.write_texts(files, path)
    return path


def _owner():
    return writers.object_owner(F.col("path"))


@check(
    "sr2_pages_with_fallback",
    f"""
    WITH numbered AS (SELECT cast(doc_id as string) AS document_id, doc_id, pos, line,
        cast(floor(pos / 5) as bigint) + 1 AS page_no FROM documents @NUMBERED_LINES(text)),
    paged AS (SELECT document_id, doc_id, page_no, string_agg(line, chr(10) ORDER BY pos) AS text
      FROM numbered GROUP BY ALL)
    SELECT document_id, page_no, text FROM paged WHERE doc_id % 6 <> 0
    UNION ALL
    SELECT cast(doc_id as string), 1, text FROM documents WHERE doc_id % 6 = 0""",
)
def sr2(t):
    docs = t.documents.select(
        F.col("doc_id").cast("string").alias("document_id"), F.lit("general").alias("document_type"), "doc_id", "text"
    )
    primary = readers.lines_as_pages(docs.filter("doc_id % 6 <> 0")).drop("document_type")
    secondary = docs.select("document_id", F.lit(1).alias("page_no"), "text")
    return readers.pages_with_fallback(primary, secondary).select(
        "document_id", F.col("page_no").cast("long").alias("page_no"), "text"
    )


@check("sr3_stored_ledger", "SELECT id, model, route, total_tokens, cast(cost_total_usd as double) AS usd FROM ledger")
def sr3(t):
    path = fresh_path(t.spark, "ledger")
    rows = t.ledger.withColumn("request_id", F.col("id")).withColumn("status", F.lit("ok"))
    writers.append_costs(rows.withColumn("ts", F.col("ts").cast("timestamp")), path)
    return t.spark.read.parquet(path).select(
        F.col("id").cast("long").alias("id"),
        "model",
        "route",
        "total_tokens",
        F.col("cost_total_usd").cast("double").alias("usd"),
    )


@check(
    "sr4_object_exists",
    """SELECT document_id, doc_id % 23 <> 0 AS object_exists FROM files""",
)
def sr4(t):
    stored = readers.raw_objects(t.spark, _folder(t.files.filter("content <> ''")), "*.txt")
    listing = stored.select(intake.storage_path(_owner(), F.lit("x.pdf")).alias("path"))
    wanted = t.files.select(
        "document_id", intake.storage_path(F.col("document_id"), F.lit("x.pdf")).alias("path")
    )
    return readers.present(wanted, listing).select("document_id", "object_exists")


@check(
    "sr5_collection_scan",
    "SELECT chunk_id, cast(sequence as bigint) AS sequence FROM vectors WHERE collection = 'rag_chunks_v1'",
)
def sr5(t):
    path = fresh_path(t.spark, "vectors")
    writers.write_vectors(t.vectors, path)
    stored = readers.collection(t.spark.read.parquet(path))
    return stored.select("chunk_id", F.col("sequence").cast("long").alias("sequence"))


@check(
    "sk1_storage_paths",
    "SELECT document_id, 'documents/' || document_id || '/' || filename AS path FROM files WHERE filename <> ''",
)
def sk1(t):
    return t.files.filter("filename <> ''").select(
        "document_id", intake.storage_path(F.col("document_id"), F.col("filename")).alias("path")
    )


@check(
    "sk2_chunk_manifest",
    f"""SELECT document_id, count(*) AS chunk_count,
      sum(len(regexp_extract_all(content, '{WORD}'))) AS token_count, sum(length(content)) AS char_count
    FROM line_chunks GROUP BY document_id""",
    longs="token_count char_count",
)
def sk2(t):
    path = fresh_path(t.spark, "manifest")
    writers.write_chunk_manifest(chunk.finish_chunks(_pieces(t)), path)
    totals = t.spark.read.schema("document_id string, chunk_count long, token_count long, char_count long")
    return totals.json(f"{path}/documents")


def _pieces(t):
    return t.line_chunks.withColumn("metadata", F.create_map(F.lit("kind"), F.lit("line")))


@check(
    "sk2_chunk_manifest_entries",
    f"""SELECT document_id, cast(sequence as bigint) AS sequence,
      sha256(document_id || chr(1) || cast(sequence as string) || chr(1) || content) AS chunk_id,
      cast(len(regexp_extract_all(content, '{WORD}')) as bigint) AS token_count, length(content) AS char_count
    FROM line_chunks""",
)
def sk2_entries(t):
    rows = chunk.manifest_entries(chunk.finish_chunks(_pieces(t)))
    return rows.select(
        "document_id",
        F.col("sequence").cast("long").alias("sequence"),
        "chunk_id",
        F.col("token_count").cast("long").alias("token_count"),
        F.col("char_count").cast("long").alias("char_count"),
    )


SK3_SQL = """
    SELECT coalesce(n.chunk_id, v.chunk_id) AS chunk_id,
      CASE WHEN n.chunk_id IS NULL THEN 'old' ELSE 'new' END AS version,
      coalesce(cast(n.sequence as string), '-') AS meta_sequence
    FROM vectors v FULL JOIN (SELECT * FROM doc_chunks) n ON n.chunk_id = v.chunk_id"""


@check("sk3_vector_upsert", SK3_SQL)
def sk3(t):
    old, new = _vector_versions(t)
    return _versions(writers.rewrite_vectors(old, new, fresh_path(t.spark, "vectors")))


# The same on a stored table in buckets of the document.
@check("sk3_bucketed_upsert", SK3_SQL)
def sk3_buckets(t):
    old, new = _vector_versions(t)
    path = fresh_path(t.spark, "vector-store")
    store.create(old, path, "document_id", 16)
    store.upsert(t.spark, path, new)
    return _versions(store.read(t.spark, path))


def _vector_versions(t):
    old = t.vectors.select(
        "chunk_id", "document_id", "sequence", "collection", "model_name",
        F.lit("old").alias("content"), F.create_map(F.lit("version"), F.lit("old")).alias("metadata"), "embedding",
    )
    new = index.vector_rows(
        t.doc_chunks.withColumn("content_normalized", fx.strip(F.col("content")))
        .withColumn("model_name", F.lit("model-a"))
        .withColumn("metadata", F.create_map(F.lit("version"), F.lit("new"), F.lit("sequence"), F.lit("x")))
        .withColumn("embedding", F.array(F.lit(0.0).cast("float")))
    )
    return old, new


def _versions(merged):
    return merged.select(
        "chunk_id",
        F.col("metadata")["version"].alias("version"),
        F.coalesce(F.col("metadata")["sequence"], F.lit("-")).alias("meta_sequence"),
    )


@check(
    "sk4_run_manifest",
    """
    SELECT c.id AS document_id, CASE WHEN c.error_message IS NULL THEN 'completed' ELSE 'failed' END AS status,
      CASE WHEN c.error_message IS NOT NULL THEN 'failed' WHEN n.n IS NULL THEN 'skipped' ELSE 'completed' END AS embed_step,
      coalesce(n.n, 0) AS chunk_count
    FROM catalog c LEFT JOIN (SELECT document_id, count(*) AS n FROM line_chunks GROUP BY document_id) n
      ON n.document_id = c.id""",
)
def sk4(t):
    return _manifests(t).select("document_id", "status", F.col("steps.embed").alias("embed_step"), "chunk_count")


def _manifests(t):
    docs = t.catalog.select(
        F.col("id").alias("document_id"),
        F.col("doc_type").alias("document_type"),
        F.lit("completed").alias("register_status"),
        F.col("error_message").alias("error"),
    )
    rows = writers.run_manifests(
        docs, t.line_chunks, "run-1", F.timestamp_seconds(F.lit(1704067200)), F.length("document_id") * 100
    )
    path = fresh_path(t.spark, "runs")
    writers.write_run_manifests(rows, path)
    return t.spark.read.schema(rows.schema).json(path)


@check(
    "sk5_appended_cost_rows",
    "SELECT id, provider, status, latency_ms, json_object('route', route)::VARCHAR AS metadata FROM calls",
)
def sk5(t):
    path = fresh_path(t.spark, "costs")
    rows = t.calls.withColumn("request_id", F.col("id").cast("string")).withColumn(
        "metadata", F.create_map(F.lit("route"), F.col("route"))
    )
    writers.append_costs(rows.withColumn("ts", F.timestamp_micros("ts_us")), path)
    return t.spark.read.parquet(path).select(
        F.col("id").cast("long").alias("id"), "provider", "status", "latency_ms", "metadata"
    )


@check(
    "in1_upload_checks",
    """
    SELECT document_id, CASE WHEN filename = '' THEN 'no_filename'
      WHEN lower(filename) NOT LIKE '%.pdf' THEN 'unsupported_extension'
      WHEN content_type IS NOT NULL AND content_type <> 'application/pdf' THEN 'unsupported_mime_type'
      WHEN strlen(content) > 104857600 THEN 'too_large' WHEN content = '' THEN 'empty_file' END AS reject_reason
    FROM files""",
)
def in1(t):
    return intake.validate_uploads(t.files).select("document_id", "reject_reason")


@check(
    "in2_document_types",
    f"SELECT document_id, {DOC_TYPE_SQL} AS doc_type FROM (SELECT document_id, {NORMAL_SQL} AS n FROM files) x",
)
def in2(t):
    return t.files.select("document_id", intake.document_type(F.col("filename")).alias("doc_type"))


@check(
    "in3_catalog_rows",
    f"""SELECT document_id AS id, filename, coalesce(content_type, 'application/octet-stream') AS content_type,
      strlen(content) AS file_size, sha256(content) AS checksum, {DOC_TYPE_SQL} AS doc_type, 'uploaded' AS status,
      'documents/' || document_id || '/' || filename AS raw_path, filename AS meta_filename
    FROM (SELECT *, {NORMAL_SQL} AS n FROM files WHERE filename <> '') x""",
)
def in3(t):
    rows = intake.catalog_rows(files(t).filter("filename <> ''"))
    return rows.select(
        "id", "filename", "content_type", "file_size", "checksum", "doc_type", "status", "raw_path",
        F.col("processing_metadata")["original_filename"].alias("meta_filename"),
    )


@check(
    "in4_duplicate_uploads",
    """SELECT document_id AS id, checksum, n = 1 AS "unique" FROM (
      SELECT document_id, sha256(content) AS checksum,
        row_number() OVER (PARTITION BY sha256(content) ORDER BY arrived_s, document_id) AS n FROM files) x""",
)
def in4(t):
    return intake.reject_duplicates(intake.catalog_rows(files(t))).select("id", "checksum", "unique")


@check(
    "in5_registration",
    """SELECT f.document_id AS id, CASE WHEN c.id IS NULL THEN 'completed' ELSE 'skipped' END AS register_status
    FROM files f LEFT JOIN (SELECT id FROM catalog WHERE status = 'indexed') c ON c.id = f.document_id""",
)
def in5(t):
    documents = t.files.select(F.col("document_id").alias("id"))
    return intake.register(documents, t.catalog.filter("status = 'indexed'"))


@check(
    "in6_file_metadata",
    """SELECT document_id, filename, extension,
      CASE extension WHEN '.pdf' THEN 'application/pdf' WHEN '.txt' THEN 'text/plain' ELSE 'application/octet-stream' END AS mime_type,
      size, CASE WHEN size < 1024 THEN format('{:.1f} B', size * 1.0::double) ELSE format('{:.1f} KB', size / 1024.0::double) END AS size_human, checksum
    FROM (SELECT document_id, filename, lower(regexp_extract(filename, '.(\\.[^.]+)$', 1)) AS extension,
      strlen(content) AS size, sha256(content) AS checksum FROM files) x""",
)
def in6(t):
    return intake.file_metadata(t.files)


@check(
    "in7_request_checks",
    f"""SELECT id, CASE WHEN length(text) < 1 THEN 'text_too_short' WHEN length(text) > 1000 THEN 'text_too_long'
      WHEN trim(text, '{B}') = '' THEN 'text_blank' WHEN top_k NOT BETWEEN 1 AND 100 THEN 'top_k_out_of_range'
      WHEN threshold NOT BETWEEN 0 AND 1 THEN 'threshold_out_of_range' END AS reject_reason,
      length(trim(text, '{B}')) AS chars
    FROM (SELECT doc_id AS id, text, doc_id % 110 AS top_k, cast(doc_id % 13 as double) / 10 AS threshold FROM documents) x""",
)
def in7(t):
    asked = t.documents.select(
        F.col("doc_id").alias("id"),
        "text",
        (F.col("doc_id") % 110).alias("top_k"),
        ((F.col("doc_id") % 13).cast("double") / 10).alias("threshold"),
    )
    return intake.validate_requests(asked).select(
        "id", "reject_reason", F.length("text").cast("long").alias("chars")
    )


@check(
    "sc_names_and_sizes",
    r"""SELECT page_id, translate(url, '<>:"/\|?*', '_________') AS safe,
      md5(html) AS md5, sha256(html) AS sha256,
      CASE WHEN length(url) <= 30 THEN url ELSE left(url, 27) || '...' END AS short,
      len(list_filter(list_transform(string_split(html, '>'), lambda p: trim(p, '"""
    + B
    + r"""')), lambda p: p <> '')) AS parts
    FROM pages""",
)
def sc_names(t):
    return t.pages.select(
        "page_id",
        fx.sanitize_filename(F.col("url")).alias("safe"),
        fx.checksum(F.col("html"), "md5").alias("md5"),
        fx.checksum(F.col("html")).alias("sha256"),
        fx.truncate_text(F.col("url"), 30).alias("short"),
        F.size(fx.split_on_boundary(F.col("html"), ">")).cast("long").alias("parts"),
    )


@check(
    "sc_byte_texts",
    """SELECT o_orderkey AS id, CASE WHEN b < 1024 THEN format('{:.1f} B', b) WHEN b < 1048576 THEN format('{:.1f} KB', b / 1024)
      WHEN b < 1073741824 THEN format('{:.1f} MB', b / 1048576) WHEN b < 1099511627776 THEN format('{:.1f} GB', b / 1073741824)
      ELSE format('{:.1f} TB', b / 1099511627776) END AS human
    FROM (SELECT o_orderkey, cast(cast(floor(o_totalprice) as bigint) * o_custkey * CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 100000 END as double) AS b FROM orders) x""",
)
def sc_bytes(t):
    size = F.floor("o_totalprice") * F.col("o_custkey") * F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(100000)
    return t.orders.select(F.col("o_orderkey").alias("id"), fx.format_bytes(size.cast("long")).alias("human"))


@check(
    "sc_word_counts",
    f"SELECT doc_id, cast(len(regexp_extract_all(text, '{WORD}')) as bigint) AS words FROM documents",
)
def sc_words(t):
    return t.documents.select("doc_id", fx.word_count(F.col("text")).cast("long").alias("words"))


@check(
    "sc_uuid_checks",
    r"""SELECT doc_id, regexp_full_match(replace(trim(replace(replace(u, 'urn:', ''), 'uuid:', ''), '{}'), '-', ''), '[0-9a-fA-F]{32}') AS valid
    FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN md5(text) WHEN 1 THEN '{' || md5(text) || '}' WHEN 2 THEN 'urn:uuid:' || md5(text)
      WHEN 3 THEN left(md5(text), 8) || '-' || substr(md5(text), 9) ELSE left(md5(text), 31) || 'g' END AS u FROM documents) x""",
)
def sc_uuid(t):
    digest, kind = F.md5("text"), F.col("doc_id") % 5
    made = (
        F.when(kind == 0, digest)
        .when(kind == 1, F.concat(F.lit("{"), digest, F.lit("}")))
        .when(kind == 2, F.concat(F.lit("urn:uuid:"), digest))
        .when(kind == 3, F.concat(F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 32)))
        .otherwise(F.concat(F.substring(digest, 1, 31), F.lit("g")))
    )
    return t.documents.select("doc_id", fx.is_valid_uuid(made).alias("valid"))


@check(
    "em1_hash_vectors",
    """
    WITH tokens AS (SELECT doc_id, unnest(@WORDS(text)) AS w FROM documents),
    slots AS (SELECT doc_id, cast('0x' || substr(md5(w), 1, 8) as bigint) % 64 AS slot,
        sum(CASE WHEN substr(md5(w), 9, 1) < '8' THEN 1 ELSE -1 END) AS v FROM tokens GROUP BY ALL),
    norms AS (SELECT doc_id, sqrt(sum(v * v)) AS norm FROM slots GROUP BY doc_id)
    SELECT doc_id, slot, round(v / norm, 6) AS value FROM slots JOIN norms USING (doc_id) WHERE v <> 0""",
)
def em1(t):
    vectors = embed.embed_chunks(t.documents.withColumn("content", F.col("text")))
    return (
        vectors.select("doc_id", F.posexplode("embedding").alias("slot", "raw"))
        .filter("raw <> 0")
        .select("doc_id", F.col("slot").cast("long").alias("slot"), F.round("raw", 6).alias("value"))
    )


@check(
    "em2_token_estimates",
    f"""
    WITH placed AS (SELECT document_id, len(regexp_extract_all(content, '{WORD}')) AS words,
      row_number() OVER (PARTITION BY document_id ORDER BY sequence) AS n FROM line_chunks),
    batches AS (SELECT document_id, cast(floor((n - 1) / 100) as bigint) AS b, sum(words) AS words, count(*) AS chunks
      FROM placed GROUP BY ALL)
    SELECT document_id, sum(chunks) AS chunk_count, count(*) AS batch_count,
      sum(cast(floor(words * 13 / 10) as bigint)) AS total_tokens FROM batches GROUP BY document_id""",
    longs="chunk_count total_tokens",
)
def em2(t):
    return embed.token_estimates(t.line_chunks)


@check(
    "em3_description_tokens",
    f"""SELECT document_id, count(*) AS description_count,
      cast(floor(sum(len(regexp_extract_all(description, '{WORD}'))) * 13 / 10) as bigint) AS total_tokens
    FROM slide_outputs WHERE description IS NOT NULL GROUP BY document_id""",
)
def em3(t):
    return embed.description_token_estimates(t.slide_outputs)


@check(
    "em3_description_vectors",
    """SELECT s.document_id, cast(s.slide_number as bigint) AS slide_number, s.description, cast(v.label as bigint) AS label
    FROM slide_outputs s JOIN vectors v ON v.document_id = s.document_id AND v.sequence = s.slide_number
    WHERE s.description IS NOT NULL""",
)
def em3_vectors(t):
    vectors = t.vectors.select("document_id", F.col("sequence").alias("slide_number"), "label")
    return embed.attach_description_vectors(t.slide_outputs, vectors).select(
        "document_id", F.col("slide_number").cast("long").alias("slide_number"), "description",
        F.col("label").cast("long").alias("label"),
    )


@check(
    "em1_embed_status",
    """SELECT d.document_id, CASE WHEN n.n IS NULL THEN 'skipped' ELSE 'completed' END AS embed_status, coalesce(n.n, 0) AS chunk_count
    FROM (SELECT cast(doc_id as string) AS document_id FROM documents) d
    LEFT JOIN (SELECT document_id, count(*) AS n FROM line_chunks GROUP BY document_id) n USING (document_id)""",
)
def em1_status(t):
    documents = t.documents.select(F.col("doc_id").cast("string").alias("document_id"))
    return embed.embed_statuses(documents, t.line_chunks)
