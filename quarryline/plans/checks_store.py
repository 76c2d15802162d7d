"""Checks: conversations, catalog, cost ledger, streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.functions import text as fx
from quarryline.operators import catalog, conversations, costs, partials, requests
from quarryline.plans import ingest_job
from quarryline.plans.checks_intake import _manifests
from quarryline.plans.checks_parse import ALL_CHUNKS_SQL, CHUNK_ID_SQL
from quarryline.plans.registry import check
from quarryline.session import fresh_path
from quarryline.sources import runs, store
from quarryline.streaming import dedup, ingest, spend

WORD = f"[^{fx.BLANK_CLASS}]+"


def _messages(t):
    return t.messages.withColumn("created_at", F.timestamp_seconds("created_s"))


def _talks(t):
    return t.talks.withColumn("created_at", F.timestamp_seconds("created_s")).withColumn(
        "updated_at", F.timestamp_seconds("updated_s")
    )


def _catalog(t):
    return t.catalog.withColumn("created_at", F.timestamp_seconds("created_s")).withColumn(
        "updated_at", F.timestamp_seconds("updated_s")
    )


def _ledger(t):
    return t.ledger.withColumn("ts", F.timestamp_micros("ts_us")).withColumn(
        "cost_total_usd", F.col("cost_total_usd").cast("decimal(18,4)")
    )


@check(
    "cv1_recent_messages",
    """SELECT conversation_id, id, age FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY created_s DESC, id DESC) AS age FROM messages) x WHERE age <= 4""",
)
def cv1(t):
    return conversations.recent_messages(_messages(t), 4).select(
        "conversation_id", "id", F.col("age").cast("long").alias("age")
    )


@check(
    "cv2_conversation_list",
    "SELECT id, user_id, title FROM talks WHERE user_id = '3' ORDER BY updated_s DESC, id LIMIT 50",
)
def cv2(t):
    return conversations.list_conversations(_talks(t), "3").select("id", "user_id", "title")


@check(
    "cv2_lists_per_user",
    """SELECT id, user_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY updated_s DESC, id) AS rank FROM talks) x WHERE rank <= 5""",
)
def cv2_users(t):
    return conversations.list_per_user(_talks(t), 5).select("id", "user_id", F.col("rank").cast("long").alias("rank"))


@check(
    "cv3_conversation_lookup",
    """SELECT cast(d.doc_id as string) AS id, t.id IS NOT NULL AS found, t.title FROM documents d LEFT JOIN talks t ON t.id = cast(d.doc_id as string)""",
)
def cv3(t):
    wanted = t.documents.select(F.col("doc_id").cast("string").alias("id"))
    return conversations.look_up(wanted, _talks(t)).select("id", "found", "title")


@check(
    "cv4_updated_conversations",
    """SELECT t.id, greatest(t.updated_s, coalesce(m.newest, 0)) AS updated_s FROM talks t
    LEFT JOIN (SELECT conversation_id, max(created_s) AS newest FROM messages WHERE turn >= 2 GROUP BY conversation_id) m ON m.conversation_id = t.id""",
)
def cv4(t):
    bumped = conversations.bump_updated(_talks(t), _messages(t).filter("turn >= 2"))
    return bumped.select("id", F.unix_seconds("updated_at").alias("updated_s"))


@check(
    "cv5_history_texts",
    """SELECT conversation_id, string_agg(role || ': ' || content, chr(10) ORDER BY created_s) AS history FROM (
      SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY created_s DESC) AS age FROM messages) x WHERE age <= 6 GROUP BY conversation_id""",
)
def cv5(t):
    return conversations.history_texts(_messages(t))


@check(
    "sk6_appended_messages",
    "SELECT id, conversation_id, role, content FROM messages",
)
def sk6(t):
    rows = _messages(t).select("id", "conversation_id", "role", "content", "created_at", "turn")
    stored = conversations.append_messages(rows.filter("turn < 3"), rows.filter("turn >= 3"))
    path = fresh_path(t.spark, "messages")
    stored.write.parquet(path)
    return t.spark.read.schema(stored.schema).parquet(path).select("id", "conversation_id", "role", "content")


@check(
    "sk6_created_conversations",
    "SELECT id, title, created_s, created_s AS updated_s FROM talks",
)
def sk6_talks(t):
    talks = _talks(t).drop("created_s", "updated_s")
    new = talks.filter("conv_id % 2 = 1").drop("updated_at")
    joined = conversations.create_conversations(talks.filter("conv_id % 2 = 0"), new)
    return joined.select(
        "id", "title", F.unix_seconds("created_at").alias("created_s"), F.unix_seconds("updated_at").alias("updated_s")
    )


@check(
    "ct1_filtered_list",
    """SELECT id, status, file_size FROM catalog WHERE status IN ('indexed', 'failed') AND doc_type = 'transcript' ORDER BY file_size DESC, id LIMIT 25 OFFSET 5""",
)
def ct1(t):
    page = catalog.list_rows(
        _catalog(t), 5, 25, "-file_size", status=["indexed", "failed"], doc_type="transcript", source=None
    )
    return page.select("id", "status", "file_size")


@check(
    "ct2_page_info",
    "SELECT count(*) AS total, 3 AS page, 20 AS page_size, count(*) > 60 AS has_next FROM catalog WHERE status = 'failed'",
    longs="page page_size",
)
def ct2(t):
    info = catalog.page_info(_catalog(t), 40, 20, status="failed")
    return info.select("total", F.col("page").cast("long").alias("page"), F.col("page_size").cast("long").alias("page_size"), "has_next")


@check(
    "ct3_lookup",
    "SELECT id, filename FROM catalog WHERE status = 'chunked' AND doc_type = 'general'",
)
def ct3(t):
    return catalog.look_up(_catalog(t), status="chunked", doc_type="general").select("id", "filename")


@check(
    "ct3_exists",
    """SELECT f.document_id, c.filename IS NOT NULL AS "exists" FROM files f LEFT JOIN (SELECT DISTINCT filename FROM catalog WHERE status = 'indexed') c ON c.filename = f.filename""",
)
def ct3_exists(t):
    wanted = t.files.select("document_id", "filename")
    return catalog.exists_many(wanted, t.catalog.filter("status = 'indexed'"), "filename").select("document_id", "exists")


@check("ct4_by_status", "SELECT id FROM catalog WHERE status = 'embedded' ORDER BY created_s, id LIMIT 100")
def ct4(t):
    return catalog.by_status(_catalog(t), "embedded").select("id")


@check("ct4_by_type", "SELECT id FROM catalog WHERE doc_type = 'slide_deck' ORDER BY created_s, id LIMIT 100")
def ct4_type(t):
    return catalog.by_type(_catalog(t), "slide_deck").select("id")


@check(
    "ct5_updates",
    """SELECT id, CASE WHEN doc_id % 3 = 0 THEN 'indexed' ELSE status END AS status,
      CASE WHEN doc_id % 6 = 0 THEN 'note' ELSE error_message END AS error_message,
      CASE WHEN doc_id % 3 = 0 THEN 1800000000 ELSE updated_s END AS updated_s FROM catalog""",
)
def ct5(t):
    rows = _catalog(t)
    changes = rows.filter("doc_id % 3 = 0").select(
        "id", F.lit("indexed").alias("status"), F.when(F.col("doc_id") % 6 == 0, "note").alias("error_message")
    )
    updated = catalog.update(rows, changes, F.timestamp_seconds(F.lit(1800000000)))
    return updated.select("id", "status", "error_message", F.unix_seconds("updated_at").alias("updated_s"))


@check("ct6_deletes", "SELECT id FROM catalog WHERE status <> 'failed'")
def ct6(t):
    rows = _catalog(t)
    return catalog.delete(rows, rows.filter("status = 'failed'").select("id")).select("id")


@check("ct6_deleted_count", "SELECT count(*) AS deleted FROM catalog WHERE source IN (SELECT source FROM catalog WHERE doc_id = 1)")
def ct6_count(t):
    rows = _catalog(t)
    return catalog.deleted_count(rows, rows.filter("doc_id = 1"), on="source")


@check(
    "ct7_cascade_delete",
    """WITH gone AS (SELECT id FROM catalog WHERE status = 'failed')
    SELECT 'catalog' AS name, count(*) AS n FROM catalog WHERE id NOT IN (SELECT id FROM gone)
    UNION ALL SELECT 'chunks', count(*) FROM line_chunks WHERE document_id NOT IN (SELECT id FROM gone)
    UNION ALL SELECT 'vectors', count(*) FROM vectors WHERE chunk_id NOT IN (SELECT doc.chunk_id FROM doc_chunks doc WHERE doc.document_id IN (SELECT id FROM gone))
    UNION ALL SELECT 'utterances', count(*) FROM messages WHERE conversation_id NOT IN (SELECT id FROM gone)""",
)
def ct7(t):
    rows = _catalog(t)
    doomed = rows.filter("status = 'failed'")
    utterances = t.messages.withColumn("document_id", F.col("conversation_id"))
    by_lines = catalog.delete_cascade(doomed, rows, t.line_chunks, t.vectors, utterances)
    by_documents = catalog.delete_cascade(doomed, rows, t.doc_chunks, t.vectors)
    left = by_lines | {"vectors": by_documents["vectors"]}
    out = None
    for name, table in left.items():
        part = table.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


# Stored tables in buckets: only those of the deleted documents are read and rewritten.
@check(
    "ct7_stored_cascade",
    """WITH gone AS (SELECT id FROM catalog WHERE status = 'failed')
    SELECT 'catalog' AS name, id FROM catalog WHERE id NOT IN (SELECT id FROM gone)
    UNION ALL SELECT 'chunks', chunk_id FROM line_chunks WHERE document_id NOT IN (SELECT id FROM gone)
    UNION ALL SELECT 'vectors', chunk_id FROM vectors WHERE document_id NOT IN (SELECT id FROM gone)""",
)
def ct7_stored(t):
    rows = _catalog(t)
    tables = {"catalog": (rows, "id"), "chunks": (t.line_chunks, "document_id"), "vectors": (t.vectors, "document_id")}
    paths = {name: fresh_path(t.spark, f"{name}-store") for name in tables}
    for name, (table, by) in tables.items():
        store.create(table, paths[name], by, 16)
    doomed = rows.filter("status = 'failed'").select("id")
    store.delete_cascade(t.spark, doomed, paths["catalog"], [paths["vectors"], paths["chunks"]])
    out = None
    for name, key in (("catalog", "id"), ("chunks", "chunk_id"), ("vectors", "chunk_id")):
        part = store.read(t.spark, paths[name]).select(F.lit(name).alias("name"), F.col(key).alias("id"))
        out = part if out is None else out.unionByName(part)
    return out


@check(
    "ct5_stored_updates",
    """SELECT id, CASE WHEN doc_id % 97 = 0 THEN 'indexed' ELSE status END AS status,
      CASE WHEN doc_id % 97 = 0 THEN 1800000000 ELSE updated_s END AS updated_s FROM catalog""",
)
def ct5_stored(t):
    rows = _catalog(t)
    path = fresh_path(t.spark, "catalog-store")
    store.create(rows, path, "id", 16)
    changes = rows.filter("doc_id % 97 = 0").select("id", F.lit("indexed").alias("status"))
    store.update(t.spark, path, changes, F.timestamp_seconds(F.lit(1800000000)))
    return store.read(t.spark, path).select("id", "status", F.unix_seconds("updated_at").alias("updated_s"))


@check(
    "ct7_conversation_cascade",
    """WITH gone AS (SELECT DISTINCT conversation_id AS id FROM messages WHERE role = 'assistant' AND length(content) > 200)
    SELECT 'conversations' AS name, count(DISTINCT conversation_id) AS n FROM messages WHERE conversation_id NOT IN (SELECT id FROM gone)
    UNION ALL SELECT 'messages', count(*) FROM messages WHERE conversation_id NOT IN (SELECT id FROM gone)""",
)
def ct7_conversations(t):
    talks = t.messages.select(F.col("conversation_id").alias("id")).distinct()
    doomed = t.messages.filter("role = 'assistant' AND length(content) > 200").select(F.col("conversation_id").alias("id"))
    left = catalog.delete_conversations(doomed, talks, t.messages)
    parts = [left[n].agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in ("conversations", "messages")]
    return parts[0].unionByName(parts[1])


@check("ct8_inserts", "SELECT id, doc_type FROM catalog")
def ct8(t):
    rows = _catalog(t)
    return catalog.insert(rows.filter("doc_id % 2 = 0"), rows.filter("doc_id % 2 = 1").drop("source")).select("id", "doc_type")


@check(
    "ct9_processing_stats",
    """
    WITH domain AS (SELECT 'status' AS dimension, unnest(['uploaded', 'processing', 'processed', 'chunked', 'embedded', 'indexed', 'failed']) AS value
      UNION ALL SELECT 'type', unnest(['transcript', 'earnings_release', 'slide_deck', 'general']) UNION ALL SELECT 'total', 'all'),
    counted AS (SELECT 'status' AS dimension, status AS value, count(*) AS n FROM catalog GROUP BY ALL
      UNION ALL SELECT 'type', doc_type, count(*) FROM catalog GROUP BY ALL UNION ALL SELECT 'total', 'all', count(*) FROM catalog)
    SELECT dimension, value, coalesce(n, 0) AS documents FROM domain LEFT JOIN counted USING (dimension, value)""",
)
def ct9(t):
    return catalog.processing_stats(_catalog(t))


@check(
    "ct10_corpus_stats",
    """SELECT (SELECT count(*) FROM catalog) AS total_documents, (SELECT count(*) FROM catalog WHERE status = 'processing') AS processing,
      (SELECT count(*) FROM catalog WHERE status = 'indexed') AS completed, (SELECT count(*) FROM catalog WHERE status = 'failed') AS failed,
      (SELECT count(*) FROM line_chunks) AS chunks, (SELECT count(*) FROM vectors) AS embeddings, (SELECT sum(file_size) FROM catalog) AS bytes""",
    longs="bytes",
)
def ct10(t):
    return catalog.corpus_stats(_catalog(t), t.line_chunks, t.vectors)


@check(
    "ct11_status_views",
    """SELECT id, status, coalesce(raw_path, processed_path, '') AS storage_path, status IN ('indexed', 'failed') AS complete,
      status IN ('chunked', 'embedded', 'indexed') AS queryable, status = 'processed' AS can_be_chunked, status = 'chunked' AS can_be_embedded,
      error_message AS error FROM catalog""",
)
def ct11(t):
    return catalog.status_view(_catalog(t)).drop("filename", "doc_type", "metadata")


def _requests(t):
    keyed = t.requests.withColumn("ts", F.timestamp_micros("ts_us"))
    args = F.create_map(F.lit("user"), F.col("user_key"))
    return keyed.withColumn("key", requests.idempotency_key(F.col("task"), args))


# Every accepted request points to the next one of its key at least an hour later.
ACCEPTED_SQL = """
  WITH RECURSIVE keyed AS (SELECT request_id, 'idem:' || task || ':' || sha256('{"user":"' || user_key || '"}') AS key, ts_us FROM requests),
  events_ AS (SELECT key, ts_us, min(request_id) AS request_id FROM keyed GROUP BY key, ts_us),
  nexts AS MATERIALIZED (SELECT e.key, e.ts_us, e.request_id, n.ts_us AS next_us FROM events_ e
    ASOF LEFT JOIN events_ n ON n.key = e.key AND e.ts_us + 3600000000 <= n.ts_us),
  accepted AS (SELECT n.* FROM nexts n JOIN (SELECT key, min(ts_us) AS ts_us FROM events_ GROUP BY key) f ON f.key = n.key AND f.ts_us = n.ts_us
    UNION ALL SELECT n.* FROM accepted a JOIN nexts n ON n.key = a.key AND n.ts_us = a.next_us)"""


@check(
    "ct12_idempotent_requests",
    ACCEPTED_SQL + " SELECT k.request_id, k.key, a.request_id IS NOT NULL AS accepted FROM keyed k LEFT JOIN accepted a ON a.request_id = k.request_id",
)
def ct12(t):
    return requests.accept_first(_requests(t)).select("request_id", "key", "accepted")


@check(
    "co1_call_costs",
    """SELECT id, cast(round(cast(prompt_tokens as decimal(18,0)) * cast('0.000015' as decimal(12,6)), 4) as double) AS cost_in,
      cast(round(cast(completion_tokens as decimal(18,0)) * cast('0.000060' as decimal(12,6)), 4) as double) AS cost_out,
      cast(round(cast(prompt_tokens as decimal(18,0)) * cast('0.000015' as decimal(12,6)) + cast(completion_tokens as decimal(18,0)) * cast('0.000060' as decimal(12,6)), 4) as double) AS cost_total
    FROM calls""",
)
def co1(t):
    cost_in, cost_out, total = costs.call_costs(F.col("prompt_tokens"), F.col("completion_tokens"))
    return t.calls.select(
        "id", cost_in.cast("double").alias("cost_in"), cost_out.cast("double").alias("cost_out"), total.cast("double").alias("cost_total")
    )


@check(
    "co2_priced_events",
    """SELECT id, model, total_tokens, 0.000015 AS price_in, 0.00006 AS price_out, cast(cost_total_usd as double) AS usd FROM ledger""",
    doubles="price_in price_out",
)
def co2(t):
    return costs.priced_events(t.calls).select(
        F.col("id"), "model", "total_tokens", F.col("unit_price_in_usd").cast("double").alias("price_in"),
        F.col("unit_price_out_usd").cast("double").alias("price_out"), F.col("cost_total_usd").cast("double").alias("usd"),
    )


@check(
    "co3_answer_calls",
    f"""SELECT query_id, p AS prompt_tokens, c AS completion_tokens,
      cast(round(cast(p as decimal(18,0)) * cast('0.000015' as decimal(12,6)) + cast(c as decimal(18,0)) * cast('0.000060' as decimal(12,6)), 4) as double) AS usd
    FROM (SELECT query_id, len(regexp_extract_all(answer || ' extra words', '{WORD}')) AS p, len(regexp_extract_all(answer, '{WORD}')) AS c FROM answers) x""",
)
def co3(t):
    priced = costs.answer_calls(t.answers.withColumn("prompt", F.concat("answer", F.lit(" extra words"))))
    return priced.select(
        "query_id", F.col("prompt_tokens").cast("long").alias("prompt_tokens"),
        F.col("completion_tokens").cast("long").alias("completion_tokens"), F.col("cost_total_usd").cast("double").alias("usd"),
    )


@check(
    "co4_step_events",
    """SELECT c.id AS document_id, CASE WHEN c.error_message IS NULL THEN 'completed' ELSE 'failed' END AS status, length(c.id) * 100 AS latency_ms,
      CASE WHEN c.error_message IS NULL THEN cast(coalesce(n.n, 0) as string) END AS chunk_count, c.error_message AS error
    FROM catalog c LEFT JOIN (SELECT document_id, count(*) AS n FROM line_chunks GROUP BY document_id) n ON n.document_id = c.id""",
)
def co4(t):
    return costs.step_events(_manifests(t)).select(
        "document_id", "status", "latency_ms",
        F.try_element_at("metadata", F.lit("chunk_count")).alias("chunk_count"),
        F.try_element_at("metadata", F.lit("error")).alias("error"),
    )


@check(
    "co5_daily_spend",
    """SELECT cast(floor(ts_us / 86400000000) as bigint) AS day, provider, model, route, count(*) AS calls, sum(total_tokens) AS tokens,
      cast(sum(cost_total_usd) as double) AS spend FROM ledger GROUP BY ALL""",
    longs="tokens",
)
def co5(t):
    daily = costs.rollup(_ledger(t))
    return daily.select(
        F.floor(F.unix_seconds("period") / 86400).alias("day"), "provider", "model", "route", "calls", "tokens",
        F.col("spend").cast("double").alias("spend"),
    )


@check(
    "co5_spend_subtotals",
    """SELECT model, route, count(*) AS calls, sum(total_tokens) AS tokens, cast(sum(cost_total_usd) as double) AS spend FROM ledger GROUP BY ROLLUP (model, route)""",
    longs="tokens",
)
def co5_subtotals(t):
    return costs.rollup_subtotals(_ledger(t)).withColumn("spend", F.col("spend").cast("double"))


# The same from partial sums of four batches, of which one came twice and two were folded.
@check(
    "co5_merged_batches",
    """SELECT cast(floor(ts_us / 86400000000) as bigint) AS day, provider, model, count(*) AS calls, sum(total_tokens) AS tokens,
      cast(sum(cost_total_usd) as double) AS spend FROM ledger GROUP BY ALL""",
    longs="tokens",
)
def co5_merged(t):
    ledger, path = _ledger(t), fresh_path(t.spark, "partials")
    batch = F.pmod(F.col("tenant"), F.lit(4))
    for i, step in enumerate((0, 1, 1, "fold", 2, 3)):
        if step == "fold":
            partials.fold(t.spark, path, f"fold-{i}")
        else:
            partials.append(t.spark, path, f"batch-{step}", ledger.filter(batch == step))
    return partials.rollup(t.spark, path, by=("provider", "model")).select(
        F.datediff("day", F.lit("1970-01-01")).cast("long").alias("day"), "provider", "model", "calls", "tokens",
        F.col("spend").cast("double").alias("spend"),
    )


RUNNING_SQL = """
  burned AS (SELECT id, tenant, date_trunc('month', ts) AS month, ts_us, sum(cost_total_usd) OVER (PARTITION BY tenant, date_trunc('month', ts) ORDER BY ts_us, id ROWS UNBOUNDED PRECEDING) AS burn FROM ledger)"""


@check("co6_running_spend", f"WITH {RUNNING_SQL} SELECT id, tenant, cast(burn as double) AS burn FROM burned")
def co6_running(t):
    return costs.running_spend(_ledger(t)).select("id", "tenant", F.col("burn").cast("double").alias("burn"))


@check(
    "co6_budget_breaches",
    f"""WITH {RUNNING_SQL},
    over AS (SELECT tenant, month, min(ts_us) AS breach_us FROM burned WHERE burn > 2.5 + tenant % 3 GROUP BY ALL)
    SELECT b.tenant, cast(max(b.burn) as double) AS spent, any_value(o.breach_us) IS NOT NULL AS breached,
      min(CASE WHEN b.ts_us = o.breach_us AND b.burn > 2.5 + b.tenant % 3 THEN b.id END) AS breach_id
    FROM burned b LEFT JOIN over o ON o.tenant = b.tenant AND o.month = b.month GROUP BY b.tenant, b.month""",
)
def co6(t):
    caps = t.events.select(F.col("user_id").alias("tenant")).distinct().withColumn(
        "cap", (F.lit(2.5) + F.col("tenant") % 3).cast("decimal(18,4)")
    )
    found = costs.budget_breaches(_ledger(t), caps)
    return found.select("tenant", F.col("spent").cast("double").alias("spent"), "breached", "breach_id")


@check("co7_retention", "SELECT id FROM ledger WHERE ts_us >= 1705276800000000")
def co7(t):
    return costs.retain(_ledger(t), F.timestamp_seconds(F.lit(1705276800))).select("id")


def _stored(t, table, label, files=4):
    """A folder of Parquet files for a stream to read."""
    path = fresh_path(t.spark, label)
    table.repartition(files).write.parquet(path)
    return path


@check(
    "st1_streamed_ingest",
    f"WITH {ALL_CHUNKS_SQL} SELECT {CHUNK_ID_SQL} AS chunk_id, document_id, sequence, trim(content, '{fx.BLANKS}') AS content FROM pieces",
)
def st1(t):
    pages = t.narratives.select(
        "document_id", "document_type", F.lit(1).alias("page_no"), F.col("full_text").alias("text")
    )
    # The second pages arrive in a later batch, which ingests their documents anew.
    path = _stored(t, pages, "pages", 2)
    later = pages.filter("cast(document_id as bigint) % 2 = 0").withColumns({"page_no": F.lit(2), "text": F.lit("")})
    later.coalesce(1).write.mode("append").parquet(path)
    return ingest.run_available(t.spark, path, files_per_batch=1, files=8, buckets=8).select(
        "chunk_id", "document_id", F.col("sequence").cast("long").alias("sequence"), "content"
    )


# Of documents with the same text the first goes on; every eighth is indexed already.
# Three runs over chunks and their documents; the second is repeated with fewer rows.
@check(
    "sk4_marked_runs",
    """WITH kept AS (SELECT *, cast(document_id as bigint) % 3 AS part FROM line_chunks)
    SELECT document_id, 'run-' || cast(part as string) AS run, count(*) AS chunks FROM kept
    WHERE part <> 1 OR sequence % 2 = 1 GROUP BY ALL""",
)
def sk4_marked(t):
    path = fresh_path(t.spark, "runs")
    chunks = t.line_chunks.select("document_id", "sequence", "content")
    part = F.col("document_id").cast("long") % 3
    for run, odd in ((0, False), (1, False), (2, False), (1, True)):
        rows = chunks.filter((part == run) & (F.lit(not odd) | (F.col("sequence") % 2 == 1)))
        tables = {"chunks": rows, "status": rows.select("document_id").distinct()}
        runs.commit(t.spark, path, f"run-{run}", tables)
    found = runs.read(t.spark, path, "chunks", with_run=True)
    status = runs.read(t.spark, path, "status", with_run=True)
    return found.join(status, ["document_id", "run"]).groupBy("document_id", "run").agg(
        F.count("*").alias("chunks")
    )


@check(
    "sk4_ingest_job",
    """WITH firsts AS (SELECT text, min(doc_id) AS first FROM documents GROUP BY text)
    SELECT cast(d.doc_id as string) AS document_id,
      CASE WHEN d.doc_id % 8 = 0 THEN 'skipped' ELSE 'completed' END AS register_status,
      CASE WHEN d.doc_id <> f.first THEN 'failed' ELSE 'completed' END AS manifest_status,
      CASE WHEN d.doc_id % 8 = 0 THEN 'uploaded' WHEN d.doc_id <> f.first THEN 'failed' ELSE 'indexed' END AS status,
      d.doc_id % 8 <> 0 AND d.doc_id = f.first AS has_chunks
    FROM documents d JOIN firsts f ON f.text = d.text WHERE trim(d.text) <> ''""",
)
def ingest_job_rows(t):
    documents = t.documents.filter("trim(text) <> ''")
    number = F.col("doc_id").cast("string")
    rows = documents.select(
        number.alias("id"), F.md5("text").alias("checksum"), F.lit("general").alias("doc_type"),
        F.lit("uploaded").alias("status"), F.lit(None).cast("string").alias("error_message"),
        F.timestamp_seconds("doc_id").alias("created_at"), F.timestamp_seconds("doc_id").alias("updated_at"),
    )
    pages = documents.select(
        number.alias("document_id"), F.lit("general").alias("document_type"), F.lit(1).alias("page_no"), "text"
    )
    known = rows.filter("cast(id as bigint) % 8 = 0").select("id")
    done = ingest_job.run(rows, pages, known, "run-1", F.timestamp_seconds(F.lit(1_700_000_000)))
    manifests = done.manifests.select(
        "document_id", F.col("steps.register").alias("register_status"), F.col("status").alias("manifest_status"),
        (F.col("chunk_count") > 0).alias("has_chunks"),
    )
    return manifests.join(done.catalog.select(F.col("id").alias("document_id"), "status"), "document_id")


def _finished(stream, path, checkpoint, mode="append"):
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)
    query.awaitTermination()


@check(
    "st2_streamed_requests",
    ACCEPTED_SQL + " SELECT request_id FROM accepted",
)
def st2(t):
    target = fresh_path(t.spark, "accepted")
    dedup.accept_first_stream(_request_stream(t), target, fresh_path(t.spark, "accepted-checkpoint")).awaitTermination()
    return dedup.accepted_rows(t.spark, target).select("request_id")


# The same with state and timers per key.
@check("st2_keyed_requests", ACCEPTED_SQL + " SELECT request_id FROM accepted")
def st2_keyed(t):
    target = fresh_path(t.spark, "keyed")
    store_class = "spark.sql.streaming.stateStore.providerClass"
    before = t.spark.conf.get(store_class)
    t.spark.conf.set(store_class, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        _finished(dedup.accept_first_keyed(_request_stream(t)), target, fresh_path(t.spark, "keyed-checkpoint"))
    finally:
        t.spark.conf.set(store_class, before)
    return t.spark.read.schema("key string, request_id long, ts timestamp").parquet(target).select("request_id")


def _request_stream(t):
    """Requests in three batches, in the order of time."""
    asked = _requests(t).select("key", "request_id", "ts")
    source = fresh_path(t.spark, "requests")
    ends = asked.select(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), [0.33, 0.66]).alias("e")).first().e
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    for low, high in ((None, ends[0]), (ends[0], ends[1]), (ends[1], None)):
        part = asked if low is None else asked.filter(at > low)
        part = part if high is None else part.filter(at <= high)
        part.coalesce(1).write.mode("append").parquet(source)
    return t.spark.readStream.schema("key string, request_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(source)


@check("st2_streamed_repeats", ACCEPTED_SQL + " SELECT key, count(DISTINCT key) AS kept FROM keyed GROUP BY key")
def st2_repeats(t):
    source = _stored(t, _requests(t).select("key", "request_id", "ts"), "requests", 1)
    rows = t.spark.readStream.schema("key string, request_id long, ts timestamp").parquet(source)
    target = fresh_path(t.spark, "repeats")
    _finished(dedup.drop_repeats(rows), target, fresh_path(t.spark, "repeats-checkpoint"))
    return t.spark.read.schema("key string, request_id long, ts timestamp").parquet(target).groupBy("key").agg(F.count("*").alias("kept"))


@check(
    "st3_spend_per_minute",
    """SELECT cast(floor(ts_us / 60000000) as bigint) AS minute, model, count(*) AS calls, sum(total_tokens) AS tokens, cast(sum(cost_total_usd) as double) AS spend,
      sum(total_tokens) > 6000 AS over_quota FROM ledger GROUP BY ALL""",
    longs="tokens",
)
def st3(t):
    ledger = _ledger(t)
    quotas = ledger.select("model").distinct().withColumn("quota", F.lit(6000))
    windows = spend.over_quota(spend.windowed_spend(ledger), quotas)
    return windows.select(
        F.floor(F.unix_seconds("window.start") / 60).alias("minute"), "model", "calls", "tokens",
        F.col("spend").cast("double").alias("spend"), "over_quota",
    )


# The stream ends with the watermark ten minutes before the last event: later windows
# are still open then.
@check(
    "st3_streamed_daily_spend",
    """SELECT day, model, calls, spend FROM (SELECT cast(floor(ts_us / 86400000000) as bigint) AS day, model, count(*) AS calls, cast(sum(cost_total_usd) as double) AS spend
      FROM ledger GROUP BY ALL) x WHERE (day + 1) * 86400000000 <= (SELECT max(ts_us) - 600000000 FROM ledger)""",
)
def st3_stream(t):
    kept = _ledger(t).select("id", "ts", "model", "total_tokens", "cost_total_usd")
    source = _stored(t, kept, "ledger", 1)
    rows = t.spark.readStream.schema(kept.schema).parquet(source)
    target = fresh_path(t.spark, "spend")
    _finished(spend.windowed_spend_stream(rows, "1 day"), target, fresh_path(t.spark, "spend-checkpoint"))
    return t.spark.read.parquet(target).select(
        F.floor(F.unix_seconds("window.start") / 86400).alias("day"), "model", "calls", F.col("spend").cast("double").alias("spend")
    )
