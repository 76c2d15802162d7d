"""Input tables of the checks, derived from the driver's tables by the same SQL text in
Spark and in the SQL twin. A few spellings differ between the two; they are named here.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


# name: (spelling in Spark, spelling in the twin)
SPELLINGS = {
    "DATE_LONG": ("date_format({0}, 'MMMM d, yyyy')", "strftime({0}, '%B %-d, %Y')"),
    "EPOCH": ("unix_micros(cast({0} as timestamp))", "epoch_us({0})"),
    "NUMBERED_LINES": (
        "LATERAL VIEW posexplode(split({0}, '\\n')) AS pos, line",
        ", LATERAL (SELECT unnest(range(len(string_split({0}, chr(10))))) AS pos, "
        "unnest(string_split({0}, chr(10))) AS line)",
    ),
    "PLACES": (
        "LATERAL VIEW explode(sequence(1, cast({0} as int))) AS place",
        ", LATERAL (SELECT unnest(range(1, {0} + 1)) AS place)",
    ),
    "STRINGS": ("array({0})", "[{0}]"),
    "JSON_K": ("cast(get_json_object({0}, '$.k') as bigint)", "cast(json_extract_string({0}, '$.k') as bigint)"),
    "WORDS": (
        r"filter(split(lower({0}), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+'), w -> w <> '')",
        r"list_filter(string_split_regex(lower({0}), '[^\p{{L}}\p{{N}}\p{{M}}]+'), lambda w: w <> '')",
    ),
}

DERIVED: dict[str, str] = {
    # Uploaded files: names by type, some unsupported, some empty, some without a name.
    "files": """
        SELECT cast(doc_id as string) AS document_id, doc_id,
          CASE WHEN doc_id % 31 = 5 THEN ''
               WHEN doc_id % 17 = 0 THEN 'source-' || cast(doc_id as string) || '.txt'
               WHEN doc_id % 4 = 0 THEN 'source-' || cast(doc_id as string) || ' Transcript.pdf'
               WHEN doc_id % 4 = 1 THEN 'source-' || cast(doc_id as string) || '-earnings-release.pdf'
               WHEN doc_id % 4 = 2 THEN 'source-' || cast(doc_id as string) || '_slide_deck.PDF'
               ELSE 'source-' || cast(doc_id as string) || '.pdf' END AS filename,
          CASE WHEN doc_id % 13 = 0 THEN 'text/plain' WHEN doc_id % 11 = 0 THEN NULL
               ELSE 'application/pdf' END AS content_type,
          CASE WHEN doc_id % 23 = 0 THEN '' ELSE text END AS content,
          doc_id * 60 + 1704067200 AS arrived_s
        FROM documents""",
    "catalog": """
        SELECT cast(doc_id as string) AS id, doc_id,
          'source-' || cast(doc_id as string) || '.pdf' AS filename,
          CASE WHEN doc_id % 4 = 0 THEN 'transcript' WHEN doc_id % 4 = 1 THEN 'earnings_release'
               WHEN doc_id % 4 = 2 THEN 'slide_deck' ELSE 'general' END AS doc_type,
          CASE WHEN doc_id % 7 = 0 THEN 'uploaded' WHEN doc_id % 7 = 1 THEN 'processing'
               WHEN doc_id % 7 = 2 THEN 'processed' WHEN doc_id % 7 = 3 THEN 'chunked'
               WHEN doc_id % 7 = 4 THEN 'embedded' WHEN doc_id % 7 = 5 THEN 'indexed'
               ELSE 'failed' END AS status,
          n_chars AS file_size, source,
          CASE WHEN doc_id % 5 = 0 THEN NULL
               ELSE 'documents/' || cast(doc_id as string) || '/x.pdf' END AS raw_path,
          CASE WHEN doc_id % 10 = 0 THEN NULL
               ELSE 'processed/' || cast(doc_id as string) END AS processed_path,
          CASE WHEN doc_id % 7 = 6 THEN 'failed in ' || source ELSE NULL END AS error_message,
          doc_id * 60 + 1704067200 AS created_s, doc_id * 90 + 1704067200 AS updated_s
        FROM documents""",
    # Earnings-call like text, one per order.
    "narratives": """
        SELECT cast(o_orderkey as string) AS document_id, o_orderkey,
          CASE WHEN o_orderkey % 4 = 0 THEN 'transcript' WHEN o_orderkey % 4 = 1 THEN 'release'
               WHEN o_orderkey % 4 = 2 THEN 'Slide_Deck' ELSE 'press' END AS document_type,
          cast(1 + o_orderkey % 5 as int) AS page_count,
          'Jane Smith: order ' || cast(o_orderkey as string) || chr(10) || 'Revenue was $'
            || cast(cast(o_totalprice as decimal(15,2)) as string)
            || ' million revenue and EPS of $' || cast(o_orderkey % 9 as string) || '.25 on '
            || @DATE_LONG(o_orderdate) || chr(10)
            || CASE WHEN o_orderkey % 3 = 0
                 THEN 'Questions and Answers' || chr(10) || 'Q: growth?' || chr(10) || 'A: 12.5% growth' || chr(10)
                 WHEN o_orderkey % 11 = 0 THEN 'q&a session' || chr(10) || '  Q: rate?' || chr(10) || chr(10) || 'A: 3% rate' || chr(10)
                 ELSE '' END
            || 'Bob Stone - done' AS full_text
        FROM orders""",
    "slides": """
        SELECT cast(l_orderkey as string) AS document_id, l_linenumber AS page_no,
          CASE WHEN l_linenumber % 2 = 1
               THEN 'Chart ' || cast(l_linenumber as string) || ': ' || cast(cast(max(l_quantity) as int) as string) || '%'
               WHEN l_linenumber % 4 = 2 THEN 'plain words about parts'
               ELSE '  ' END AS text
        FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "slide_outputs": """
        SELECT document_id, page_no AS slide_number,
          CASE WHEN page_no % 3 = 0 THEN NULL ELSE 'seen: ' || text END AS description,
          cast(page_no * 10 as int) AS tokens_used,
          CASE WHEN page_no % 3 = 0 THEN 'timeout' ELSE NULL END AS error
        FROM slides WHERE page_no % 5 <> 4""",
    # Tables of customers: row 0 of every twenty is the header; two extraction methods.
    "cells": """
        SELECT 'd' || cast(cast(floor(c_custkey / 100) as bigint) as string) AS document_id,
          't' || cast(cast(floor(c_custkey / 20) as bigint) as string) AS table_id,
          'plumber' AS method, cast(1 + c_custkey % 3 as int) AS page, cast(c_custkey % 20 as int) AS row_no,
          CASE WHEN c_custkey % 20 = 0
               THEN @STRINGS('name', 'segment', 'note', 'name')
               ELSE @STRINGS(c_name, c_mktsegment,
                 CASE WHEN c_custkey % 5 = 0 THEN '' ELSE cast(c_nationkey as string) END,
                 'C' || cast(c_custkey as string)) END AS cells
        FROM customer
        UNION ALL
        SELECT 'd' || cast(cast(floor(c_custkey / 100) as bigint) as string) AS document_id,
          't' || cast(cast(floor(c_custkey / 20) as bigint) as string) AS table_id,
          'lattice' AS method, cast(1 + c_custkey % 3 as int) AS page, cast(c_custkey % 20 as int) AS row_no,
          CASE WHEN c_custkey % 20 = 0
               THEN @STRINGS('name', 'segment', 'note', 'name')
               ELSE @STRINGS(c_name, c_mktsegment,
                 CASE WHEN c_custkey % 5 = 0 THEN '' ELSE cast(c_nationkey as string) END,
                 'C' || cast(c_custkey as string)) END AS cells
        FROM customer WHERE cast(floor(c_custkey / 100) as bigint) % 2 = 0""",
    # Calls of one page a line, a question on every third, so that turns go over pages.
    "call_pages": """
        SELECT cast(doc_id as string) AS document_id, 'transcript' AS document_type, cast(pos + 3 as int) AS page_no,
          CASE WHEN pos % 3 = 0 THEN 'Q: ' ELSE '- ' END || line AS text
        FROM documents @NUMBERED_LINES(text)
        UNION ALL
        SELECT cast(doc_id as string) AS document_id, 'transcript' AS document_type, 1 AS page_no,
          'Opening of ' || cast(doc_id as string) AS text FROM documents
        UNION ALL
        SELECT cast(doc_id as string) AS document_id, 'transcript' AS document_type, 2 AS page_no,
          'Questions and Answers' AS text FROM documents""",
    # One chunk per non-blank text line: a splitter both sides can express.
    "line_chunks": """
        SELECT cast(doc_id as string) || ':' || cast(pos + 1 as string) AS chunk_id,
          cast(doc_id as string) AS document_id, cast(pos + 1 as int) AS sequence, line AS content,
          CASE WHEN doc_id % 5 = 4 THEN 'archive' ELSE 'rag_chunks_v1' END AS collection
        FROM documents @NUMBERED_LINES(text)
        WHERE line <> ''""",
    # One chunk per document, with the document's vector where there is one.
    "doc_chunks": """
        SELECT cast(doc_id as string) AS chunk_id, cast(doc_id as string) AS document_id,
          cast(doc_id % 3 as int) AS sequence, text AS content, 'rag_chunks_v1' AS collection
        FROM documents""",
    "vectors": """
        SELECT cast(vec_id as string) AS chunk_id, cast(vec_id as string) AS document_id,
          cast(vec_id % 3 as int) AS sequence, embedding, label,
          CASE WHEN label = 9 THEN 'archive' ELSE 'rag_chunks_v1' END AS collection,
          'model-a' AS model_name
        FROM embeddings""",
    "queries": """
        SELECT b.item_id AS query_id, b.text, e.embedding
        FROM benchmark b JOIN embeddings e ON b.item_id = e.vec_id""",
    # Three wordings of every question, each with a vector of its own.
    "variants": """
        SELECT b.item_id AS query_id, b.variant,
          CASE WHEN b.variant = 0 THEN b.text WHEN b.variant = 1 THEN split_part(b.text, ' ', 2)
               ELSE split_part(b.text, ' ', 3) || ' ' || split_part(b.text, ' ', 4) END AS text, e.embedding
        FROM (SELECT item_id, text, cast(place % 3 as bigint) AS variant FROM benchmark @PLACES(3)) b
        JOIN embeddings e ON e.vec_id = b.item_id + 11 * (b.variant + 1)""",
    # One query per distinct long word of every item; some restricted to one document.
    "word_queries": """
        SELECT item_id * 1000 + row_number() OVER (PARTITION BY item_id ORDER BY word) AS query_id,
          word AS text,
          CASE WHEN item_id % 4 = 3 THEN cast(item_id as string) ELSE NULL END AS document_id
        FROM (SELECT DISTINCT item_id, word FROM (
          SELECT item_id, explode_words AS word FROM @EXPLODED_WORDS(benchmark)) x
          WHERE length(word) > 4) y""",
    # Pairs of neighbouring long words of every item.
    "pair_queries": """
        SELECT item_id * 1000 + row_number() OVER (PARTITION BY item_id ORDER BY text) AS query_id, text
        FROM (SELECT DISTINCT item_id, w1 || ' ' || w2 AS text FROM (
          SELECT item_id, explode_words AS w1,
            lead(explode_words) OVER (PARTITION BY item_id ORDER BY place) AS w2
          FROM @EXPLODED_WORDS(benchmark)) x
          WHERE length(w1) > 4 AND length(w2) > 4 AND w1 <> w2) y""",
    "messages": """
        SELECT cast(conv_id as string) || '-' || cast(turn as string) AS id,
          cast(conv_id as string) AS conversation_id, conv_id, turn, role, text AS content,
          1704067200 + conv_id * 3600 + turn * 60 AS created_s
        FROM conversations""",
    "talks": """
        SELECT cast(conv_id as string) AS id, cast(conv_id % 10 as string) AS user_id,
          'talk ' || cast(conv_id as string) AS title, conv_id,
          1704067200 + conv_id * 3600 AS created_s, 1704067200 + conv_id * 3600 AS updated_s
        FROM (SELECT DISTINCT conv_id FROM conversations) c""",
    # Model answers: assistant turns, some hedged.
    "answers": """
        SELECT conv_id * 100 + turn AS query_id, conv_id, turn,
          text || CASE WHEN conv_id % 5 = 0 THEN ' Maybe it is unclear.'
                       WHEN conv_id % 5 = 1 THEN ' I am not sure.' ELSE '' END AS answer,
          turn AS n_sources
        FROM conversations WHERE role = 'assistant'""",
    "calls": """
        SELECT event_id AS id, ts, @EPOCH(ts) AS ts_us, 'm' || cast(user_id % 3 as string) AS model,
          'hosted' AS provider, event_type AS route, user_id AS tenant,
          @JSON_K(props) * 100 AS prompt_tokens, @JSON_K(props) * 10 AS completion_tokens,
          cast(floor(value * 10) as bigint) AS latency_ms,
          CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status
        FROM events""",
    "ledger": """
        SELECT id, ts, ts_us, model, provider, route, tenant, prompt_tokens, completion_tokens,
          prompt_tokens + completion_tokens AS total_tokens,
          round(cast(prompt_tokens as decimal(18,0)) * cast('0.000015' as decimal(12,6))
            + cast(completion_tokens as decimal(18,0)) * cast('0.000060' as decimal(12,6)), 4) AS cost_total_usd
        FROM calls""",
    "requests": """
        SELECT event_id AS request_id, event_type AS task, cast(user_id % 20 as string) AS user_key, ts, @EPOCH(ts) AS ts_us
        FROM events""",
    # Ranked lists with external scores and raw grades, from the queries and vectors.
    "ranked": """
        SELECT item_id AS query_id, cast(place as int) AS rank,
          cast(item_id * 7 + place * 13 as string) AS chunk_id,
          cast(item_id * 7 + place * 13 as string) AS document_id,
          CASE WHEN place % 4 = 0 THEN NULL ELSE 'name-' || cast(item_id * 7 + place * 13 as string) END AS document_name,
          cast(place % 3 as int) AS sequence, cast(100 - place as double) / 100 AS score
        FROM benchmark @PLACES(2 + item_id % 7)""",
    "scores": """
        SELECT query_id, cast(rank - 1 + CASE WHEN rank = 3 THEN 50 ELSE 0 END as int) AS idx,
          cast((query_id * 31 + rank * 17) % 100 as double) / 100 AS score
        FROM ranked WHERE query_id % 6 <> 0 AND rank % 5 <> 2""",
    "grades": """
        SELECT query_id, rank, chunk_id,
          CASE WHEN (query_id * 3 + rank) % 11 = 0 THEN 'no json here'
               WHEN (query_id * 3 + rank) % 13 = 0 THEN '{"relevance": 0.9}'
               WHEN (query_id * 3 + rank) % 7 = 0 THEN 'Sure: {"relevance": "0.8", "supportiveness": 0.7, "usefulness": 1} done'
               WHEN (query_id * 3 + rank) % 17 = 0 THEN '[1, 2]'
               WHEN (query_id * 3 + rank) % 19 = 0 THEN '{"relevance": null, "supportiveness": 1}'
               ELSE '{"relevance": ' || cast(((query_id * 31 + rank * 17) % 10) as string) || 'e-1, "supportiveness": "0.'
                 || cast(((query_id * 13 + rank * 7) % 10) as string) || '", "usefulness": 0.'
                 || cast(((query_id * 5 + rank * 3) % 10) as string) || '}' END AS raw
        FROM ranked""",
}

# Word lists with their place: LATERAL forms differ between the two.
_EXPLODED = {
    "spark": "(SELECT t.*, place, explode_words FROM {0} t LATERAL VIEW posexplode(@WORDS(text)) AS place, explode_words)",
    "twin": "(SELECT t.*, unnest(range(len(@WORDS(text)))) AS place, unnest(@WORDS(text)) AS explode_words FROM {0} t)",
}


def _spell(text: str, side: int) -> str:
    """Replaces every @NAME(arg) by its spelling on one side."""
    exploded = _EXPLODED["spark" if side == 0 else "twin"]
    text = re.sub(r"@EXPLODED_WORDS\((\w+)\)", lambda m: exploded.format(m.group(1)), text)
    for name, forms in SPELLINGS.items():
        while (at := text.find(f"@{name}(")) >= 0:
            start = at + len(name) + 2
            depth, end = 1, start
            while depth:
                depth += {"(": 1, ")": -1}.get(text[end], 0)
                end += 1
            text = text[:at] + forms[side].format(text[start : end - 1]) + text[end:]
    return text


DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def derive(tables, name: str) -> DataFrame:
    """A derived table as a DataFrame; its inputs are bound by temporary view names."""
    text = _spell(DERIVED[name], 0)
    for n in (*DRIVER_TABLES, *DERIVED):
        if n != name and re.search(rf"(FROM|JOIN) {n}\b", text):
            getattr(tables, n).createOrReplaceTempView(f"quarryline_{n}")
            text = re.sub(rf"(FROM|JOIN) {n}\b", rf"\1 quarryline_{n}", text)
    return tables.spark.sql(text)


def with_ctes(sql: str) -> str:
    """SQL of a twin with the derived tables it names in front, in order of need."""
    sql = _spell(sql, 1)
    needed: list[str] = []

    def need(text: str, skip: str = "") -> None:
        for n in DERIVED:
            if n != skip and n not in needed and re.search(rf"(FROM|JOIN) {n}\b", text):
                need(DERIVED[n], n)
                if n not in needed:
                    needed.append(n)

    need(sql)
    parts = [f"{n} AS MATERIALIZED ({_spell(DERIVED[n], 1)})" for n in needed]
    body = sql.strip()
    recursive = body.upper().startswith("WITH RECURSIVE")
    if body.upper().startswith("WITH"):
        body = re.sub(r"^WITH( RECURSIVE)?\s+", "", body, flags=re.I)
        parts.append("")
        joined = ",\n".join(parts[:-1])
        head = "WITH RECURSIVE " if recursive else "WITH "
        return head + (joined + ",\n" if joined else "") + body
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body

