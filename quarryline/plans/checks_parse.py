"""Checks: parsing and chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.functions import text as fx
from quarryline.operators import chunk, parse, shards
from quarryline.plans import corpus
from quarryline.plans.registry import check
from quarryline.sources import readers

B = fx.BLANKS
WORD = f"[^{fx.BLANK_CLASS}]+"
SPEAKER = parse.SPEAKER_PATTERN
AMOUNT_METRICS = parse.RELEASE_METRICS | parse.DECK_METRICS

BRANCH_SQL = """CASE WHEN lower(document_type) IN ('transcript', 'earnings_transcript') THEN 'transcript'
  WHEN lower(document_type) IN ('release', 'earnings_release') THEN 'release'
  WHEN lower(document_type) IN ('slides', 'slide_deck') THEN 'slides' ELSE 'press' END"""

# Position of the first marker in list order, null without one.
QA_SQL = """coalesce(
  nullif(strpos(lower(full_text), nullif(lower(regexp_extract(full_text, '(?i)\\bQ&A\\b')), '')), 0),
  nullif(strpos(lower(full_text), nullif(lower(regexp_extract(full_text, '(?i)\\bQuestion and Answer\\b')), '')), 0),
  nullif(strpos(lower(full_text), nullif(lower(regexp_extract(full_text, '(?i)\\bQuestions and Answers\\b')), '')), 0),
  nullif(strpos(lower(full_text), nullif(lower(regexp_extract(full_text, '(?i)\\bQ-and-A\\b')), '')), 0))"""

SECTIONS_SQL = f"""
  placed AS (SELECT document_id, document_type, full_text, page_count, {QA_SQL} AS qa_at FROM narratives),
  sections AS (
    SELECT document_id, 1 AS section_no, 'prepared_remarks' AS type, trim(substr(full_text, 1, qa_at - 1), '{B}') AS content,
      1 AS first_page, CASE WHEN page_count > 1 THEN cast(floor(page_count / 2) as bigint) ELSE 1 END AS last_page
    FROM placed WHERE qa_at > 1
    UNION ALL
    SELECT document_id, 2, 'qa_session', trim(substr(full_text, qa_at), '{B}'),
      CASE WHEN page_count > 1 THEN cast(floor(page_count / 2) as bigint) + 1 ELSE 1 END,
      CASE WHEN page_count > 1 THEN page_count ELSE 1 END
    FROM placed WHERE qa_at > 1
    UNION ALL
    SELECT document_id, 1, 'full_transcript', full_text, 1, page_count FROM placed WHERE coalesce(qa_at, 0) <= 1)"""

# Turns of every Q&A section, line by line.
TURNS_SQL = f"""
  lines AS (SELECT document_id, section_no, pos, line FROM sections @NUMBERED_LINES(content) WHERE type = 'qa_session'),
  marked AS (SELECT *, regexp_matches(trim(line, '{B}'), '^([A-Z][a-z]+ [A-Z][a-z]+|[A-Z]{{2,}}|Q:|A:)') AS opens FROM lines),
  grouped AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY pos) AS turn FROM marked),
  turns AS (SELECT document_id, turn, trim(string_agg(line, chr(10) ORDER BY pos), '{B}') AS speech FROM grouped GROUP BY document_id, turn),
  numbered AS (SELECT document_id, speech, row_number() OVER (PARTITION BY document_id ORDER BY turn) AS turn_index,
      nullif(regexp_extract(speech, '^([A-Z][a-z]+ [A-Z][a-z]+|[A-Z]{{2,}}|Q:|A:)', 1), '') AS speaker
    FROM turns WHERE speech <> '')"""


@check(
    "px1_strategies",
    f"SELECT document_id, {BRANCH_SQL} AS branch, 'parse_' || document_type AS strategy FROM narratives",
)
def px1(t):
    kind = F.col("document_type")
    return t.narratives.select(
        "document_id", parse.route(kind).alias("branch"), parse.strategy(kind).alias("strategy")
    )


@check(
    "px2_full_texts",
    """
    WITH numbered AS (SELECT cast(doc_id as string) AS document_id, pos, line,
        cast(floor(pos / 5) as bigint) + 1 AS page_no FROM documents @NUMBERED_LINES(text)),
    paged AS (SELECT document_id, page_no, string_agg(line, chr(10) ORDER BY pos) AS text FROM numbered GROUP BY ALL)
    SELECT document_id, count(*) AS page_count, string_agg(text, chr(10) || chr(10) ORDER BY page_no) AS full_text
    FROM paged GROUP BY document_id""",
)
def px2(t):
    return parse.full_texts(_pages(t)).select(
        "document_id", F.col("page_count").cast("long").alias("page_count"), "full_text"
    )


def _pages(t):
    return readers.lines_as_pages(
        t.documents.select(
            F.col("doc_id").cast("string").alias("document_id"), F.lit("general").alias("document_type"), "text"
        )
    )


@check(
    "px3_speakers",
    f"""SELECT document_id, array_to_string(list_sort(list_distinct(regexp_extract_all(full_text, '(?m){SPEAKER}', 1))), '; ') AS speakers
    FROM narratives""",
)
def px3(t):
    return t.narratives.select(
        "document_id", F.array_join(parse.speakers(F.col("full_text")), "; ").alias("speakers")
    )


@check(
    "px4_sections",
    f"WITH {SECTIONS_SQL} SELECT document_id, section_no, type, content, first_page, last_page FROM sections",
    longs="section_no",
)
def px4(t):
    return parse.section_rows(parse.parse_transcripts(t.narratives)).select(
        "document_id",
        F.col("section_no").cast("long").alias("section_no"),
        "type",
        "content",
        F.col("page_range")[0].cast("long").alias("first_page"),
        F.col("page_range")[1].cast("long").alias("last_page"),
    )


@check(
    "px5_transcript_records",
    f"""SELECT document_id, page_count, {QA_SQL} IS NOT NULL AS has_qa,
      CASE WHEN {QA_SQL} > 1 THEN 2 ELSE 1 END AS sections,
      len(list_distinct(regexp_extract_all(full_text, '(?m){SPEAKER}', 1))) AS speakers FROM narratives""",
    longs="page_count sections",
)
def px5(t):
    return parse.parse_transcripts(t.narratives).select(
        "document_id",
        F.col("page_count").cast("long").alias("page_count"),
        "has_qa",
        F.size("sections").cast("long").alias("sections"),
        F.size("speakers").cast("long").alias("speakers"),
    )


RECORDS_SQL = """
  heads AS (SELECT document_id, table_id, method, cells AS header FROM cells WHERE row_no = 0),
  body AS (SELECT c.document_id, c.table_id, c.method, c.row_no, c.cells, h.header FROM cells c
    JOIN heads h ON h.document_id = c.document_id AND h.table_id = c.table_id AND h.method = c.method WHERE c.row_no > 0)"""


@check(
    "px6_table_records",
    f"""WITH {RECORDS_SQL}
    SELECT document_id, table_id, method, row_no, header[2] AS key, cells[2] AS value FROM body
    UNION ALL SELECT document_id, table_id, method, row_no, header[3], cells[3] FROM body
    UNION ALL SELECT document_id, table_id, method, row_no, header[1], cells[4] FROM body""",
    longs="row_no",
)
def px6(t):
    return parse.table_records(t.cells).select(
        "document_id", "table_id", "method", F.col("row_no").cast("long").alias("row_no"), F.inline("record")
    )


@check(
    "px7_preferred_tables",
    """SELECT document_id, min(method) AS table_extractor, count(DISTINCT table_id) AS table_count FROM cells c
    WHERE method = 'lattice' OR document_id NOT IN (SELECT document_id FROM cells WHERE method = 'lattice')
    GROUP BY document_id""",
)
def px7(t):
    return parse.table_counts(parse.preferred_tables(t.cells, "lattice", "plumber"))


def _metric_sql(patterns):
    return " UNION ALL ".join(
        f"""SELECT document_id, '{name}' AS metric, array_to_string(m, '; ') AS matches FROM
        (SELECT document_id, regexp_extract_all(full_text, '(?i){pattern}', 1) AS m FROM narratives) x WHERE len(m) > 0"""
        for name, pattern in patterns.items()
    )


@check("px8_release_metrics", _metric_sql(parse.RELEASE_METRICS))
def px8(t):
    rows = parse.metric_rows(t.narratives, parse.RELEASE_METRICS)
    return rows.select("document_id", "metric", F.array_join("matches", "; ").alias("matches"))


@check("px8_deck_metrics", _metric_sql(parse.DECK_METRICS))
def px8_decks(t):
    rows = parse.metric_rows(t.narratives, parse.DECK_METRICS)
    return rows.select("document_id", "metric", F.array_join("matches", "; ").alias("matches"))


@check(
    "px9_release_records",
    f"""
    WITH counts AS (SELECT document_id, count(DISTINCT table_id) AS n FROM cells GROUP BY document_id)
    SELECT 'd' || o.document_id AS document_id,
      array_to_string(regexp_extract_all(o.full_text, '(?i){parse.EPS_PATTERN}', 1), '; ') AS eps, coalesce(c.n, 0) AS table_count
    FROM narratives o LEFT JOIN counts c ON c.document_id = 'd' || o.document_id""",
)
def px9(t):
    documents = t.narratives.withColumn("document_id", F.concat(F.lit("d"), "document_id"))
    return parse.parse_releases(documents, t.cells).select(
        "document_id",
        F.coalesce(F.array_join(F.try_element_at("metrics", F.lit("eps")), "; "), F.lit("")).alias("eps"),
        "table_count",
    )


CHART_SQL = " OR ".join(f"contains(lower(text), '{w}')" for w in parse.CHART_WORDS)


@check(
    "px10_slides",
    f"SELECT document_id, cast(page_no as bigint) AS slide_number, ({CHART_SQL}) AS has_potential_chart FROM slides",
)
def px10(t):
    return parse.slide_rows(t.slides).select(
        "document_id", F.col("slide_number").cast("long").alias("slide_number"), "has_potential_chart"
    )


MERGED_SQL = f"""
  merged AS (SELECT s.document_id, s.page_no AS slide_number, ({CHART_SQL}) AND o.error IS NULL AS has_potential_chart,
    CASE WHEN o.error IS NULL THEN o.description END AS vision_description,
    CASE WHEN o.error IS NULL AND o.description IS NOT NULL THEN o.tokens_used ELSE 0 END AS tokens_used, o.error AS processing_error
  FROM slides s LEFT JOIN slide_outputs o ON o.document_id = s.document_id AND o.slide_number = s.page_no)"""


@check(
    "px11_deck_records",
    f"""WITH {MERGED_SQL}
    SELECT document_id, count(*) AS slide_count, count(*) FILTER (WHERE has_potential_chart) AS charts_detected,
      count(vision_description) AS vision_descriptions, sum(tokens_used) AS vision_tokens_used FROM merged GROUP BY document_id""",
    longs="vision_tokens_used",
)
def px11(t):
    return parse.deck_summaries(parse.merge_slide_outputs(parse.slide_rows(t.slides), t.slide_outputs))


@check(
    "px11_deck_documents",
    f"""WITH {MERGED_SQL},
    decks AS (SELECT document_id, count(*) AS slide_count, count(*) FILTER (WHERE has_potential_chart) AS charts_detected FROM merged GROUP BY document_id)
    SELECT n.document_id, array_to_string(regexp_extract_all(n.full_text, '(?i){parse.GROWTH_PATTERN}', 1), '; ') AS growth,
      d.slide_count, d.charts_detected, 0 AS table_count FROM narratives n LEFT JOIN decks d ON d.document_id = n.document_id""",
    longs="table_count",
)
def px11_documents(t):
    slides = parse.merge_slide_outputs(parse.slide_rows(t.slides), t.slide_outputs)
    return parse.parse_decks(t.narratives, slides, t.cells).select(
        "document_id",
        F.coalesce(F.array_join(F.try_element_at("metrics", F.lit("growth")), "; "), F.lit("")).alias("growth"),
        "slide_count",
        "charts_detected",
        "table_count",
    )


@check(
    "px12_slide_outputs",
    f"""WITH {MERGED_SQL} SELECT document_id, cast(slide_number as bigint) AS slide_number, has_potential_chart, vision_description,
      cast(tokens_used as bigint) AS tokens_used, processing_error FROM merged""",
)
def px12(t):
    merged = parse.merge_slide_outputs(parse.slide_rows(t.slides), t.slide_outputs)
    return merged.select(
        "document_id", F.col("slide_number").cast("long").alias("slide_number"), "has_potential_chart",
        "vision_description", "tokens_used", "processing_error",
    )


@check(
    "px13_press_records",
    f"""SELECT document_id, array_to_string(regexp_extract_all(full_text, '{parse.DATE_PATTERN}'), '; ') AS dates,
      len(regexp_extract_all(full_text, '{WORD}')) AS word_count FROM narratives""",
)
def px13(t):
    return parse.parse_press(t.narratives).select(
        "document_id",
        F.array_join("dates_mentioned", "; ").alias("dates"),
        F.col("word_count").cast("long").alias("word_count"),
    )


@check(
    "px_all_branches",
    f"""SELECT document_id, branch,
      CASE WHEN branch = 'transcript' THEN {QA_SQL} IS NOT NULL END AS has_qa,
      CASE WHEN branch = 'press' THEN len(regexp_extract_all(full_text, '{WORD}')) END AS word_count,
      CASE WHEN branch = 'press' THEN len(regexp_extract_all(full_text, '{parse.DATE_PATTERN}')) END AS dates
    FROM (SELECT *, {BRANCH_SQL} AS branch FROM narratives) x""",
)
def px_all(t):
    return parse.parse_documents(t.narratives).select(
        "document_id", "branch", "has_qa",
        F.col("word_count").cast("long").alias("word_count"),
        F.when(F.col("dates_mentioned").isNotNull(), F.size("dates_mentioned")).cast("long").alias("dates"),
    )


def _documents(t):
    return t.documents.select(
        F.col("doc_id").cast("string").alias("document_id"), F.lit("general").alias("document_type"),
        F.col("text").alias("full_text"),
    )


def _plain(chunks):
    return chunks.select(
        "chunk_id", "document_id", F.col("sequence").cast("long").alias("sequence"), "content",
        F.col("token_count").cast("long").alias("token_count"),
    )


@check("ch2_recursive_split")
def ch2(t):
    return chunk.split_documents(_documents(t))


# What the splitter must keep true of every document, as one row per document; each
# value follows from the text alone.
@check(
    "ch2_split_invariants",
    f"""SELECT cast(doc_id as string) AS document_id, 0 AS too_long, 0 AS misplaced, 0 AS out_of_order, 0 AS overlapping,
      length(regexp_replace(text, '[{B}]', '', 'g')) AS covered, trim(text, '{B}') = '' AS blank FROM documents""",
    longs="too_long misplaced out_of_order overlapping covered",
)
def ch2_invariants(t):
    pieces = chunk.split_documents(_documents(t))
    before = F.lag("start_index").over(_in_order())
    stop = F.coalesce(F.lag(F.col("start_index") + F.length("content")).over(_in_order()), F.lit(0))
    joined = pieces.withColumns({"_before": before, "_stop": stop}).join(
        _documents(t).select("document_id", "full_text"), "document_id", "right"
    )
    found = F.substring("full_text", F.col("start_index") + 1, F.length("content"))
    # What a piece adds to those before it: all of these hold every character but blanks.
    added = F.substr("content", F.greatest(F.lit(0), F.col("_stop") - F.col("start_index")) + 1)
    return joined.groupBy("document_id").agg(
        F.coalesce(F.sum(F.length(F.regexp_replace(added, f"[{fx.BLANK_CLASS}]", ""))), F.lit(0)).alias("covered"),
        F.count_if(F.col("_stop") - F.col("start_index") > 200).alias("overlapping"),
        F.count_if(F.length("content") > 1000).alias("too_long"),
        F.count_if(found != F.col("content")).alias("misplaced"),
        F.count_if(F.col("start_index") < F.col("_before")).alias("out_of_order"),
        (F.count("content") == 0).alias("blank"),
    )


def _in_order():
    from pyspark.sql import Window

    return Window.partitionBy("document_id").orderBy("sequence")


CHUNK_ID_SQL = "sha256(document_id || chr(1) || cast(sequence as string) || chr(1) || content)"

# Chunks of the narratives by branch: short texts are one piece each.
ALL_CHUNKS_SQL = f"""{SECTIONS_SQL}, {TURNS_SQL},
  kinds AS (SELECT document_id, full_text, {BRANCH_SQL} AS branch FROM narratives),
  pieces AS (
    SELECT document_id, 1 AS sequence, trim(content, '{B}') AS content FROM sections JOIN kinds USING (document_id) WHERE branch = 'transcript' AND type <> 'qa_session'
    UNION ALL SELECT document_id, 1 + turn_index, speech FROM numbered JOIN kinds USING (document_id) WHERE branch = 'transcript'
    UNION ALL SELECT document_id, 1, full_text FROM kinds WHERE branch <> 'transcript')"""


@check(
    "ch1_all_chunks",
    f"WITH {ALL_CHUNKS_SQL} SELECT {CHUNK_ID_SQL} AS chunk_id, document_id, sequence, content, len(regexp_extract_all(content, '{WORD}')) AS token_count FROM pieces",
)
def ch1(t):
    pages = t.narratives.select(
        "document_id", "document_type", F.lit(1).alias("page_no"), F.col("full_text").alias("text")
    )
    return _plain(corpus.chunked(pages))


# Short sections are one piece each, so SQL can say what a transcript becomes.
@check(
    "ch3_transcript_chunks",
    f"""WITH {SECTIONS_SQL}, {TURNS_SQL},
    pieces AS (SELECT document_id, 1 AS sequence, trim(content, '{B}') AS content FROM sections WHERE type <> 'qa_session'
      UNION ALL SELECT document_id, 1 + turn_index, speech FROM numbered)
    SELECT sha256(document_id || chr(1) || cast(sequence as string) || chr(1) || content) AS chunk_id, document_id, sequence, content,
      len(regexp_extract_all(content, '{WORD}')) AS token_count FROM pieces""",
)
def ch3(t):
    return _plain(chunk.chunk_transcripts(parse.parse_transcripts(t.narratives)))


TABLE_TEXT_SQL = f"""WITH {RECORDS_SQL},
  rows_ AS (SELECT document_id, table_id, method, row_no, cast(floor((row_no - 1) / 10) as int) AS part,
    concat_ws(', ', CASE WHEN cells[4] <> '' THEN header[1] || ': ' || cells[4] END, CASE WHEN cells[2] <> '' THEN header[2] || ': ' || cells[2] END,
      CASE WHEN cells[3] <> '' THEN header[3] || ': ' || cells[3] END) AS line FROM body),
  texts AS (SELECT h.document_id, h.table_id, h.method, coalesce(r.part, 0) AS part,
      coalesce('Table ' || h.table_id || ':' || chr(10) || r.lines, 'Table ' || h.table_id || ': No data') AS content
    FROM heads h LEFT JOIN (SELECT document_id, table_id, method, part, string_agg(line, chr(10) ORDER BY row_no) AS lines FROM rows_
      WHERE line <> '' GROUP BY document_id, table_id, method, part) r USING (document_id, table_id, method))"""

# The tables of one method per document, as long ones with all their parts.
PREFERRED_SQL = """ chosen AS (SELECT * FROM texts
    WHERE method = 'lattice' OR document_id NOT IN (SELECT document_id FROM cells WHERE method = 'lattice'))"""


@check(
    "ch4_release_chunks",
    TABLE_TEXT_SQL
    + f""", {PREFERRED_SQL}, docs AS (SELECT 'd' || document_id AS document_id, full_text FROM narratives),
    pieces AS (SELECT document_id, 1 AS sequence, full_text AS content FROM docs
      UNION ALL SELECT document_id, 1 + row_number() OVER (PARTITION BY document_id ORDER BY table_id, part), content
        FROM chosen JOIN docs USING (document_id))
    SELECT sha256(document_id || chr(1) || cast(sequence as string) || chr(1) || content) AS chunk_id, document_id, sequence, content,
      len(regexp_extract_all(content, '{WORD}')) AS token_count FROM pieces""",
)
def ch4(t):
    tables = chunk.table_texts(parse.preferred_tables(t.cells, "lattice", "plumber"))
    documents = t.narratives.select(F.concat(F.lit("d"), "document_id").alias("document_id"), "full_text")
    return _plain(chunk.chunk_releases(documents, tables))


@check(
    "ch5_deck_chunks",
    f"""SELECT sha256(document_id || chr(1) || cast(page_no as string) || chr(1) || text) AS chunk_id, document_id,
      cast(page_no as bigint) AS sequence, text AS content, len(regexp_extract_all(text, '{WORD}')) AS token_count
    FROM slides WHERE trim(text, '{B}') <> ''""",
)
def ch5(t):
    return _plain(chunk.chunk_decks(parse.slide_rows(t.slides)))


@check(
    "ch6_press_chunks",
    f"""SELECT sha256(document_id || chr(1) || '1' || chr(1) || full_text) AS chunk_id, document_id, 1 AS sequence, full_text AS content,
      len(regexp_extract_all(full_text, '{WORD}')) AS token_count,
      array_to_string(regexp_extract_all(full_text, '{parse.DATE_PATTERN}'), '; ') AS dates FROM narratives""",
    longs="sequence",
)
def ch6(t):
    chunks = chunk.chunk_press(t.narratives)
    return chunks.select(
        "chunk_id", "document_id", F.col("sequence").cast("long").alias("sequence"), "content",
        F.col("token_count").cast("long").alias("token_count"),
        F.col("metadata")["dates_mentioned"].alias("dates"),
    )


@check(
    "ch7_speaker_turns",
    f"WITH {SECTIONS_SQL}, {TURNS_SQL} SELECT document_id, turn_index, speaker, speech FROM numbered",
)
def ch7(t):
    sections = parse.section_rows(parse.parse_transcripts(t.narratives))
    return chunk.utterances(sections).select(
        "document_id", F.col("turn_index").cast("long").alias("turn_index"), "speaker", "speech"
    )


@check("ch8_table_texts", TABLE_TEXT_SQL + " SELECT document_id, table_id, method, part, content FROM texts", longs="part")
def ch8(t):
    texts = chunk.table_texts(t.cells)
    return texts.select("document_id", "table_id", "method", F.col("part").cast("long").alias("part"), "content")


# The form that shows the first ten records of a table only.
@check(
    "ch8_first_table_rows",
    TABLE_TEXT_SQL + f", {PREFERRED_SQL} SELECT document_id, table_id, method, content FROM chosen WHERE part = 0",
)
def ch8_first(t):
    tables = parse.preferred_tables(t.cells, "lattice", "plumber")
    return chunk.table_texts(tables, max_rows=10).select("document_id", "table_id", "method", "content")


@check(
    "ch9_chunk_ids",
    """SELECT document_id, cast(sequence as bigint) AS sequence,
      sha256(document_id || chr(1) || cast(sequence as string) || chr(1) || content) AS chunk_id FROM line_chunks""",
)
def ch9(t):
    rows = chunk.finish_chunks(t.line_chunks.withColumn("metadata", F.lit(None).cast("map<string,string>")))
    return rows.select("document_id", F.col("sequence").cast("long").alias("sequence"), "chunk_id")


@check("ch10_page_shards")
def ch10(t):
    return _plain(chunk.chunk_page_shards(_pages(t), 2))


# Turns that go over pages and shards, as the chunks of the whole call.
@check(
    "ch10_sharded_calls",
    f"""WITH turns AS (
      SELECT document_id, CASE WHEN page_no < 3 THEN page_no ELSE 3 + cast(floor((page_no - 3) / 3) as int) END AS sequence,
        trim(string_agg(text, chr(10) || chr(10) ORDER BY page_no), '{B}') AS content
      FROM call_pages GROUP BY ALL)
    SELECT sha256(document_id || chr(1) || cast(sequence as string) || chr(1) || content) AS chunk_id, document_id, sequence, content,
      len(regexp_extract_all(content, '{WORD}')) AS token_count FROM turns""",
    longs="sequence token_count",
)
def ch10_calls(t):
    return _plain(shards.chunk_sharded(t.call_pages, pages_per_shard=4))
