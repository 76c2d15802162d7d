"""Checks: grading, evidence, answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.functions import jsontext as jx
from quarryline.functions import text as fx
from quarryline.operators import answer, grade, index
from quarryline.plans import self_rag
from quarryline.plans.checks_retrieval import hybrid_sql
from quarryline.plans.registry import check
from quarryline.session import materialise

WORD = f"[^{fx.BLANK_CLASS}]+"
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def number_sql(key: str, source: str = "raw") -> str:
    """Number at a key of valid JSON: 0 when missing, null when unreadable."""
    value = f"json_extract_string({source}, '$.{key}')"
    return f"""CASE WHEN json_type({source}, '$.{key}') IS NULL THEN 0.0
      WHEN json_type({source}, '$.{key}') = 'NULL' THEN NULL
      WHEN {value} = 'true' THEN 1.0 WHEN {value} = 'false' THEN 0.0
      WHEN regexp_matches({value}, '{NUMBER}') THEN cast(trim({value}) as double) END"""


PARSED_SQL = f"""
  read AS (SELECT query_id, rank, chunk_id, raw, CASE WHEN json_valid(raw) THEN {number_sql('relevance')} END AS r,
      CASE WHEN json_valid(raw) THEN {number_sql('supportiveness')} END AS s,
      CASE WHEN json_valid(raw) THEN {number_sql('usefulness')} END AS u FROM grades),
  strict AS (SELECT query_id, rank, chunk_id, CASE WHEN r + s + u IS NULL THEN 0 ELSE r END AS relevance,
      CASE WHEN r + s + u IS NULL THEN 0 ELSE s END AS supportiveness, CASE WHEN r + s + u IS NULL THEN 0 ELSE u END AS usefulness FROM read)"""

LENIENT_SQL = f"""
  spans AS (SELECT *, regexp_extract(raw, '(?s)(\\{{.*\\}}|\\[.*\\])', 1) AS span FROM grades),
  texts AS (SELECT query_id, rank, chunk_id, CASE WHEN json_valid(raw) THEN raw WHEN span <> '' AND json_valid(span) THEN span END AS j FROM spans),
  loose AS (SELECT query_id, rank, chunk_id, CASE WHEN j IS NULL THEN 0.0 WHEN json_type(j) = 'OBJECT' THEN {number_sql('relevance', 'j')} END AS relevance,
      CASE WHEN j IS NULL THEN 0.0 WHEN json_type(j) = 'OBJECT' THEN {number_sql('supportiveness', 'j')} END AS supportiveness,
      CASE WHEN j IS NULL THEN 0.0 WHEN json_type(j) = 'OBJECT' THEN {number_sql('usefulness', 'j')} END AS usefulness FROM texts),
  sorted AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS grade_rank FROM (
      SELECT *, round(relevance + supportiveness + 0.5 * usefulness, 6) AS score FROM loose
      WHERE relevance + supportiveness + usefulness IS NOT NULL) x)"""

EVIDENCE_SQL = f"""{LENIENT_SQL},
  flags AS (SELECT *, CASE WHEN relevance >= 0.6 AND supportiveness >= 0.5 THEN 1 ELSE 0 END AS p FROM sorted),
  counted AS (SELECT *, sum(p) OVER (PARTITION BY query_id ORDER BY grade_rank) AS seen,
      least(sum(p) OVER (PARTITION BY query_id), 5) AS chosen, least(count(*) OVER (PARTITION BY query_id), 2) AS needed FROM flags),
  evidence AS (SELECT * FROM counted WHERE CASE WHEN chosen < needed THEN grade_rank <= 5 ELSE p = 1 AND seen <= 5 END)"""


@check("gr1_score_parsing", f"WITH {PARSED_SQL} SELECT query_id, cast(rank as bigint) AS rank, relevance, supportiveness, usefulness FROM strict")
def gr1(t):
    return grade.parse_scores(t.grades).select(
        "query_id", F.col("rank").cast("long").alias("rank"), *grade.GRADE_KEYS
    )


@check(
    "gr2_lenient_json",
    f"WITH {LENIENT_SQL} SELECT query_id, cast(rank as bigint) AS rank, j AS json FROM texts",
)
def gr2(t):
    return t.grades.select(
        "query_id", F.col("rank").cast("long").alias("rank"), jx.lenient_json(F.col("raw")).alias("json")
    )


@check(
    "gr3_combined_scores",
    f"""WITH {PARSED_SQL} SELECT query_id, chunk_id, round(0.6::double * relevance + 0.3::double * supportiveness + 0.1::double * usefulness, 6) AS score,
      relevance AS r, supportiveness AS s, usefulness AS u FROM strict""",
)
def gr3(t):
    return grade.diagnostics(grade.parse_scores(t.grades)).drop("rank")


@check(
    "gr4_fast_filter",
    f"""WITH {PARSED_SQL}, head AS (SELECT *, relevance >= 0.6 AND supportiveness >= 0.5 AS passes FROM strict WHERE rank <= 5),
    flagged AS (SELECT *, bool_or(passes) OVER (PARTITION BY query_id) AS any_pass FROM head)
    SELECT query_id, chunk_id, NOT any_pass AS fallback FROM flagged WHERE passes OR NOT any_pass""",
)
def gr4(t):
    return grade.filter_fast(grade.parse_scores(t.grades)).select("query_id", "chunk_id", "fallback")


def _sorted(t):
    return grade.sort_graded(grade.parse_grades(t.grades))


@check("gr5_graded_order", f"WITH {LENIENT_SQL} SELECT query_id, chunk_id, score, grade_rank FROM sorted")
def gr5(t):
    return _sorted(t).select("query_id", "chunk_id", "score", F.col("grade_rank").cast("long").alias("grade_rank"))


@check("gr6_evidence", f"WITH {EVIDENCE_SQL} SELECT query_id, chunk_id, grade_rank FROM evidence")
def gr6(t):
    return grade.select_evidence(_sorted(t)).select(
        "query_id", "chunk_id", F.col("grade_rank").cast("long").alias("grade_rank")
    )


# Model replies: a list of rewordings, broken text, or a single string; keywords likewise.
def _questions(t):
    first, other = F.col("text"), F.reverse("text")
    kind = F.col("item_id") % 4
    listed = F.to_json(F.array(first, F.concat(other, other), F.concat(first, F.lit("!")), F.lit("fourth")))
    words = F.to_json(F.struct(fx.words(first).alias("keywords")))
    return t.benchmark.select(
        F.col("item_id").alias("query_id"),
        first.alias("question"),
        F.when(kind == 0, F.concat(F.lit("Here: "), listed)).when(kind == 1, listed).when(kind == 2, "[]").otherwise("none").alias("variants_raw"),
        F.when(kind == 0, words).when(kind == 1, '{"keywords": []}').when(kind == 2, F.concat(F.lit("Text. "), words)).otherwise(None).alias("hyde_raw"),
    )


HYDE_SQL = f"""CASE WHEN item_id % 4 IN (0, 2) THEN array_to_string(regexp_extract_all(text, '{WORD}')[1:12], ', ') ELSE text END"""


@check(
    "gr7_query_variants",
    f"""
    WITH lists AS (SELECT item_id, text, {HYDE_SQL} AS hyde,
      CASE WHEN item_id % 4 IN (0, 1) THEN [text[1:200], (reverse(text) || reverse(text))[1:200], (text || chr(33))[1:200]] ELSE [text] END AS variants FROM benchmark),
    items AS (SELECT item_id, 0 AS place, text AS q FROM lists UNION ALL
      SELECT item_id, unnest(range(1, len(variants) + 1)), unnest(variants) FROM lists UNION ALL SELECT item_id, 100, hyde FROM lists),
    firsts AS (SELECT item_id, q, min(place) AS place FROM items GROUP BY ALL)
    SELECT item_id AS query_id, row_number() OVER (PARTITION BY item_id ORDER BY place) - 1 AS variant, q AS text FROM firsts""",
)
def gr7(t):
    return grade.query_variants(_questions(t)).select(
        "query_id", F.col("variant").cast("long").alias("variant"), "text"
    )


@check("gr8_hyde_keywords", f"SELECT item_id AS query_id, {HYDE_SQL} AS hyde FROM benchmark")
def gr8(t):
    rows = _questions(t)
    return rows.select("query_id", grade.hyde_keywords(F.col("question"), F.col("hyde_raw")).alias("hyde"))


@check(
    "gr9_rewrite_rounds",
    f"""WITH {EVIDENCE_SQL},
    decided AS (SELECT b.item_id AS query_id, count(e.chunk_id) AS n FROM benchmark b LEFT JOIN evidence e ON e.query_id = b.item_id GROUP BY b.item_id)
    SELECT d.query_id, d.n AS selected_count, d.n < 2 AS rewrite, coalesce(f.rows_, 0) AS kept,
      CASE WHEN f.rows_ IS NULL THEN NULL WHEN d.n < 2 THEN 2 ELSE 1 END AS round
    FROM decided d LEFT JOIN (SELECT query_id, count(*) AS rows_ FROM (
      SELECT e.query_id FROM evidence e JOIN decided x ON x.query_id = e.query_id AND x.n >= 2
      UNION ALL SELECT s.query_id FROM sorted s JOIN decided x ON x.query_id = s.query_id AND x.n < 2) r GROUP BY query_id) f ON f.query_id = d.query_id""",
    longs="round",
)
def gr9(t):
    ordered = _sorted(t)
    evidence = grade.select_evidence(ordered)
    decisions = grade.needs_rewrite(t.benchmark.select(F.col("item_id").alias("query_id")), evidence)
    kept = grade.second_round(evidence, decisions, ordered).groupBy("query_id").agg(
        F.count("*").alias("_kept"), F.max("round").cast("long").alias("round")
    )
    return decisions.join(kept, "query_id", "left").select(
        "query_id", "selected_count", "rewrite", F.coalesce("_kept", F.lit(0)).alias("kept"), "round"
    )


# Grades follow from a chunk's number; every question has three wordings with vectors of their own.
def _sorted_sql(hits: str) -> str:
    return f"""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS grade_rank FROM (
      SELECT *, round((c % 10)::double / 10 + (c * 7 % 10)::double / 10 + 0.25, 6) AS score,
        CASE WHEN c % 10 >= 6 AND c * 7 % 10 >= 5 THEN 1 ELSE 0 END AS p
      FROM (SELECT *, cast(chunk_id as bigint) AS c FROM {hits} WHERE rank <= 8) h) g"""


def _evidence_sql(sorted_hits: str) -> str:
    return f"""SELECT query_id, chunk_id, grade_rank, score FROM (
      SELECT *, sum(p) OVER (PARTITION BY query_id ORDER BY grade_rank) AS seen,
        least(sum(p) OVER (PARTITION BY query_id), 5) AS chosen, least(count(*) OVER (PARTITION BY query_id), 2) AS needed
      FROM ({_sorted_sql(sorted_hits)}) s) x
      WHERE CASE WHEN chosen < needed THEN grade_rank <= 5 ELSE p = 1 AND seen <= 5 END"""


SELF_RAG_SQL = f"""WITH asked AS (SELECT query_id, text, embedding FROM queries WHERE query_id % 7 <> 0),
    hits1 AS (WITH {hybrid_sql('asked')} SELECT query_id, chunk_id, rank FROM top),
    round1 AS ({_evidence_sql('hits1')}),
    decided AS (SELECT a.query_id, count(e.chunk_id) AS n FROM asked a LEFT JOIN round1 e USING (query_id) GROUP BY a.query_id),
    wordings AS (SELECT query_id * 64 + variant AS query_id, text, embedding FROM variants JOIN decided USING (query_id) WHERE n < 2),
    hits AS (WITH {hybrid_sql('wordings')} SELECT * FROM top WHERE rank <= 8),
    merged AS (SELECT cast(floor(query_id / 64) as bigint) AS query_id, chunk_id, round(sum(1 / (60.0::double + rank - 1)), 6) AS total,
      min((query_id % 64) * 1000 + rank) AS first FROM hits GROUP BY ALL),
    hits2 AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, first, chunk_id) AS rank FROM merged),
    round2 AS ({_evidence_sql('hits2')})
    SELECT r.query_id, chunk_id, grade_rank, score, 1 AS round FROM round1 r JOIN decided USING (query_id) WHERE n >= 2
    UNION ALL SELECT query_id, chunk_id, grade_rank, score, 2 FROM round2"""


@check("gr9_self_rag", SELF_RAG_SQL, longs="round")
def gr9_self_rag(t):
    chunk_no = F.col("chunk_id").cast("long")
    numbers = t.doc_chunks.select("chunk_id").union(t.vectors.select("chunk_id")).distinct()
    grades = numbers.select(
        "chunk_id",
        F.format_string(
            '{"relevance": 0.%d, "supportiveness": 0.%d, "usefulness": 0.5}', chunk_no % 10, chunk_no * 7 % 10
        ).alias("raw"),
    )
    no = F.when(F.col("query_id") % 7 == 0, '{"retrieval_needed": false}')
    questions = t.queries.select("query_id", "text", "embedding", no.alias("needed_raw"))
    postings = materialise(index.postings(t.doc_chunks), "postings")
    found = self_rag.self_rag(t.vectors, postings, questions, t.variants, grades)
    return found.select(
        "query_id", "chunk_id", F.col("grade_rank").cast("long").alias("grade_rank"), "score",
        F.col("round").cast("long").alias("round"),
    )


CITED_SQL = "(SELECT r.*, coalesce(d.text, 'no text') AS content FROM ranked r LEFT JOIN documents d ON d.doc_id = cast(r.document_id as bigint))"


def _evidence(t):
    texts = t.documents.select(F.col("doc_id").cast("string").alias("document_id"), F.col("text").alias("content"))
    return t.ranked.join(texts, "document_id", "left").withColumn("content", F.coalesce("content", F.lit("no text")))


@check(
    "gr10_evidence_blocks",
    f"""SELECT query_id, string_agg('[' || coalesce(document_name, document_id) || ':' || chunk_id || '] ' || content, chr(10) ORDER BY rank) AS evidence
    FROM {CITED_SQL} x GROUP BY query_id""",
)
def gr10(t):
    return answer.evidence_block(_evidence(t), answer.named_line())


@check(
    "gr10_cited_blocks",
    f"""SELECT query_id, string_agg('- (' || document_id || ':' || chunk_id || ') ' || substr(content, 1, 600), chr(10) ORDER BY rank) AS evidence
    FROM {CITED_SQL} x GROUP BY query_id""",
)
def gr10_cited(t):
    return answer.evidence_block(_evidence(t), answer.cited_line(answer.VERIFY_CHARS))


@check(
    "gr10_plain_context",
    f"SELECT query_id, string_agg(content, chr(10) || chr(10) ORDER BY rank) AS evidence FROM {CITED_SQL} x GROUP BY query_id",
)
def gr10_plain(t):
    return answer.evidence_block(_evidence(t), F.col("content"), "\n\n")


def _template_sql(kind: str, **fields: str) -> str:
    text = "'" + answer.TEMPLATES[kind].replace("'", "''") + "'"
    for field, value in fields.items():
        text = f"replace({text}, '{{{field}}}', {value})"
    return text


@check(
    "gr11_prompts",
    f"""SELECT item_id AS query_id, d.doc_id, {_template_sql('hyde', question='b.text')} AS hyde, {_template_sql('retrieval_needed', question='b.text')} AS retrieval,
      {_template_sql('grade', chunk='substr(d.text, 1, 2000)', question='b.text')} AS grade,
      {_template_sql('revision', report='substr(d.text, 1, 1500)', answer='lower(b.text)', question='b.text')} AS revision,
      'Earlier conversation, not to be cited:' || chr(10) || d.source || chr(10) || chr(10) || {_template_sql('answer', evidence='d.lang', question='b.text')} AS answer
    FROM benchmark b JOIN (SELECT doc_id % (SELECT count(*) FROM benchmark) AS item_id, coalesce(text, '') AS text, source, lang, doc_id
      FROM documents) d USING (item_id)""",
)
def gr11(t):
    items = t.benchmark.count()
    rows = t.benchmark.withColumnRenamed("text", "question").join(
        t.documents.withColumn("item_id", F.col("doc_id") % items).withColumn("text", F.coalesce("text", F.lit(""))), "item_id"
    )
    question, text = F.col("question"), F.col("text")
    return rows.select(
        F.col("item_id").alias("query_id"),
        "doc_id",
        answer.prompt("hyde", question=question).alias("hyde"),
        answer.prompt("retrieval_needed", question=question).alias("retrieval"),
        answer.prompt("grade", question=question, chunk=text).alias("grade"),
        answer.prompt("revision", question=question, answer=F.lower(question), report=text).alias("revision"),
        answer.with_history(
            answer.prompt("answer", question=question, evidence=F.col("lang")), F.col("source")
        ).alias("answer"),
    )


@check(
    "gr12_retrieval_needed",
    """SELECT event_id, CASE event_id % 7 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN value <> 0 WHEN 4 THEN false WHEN 5 THEN true ELSE event_type <> '' END AS needed FROM events""",
)
def gr12(t):
    kind = F.col("event_id") % 7
    raw = (
        F.when(kind == 0, '{"retrieval_needed": true}')
        .when(kind == 1, 'So: {"retrieval_needed": false}')
        .when(kind == 2, "no idea")
        .when(kind == 3, F.concat(F.lit('{"retrieval_needed": '), F.col("value").cast("string"), F.lit("}")))
        .when(kind == 4, '{"retrieval_needed": null}')
        .when(kind == 5, '{"reason": "x"}')
        .otherwise(F.to_json(F.struct(F.col("event_type").alias("retrieval_needed"))))
    )
    return t.events.select("event_id", grade.retrieval_needed(raw).alias("needed"))


@check(
    "gr13_verification_reports",
    """SELECT query_id, turn % 2 = 1 AS needs_revision, CASE WHEN conv_id % 3 = 0 THEN 0 ELSE 1 + turn % 2 END AS claims,
      CASE WHEN conv_id % 3 = 0 THEN 0 ELSE 1 END AS verified, CASE WHEN conv_id % 3 = 0 OR turn % 2 = 0 THEN 0 ELSE 1 END AS unsupported, 0 AS contradicted
    FROM answers""",
    longs="verified unsupported contradicted",
)
def gr13(t):
    claim = F.to_json(
        F.struct(F.substring("answer", 1, 40).alias("text"), F.lit("Verified").alias("label"), F.array(F.lit("a:1")).alias("evidence"))
    )
    second = ', {"text": "x", "label": "Unsupported", "evidence": []}'
    odd = F.col("turn") % 2 == 1
    claims = F.when(F.col("conv_id") % 3 == 0, "").otherwise(F.concat(claim, F.when(odd, second).otherwise("")))
    raw = F.concat(
        F.lit('Report {"claims": ['), claims, F.lit('], "needs_revision": '), F.when(odd, "true").otherwise("false"), F.lit("}")
    )
    reports = answer.verification_reports(t.answers.withColumn("verification", raw))
    return reports.select("query_id", "needs_revision", "claims", "verified", "unsupported", "contradicted")


@check(
    "gr14_confidence",
    f"""SELECT query_id, round(greatest(0.1, least(1.0, 0.5 + least(n_sources / 5.0, 1.0) * 0.2
        + CASE WHEN words BETWEEN 20 AND 200 THEN 0.2 WHEN words BETWEEN 5 AND 9 OR words BETWEEN 201 AND 300 THEN 0.1 ELSE 0 END
        - 0.1 * (cast(contains(a, 'i don''t know') as int) + cast(contains(a, 'not sure') as int) + cast(contains(a, 'unclear') as int)
          + cast(contains(a, 'maybe') as int) + cast(contains(a, 'possibly') as int))))::double, 6) AS confidence
    FROM (SELECT query_id, n_sources, lower(answer) AS a, len(regexp_extract_all(answer, '{WORD}')) AS words FROM answers) x""",
)
def gr14(t):
    return t.answers.select(
        "query_id", answer.confidence(F.col("answer"), F.col("n_sources")).alias("confidence")
    )


@check(
    "gr15_citations",
    f"""SELECT query_id, chunk_id, document_id, coalesce(document_name, '') AS document_filename, substr(content, 1, 500) AS content_excerpt,
      score AS relevance_score FROM {CITED_SQL} x""",
)
def gr15(t):
    return answer.citations(_evidence(t)).drop("rank", "page_number")


@check(
    "gr15_answer_records",
    f"""SELECT b.item_id AS query_id, 0.85 AS confidence, coalesce(c.n, 0) AS citations, c.first_chunk
    FROM benchmark b LEFT JOIN (SELECT query_id, count(*) AS n, arg_min(chunk_id, rank) AS first_chunk FROM {CITED_SQL} x GROUP BY query_id) c ON c.query_id = b.item_id""",
    doubles="confidence",
)
def gr15_records(t):
    answers = t.benchmark.select(F.col("item_id").alias("query_id"), F.lit(None).cast("double").alias("confidence"))
    return answer.answer_records(answers, answer.citations(_evidence(t))).select(
        "query_id",
        "confidence",
        F.coalesce(F.size("citations"), F.lit(0)).cast("long").alias("citations"),
        F.get("citations", F.lit(0))["chunk_id"].alias("first_chunk"),
    )
