"""Evidence blocks, prompt tables, verification reports, confidence and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions import jsontext as jx
from quarryline.functions import text as fx

# Fixed values.
ANSWER_CHARS, VERIFY_CHARS, GRADE_CHARS, REPORT_CHARS, EXCERPT_CHARS = 800, 600, 2000, 1500, 500
DEFAULT_CONFIDENCE = 0.85
UNCERTAIN_PHRASES = ("i don't know", "not sure", "unclear", "maybe", "possibly")
CLAIM_LABELS = ("Verified", "Unsupported", "Contradicted")

# Prompt templates of our own wording; {fields} are filled per row. Any of them can be
# replaced by the caller.
TEMPLATES = {
    "answer": (
        "Answer from the evidence alone and cite every statement as [document:chunk].\n\n"
        "Evidence:\n{evidence}\n\nQuestion: {question}\n\nAnswer:"
    ),
    "grade": (
        "Rate this passage for the question. Reply with JSON holding relevance, "
        "supportiveness and usefulness, each from 0 to 1.\n"
        "Question: {question}\nPassage: {chunk}"
    ),
    "hyde": "Write a short passage that could answer this question.\nQuestion: {question}\n",
    "verification": (
        "List the claims of the answer and label each as Verified, Unsupported or "
        "Contradicted by the evidence. Reply with JSON holding claims and needs_revision.\n"
        "Question: {question}\nAnswer: {answer}\n\nEvidence:\n{evidence}"
    ),
    "revision": (
        "Rewrite the answer so that the evidence supports every claim.\n"
        "Question: {question}\nAnswer: {answer}\nReport: {report}\n"
    ),
    "retrieval_needed": (
        "Does this question need documents? Reply with JSON holding retrieval_needed.\n"
        "Question: {question}\n"
    ),
    "concise": "Answer in at most three sentences.\n\nContext: {context}\n\nQuestion: {question}\n",
    "detailed": "Answer in full, in sections, from the context.\n\nContext:\n{context}\n\nQuestion: {question}\n",
}
HISTORY_TEMPLATE = "Earlier conversation, not to be cited:\n{history}\n\n"


def fill(template: str, **fields: Column) -> Column:
    """A template with its {fields} replaced by columns; other braces stay as they are."""
    parts, rest = [], template
    while rest:
        found = [(rest.find("{" + f + "}"), f) for f in fields if "{" + f + "}" in rest]
        if not found:
            parts.append(F.lit(rest))
            break
        at, field = min(found)
        parts += [F.lit(rest[:at]), F.coalesce(fields[field], F.lit(""))]
        rest = rest[at + len(field) + 2 :]
    return F.concat(*parts)


PROMPT_LIMITS = {"grade": ("chunk", GRADE_CHARS), "revision": ("report", REPORT_CHARS)}


def prompt(
    kind: str,
    template: str | None = None,
    limits: dict[str, tuple[str, int]] | None = PROMPT_LIMITS,
    **fields: Column,
) -> Column:
    """Prompt of a kind; `limits` cut one input of a kind to a model's room (None: all whole)."""
    if limits and kind in limits:
        field, limit = limits[kind]
        fields[field] = F.substring(fields[field], 1, limit)
    return fill(template or TEMPLATES[kind], **fields)


def with_history(text: Column, history: Column) -> Column:
    """The prompt after the conversation so far, where there is one."""
    return F.when(fx.truthy(history).isNotNull(), F.concat(fill(HISTORY_TEMPLATE, history=history), text)).otherwise(text)


def named_line() -> Column:
    """`[name:chunk] text`; document id or unknown_doc stand in for the name."""
    name = F.coalesce(fx.truthy(F.col("document_name")), fx.truthy(F.col("document_id")), F.lit("unknown_doc"))
    chunk = F.coalesce(
        fx.truthy(F.col("chunk_id")), F.nullif(F.col("sequence"), F.lit(0)).cast("string"), F.lit("")
    )
    label = F.when(chunk == "", name).otherwise(F.concat(name, F.lit(":"), chunk))
    return F.concat(F.lit("["), label, F.lit("] "), F.col("content"))


def cited_line(chars: int) -> Column:
    """`- (document:chunk) text`, the text cut."""
    chunk = F.coalesce(
        fx.truthy(F.col("chunk_id")), F.nullif(F.col("sequence"), F.lit(0)).cast("string"), F.lit("0")
    )
    return F.concat(
        F.lit("- ("),
        F.coalesce(F.col("document_id"), F.lit("unknown")),
        F.lit(":"),
        chunk,
        F.lit(") "),
        F.substring(F.col("content"), 1, chars),
    )


def evidence_block(evidence: DataFrame, line: Column, separator: str = "\n") -> DataFrame:
    """Lines of a query's evidence in rank order; at most k rows per query."""
    lines = F.array_sort(F.collect_list(F.struct(F.col("rank"), line.alias("line"))))
    return evidence.groupBy("query_id").agg(
        F.array_join(F.transform(lines, lambda r: r["line"]), separator).alias("evidence")
    )


def verification_claims(answers: DataFrame, raw: str = "verification") -> DataFrame:
    """Claims of the verification reports as rows."""
    parsed = F.from_json(
        jx.lenient_json(F.col(raw)),
        "claims array<struct<text:string,label:string,evidence:array<string>>>",
    )
    return answers.select("query_id", F.posexplode(parsed["claims"]).alias("claim_no", "claim")).select(
        "query_id", "claim_no", "claim.*"
    )


def needs_revision(raw: Column) -> Column:
    text = F.coalesce(jx.lenient_json(raw), F.lit("{}"))
    return F.coalesce(~jx.is_falsy(text, "$.needs_revision"), F.lit(False))


def verification_reports(answers: DataFrame, raw: str = "verification") -> DataFrame:
    """Number of claims per label and the revision flag, for every answer."""
    claims = verification_claims(answers, raw)
    counts = claims.groupBy("query_id").agg(
        F.count("*").alias("claims"),
        *[F.count_if(F.col("label") == label).alias(label.lower()) for label in CLAIM_LABELS],
    )
    names = ["claims", *[label.lower() for label in CLAIM_LABELS]]
    return (
        answers.select("query_id", needs_revision(F.col(raw)).alias("needs_revision"))
        .join(counts, "query_id", "left")
        .select("query_id", "needs_revision", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])
    )


def confidence(answer: Column, sources: Column) -> Column:
    """0.5 + source share + length share - 0.1 per uncertain phrase, within [0.1, 1].

    The length share has gaps on purpose: 10 to 19 words add nothing, 5 to 9 add 0.1.
    """
    length = fx.word_count(F.coalesce(answer, F.lit("")))
    share = F.least(sources.cast("double") / 5.0, F.lit(1.0)) * 0.2
    by_length = (
        F.when(length.between(20, 200), 0.2)
        .when(length.between(5, 9) | length.between(201, 300), 0.1)
        .otherwise(0.0)
    )
    lowered = F.lower(F.coalesce(answer, F.lit("")))
    doubt = F.lit(0.0)
    for phrase in UNCERTAIN_PHRASES:
        doubt = doubt + F.when(lowered.contains(phrase), 0.1).otherwise(0.0)
    total = F.lit(0.5) + share + by_length - doubt
    return F.round(F.greatest(F.lit(0.1), F.least(F.lit(1.0), total)), 6)


def citations(evidence: DataFrame, excerpt_chars: int | None = EXCERPT_CHARS) -> DataFrame:
    """Citation rows of the evidence used, with an excerpt of its text (None: all of it)."""
    content = F.coalesce("content", F.lit(""))
    excerpt = content if excerpt_chars is None else F.substring(content, 1, excerpt_chars)
    page = F.col("page_number") if "page_number" in evidence.columns else F.lit(None)
    return evidence.select(
        "query_id",
        "rank",
        "chunk_id",
        "document_id",
        F.coalesce(F.col("document_name"), F.lit("")).alias("document_filename"),
        excerpt.alias("content_excerpt"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("relevance_score"),
        page.cast("int").alias("page_number"),
    )


def answer_records(answers: DataFrame, cited: DataFrame) -> DataFrame:
    """Answers with their citations in rank order and a confidence (0.85 when not given)."""
    fields = ["rank", "chunk_id", "document_id", "document_filename", "content_excerpt", "relevance_score", "page_number"]
    listed = cited.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("citations"))
    return answers.join(listed, "query_id", "left").withColumn(
        "confidence", F.coalesce("confidence", F.lit(DEFAULT_CONFIDENCE))
    )
