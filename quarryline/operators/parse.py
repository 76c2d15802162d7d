"""Parsing page text: full text, sections, speakers, tables, metrics, dates, slides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions import text as fx
from quarryline.functions.binding import bind

# Patterns, markers and aliases.
SPEAKER_PATTERN = rf"^([A-Z][a-z]+ [A-Z][a-z]+|[A-Z]{{2,}})[{fx.BLANK_CLASS}]*[-:]"
QA_MARKERS = ("Q&A", "Question and Answer", "Questions and Answers", "Q-and-A")
DATE_PATTERN = r"\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4}\b"
REVENUE_PATTERN = (
    r"\$?(\d{1,3}(?:,\d{3})*(?:\.\d+)?)\s*(?:million|billion|M|B)?\s*(?:revenue|sales)"
)
PROFIT_PATTERN = (
    r"\$?(\d{1,3}(?:,\d{3})*(?:\.\d+)?)\s*(?:million|billion|M|B)?\s*(?:profit|income|earnings)"
)
EPS_PATTERN = r"(?:EPS|earnings per share).*?\$?(\d+\.\d+)"
GROWTH_PATTERN = r"(\d+(?:\.\d+)?)%\s*(?:growth|increase|decrease)"
MARGIN_PATTERN = r"(\d+(?:\.\d+)?)%\s*(?:margin|rate)"
RELEASE_METRICS = {"revenue": REVENUE_PATTERN, "profit": PROFIT_PATTERN, "eps": EPS_PATTERN}
DECK_METRICS = {
    "revenue": REVENUE_PATTERN,
    "profit": PROFIT_PATTERN,
    "growth": GROWTH_PATTERN,
    "margin": MARGIN_PATTERN,
}
CHART_WORDS = ("chart", "graph", "figure", "table", "%", "$")
TYPE_ALIASES = {
    "transcript": "transcript",
    "earnings_transcript": "transcript",
    "release": "release",
    "earnings_release": "release",
    "slides": "slides",
    "slide_deck": "slides",
}
OTHER_TYPE = "press"
PAGE_BREAK = "\n\n"

# Java flags that make a pattern read like the Unicode-aware one it states:
# d = only "\n" ends a line, U = Unicode classes.
_LINES, _ANY_CASE, _EXACT = "(?mdU)", "(?idU)", "(?dU)"


def route(kind: Column) -> Column:
    """Parsing branch of a document type, aliases resolved."""
    kind = F.lower(kind)
    branch = None
    for alias, target in TYPE_ALIASES.items():
        test = kind == alias
        branch = F.when(test, target) if branch is None else branch.when(test, target)
    return branch.otherwise(OTHER_TYPE)


def strategy(kind: Column) -> Column:
    return F.concat(F.lit("parse_"), kind)


def full_texts(pages: DataFrame) -> DataFrame:
    """One row per document: pages in order joined by a blank line, and their number.

    A document is one admitted upload (see `intake.MAX_FILE_BYTES`), which bounds its text.
    """
    ordered = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    return pages.groupBy("document_id").agg(
        F.min("document_type").alias("document_type"),
        F.array_join(F.transform(ordered, lambda p: p["text"]), PAGE_BREAK).alias("full_text"),
        F.count("*").cast("int").alias("page_count"),
    )


def speakers(text: Column) -> Column:
    """Distinct speaker labels, sorted."""
    found = F.regexp_extract_all(text, F.lit(_LINES + SPEAKER_PATTERN), F.lit(1))
    return F.array_sort(F.array_distinct(found))


def qa_position(text: Column) -> Column:
    """1-based position of the Q&A marker: the first marker *in list order* that occurs.

    Counted in characters, as `substring` does: the length of what stands before the marker.
    """

    def place(marker: str) -> Column:
        pattern = rf"{_ANY_CASE}\b{marker}\b"
        return F.when(text.rlike(pattern), F.length(F.get(F.split(text, pattern, 2), F.lit(0))) + 1)

    return F.coalesce(*[place(marker) for marker in QA_MARKERS])


def _section(kind: str, content: Column, first: Column, last: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("type"),
        content.alias("content"),
        F.array(first, last).alias("page_range"),
    )


def transcript_sections(text: Column, pages: Column, qa_at: Column) -> Column:
    """Prepared remarks and Q&A, or the whole text.

    A marker at the very start sets `has_qa` but does not split: that quirk is kept.
    """
    one, half = F.lit(1), F.floor(pages / 2).cast("int")
    several = pages > 1
    return F.when(
        qa_at > 1,
        F.array(
            _section(
                "prepared_remarks",
                fx.strip(F.substring(text, F.lit(1), qa_at - 1)),
                one,
                F.when(several, half).otherwise(one),
            ),
            _section(
                "qa_session",
                fx.strip(F.substring(text, qa_at, F.length(text))),
                F.when(several, half + 1).otherwise(one),
                F.when(several, pages).otherwise(one),
            ),
        ),
    ).otherwise(F.array(_section("full_transcript", text, one, pages)))


def transcript_fields(text: Column, pages: Column) -> Column:
    """Struct of `sections` and `has_qa`; the marker is searched for once."""
    return bind(
        qa_position(text),
        lambda at: F.struct(
            transcript_sections(text, pages, at).alias("sections"),
            at.isNotNull().alias("has_qa"),
        ),
    )


def parse_transcripts(documents: DataFrame) -> DataFrame:
    """Adds `sections`, `speakers`, `has_qa` to rows with `full_text`, `page_count`."""
    found = transcript_fields(F.col("full_text"), F.col("page_count"))
    return documents.withColumn("speakers", speakers(F.col("full_text"))).select(
        "*", F.inline(F.array(found))
    )


def section_rows(transcripts: DataFrame) -> DataFrame:
    """Sections as rows, numbered from 1 within the document."""
    return transcripts.select(
        "document_id", F.posexplode("sections").alias("position", "section")
    ).select("document_id", (F.col("position") + 1).alias("section_no"), "section.*")


def metric_values(text: Column, patterns: dict[str, str]) -> Column:
    """Map of metric name to its matches; metrics without a match are absent."""
    entries = [
        F.struct(
            F.lit(name).alias("key"),
            F.regexp_extract_all(text, F.lit(_ANY_CASE + pattern), F.lit(1)).alias("value"),
        )
        for name, pattern in patterns.items()
    ]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: F.size(e["value"]) > 0))


def metric_rows(documents: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """One row per document and matched metric."""
    return documents.select(
        "document_id",
        F.explode(metric_values(F.col("full_text"), patterns)).alias("metric", "matches"),
    )


def dates_mentioned(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_EXACT + DATE_PATTERN), F.lit(0))


def parse_press(documents: DataFrame) -> DataFrame:
    """Adds `dates_mentioned` and `word_count`."""
    return documents.withColumn("dates_mentioned", dates_mentioned(F.col("full_text"))).withColumn(
        "word_count", fx.word_count(F.col("full_text"))
    )


def record_entries(header: Column, row: Column) -> Column:
    """Header zipped with a row: cut to the shorter, a repeated name keeps its last value."""
    width = F.least(F.size(header), F.size(row))
    names = F.transform(F.slice(header, 1, width), lambda n: F.coalesce(n, F.lit("None")))
    values = F.reverse(F.slice(row, 1, width))
    backwards = F.reverse(names)
    return F.transform(
        F.array_distinct(names),
        lambda name: F.struct(
            name.alias("key"),
            F.element_at(values, F.array_position(backwards, name).cast("int")).alias("value"),
        ),
    )


def table_records(cells: DataFrame) -> DataFrame:
    """Rows of extracted tables as records; row 0 of a table is its header.

    Extraction methods may use the same table ids, so the method is part of the key.
    """
    key = ["document_id", "table_id", "method"]
    header = cells.filter("row_no = 0").select(*key, F.col("cells").alias("header"))
    body = cells.filter((F.col("row_no") > 0) & (F.size("cells") > 0))
    return body.join(header, key).select(
        *key, "page", "row_no", record_entries(F.col("header"), F.col("cells")).alias("record")
    )


def preferred_tables(cells: DataFrame, first: str, second: str) -> DataFrame:
    """Tables of method `first`; those of `second` only where `first` found none.

    The documents with a `first` table are a combined distinct list, so no document's
    rows are gathered in one task.
    """
    preferred = cells.filter(F.col("method") == first)
    found = preferred.select("document_id").distinct()
    fallback = cells.filter(F.col("method") == second).join(found, "document_id", "left_anti")
    return preferred.unionByName(fallback)


def table_counts(cells: DataFrame) -> DataFrame:
    """Extractor used and number of tables per document (of preferred tables)."""
    return cells.groupBy("document_id").agg(
        F.min("method").alias("table_extractor"), F.countDistinct("table_id").alias("table_count")
    )


def parse_releases(documents: DataFrame, tables: DataFrame) -> DataFrame:
    """Adds `metrics`, `table_extractor` and `table_count` to rows with `full_text`."""
    return (
        documents.withColumn("metrics", metric_values(F.col("full_text"), RELEASE_METRICS))
        .join(table_counts(tables), "document_id", "left")
        .withColumn("table_count", F.coalesce("table_count", F.lit(0)))
    )


def has_potential_chart(text: Column) -> Column:
    lowered = F.lower(text)
    test = F.lit(False)
    for word in CHART_WORDS:
        test = test | lowered.contains(word)
    return test


def slide_rows(pages: DataFrame) -> DataFrame:
    """Pages of decks as slides with the chart flag."""
    return pages.select(
        "document_id",
        F.col("page_no").alias("slide_number"),
        F.col("text").alias("content"),
        has_potential_chart(F.col("text")).alias("has_potential_chart"),
    )


def merge_slide_outputs(slides: DataFrame, outputs: DataFrame) -> DataFrame:
    """Attaches model outputs to slides; a failed slide keeps its text and its error."""
    failed = F.col("error").isNotNull()
    return slides.join(outputs, ["document_id", "slide_number"], "left").select(
        "document_id",
        "slide_number",
        "content",
        (F.col("has_potential_chart") & ~failed).alias("has_potential_chart"),
        F.when(~failed, F.col("description")).alias("vision_description"),
        F.when(failed | F.col("description").isNull(), 0)
        .otherwise(F.coalesce("tokens_used", F.lit(0)))
        .cast("long")
        .alias("tokens_used"),
        F.col("error").alias("processing_error"),
    )


def deck_summaries(slides: DataFrame) -> DataFrame:
    """Slide, chart and token counts per deck (of merged slides)."""
    return slides.groupBy("document_id").agg(
        F.count("*").alias("slide_count"),
        F.count_if("has_potential_chart").alias("charts_detected"),
        F.count("vision_description").alias("vision_descriptions"),
        F.sum("tokens_used").alias("vision_tokens_used"),
    )


def parse_decks(documents: DataFrame, slides: DataFrame, tables: DataFrame) -> DataFrame:
    """Deck record: metrics over the whole text, slide summary, table summary."""
    return (
        documents.withColumn("metrics", metric_values(F.col("full_text"), DECK_METRICS))
        .join(deck_summaries(slides), "document_id", "left")
        .join(table_counts(tables), "document_id", "left")
        .withColumn("table_count", F.coalesce("table_count", F.lit(0)))
    )


def parse_documents(documents: DataFrame) -> DataFrame:
    """One pass over all documents: every text-derived field of the routed branch.

    Fields of other branches stay null; nothing is scanned twice and nothing shuffles.
    """
    text, branch = F.col("full_text"), F.col("branch")
    found = F.when(branch == "transcript", transcript_fields(text, F.col("page_count")))
    return (
        documents.withColumn("branch", route(F.col("document_type")))
        .select("*", found.alias("found"))
        .select(
            *documents.columns,
            "branch",
            strategy(F.col("document_type")).alias("strategy"),
            F.when(branch == "transcript", speakers(text)).alias("speakers"),
            F.when(branch == "release", metric_values(text, RELEASE_METRICS))
            .when(branch == "slides", metric_values(text, DECK_METRICS))
            .alias("metrics"),
            F.when(branch == OTHER_TYPE, dates_mentioned(text)).alias("dates_mentioned"),
            F.when(branch == OTHER_TYPE, fx.word_count(text)).alias("word_count"),
            F.inline(F.array("found")),
        )
    )
