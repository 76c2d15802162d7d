from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quarryline.operators import intake, parse


@pytest.mark.parametrize(
    "name, kind",
    [
        ("Q1 Earnings-Call Transcript.pdf", "transcript"),
        ("earnings  release.pdf", "earnings_release"),
        ("deck.pdf", "slide_deck"),
        ("x.pdf", "general"),
    ],
)
def test_document_type(one, name, kind):
    assert one(intake.document_type(F.col("x")), x=name) == kind


def test_first_failing_upload_rule_wins(spark):
    rows = [
        (1, None, None, b"x"), (2, "a.txt", "text/plain", b""), (3, "a.pdf", "text/plain", b"x"),
        (4, "a.PDF", None, b""), (5, "a.pdf", "", b"x"), (6, "a.pdf", "application/pdf", b"x"),
    ]
    files = spark.createDataFrame(rows, "id int, filename string, content_type string, content binary")
    got = {r.id: r.reject_reason for r in intake.validate_uploads(files).collect()}
    assert got == {1: "no_filename", 2: "unsupported_extension", 3: "unsupported_mime_type", 4: "empty_file", 5: None, 6: None}
    accepted, rejected = intake.split_accepted(intake.validate_uploads(files))
    assert (accepted.count(), rejected.count()) == (2, 4)


def test_size_limit_is_inclusive(spark):
    limit = intake.MAX_FILE_BYTES
    files = spark.createDataFrame([(limit,), (limit + 1,)], "n int").select(
        F.lit("a.pdf").alias("filename"), F.lit(None).cast("string").alias("content_type"), F.repeat(F.lit("x"), F.col("n")).alias("content")
    )
    assert [r.reject_reason for r in intake.validate_uploads(files).select("reject_reason").collect()] == [None, "too_large"]


def test_a_third_of_all_rows_may_be_copies_and_the_first_still_wins(spark):
    rows = spark.range(3000).select(
        F.col("id").cast("string").alias("id"),
        F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("checksum"),
        (-F.col("id")).alias("created_at"),
    )
    marked = intake.reject_duplicates(rows)
    assert marked.count() == 3000
    assert [r.id for r in marked.filter("unique and checksum = 'same'").collect()] == ["2997"]
    known = spark.createDataFrame([("same",)], "checksum string")
    assert intake.reject_duplicates(rows, known).filter("unique and checksum = 'same'").count() == 0


def test_force_registers_again(spark):
    documents = spark.createDataFrame([("a",), ("b",)], "id string")
    known = spark.createDataFrame([("a",), ("a",)], "id string")
    status = lambda **o: sorted((r.id, r.register_status) for r in intake.register(documents, known, **o).collect())
    assert status() == [("a", "skipped"), ("b", "completed")]
    assert status(force=True) == [("a", "completed"), ("b", "completed")]


def transcript(spark, text, pages=1):
    rows = spark.createDataFrame([("d", text, pages)], "document_id string, full_text string, page_count int")
    return parse.parse_transcripts(rows).first()


def test_marker_at_the_start_does_not_split(spark):
    got = transcript(spark, "Q&A begins")
    assert got.has_qa and [s["type"] for s in got.sections] == ["full_transcript"]


@pytest.mark.parametrize("pages, ranges", [(1, [[1, 1], [1, 1]]), (2, [[1, 1], [2, 2]]), (5, [[1, 2], [3, 5]])])
def test_page_ranges(spark, pages, ranges):
    got = transcript(spark, " intro \nQ&A end", pages)
    assert [s["page_range"] for s in got.sections] == ranges
    assert [s["content"] for s in got.sections] == ["intro", "Q&A end"]


def test_marker_order_decides_not_position(spark):
    got = transcript(spark, "x Question and Answer y Q&A z")
    assert got.sections[1]["content"] == "Q&A z"
    assert not transcript(spark, "no xQ&Ay here").has_qa


def test_speakers_need_a_line_start(one):
    text = "Jane Smith: hi\nCEO - yes\nnot Bob Stone: no\nJane Smith - again\nA: b"
    assert one(parse.speakers(F.col("x")), x=text) == ["CEO", "Jane Smith"]


def test_repeated_header_keeps_first_place_and_last_value(one):
    entry = one(
        parse.record_entries(F.array(F.lit("a"), F.lit("b"), F.lit("a"), F.lit("z")), F.array(F.lit("1"), F.lit("2"), F.lit("3")))
    )
    assert [tuple(e) for e in entry] == [("a", "3"), ("b", "2")]


def test_metrics(one):
    text = "12,345.6 million revenue; $3 profit. EPS was about $1.25\n7.5% growth 2% rate"
    got = one(parse.metric_values(F.col("x"), parse.RELEASE_METRICS | parse.DECK_METRICS), x=text)
    assert got == {"revenue": ["12,345.6"], "profit": ["3"], "eps": ["1.25"], "growth": ["7.5"], "margin": ["2"]}


def test_dates(one):
    text = "On March 3 2024 and April 15, 2024, not Mai 1, 2024 or June 123, 2024"
    assert one(parse.dates_mentioned(F.col("x")), x=text) == ["March 3 2024", "April 15, 2024"]


def test_preferred_extractor_per_document(spark):
    rows = [("a", "t1", "x"), ("a", "t2", "y"), ("b", "t3", "y")]
    cells = spark.createDataFrame(rows, "document_id string, table_id string, method string")
    assert sorted(r.table_id for r in parse.preferred_tables(cells, "x", "y").collect()) == ["t1", "t3"]


def test_qa_position_counts_characters_beyond_the_basic_plane(one):
    from quarryline.operators import parse

    assert one(parse.qa_position(F.col("t")), t="😀😀 Q&A") == 4
    assert one(parse.qa_position(F.col("t")), t="q&a first") == 1
    assert one(parse.qa_position(F.col("t")), t="none") is None
