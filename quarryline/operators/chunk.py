"""Chunking: recursive splitting, speaker turns, slides, tables, page shards.

A document's chunks are worked out inside its own row and numbered by their position
in the exploded array, so chunking needs no shuffle and no window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions import text as fx
from quarryline.functions.binding import bind
from quarryline.functions.splitter import PIECES, split_column, split_columns
from quarryline.operators import parse

# Fixed values.
TURN_PATTERN = r"([A-Z][a-z]+ [A-Z][a-z]+|[A-Z]{2,}|Q:|A:)"
ROWS_PER_TABLE_TEXT = 10
PAGES_PER_SHARD = 50
QA_SECTION = "qa_session"

_META = "map<string,string>"
_TABLES = "array<struct<table_id:string,method:string,page:int,part:int,content:string>>"


def chunk_id(document_id: Column, sequence: Column, content: Column) -> Column:
    """Content-derived id: the same input gives the same chunk ids on every run."""
    return F.sha2(F.concat_ws("\u0001", document_id, sequence.cast("string"), content), 256)


def finish_chunks(pieces: DataFrame) -> DataFrame:
    """Chunk rows from (document_id, sequence, content, metadata)."""
    content = F.col("content")
    return pieces.select(
        chunk_id(F.col("document_id"), F.col("sequence"), content).alias("chunk_id"),
        "document_id",
        F.col("sequence").cast("int").alias("sequence"),
        content,
        fx.strip(content).alias("content_normalized"),
        fx.word_count(content).cast("int").alias("token_count"),
        "metadata",
    )


def turns(text: Column) -> Column:
    """Speaker turns: array<struct<content, speaker>>.

    A line whose stripped text begins with a name, capitals, `Q:` or `A:` opens a turn.
    Text before the first such line has no speaker; blank turns are dropped; without
    any turn the whole text is one.
    """
    opens = rf"\n(?=[{fx.INLINE_BLANK_CLASS}]*{TURN_PATTERN})"
    parts = F.transform(F.split(text, opens), fx.strip)
    found = F.transform(
        F.filter(parts, lambda t: t != ""),
        lambda t: F.struct(
            t.alias("content"),
            fx.truthy(F.regexp_extract(t, rf"\A{TURN_PATTERN}", 1)).alias("speaker"),
        ),
    )
    whole = F.array(F.struct(text.alias("content"), F.lit(None).cast("string").alias("speaker")))
    return bind(found, lambda f: F.when(F.size(f) > 0, f).otherwise(whole))


def utterances(sections: DataFrame) -> DataFrame:
    """Turns of Q&A sections as rows, `turn_index` from 1."""
    return (
        sections.filter("type = 'qa_session'")
        .select(
            "document_id",
            "section_no",
            F.col("type").alias("section"),
            F.posexplode(turns(F.col("content"))).alias("position", "turn"),
        )
        .select(
            F.sha2(F.concat_ws("\u0001", "document_id", "section_no", "position"), 256).alias(
                "utterance_id"
            ),
            "document_id",
            "section_no",
            "section",
            (F.col("position") + 1).alias("turn_index"),
            F.col("turn.speaker").alias("speaker"),
            F.col("turn.content").alias("speech"),
        )
    )


def records_text(table_id: Column, rows: Column, max_rows: int | None = None) -> Column:
    """Text of a table whose rows are arrays of (key, value), empty values out.

    `max_rows` keeps the first rows only.
    """
    lines = F.transform(
        rows if max_rows is None else F.slice(rows, 1, max_rows),
        lambda row: F.array_join(
            F.transform(
                F.filter(row, lambda e: F.coalesce(e["value"], F.lit("")) != ""),
                lambda e: F.concat(e["key"], F.lit(": "), e["value"]),
            ),
            ", ",
        ),
    )
    return _table_text(table_id, rows, lines)


def cells_text(table_id: Column, rows: Column, max_rows: int | None = None) -> Column:
    """Text of a table whose rows are arrays of cells; `max_rows` keeps the first only."""
    lines = F.transform(
        rows if max_rows is None else F.slice(rows, 1, max_rows),
        lambda row: F.array_join(F.filter(row, lambda c: F.coalesce(c, F.lit("")) != ""), " | "),
    )
    return _table_text(table_id, rows, lines)


def _table_text(table_id: Column, rows: Column, lines: Column) -> Column:
    title = F.concat(F.lit("Table "), F.coalesce(table_id, F.lit("unknown")), F.lit(":"))
    body = F.concat(F.array(title), F.filter(lines, lambda line: line != ""))
    return F.when(F.coalesce(F.size(rows), F.lit(0)) > 0, F.array_join(body, "\n")).otherwise(
        F.concat(title, F.lit(" No data"))
    )


def table_texts(
    cells: DataFrame, max_rows: int | None = None, rows_per_text: int = ROWS_PER_TABLE_TEXT
) -> DataFrame:
    """Texts of extracted tables (header in row 0, records below), as parts from 0.

    A table is known by document, table id and method. Every text holds `rows_per_text` rows
    under the table's name, so a long table becomes several parts and never gathers in one
    task. With `max_rows` only the first non-empty records count, which are cut per table
    before the rows of a table come together.
    """
    key = ["document_id", "table_id", "method"]
    heads = cells.filter("row_no = 0").select(*key, "page")
    records = parse.table_records(cells).withColumn("_row", F.col("row_no"))
    if max_rows is not None:
        order = Window.partitionBy(*key).orderBy("row_no")
        numbered = records.withColumn("_row", F.row_number().over(order))
        records = numbered.filter(F.col("_row") <= max_rows)
    part = F.floor((F.col("_row") - 1) / rows_per_text).cast("int")
    rows = (
        records.groupBy(*key, part.alias("part"))
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("_row", "record"))), lambda r: r["record"]
            ).alias("rows")
        )
    )
    return heads.join(rows, key, "left").select(
        *key,
        "page",
        F.coalesce("part", F.lit(0)).alias("part"),
        records_text(F.col("table_id"), F.col("rows")).alias("content"),
    )


def split_documents(documents: DataFrame, text: str = "full_text") -> DataFrame:
    """Recursive splitting of a text column: rows (document_id, sequence, content, start_index)."""
    return documents.select(
        "document_id", F.posexplode(split_column(F.col(text))).alias("position", "piece")
    ).select("document_id", (F.col("position") + 1).alias("sequence"), "piece.*")


def _meta(**entries: Column) -> Column:
    """String map without the null entries."""
    pairs = F.array(
        *[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in entries.items()]
    )
    return F.map_from_entries(F.filter(pairs, lambda e: e["value"].isNotNull()))


def string_map(**entries: Column) -> Column:
    """`_meta` as the metadata type, also where every entry is null."""
    return _meta(**entries).cast(_META)


def _piece(content: Column, metadata: Column) -> Column:
    return F.struct(content.alias("content"), metadata.cast(_META).alias("metadata"))


def _numbers(values: Column) -> Column:
    return F.array_join(values.cast("array<string>"), ",")


def _transcript_texts() -> Column:
    """Texts of a transcript to split: its sections but the Q&A, and a spare.

    The spare is the non-blank full text where the sections give no chunk, which can only
    be where no section is a Q&A and all of them are blank.
    """
    nothing_else = F.forall(
        "sections", lambda s: (s["type"] != QA_SECTION) & fx.is_blank(s["content"])
    )
    spare = F.when(nothing_else & ~fx.is_blank(F.col("full_text")), F.col("full_text"))
    return F.concat(
        F.transform("sections", lambda s: F.when(s["type"] != QA_SECTION, s["content"])),
        F.array(spare),
    )


def _transcript_pieces(found: Column) -> Column:
    """Q&A sections by speaker turn, other sections by splitting, in section order."""

    def talk(section: Column) -> Column:
        return F.transform(
            turns(section["content"]),
            lambda t, i: _piece(
                t["content"],
                _meta(
                    section_type=section["type"],
                    qa_index=i,
                    speaker=t["speaker"],
                    page_range=_numbers(section["page_range"]),
                ),
            ),
        )

    def plain(section: Column, pieces: Column) -> Column:
        return F.transform(
            pieces,
            lambda p: _piece(
                p["content"],
                _meta(
                    section_type=section["type"],
                    page_range=_numbers(section["page_range"]),
                    start_index=p["start_index"],
                ),
            ),
        )

    by_section = F.zip_with(
        "sections",
        F.slice(found, 1, F.size("sections")),
        lambda s, pieces: F.when(s["type"] == QA_SECTION, talk(s)).otherwise(plain(s, pieces)),
    )
    fallback = F.transform(
        F.coalesce(F.element_at(found, -1), F.array().cast(PIECES)),
        lambda p: _piece(
            p["content"],
            _meta(section_type=F.lit("full_text_fallback"), start_index=p["start_index"]),
        ),
    )
    return F.concat(F.flatten(by_section), fallback)


def _text_pieces(found: Column, **extra: Column) -> Column:
    """Pieces of the full text."""
    return F.transform(
        F.coalesce(F.element_at(found, 1), F.array().cast(PIECES)),
        lambda p: _piece(
            p["content"],
            _meta(content_type=F.lit("text"), start_index=p["start_index"], **extra),
        ),
    )


def _table_pieces(tables: Column) -> Column:
    """One piece per non-blank table text, in table order."""
    return F.transform(
        F.filter(F.coalesce(tables, F.array().cast(_TABLES)), lambda t: ~fx.is_blank(t["content"])),
        lambda t: _piece(
            t["content"],
            _meta(
                content_type=F.lit("table"),
                table_id=t["table_id"],
                table_method=t["method"],
                page=t["page"],
                part=F.when(t["part"] > 0, t["part"]),
            ),
        ),
    )


def _dates(dates: Column) -> Column:
    return fx.truthy(F.array_join(dates, "; "))


def _with_tables(documents: DataFrame, tables: DataFrame) -> DataFrame:
    """Documents with the texts of their tables, by table, method and part."""
    part = F.col("part") if "part" in tables.columns else F.lit(0).alias("part")
    listed = F.array_sort(F.collect_list(F.struct("table_id", "method", "page", part, "content")))
    return documents.join(
        tables.groupBy("document_id").agg(listed.cast(_TABLES).alias("tables")), "document_id", "left"
    )


def _exploded(pieces: DataFrame) -> DataFrame:
    rows = pieces.select("document_id", F.posexplode("pieces").alias("position", "piece"))
    return finish_chunks(
        rows.select("document_id", (F.col("position") + 1).alias("sequence"), "piece.*")
    )


def chunk_transcripts(transcripts: DataFrame) -> DataFrame:
    """Chunks of transcripts with one running sequence over their sections.

    All texts of a document go to the splitter in one array and the pieces stay in the
    document's row.
    """
    split = transcripts.select(
        "document_id", "sections", split_columns(_transcript_texts()).alias("found")
    )
    return _exploded(split.select("document_id", _transcript_pieces(F.col("found")).alias("pieces")))


def chunk_releases(documents: DataFrame, tables: DataFrame) -> DataFrame:
    """Text pieces first, then one chunk per table of `table_texts`; the sequence continues."""
    split = _with_tables(documents, tables).select(
        "document_id", "tables", split_columns(F.array("full_text")).alias("found")
    )
    pieces = F.concat(_text_pieces(F.col("found")), _table_pieces(F.col("tables")))
    return _exploded(split.select("document_id", pieces.alias("pieces")))


def chunk_press(documents: DataFrame) -> DataFrame:
    """Pieces of the full text, each carrying the dates the document mentions."""
    split = documents.select(
        "document_id",
        _dates(parse.dates_mentioned(F.col("full_text"))).alias("dates"),
        split_columns(F.array("full_text")).alias("found"),
    )
    pieces = _text_pieces(F.col("found"), dates_mentioned=F.col("dates"))
    return _exploded(split.select("document_id", pieces.alias("pieces")))


def chunk_decks(slides: DataFrame) -> DataFrame:
    """One chunk per non-blank slide; the sequence is the slide number."""
    return finish_chunks(
        slides.filter(~fx.is_blank(F.col("content"))).select(
            "document_id",
            F.col("slide_number").alias("sequence"),
            "content",
            _meta(
                content_type=F.lit("slide"),
                slide_number=F.col("slide_number"),
                has_potential_chart=F.col("has_potential_chart"),
            ).alias("metadata"),
        )
    )


def chunk_documents(
    documents: DataFrame, slides: DataFrame | None = None, tables: DataFrame | None = None
) -> DataFrame:
    """Chunks of parsed documents of every type (rows of `parse.parse_documents`).

    One pass: the branch decides, row by row, which texts are split and how pieces are
    labelled. Decks come as `slides`, tables of releases as rows of `table_texts`.
    """
    is_transcript, is_release = F.col("branch") == "transcript", F.col("branch") == "release"
    whole = documents.filter(F.col("branch") != "slides")
    if tables is None:
        whole = whole.withColumn("tables", F.lit(None).cast(_TABLES))
    else:
        whole = _with_tables(whole, tables)
    texts = F.when(is_transcript, _transcript_texts()).otherwise(F.array("full_text"))
    split = whole.select(
        "document_id",
        "branch",
        "sections",
        "tables",
        _dates(F.col("dates_mentioned")).alias("dates"),
        split_columns(texts).alias("found"),
    )
    found = F.col("found")
    pieces = (
        F.when(is_transcript, _transcript_pieces(found))
        .when(is_release, F.concat(_text_pieces(found), _table_pieces(F.col("tables"))))
        .otherwise(_text_pieces(found, dates_mentioned=F.col("dates")))
    )
    chunks = _exploded(split.select("document_id", pieces.alias("pieces")))
    return chunks if slides is None else chunks.unionByName(chunk_decks(slides))


def chunk_page_shards(pages: DataFrame, pages_per_shard: int = PAGES_PER_SHARD) -> DataFrame:
    """Chunks of very long documents, split by page range first.

    Pages come together per shard only, so no task holds a whole document. Piece
    counts per shard are summed up to give every shard its first sequence number.
    """
    shard = F.floor((F.col("page_no") - 1) / pages_per_shard).cast("int")
    ordered = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    shards = (
        pages.withColumn("shard", shard)
        .groupBy("document_id", "shard")
        .agg(F.array_join(F.transform(ordered, lambda p: p["text"]), parse.PAGE_BREAK).alias("text"))
        .select("document_id", "shard", split_column(F.col("text")).alias("found"))
    )
    before = Window.partitionBy("document_id").orderBy("shard").rowsBetween(
        Window.unboundedPreceding, -1
    )
    numbered = shards.withColumn("before", F.coalesce(F.sum(F.size("found")).over(before), F.lit(0)))
    return finish_chunks(
        numbered.select(
            "document_id", "shard", "before", F.posexplode("found").alias("position", "piece")
        ).select(
            "document_id",
            (F.col("before") + F.col("position") + 1).alias("sequence"),
            F.col("piece.content").alias("content"),
            _meta(shard=F.col("shard"), start_index=F.col("piece.start_index")).alias("metadata"),
        )
    )


def manifest_entries(chunks: DataFrame) -> DataFrame:
    """Per-chunk lines of the chunk manifest."""
    return chunks.select(
        "document_id",
        "chunk_id",
        "sequence",
        "token_count",
        F.length("content").alias("char_count"),
        "metadata",
    )


def manifest_totals(chunks: DataFrame) -> DataFrame:
    """Per-document head of the chunk manifest."""
    return chunks.groupBy("document_id").agg(
        F.count("*").alias("chunk_count"),
        F.sum("token_count").alias("token_count"),
        F.sum(F.length("content")).alias("char_count"),
    )
