from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarryline.functions.splitter import split_text
from quarryline.operators import chunk


def pieces_by_strings(text, size, overlap, separators=("\n\n", "\n", " ", "")):
    """The splitting rules on plain strings, slow and literal, as a check on the offsets."""
    separator = next(s for s in separators if s == "" or s in text)
    rest = separators[separators.index(separator) + 1 :]
    if separator:
        head, *others = text.split(separator)
        parts = [p for p in [head, *(separator + o for o in others)] if p]
    else:
        parts = list(text)
    out, small = [], []

    def flush():
        window, total = [], 0
        for part in small:
            if window and total + len(part) > size:
                out.append("".join(window))
                while window and (total > overlap or total + len(part) > size):
                    total -= len(window.pop(0))
            window.append(part)
            total += len(part)
        if window:
            out.append("".join(window))
        small.clear()

    for part in parts:
        if len(part) < size:
            small.append(part)
            continue
        flush()
        out.extend(pieces_by_strings(part, size, overlap, rest) if rest else [part])
    flush()
    return [p.strip() for p in out if p.strip()]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n", max_size=120), st.integers(1, 12), st.integers(0, 12))
def test_offsets_follow_the_string_rules(text, size, overlap):
    overlap = min(overlap, size)
    got = split_text(text, size, overlap)
    assert [p["content"] for p in got] == (pieces_by_strings(text, size, overlap) if text else [])
    for piece in got:
        at = piece["start_index"]
        assert at < 0 or text[at : at + len(piece["content"])] == piece["content"]
    assert all(len(p["content"]) <= size for p in got)


def test_no_character_is_lost(spark):
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    total = 0
    for (text,) in texts:
        got = split_text(text)
        total += len(got)
        covered = set()
        for piece in got:
            covered.update(range(piece["start_index"], piece["start_index"] + len(piece["content"])))
        assert all(i in covered for i, c in enumerate(text) if not c.isspace())
    assert total == 744


def test_turns(one):
    text = "hello\nthere\nQ: why?\nmore\n  A: so\n\nJane Smith - ok\nCEO yes"
    got = [tuple(t) for t in one(chunk.turns(F.col("x")), x=text)]
    assert got == [("hello\nthere", None), ("Q: why?\nmore", "Q:"), ("A: so", "A:"), ("Jane Smith - ok", "Jane Smith"), ("CEO yes", "CEO")]
    assert [tuple(t) for t in one(chunk.turns(F.col("x")), x="just text")] == [("just text", None)]
    assert [tuple(t) for t in one(chunk.turns(F.col("x")), x=" \n ")] == [(" \n ", None)]


def test_table_texts(spark):
    rows = [("d", "t", "m", 1, 0, ["k", "v"])] + [("d", "t", "m", 1, i, [str(i), "" if i == 2 else "x"]) for i in range(1, 13)]
    rows.append(("d", "u", "m", 1, 0, ["k"]))
    cells = spark.createDataFrame(rows, "document_id string, table_id string, method string, page int, row_no int, cells array<string>")
    got = {r.table_id: r.content for r in chunk.table_texts(cells, max_rows=10).collect()}
    whole = sorted((r.part, r.content) for r in chunk.table_texts(cells).filter("table_id = 't'").collect())
    assert [p for p, _ in whole] == [0, 1] and whole[1][1] == "Table t:\nk: 11, v: x\nk: 12, v: x"
    lines = got["t"].split("\n")
    assert lines[0] == "Table t:" and len(lines) == 11 and lines[1] == "k: 1, v: x" and lines[2] == "k: 2"
    assert got["u"] == "Table u: No data"


def test_list_form_of_tables(one):
    rows = F.array(F.array(F.lit("a"), F.lit(None), F.lit("b")), F.array(F.lit("")))
    assert one(chunk.cells_text(F.lit("t"), rows)) == "Table t:\na | b"


def test_fallback_to_the_full_text(spark):
    schema = "document_id string, full_text string, sections array<struct<type:string,content:string,page_range:array<int>>>"
    rows = [("a", "the text", [("prepared_remarks", "  ", [1, 1])]), ("b", "unused", [("x", "kept", [1, 1])]), ("c", " ", [])]
    got = chunk.chunk_transcripts(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.document_id, r.content, r.metadata["section_type"]) for r in got) == [
        ("a", "the text", "full_text_fallback"), ("b", "kept", "x"),
    ]


def test_page_shards_number_on(spark):
    rows = [("d", i, f"page {i}") for i in range(1, 6)]
    pages = spark.createDataFrame(rows, "document_id string, page_no int, text string")
    got = chunk.chunk_page_shards(pages, 2).orderBy("sequence").collect()
    assert [(r.sequence, r.content) for r in got] == [(1, "page 1\n\npage 2"), (2, "page 3\n\npage 4"), (3, "page 5")]


def test_release_tables_follow_the_text(spark):
    documents = spark.createDataFrame([("d", "some text"), ("e", " ")], "document_id string, full_text string")
    tables = spark.createDataFrame(
        [("d", "t2", "m", 1, "two"), ("d", "t1", "m", 1, "one"), ("e", "t3", "m", 1, "three")],
        "document_id string, table_id string, method string, page int, content string",
    )
    got = chunk.chunk_releases(documents, tables).collect()
    assert sorted((r.document_id, r.sequence, r.content) for r in got) == [
        ("d", 1, "some text"), ("d", 2, "one"), ("d", 3, "two"), ("e", 1, "three"),
    ]


def test_methods_may_share_table_ids(spark):
    rows = [("d", "t", m, 1, i, c) for m, v in (("lattice", "x"), ("plumber", "y")) for i, c in ((0, ["k"]), (1, [v]))]
    cells = spark.createDataFrame(rows, "document_id string, table_id string, method string, page int, row_no int, cells array<string>")
    got = sorted((r.method, r.content) for r in chunk.table_texts(cells).collect())
    assert got == [("lattice", "Table t:\nk: x"), ("plumber", "Table t:\nk: y")]


def test_length_does_not_change_how_a_document_is_chunked(spark):
    from quarryline.plans import corpus

    talk = ["Jane Smith: hello", "Questions and Answers", "Q: growth?", "A: 3% growth"]
    rows = [("long", "transcript", i + 1, talk[i] if i < 4 else f"A: page {i}") for i in range(6000)]
    rows += [("release", "release", i, f"page {i}") for i in range(1, 7)] + [("deck", "slides", 1, "slide")]
    pages = spark.createDataFrame(rows, "document_id string, document_type string, page_no int, text string")
    cells = [("release", "t", "m", 1, i, ["k"] if i == 0 else [f"v{i}"]) for i in range(26)]
    tables = chunk.table_texts(
        spark.createDataFrame(cells, "document_id string, table_id string, method string, page int, row_no int, cells array<string>")
    )
    got = corpus.chunked(pages, tables).collect()
    turns = [r for r in got if r.document_id == "long" and r.metadata["section_type"] == "qa_session"]
    assert len(turns) > 5990 and any(r.metadata.get("speaker") == "Q:" for r in turns)
    text = "\n".join(r.content for r in got if r.document_id == "release")
    assert all(f"k: v{i}" in text for i in range(1, 26))


def test_shards_by_page_range_are_the_callers_choice(spark):
    rows = [("long", i, f"page {i}") for i in range(1, 121)]
    pages = spark.createDataFrame(rows, "document_id string, page_no int, text string")
    long = sorted(chunk.chunk_page_shards(pages).collect(), key=lambda r: r.sequence)
    assert [r.sequence for r in long] == list(range(1, len(long) + 1))
    assert sorted({r.metadata["shard"] for r in long}) == ["0", "1", "2"]
    assert all(any(f"page {i}" in r.content for r in long) for i in range(1, 121))
