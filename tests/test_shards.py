from __future__ import annotations

import random

from quarryline.operators import chunk, shards
from quarryline.plans import corpus

PAGES = "document_id string, document_type string, page_no int, text string"
CELLS = "document_id string, table_id string, method string, page int, row_no int, cells array<string>"
WORDS = (
    "revenue grew in the second quarter as demand held and margins rose while costs fell across most of our "
    "markets Jane Smith CFO Q: A: January 5, 2024 é 😀"
).split()


def paragraphs(rng):
    """Text of a page: paragraphs of all sizes, odd runs of line ends, blanks, turns."""
    out = [rng.choice(["", "", "\n", "\n\n\n", "  "])]
    for _ in range(rng.randint(0, 6)):
        count = rng.choice([0, 1, 3, 20, 60, 150, 300])
        out.append(" ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) * rng.randint(0, 1) for _ in range(count)))
        out.append(rng.choice(["\n", "\n\n", "\n\n\n", "\n\n  \n\n", "\n" * 7, "\nJane Smith - ", "\n Q: "]))
    return "".join(out) if rng.random() < 0.9 else rng.choice(["", "\n", " \n \n", "A: " + "word " * 900])


def collection(seed, documents):
    rng = random.Random(seed)
    rows = []
    for d in range(documents):
        kind = rng.choice(["transcript", "release", "press", "general"])
        for p in range(1, rng.randint(1, 14) + 1):
            text = None if rng.random() < 0.05 else paragraphs(rng)
            if text is not None and rng.random() < 0.15:
                text += rng.choice(["\nQuestions and Answers\n", "Q&A", "\n\n \n\n Q-and-A session"])
            rows.append((f"d{d}", kind, p, text))
    return rows


def as_rows(chunks, leave_out=()):
    return sorted(
        (r.document_id, r.sequence, r.content, r.chunk_id, r.token_count,
         tuple(sorted((k, v) for k, v in r.metadata.items() if k not in leave_out)))
        for r in chunks.collect()
    )


def test_shards_give_the_chunks_of_the_whole(spark):
    pages = spark.createDataFrame(collection(7, 120), PAGES)
    cells = [(f"d{d}", "t", "m", 1, i, ["k"] if i == 0 else [f"v{i}"]) for d in range(0, 130, 3) for i in range(26)]
    tables = chunk.table_texts(spark.createDataFrame(cells, CELLS))
    whole = corpus.chunked(pages, tables)
    texts = as_rows(whole, ["start_index"])
    assert len({r[0] for r in texts}) > 100
    for pages_per_shard in (1, 3, 50):
        got = shards.chunk_sharded(pages, tables, pages_per_shard)
        assert as_rows(got, ["start_index"]) == texts
    # Places differ only after short pieces that stand in the text before them once more.
    wide = {r[3] for r in texts if len(r[2]) > 200}
    places = {r[3]: r[5] for r in as_rows(whole)}
    assert sum(places[r[3]] == r[5] for r in as_rows(got) if r[3] in wide) > 0.9 * len(wide)


def test_places_of_texts_that_do_not_repeat(spark):
    rows = [("d", "press", p, "\n\n".join(f"{p}.{i} " + "words here " * (i * 9) + f"{p}.{i}" for i in range(9))) for p in range(1, 12)]
    pages = spark.createDataFrame(rows, PAGES)
    assert as_rows(shards.chunk_sharded(pages, pages_per_shard=2)) == as_rows(corpus.chunked(pages))


def test_repeated_texts_differ_in_start_index_only(spark):
    rows = [("d", "press", i, "same words again\n\n" * 40) for i in range(1, 9)]
    rows += [("e", "press", i, "\n" * i) for i in range(1, 9)] + [("e", "press", 9, "end " * 700)]
    pages = spark.createDataFrame(rows, PAGES)
    got = as_rows(shards.chunk_sharded(pages, pages_per_shard=2), ["start_index"])
    assert got == as_rows(corpus.chunked(pages), ["start_index"])


def test_dates_over_a_border(spark):
    texts = ["on January", "5,", "2024 and March 3, 2023 and May", "June 7", ", 2022", "July 8", "20211", "August 9, 2020"]
    pages = spark.createDataFrame([("d", "press", i + 1, t) for i, t in enumerate(texts)], PAGES)
    whole = as_rows(corpus.chunked(pages))
    assert as_rows(shards.chunk_sharded(pages, pages_per_shard=1)) == whole
    assert dict(whole[0][5])["dates_mentioned"].count(";") == 2


def test_nothing_and_decks(spark):
    none = spark.createDataFrame([], PAGES)
    assert shards.chunk_sharded(none).count() == 0
    rows = [("a", "slides", 1, "one"), ("a", "slides", 2, " "), ("b", "transcript", 1, None), ("c", "release", None, "x")]
    pages = spark.createDataFrame(rows, PAGES)
    assert as_rows(shards.chunk_sharded(pages, pages_per_shard=1)) == as_rows(corpus.chunked(pages))


def test_a_turn_and_a_section_over_many_shards(spark):
    talk = ["Opening words", "Questions and Answers", "Q: a long question"] + [f"goes on {i}" for i in range(60)]
    rows = [("d", "transcript", i + 1, t) for i, t in enumerate([*talk, "A: short", " \n "])]
    pages = spark.createDataFrame(rows, PAGES)
    got = as_rows(shards.chunk_sharded(pages, pages_per_shard=4))
    assert got == as_rows(corpus.chunked(pages))
    assert [r[2][:8] for r in got] == ["Opening ", "Question", "Q: a lon", "A: short"]
