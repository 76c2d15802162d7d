"""Chunks of documents of any length, worked out by page range and equal to those of the whole.

No task holds a document. Its pages come together in shards only; every shard reports what may
touch its neighbours (runs of line ends, markers, openings of speaker turns, dates cut in two) as
positions, not as text. One walk over these reports, document by document, says where the pieces
of the whole text begin and end; the shards cut them, and only pieces that cross a border are
put together from two or more shards.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions import text as fx
from quarryline.functions.splitter import CHUNK_OVERLAP, CHUNK_SIZE, PIECES, spans
from quarryline.operators import chunk, parse
from quarryline.session import materialise

# A shard's text stands behind the page break before it; the first one's break is at -2.
_START = -len(parse.PAGE_BREAK)

_LINE_ENDS = re.compile(r"\n{2,}|\A\n|\n\Z")
_OPENS = re.compile(r"\n(?=[^\S\n]*" + chunk.TURN_PATTERN + ")")
_MARKERS = [re.compile(rf"\b{m}\b", re.I) for m in parse.QA_MARKERS]
_DATE = re.compile(parse.DATE_PATTERN)
_MONTH = parse.DATE_PATTERN[: parse.DATE_PATTERN.index(r"\s")]
_OPEN_DATE = re.compile(_MONTH + r"(?:\s+(?:\d{1,2},?\s*)?)?\Z")
_DATE_REST = re.compile(r"\s*(?:\d{1,2},?)?\s*(?:\d{1,4}\w?)?")

_REPORT = (
    "struct<length:int, first:int, last:int, runs:array<struct<at:int,n:int>>, "
    "marks:array<struct<at:int,last:int>>, opens:array<int>, "
    "dates:array<struct<at:int,text:string>>, open_date:string, date_rest:string>"
)
_SPOT = [("at", pa.int32()), ("n", pa.int32())]
_MARK = [("at", pa.int32()), ("last", pa.int32())]
_REPORT_ARROW = pa.struct(
    [
        ("length", pa.int32()), ("first", pa.int32()), ("last", pa.int32()),
        ("runs", pa.list_(pa.struct(_SPOT))), ("marks", pa.list_(pa.struct(_MARK))),
        ("opens", pa.list_(pa.int32())),
        ("dates", pa.list_(pa.struct([("at", pa.int32()), ("text", pa.string())]))),
        ("open_date", pa.string()), ("date_rest", pa.string()),
    ]
)

_CUTS = (
    "document_id string, branch string, pages int, shard int, section int, kind string, "
    "begin long, section_begin long, number int, start int, stop int, text string"
)
_CUTS_ARROW = pa.schema(
    [
        ("document_id", pa.string()), ("branch", pa.string()), ("pages", pa.int32()),
        ("shard", pa.int32()), ("section", pa.int32()), ("kind", pa.string()),
        ("begin", pa.int64()), ("section_begin", pa.int64()), ("number", pa.int32()),
        ("start", pa.int32()), ("stop", pa.int32()), ("text", pa.string()),
    ]
)
_ROWS_PER_BATCH = 20_000


def _report(text: str | None) -> dict | None:
    """What of a shard's text its neighbours or the whole document need to know."""
    if text is None:
        return None
    solid = text.strip()
    rest = _DATE_REST.match(text)[0]
    open_date = _OPEN_DATE.search(text, len(text) - _tail(text))
    marks = [m.search(text) for m in _MARKERS]
    return {
        "length": len(text),
        "first": len(text) - len(text.lstrip()) if solid else None,
        "last": len(text.rstrip()) if solid else None,
        "runs": [{"at": m.start(), "n": m.end() - m.start()} for m in _LINE_ENDS.finditer(text)],
        "marks": [m and {"at": m.start(), "last": len(text[: m.start()].rstrip())} for m in marks],
        "opens": [m.start() for m in _OPENS.finditer(text)],
        "dates": [{"at": m.start(), "text": m[0]} for m in _DATE.finditer(text)],
        "open_date": open_date and open_date[0],
        "date_rest": rest,
    }


def _tail(text: str) -> int:
    """Length of the last two words with the blanks around them: room for an open date."""
    end = text.rstrip()
    for _ in range(2):
        end = end.rstrip()
        cut = max((i for i, c in enumerate(end[-64:]) if c.isspace()), default=-1)
        end = end[: len(end) - len(end[-64:]) + cut + 1]
    return len(text) - len(end)


class _Walk:
    """The walk over the shards of one document: pieces as spans of its whole text."""

    def __init__(self, head: dict, size: int, overlap: int):
        self.head, self.size, self.overlap = head, size, overlap
        self.end = _START
        self.places: list[tuple[int, int, int]] = []  # shard, where it begins and ends
        self.held: list[int] | None = None  # a run of line ends that may go on
        self.qa = head["qa"] if head["branch"] == "transcript" and (head["qa"] or 0) > 0 else None
        if self.qa is None:
            self.begin, self.stop, self.closed = 0, head["total"], False
        else:
            self.begin, self.stop = head["first"], head["qa_last"]
            self.closed = self.begin >= self.stop
        self.cut, self.small = self.begin, []
        self.turn, self.turns = self.qa, 0
        self.open_date = ""

    def _piece(self, kind: str, begin: int, end: int, section: int = 0, number: int | None = None):
        """One row for every shard that holds a part of the piece."""
        of = self.qa if section else self.begin
        for shard, first, last in self.places:
            if first < end and begin < last:
                yield self._row(
                    kind, shard, section, begin, of, number, max(begin, first) - first, min(end, last) - first
                )

    def _row(self, kind, shard, section, begin, of, number, start, stop, text=None) -> tuple:
        h = self.head
        return (h["document_id"], h["branch"], h["page_count"], shard, section, kind, begin, of, number, start, stop, text)

    def _part(self, start: int, stop: int):
        """The next part between cuts: small ones slide through a window, long ones stand alone."""
        small = self.small
        if stop - start >= self.size:
            yield from self._window(start)
            yield from self._piece("long", start, stop)
            return
        if small and stop - small[0] > self.size:
            yield from self._piece("window", small[0], start)
            drop = 0
            while drop < len(small) and (
                start - small[drop] > self.overlap or stop - small[drop] > self.size
            ):
                drop += 1
            del small[:drop]
        small.append(start)

    def _window(self, end: int):
        if self.small:
            yield from self._piece("window", self.small[0], end)
            self.small.clear()

    def _close(self):
        if not self.closed:
            yield from self._part(self.cut, self.stop)
            yield from self._window(self.stop)
            self.closed = True

    def _line_ends(self, at: int, n: int):
        """Cuts at every pair of line ends, counted from where the run begins."""
        step = len(parse.PAGE_BREAK)
        for cut in range(at, at + n - step + 1, step):
            if not self.closed and self.begin < cut < self.stop:
                yield from self._part(self.cut, cut)
                self.cut = cut

    def shard(self, number: int, report: dict):
        """Goes on by one shard."""
        offset = self.end
        self.end = offset + report["length"]
        self.places.append((number, offset, self.end))
        for run in report["runs"]:
            at, n = offset + run["at"], run["n"]
            if self.held and sum(self.held) == at:
                self.held[1] += n
            else:
                if self.held:
                    yield from self._line_ends(*self.held)
                self.held = [at, n]
        if self.held and sum(self.held) < self.end:
            yield from self._line_ends(*self.held)
            self.held = None
        if self.end >= self.stop and self.qa is not None:
            yield from self._close()
        if self.qa is not None:
            for at in report["opens"]:
                if offset + at > self.qa:
                    yield from self._piece("turn", self.turn, offset + at, 1, self.turns)
                    self.turn, self.turns = offset + at, self.turns + 1
        if self.head["branch"] == parse.OTHER_TYPE:
            yield from self._dates(number, offset, report)
        needed = [] if self.closed else [self.small[0] if self.small else self.cut]
        needed += [] if self.qa is None else [self.turn]
        if self.held and not self.closed:
            needed.append(self.held[0])
        self.places = [p for p in self.places if p[2] > min(needed, default=self.end)]

    def _dates(self, number: int, offset: int, report: dict):
        if self.open_date:
            over = _DATE.match(self.open_date + report["date_rest"])
            if over and over.end() > len(self.open_date):
                yield self._row("date", number, 0, offset - len(self.open_date), 0, None, 0, 0, over[0])
        for d in report["dates"]:
            yield self._row("date", number, 0, offset + d["at"], 0, None, 0, 0, d["text"])
        if len(report["date_rest"]) == report["length"]:
            longer = _OPEN_DATE.match(self.open_date + report["date_rest"])
            self.open_date = longer[0] if longer else ""
        else:
            self.open_date = report["open_date"] or ""

    def finish(self):
        if self.held:
            yield from self._line_ends(*self.held)
        yield from self._close()
        if self.qa is not None:
            yield from self._piece("turn", self.turn, self.end, 1, self.turns)


def _walked(size: int, overlap: int):
    """Walks the shards of a sorted partition and returns the rows of their pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def rows():
            walk = None
            for batch in batches:
                for row in batch.to_pylist():
                    if walk is None or walk.head["document_id"] != row["document_id"]:
                        if walk is not None:
                            yield from walk.finish()
                        walk = _Walk(row, size, overlap)
                    yield from walk.shard(row["shard"], row["report"])
            if walk is not None:
                yield from walk.finish()

        for row in rows():
            out.append(row)
            if len(out) == _ROWS_PER_BATCH:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), _CUTS_ARROW)]
    return pa.RecordBatch.from_arrays(columns, schema=_CUTS_ARROW)


def page_shards(pages: DataFrame, pages_per_shard: int = chunk.PAGES_PER_SHARD) -> DataFrame:
    """Pages by page range: (document_id, shard, document_type, page_count, text, report).

    The text of a shard has the page break before it; it is null where all its pages are.
    Only here does text move between tasks before the pieces are cut.
    """

    @F.arrow_udf(_REPORT)
    def report(texts: pa.Array) -> pa.Array:
        return pa.array([_report(t) for t in texts.to_pylist()], _REPORT_ARROW)

    ordered = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("page_no", "text"))))
    joined = F.array_join(F.transform(ordered, lambda p: p["text"]), parse.PAGE_BREAK)
    shard = F.floor((F.coalesce("page_no", F.lit(0)) - 1) / pages_per_shard).cast("int")
    shards = (
        pages.groupBy("document_id", shard.alias("shard"))
        .agg(
            F.min("document_type").alias("document_type"),
            F.count("*").alias("page_count"),
            F.when(F.count("text") > 0, F.concat(F.lit(parse.PAGE_BREAK), joined)).alias("text"),
        )
    )
    return shards.withColumn("report", report("text"))


def _heads(shards: DataFrame) -> DataFrame:
    """Per document: branch, pages, length, first letter, and where its Q&A begins."""
    before = Window.partitionBy("document_id").orderBy("shard")
    earlier = before.rowsBetween(Window.unboundedPreceding, -1)
    length = F.coalesce(F.col("report.length"), F.lit(0)).cast("long")
    placed = shards.select(
        "document_id",
        "shard",
        "document_type",
        "page_count",
        length.alias("length"),
        F.col("report.first").alias("first"),
        F.col("report.last").alias("last"),
        F.col("report.marks").alias("marks"),
        (F.coalesce(F.sum(length).over(earlier), F.lit(0)) + _START).alias("offset"),
    ).withColumn("_last", F.max(F.col("offset") + F.col("last")).over(earlier))

    def mark(i: int) -> Column:
        m = F.get("marks", F.lit(i))
        inside = F.when(m["last"] > 0, F.col("offset") + m["last"])
        found = F.struct(
            (F.col("offset") + m["at"]).alias("qa"),
            F.coalesce(inside, "_last", F.lit(0)).alias("qa_last"),
        )
        return F.min(F.when(m.isNotNull(), found)).alias(f"_mark{i}")

    marks = [mark(i) for i in range(len(parse.QA_MARKERS))]
    chosen = F.coalesce(*[F.col(f"_mark{i}") for i in range(len(marks))])
    return (
        placed.groupBy("document_id")
        .agg(
            parse.route(F.min("document_type")).alias("branch"),
            F.sum("page_count").cast("int").alias("page_count"),
            (F.sum("length") + _START).alias("total"),
            F.min(F.col("offset") + F.col("first")).alias("first"),
            *marks,
        )
        .select("document_id", "branch", "page_count", "total", "first", chosen.alias("_qa"))
        .select("document_id", "branch", "page_count", "total", "first", "_qa.*")
    )


def _cut(shards: DataFrame, cuts: DataFrame) -> DataFrame:
    """Texts of the pieces: cut in their shards, those over a border put together."""
    of_piece = ["document_id", "branch", "pages", "section", "kind", "begin", "section_begin", "number"]

    @F.arrow_udf("array<string>")
    def slices(texts: pa.Array, starts: pa.Array, stops: pa.Array) -> pa.Array:
        rows = zip(texts.to_pylist(), starts.to_pylist(), stops.to_pylist())
        return pa.array([[t[a:b] for a, b in zip(x, y)] for t, x, y in rows], pa.list_(pa.string()))

    listed = cuts.groupBy("document_id", "shard").agg(
        F.collect_list(F.struct(*of_piece[1:], "start", "stop")).alias("cuts")
    )
    found = slices("text", F.col("cuts.start"), F.col("cuts.stop"))
    parts = (
        shards.select("document_id", "shard", "text")
        .join(listed, ["document_id", "shard"])
        .select("document_id", "shard", F.inline(F.arrays_zip("cuts", found.alias("part"))))
        .select("document_id", "shard", "cuts.*", "part")
    )
    ordered = F.array_sort(F.collect_list(F.struct("shard", "part")))
    return parts.groupBy(*of_piece).agg(
        F.array_join(F.transform(ordered, lambda p: p["part"]), "").alias("text")
    )


def _split(kind: Column, text: Column, size: int, overlap: int) -> Column:
    """Stripped, non-blank pieces of a span with their places in it."""

    def pieces_of(kind: str, text: str) -> list[dict]:
        found = []
        for begin, end in spans(text, 1, size, overlap) if kind == "long" else ((0, len(text)),):
            piece = text[begin:end]
            if piece.strip():
                at = begin + len(piece) - len(piece.lstrip())
                found.append({"content": piece.strip(), "start_index": at})
        return found

    @F.arrow_udf(PIECES)
    def pieces(kinds: pa.Array, texts: pa.Array) -> pa.Array:
        rows = zip(kinds.to_pylist(), texts.to_pylist())
        return pa.array(
            [pieces_of(k, t) for k, t in rows],
            pa.list_(pa.struct([("content", pa.string()), ("start_index", pa.int32())])),
        )

    return pieces(kind, text)


def _metadata() -> Column:
    """The entries that `chunk.chunk_documents` gives a piece of this kind."""
    is_turn, has_qa = F.col("kind") == "turn", F.col("qa_split")
    pages, half = F.col("pages"), F.floor(F.col("pages") / 2).cast("int")
    several = pages > 1
    first = F.when(is_turn & several, half + 1).otherwise(1)
    last = F.when(has_qa & ~is_turn, F.when(several, half).otherwise(1)).otherwise(
        F.when(several | ~has_qa, pages).otherwise(1)
    )
    page_range = F.concat_ws(",", first.cast("string"), last.cast("string"))
    index = (F.col("begin") - F.col("section_begin") + F.col("piece.start_index")).cast("string")
    section = F.when(is_turn, chunk.QA_SECTION).when(has_qa, "prepared_remarks").otherwise("full_transcript")
    speaker = fx.truthy(F.regexp_extract("piece.content", rf"\A{chunk.TURN_PATTERN}", 1))
    transcript = chunk.string_map(
        section_type=section,
        qa_index=F.when(is_turn, F.col("number")),
        speaker=F.when(is_turn, speaker),
        page_range=page_range,
        start_index=F.when(~is_turn, index),
    )
    other = chunk.string_map(
        content_type=F.lit("text"), start_index=index, dates_mentioned=F.col("dates")
    )
    return F.when(F.col("branch") == "transcript", transcript).otherwise(other)


def chunk_sharded(
    pages: DataFrame,
    tables: DataFrame | None = None,
    pages_per_shard: int = chunk.PAGES_PER_SHARD,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
) -> DataFrame:
    """The chunks that `chunk.chunk_documents` gives for whole documents, shard by shard.

    Pages (document_id, document_type, page_no, text) may have nulls: a null text is left out,
    a document without any text has no text chunks. Decks are chunked by slide and need no
    shards. `tables` are rows of `chunk.table_texts`; those of releases follow the text, part by
    part, never gathered per document. Text goes through two shuffles, by shard and by piece.

    `start_index` is the true place of a piece in its section. The whole form looks for the piece
    from the piece before on, so in texts that repeat themselves it may name an earlier copy.
    """
    is_deck = parse.route(F.col("document_type")) == "slides"
    shards = materialise(page_shards(pages.filter(~is_deck), pages_per_shard), "page-shards")
    heads = materialise(_heads(shards), "shard-heads")
    walked = (
        shards.filter("report IS NOT NULL")
        .select("document_id", "shard", "report")
        .join(heads, "document_id")
        .repartition("document_id")
        .sortWithinPartitions("document_id", "shard")
        .mapInArrow(_walked(size, overlap), _CUTS)
    )
    cuts = materialise(walked, "shard-cuts")
    texts = _cut(shards, cuts.filter("kind <> 'date'").drop("text"))
    split = _split(F.col("kind"), F.col("text"), size, overlap)
    pieces = materialise(texts.withColumn("pieces", split).drop("text"), "shard-pieces")

    order = Window.partitionBy("document_id").orderBy("section", "begin")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    dates = cuts.filter("kind = 'date'").groupBy("document_id").agg(
        F.array_sort(F.collect_list(F.struct("begin", "text"))).alias("dates")
    )
    numbers = pieces.select("document_id", "section", "begin", F.size("pieces").alias("n"))
    numbered = numbers.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(
        dates.select("document_id", F.array_join("dates.text", "; ").alias("dates")),
        "document_id",
        "left",
    )
    qa = heads.select("document_id", F.coalesce(F.col("qa") > 0, F.lit(False)).alias("qa_split"))
    rows = pieces.join(numbered.join(qa, "document_id"), ["document_id", "section", "begin"]).select(
        "*", F.posexplode("pieces").alias("position", "piece")
    )
    chunks = rows.select(
        "document_id",
        (F.col("before") + F.col("position") + 1).alias("sequence"),
        F.col("piece.content").alias("content"),
        _metadata().alias("metadata"),
    )
    if tables is not None:
        chunks = chunks.unionByName(_tables_after(heads, numbers, tables))
    decks = chunk.chunk_decks(parse.slide_rows(pages.filter(is_deck)))
    return chunk.finish_chunks(chunks).unionByName(decks)


def _tables_after(heads: DataFrame, numbers: DataFrame, tables: DataFrame) -> DataFrame:
    """Table texts of releases, numbered on from the number of text chunks."""
    counts = numbers.groupBy("document_id").agg(F.sum("n").alias("before"))
    first = heads.filter("branch = 'release'").select("document_id").join(counts, "document_id", "left")
    key = ["document_id", "table_id", "method", "page", "part", "mark"]
    part = F.col("part") if "part" in tables.columns else F.lit(0)
    kept = (
        tables.filter(~fx.is_blank(F.col("content")))
        .withColumns({"part": part, "mark": F.md5("content")})
        .groupBy(*key)
        .agg(F.min("content").alias("content"), F.count("*").alias("copies"))
        .withColumn("place", F.struct(*key))
    )
    # Numbers are worked out without the texts.
    order = Window.partitionBy("document_id").orderBy(*key[1:])
    light = kept.select(*key, "place", F.sum("copies").over(order).alias("upto"))
    rows = kept.join(light.select("place", "upto"), "place").withColumn(
        "row", F.explode(F.sequence(F.col("upto") - F.col("copies") + 1, F.col("upto")))
    )
    return rows.join(first, "document_id").select(
        "document_id",
        (F.coalesce("before", F.lit(0)) + F.col("row")).alias("sequence"),
        "content",
        chunk.string_map(
            content_type=F.lit("table"),
            table_id=F.col("table_id"),
            table_method=F.col("method"),
            page=F.col("page"),
            part=F.when(F.col("part") > 0, F.col("part")),
        ).alias("metadata"),
    )
