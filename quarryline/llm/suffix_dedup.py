"""Repeated byte strings by a radix sort of suffixes that stops at the threshold.

Suffixes are told apart most significant digit first and no further than the threshold length;
suffixes still equal then are exactly the repeated windows. Digits are hashed byte strings:

1. A gram of 64 bytes. Of the windows of 400 bytes that begin at neighbouring suffixes, all
   those whose least gram is the same one go as one row, keyed by that gram (their anchor). Equal
   windows have equal anchors at equal places, so a gram that occurs once ends its row here.
2. The hull of a row, all bytes its windows cover. Rows with equal hulls repeat each other whole,
   however many they are; one of each kind goes on against the other kinds.
3. A core of 232 bytes, the part that all windows of one half of a row share; then one of 337
   bytes, the part that 64 neighbouring windows share.
4. The whole window, for what is left: mostly the ends of copied passages.

Every pass is a sort in which a row only looks at its neighbours, so a string with a third of
all rows passes in constant memory.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import (
    arrow_map,
    byte_values,
    changes,
    repeated_rows,
    with_neighbours,
    written,
)
from quarryline.llm.words import mixed

LENGTH = 400
GRAM = 64
# Windows whose shared core is looked at before each of them is.
BLOCK = 64
# Bytes of a document hashed at a time; a worker holds four tables of as many powers.
SEGMENT = 1 << 18
BASES = (0x9E3779B97F4A7C15 | 5, 0xC2B2AE3D27D4EB4F & ~7 | 5)


@cache
def _tables(which: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for every byte, and powers and inverse powers of a base modulo 2^64."""
    letters = np.random.default_rng(which).integers(0, 1 << 64, 256, np.uint64)
    out = [letters]
    for base in (BASES[which], pow(BASES[which], -1, 1 << 64)):
        column = np.full(size + 1, np.uint64(base), np.uint64)
        column[0] = 1
        out.append(np.multiply.accumulate(column))
    return tuple(out)


class Hashes:
    """Hashes of any substrings of some bytes, from one running sum."""

    def __init__(self, data: np.ndarray, which: int, size: int):
        letters, powers, self.inverse = _tables(which, size)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(letters[data] * powers[: len(data)], out=self.sums[1:])

    def of(self, begin, end) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[begin]) * self.inverse[begin])

    def grams(self, size: int) -> np.ndarray:
        count = len(self.sums) - size
        return mixed((self.sums[size:] - self.sums[:count]) * self.inverse[:count])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every `width` values in a row, by doubling."""
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def anchors(data: np.ndarray, length: int, gram: int):
    """(anchor, first, last): windows first..last have their least gram at the anchor."""
    first = Hashes(data, 0, SEGMENT + length)
    grams = first.grams(gram)
    place = np.arange(len(grams), dtype=np.uint64)
    # Place in the low bits: the leftmost of equal grams wins, in every copy alike.
    ranked = (grams & ~np.uint64((1 << 24) - 1)) | place
    owner = (sliding_least(ranked, length - gram + 1) & np.uint64((1 << 24) - 1)).astype(np.int64)
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    ends = np.append(starts[1:], len(owner)) - 1
    return first, grams, owner[starts], starts, ends


COLUMNS = ["id", "mark", "key", "lo", "span", "hull1", "hull2", "left", "right"]
SCHEMA = ", ".join(f"{c} long" for c in COLUMNS)


def _suffix_rows(length: int, gram: int):
    half = (length - gram) // 2

    def run(batches):
        for batch in batches:
            held, size = [], 0
            ids, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, text in zip(range(batch.num_rows), batch.column(2)):
                data = np.frombuffer(text.as_py() or b"", np.uint8)
                for base in range(0, len(data) - length + 1, SEGMENT):
                    part = data[base : base + SEGMENT + length - 1]
                    if len(part) < length:
                        continue
                    one, grams, at, lo, hi = anchors(part, length, gram)
                    two = Hashes(part, 1, SEGMENT + length)
                    left = one.of(np.maximum(at - half, 0), at + gram)
                    right = one.of(at, np.minimum(at + gram + half, len(part)))
                    span = (at - lo) << 20 | (hi - lo)
                    rows = [
                        np.full(len(at), ids[i]), np.full(len(at), marks[i]), grams[at].view(np.int64),
                        base + lo, span, one.of(lo, hi + length).view(np.int64),
                        two.of(lo, hi + length).view(np.int64), left.view(np.int64), right.view(np.int64),
                    ]
                    held.append(rows)
                    size += len(at)
                    if size > 50_000:
                        yield _joined(held)
                        held, size = [], 0
            if held:
                yield _joined(held)

    return run


def _joined(held):
    return pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*held)], COLUMNS)


def _by_hull(batches):
    """Kind 1: rows whose hull another row has. Kind 0: one row of every hull whose gram recurs."""
    for rows, first, end in with_neighbours(batches):
        column = {c: rows[c].to_numpy() for c in COLUMNS}
        new_key = changes([column["key"]])
        new = changes([column[c] for c in ("key", "span", "hull1", "hull2")])
        # The row after the last belongs to another batch; its group counts as going on.
        alone_key = new_key & np.append(new_key[1:], True)
        alone = new & np.append(new[1:], True)
        own = np.zeros(len(new), bool)
        own[first:end] = True
        for kind, mask in ((1, own & ~alone), (0, own & new & ~alone_key)):
            if mask.any():
                values = [column[c][mask] for c in ("id", "mark", "lo", "span", "left", "right")]
                kinds = np.full(int(mask.sum()), kind, np.int64)
                yield pa.record_batch(
                    [pa.array(v) for v in (kinds, *values)],
                    ["kind", "id", "mark", "lo", "span", "left", "right"],
                )


def _blocks(length: int, block: int):
    """(core, id, mark, lo, piece): window ranges of a document cut at fixed places of an anchor.

    `core` is the hash of what all windows of an uncut block share, `piece` holds the bytes of
    the windows that the range has of it.
    """
    names = ["core", "id", "mark", "lo", "piece"]

    def run(batches):
        for batch in batches:
            ids, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, text, ranges in zip(range(batch.num_rows), batch.column(2), batch.column(3)):
                text = text.as_py() or b""
                data = np.frombuffer(text, np.uint8)
                at, lo, hi = (np.asarray(c) for c in ranges.values.flatten())
                first, last = (at - hi) // block, (at - lo) // block
                number = np.repeat(first, last - first + 1) + _within(last - first + 1)
                at, lo, hi = (np.repeat(c, last - first + 1) for c in (at, lo, hi))
                core = at - number * block
                lo, hi = np.maximum(lo, core - block + 1), np.minimum(hi, core)
                order = np.argsort(core)
                core, lo, hi = core[order], lo[order], hi[order]
                for base in range(int(core[0]), int(core[-1]) + 1, SEGMENT):
                    here = slice(*np.searchsorted(core, [base, base + SEGMENT]))
                    begin = core[here] - base
                    if not len(begin):
                        continue
                    size = length - block + 1
                    part = data[base : base + int(begin[-1]) + size]
                    found = Hashes(part, 0, SEGMENT + length).of(begin, begin + size)
                    pieces = [text[x : y + length] for x, y in zip(lo[here].tolist(), hi[here].tolist())]
                    fill = [np.full(len(begin), v[i]) for v in (ids, marks)]
                    columns = [pa.array(c) for c in (found.view(np.int64), *fill, lo[here])]
                    yield pa.record_batch([*columns, pa.array(pieces, pa.binary())], names)

    return run


def _by_piece(length: int):
    """Kind 1: blocks whose piece another block has. Kind 0: one of every piece, with its bytes,
    where blocks of the same core differ.

    Rows come sorted by core and piece, of which one of each is held at a time.
    """
    names = ["kind", "id", "mark", "lo", "hi", "piece"]

    def run(batches):
        core = first = None
        count, several, out = 0, False, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != core:
                    if several:
                        out.append((0, *first[1:4], None, first[4]))
                    core, first, count, several = row[0], row, 1, False
                elif row[4] == first[4]:
                    for repeated in (first, row) if count == 1 else (row,):
                        out.append((1, *repeated[1:4], repeated[3] + len(row[4]) - length, None))
                    count += 1
                else:
                    out.append((0, *first[1:4], None, first[4]))
                    first, count, several = row, 1, True
            yield block_batch(out)
            out = []
        if several:
            yield block_batch([(0, *first[1:4], None, first[4])])

    def block_batch(rows):
        kinds = [*[pa.int64()] * 5, pa.binary()]
        columns = zip(*rows) if rows else [[]] * 6
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return run


def _windows(length: int, block: int):
    """(one, two, id, mark, at): both hashes of every window in each piece."""
    names = ["one", "two", "id", "mark", "at"]

    def run(batches):
        for batch in batches:
            ids, marks, lo = (batch.column(c).to_numpy() for c in range(3))
            pieces = batch.column(3).to_pylist()
            for begin in range(0, len(pieces), 1000):
                part = pieces[begin : begin + 1000]
                sizes = np.array([len(p) - length + 1 for p in part])
                data = np.frombuffer(b"".join(part), np.uint8)
                ends = np.cumsum(sizes + length - 1)
                places = np.repeat(ends - sizes - length + 1, sizes) + _within(sizes)
                rows = np.repeat(np.arange(begin, begin + len(part)), sizes)
                found = [
                    Hashes(data, which, 1000 * (length + block)).of(places, places + length).view(np.int64)
                    for which in (0, 1)
                ]
                at = lo[rows] + _within(sizes)
                yield pa.record_batch([pa.array(c) for c in (*found, ids[rows], marks[rows], at)], names)

    return run


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... anew for each size."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _texts(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Rows by (id, mark): the mark takes in whether the id is null, and the text."""
    key = F.col(id_column).cast("long")
    return docs.select(
        F.coalesce(key, F.lit(0)).alias("id"),
        F.xxhash64(key, text_column).alias("mark"),
        F.encode(F.coalesce(F.col(text_column), F.lit("")), "utf-8").alias("text"),
        key.alias("doc_id"),
    )


def repeated_starts(
    docs: DataFrame,
    length: int = LENGTH,
    gram: int = GRAM,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """(id, mark, lo, hi): runs of starts of strings of `length` bytes that start elsewhere too."""
    half, block = (length - gram) // 2, max(1, min(BLOCK, (length - gram) // 4))
    texts = _texts(docs, id_column, text_column)
    suffixes = texts.select("id", "mark", "text").mapInArrow(_suffix_rows(length, gram), SCHEMA)
    order = ["key", "span", "hull1", "hull2"]
    sorted_rows = suffixes.repartition("key").sortWithinPartitions(*order)
    kinds = "kind long, id long, mark long, lo long, span long, left long, right long"
    judged = written(sorted_rows.mapInArrow(_by_hull, kinds), "suffixes")
    last = F.col("lo") + F.col("span").bitwiseAND((1 << 20) - 1)
    whole = judged.where("kind = 1").select("id", "mark", "lo", last.alias("hi"))
    at = F.col("lo") + F.shiftright("span", 20)
    open_rows = judged.where("kind = 0").withColumns({"at": at, "hi": last})
    sides = open_rows.select(
        "id",
        "mark",
        "at",
        F.explode(
            F.array(
                F.struct(
                    F.lit(0).alias("side"),
                    F.col("left").alias("core"),
                    F.col("lo").alias("lo"),
                    F.least(F.col("hi"), F.col("at") - half).alias("hi"),
                ),
                F.struct(
                    F.lit(1).alias("side"),
                    F.col("right").alias("core"),
                    F.greatest(F.col("lo"), F.col("at") - half + 1).alias("lo"),
                    F.col("hi").alias("hi"),
                ),
            )
        ).alias("s"),
    ).select("id", "mark", "at", "s.*").where("lo <= hi")
    close = repeated_rows(sides, ["core", "side"], ["id", "mark", "at", "lo", "hi"])
    ranges = close.groupBy("id", "mark").agg(F.collect_list(F.struct("at", "lo", "hi")).alias("ranges"))
    one_text = texts.select("id", "mark", "text").join(ranges, ["id", "mark"]).select(
        "id", "mark", "text", "ranges"
    )
    blocks = one_text.mapInArrow(_blocks(length, block), "core long, id long, mark long, lo long, piece binary")
    near = repeated_rows(blocks, ["core", "piece"], ["core", "id", "mark", "lo", "piece"], group=["core"])
    pieces = written(
        near.mapInArrow(_by_piece(length), "kind long, id long, mark long, lo long, hi long, piece binary"), "pieces"
    )
    whole = whole.union(pieces.where("kind = 1").select("id", "mark", "lo", "hi"))
    near = pieces.where("kind = 0").select("id", "mark", "lo", "piece")
    windows = near.mapInArrow(_windows(length, block), "one long, two long, id long, mark long, at long")
    single = repeated_rows(windows, ["one", "two"], ["id", "mark", "at"])
    return whole.union(single.select("id", "mark", F.col("at").alias("lo"), F.col("at").alias("hi")))


def without_repeats(
    docs: DataFrame,
    length: int = LENGTH,
    gram: int = GRAM,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept): every text without its repeated bytes.

    A byte goes if a string of `length` bytes that covers it starts anywhere else too, in the
    same text or another; strings are judged on the input and may overlap. `kept` is what
    remains, in UTF-8 bytes. Null texts are empty, texts shorter than `length` stay whole,
    repeated rows repeat each other, and a null id is returned as null.
    """
    starts = repeated_starts(docs, length, gram, id_column, text_column)
    # A run of starts in one number: the first above, how many follow below.
    run_of_starts = F.shiftleft("lo", 20).bitwiseOR(F.col("hi") - F.col("lo"))
    spans = starts.groupBy("id", "mark").agg(F.collect_list(run_of_starts).alias("spans"))
    rows = (
        _texts(docs, id_column, text_column)
        .join(spans, ["id", "mark"], "left")
        .select("doc_id", "text", "spans")
    )

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [cut(t, s, length) for t, s in zip(byte_values(batch.column(1)), batch.column(2))]
        sizes, removed, counts, kept = zip(*out)
        return pa.record_batch(
            [batch.column(0), *(pa.array(c, pa.int64()) for c in (sizes, removed, counts)), pa.array(kept, pa.binary())],
            ["id", "n_bytes", "n_removed", "n_spans", "kept"],
        )

    return arrow_map(rows, run, "id long, n_bytes long, n_removed long, n_spans long, kept binary")


def cut(text: bytes, spans: pa.ListScalar, length: int) -> tuple[int, int, int, bytes]:
    """Sizes of a text and of what goes, the number of runs that go, and the rest."""
    if not spans.is_valid:
        return len(text), 0, 0, text
    runs = np.asarray(spans.values)
    lo = runs >> 20
    hi = lo + (runs & ((1 << 20) - 1))
    edges = np.zeros(len(text) + 1, np.int64)
    np.add.at(edges, lo, 1)
    np.add.at(edges, np.minimum(hi + length, len(text)), -1)
    gone = np.cumsum(edges[:-1]) > 0
    count = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
    return len(text), int(gone.sum()), count, kept

