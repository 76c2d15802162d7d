"""Stretches of words that repeat with a period, and texts without the repetitions.

A run is a stretch of words with smallest period q (words q apart are the same), of at least
`least` words and `copies` periods, that no neighbouring word extends. Every word of a run occurs
`copies` times in it, so:

1. Recursive frequency splitting: a word that occurs fewer than `copies` times within its segment
   is in no run and splits the segment; pieces under `least` words go. A cut only concerns words
   with an occurrence on its other side: these alone are looked at again, until nothing splits.
   The largest piece keeps the number of its segment, so a text of n words costs n log n looks.
2. Lag scan of what is left, by lags from w to 2 w - 1 for every power of two w. A run with such
   a period holds a whole block of w words, aligned in its segment, and the block's next copy; so
   every place is compared with one block only. Matches grow to both sides by halving steps
   over hashes; what is found is compared word for word.

Texts are read whole. Many short texts are worked on together, long ones alone.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import byte_values

LEAST = 24
COPIES = 3
# Bytes of short texts that are worked on together.
TOGETHER = 4 << 20
BASE = 0x9E3779B97F4A7C15

RUN = "struct<start:long,length:long,period:long>"


@cache
def _space() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers (equal for equal words), words before each text, and the words' bytes.

    The last two are the bytes of all words, each followed by one space, and where each begins.
    """
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = _space()[data]
    first = ~space & np.append(True, space[:-1])
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(space & np.append(False, ~space[:-1]))
    lengths = ends - starts
    places = np.append(0, np.cumsum(lengths))
    letters = data[~space]
    column = pa.Array.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(letters)]
    )
    words = column.dictionary_encode().indices.to_numpy().astype(np.int64)
    begins = np.append(0, np.cumsum([len(t) + 1 for t in texts]))
    before = np.searchsorted(starts, begins)
    spaced = np.full(len(letters) + len(starts), 0x20, np.uint8)
    spaced[np.arange(len(letters)) + np.repeat(np.arange(len(starts)), lengths)] = letters
    return words, before, spaced, places + np.arange(len(places))


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    sizes = ends - starts
    out = np.repeat(starts - np.append(0, np.cumsum(sizes)[:-1]), sizes)
    return out + np.arange(len(out))


class Occurrences:
    """For every place of a word the neighbouring places of the same word."""

    def __init__(self, words: np.ndarray):
        self.order = np.argsort(words, kind="stable")
        self.rank = np.empty(len(words), np.int64)
        self.rank[self.order] = np.arange(len(words))
        self.words = words

    def at(self, places: np.ndarray, steps: int) -> np.ndarray:
        """Place of the occurrence `steps` further on; -1 where there is none."""
        rank = self.rank[places] + steps
        inside = (rank >= 0) & (rank < len(self.order))
        found = self.order[np.where(inside, rank, 0)]
        return np.where(inside & (self.words[found] == self.words[places]), found, -1)

    def enough(self, places: np.ndarray, low: np.ndarray, high: np.ndarray, copies: int) -> np.ndarray:
        """Whether the word at each place occurs `copies` times from `low` to before `high`."""
        out = np.zeros(len(places), bool)
        for back in range(copies):
            first, last = self.at(places, -back), self.at(places, copies - 1 - back)
            out |= (first >= low) & (last >= 0) & (last < high)
        return out


def frequent_segments(
    words: np.ndarray, before: np.ndarray, least: int = LEAST, copies: int = COPIES
) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the segments in which every word occurs `copies` times."""
    low, high = before[:-1].astype(np.int64), before[1:].astype(np.int64)
    live = high - low >= least
    segment = np.repeat(np.where(live, np.arange(len(low)), -1), high - low)
    occurrences = Occurrences(words)
    look = np.flatnonzero(segment >= 0)
    while len(look):
        own = segment[look]
        cuts = look[~occurrences.enough(look, low[own], high[own], copies)]
        if not len(cuts):
            break
        own = segment[cuts]
        # Pieces before each cut, and the one behind the last cut of every segment.
        last = np.append(own[1:] != own[:-1], True)
        opened = np.append(True, last[:-1])
        starts = np.where(opened, low[own], np.append(0, cuts[:-1] + 1))
        starts = np.concatenate([starts, cuts[last] + 1])
        ends = np.concatenate([cuts, high[own[last]]])
        owner = np.concatenate([own, own[last]])
        sizes = ends - starts
        order = np.lexsort((sizes, owner))
        largest = np.zeros(len(owner), bool)
        largest[order[np.append(owner[order][1:] != owner[order][:-1], True)]] = True
        keeps = sizes >= least
        segment[cuts] = -1
        stays = largest & keeps
        low[owner[stays]], high[owner[stays]] = starts[stays], ends[stays]
        dead = owner[largest & ~keeps]
        live[dead] = False
        moved = ~stays
        fresh = moved & keeps
        numbers = np.where(fresh, len(low) + np.cumsum(fresh) - 1, -1)
        inside = _ranges(starts[moved], ends[moved])
        segment[inside] = np.repeat(numbers[moved], sizes[moved])
        low, high = np.append(low, starts[fresh]), np.append(high, ends[fresh])
        live = np.append(live, np.ones(fresh.sum(), bool))
        # Words of the pieces that moved, and those elsewhere that lost an occurrence to them.
        gone = np.concatenate([inside, cuts])
        linked = [occurrences.at(gone, s) for s in range(1 - copies, copies) if s]
        look = np.unique(np.concatenate([inside, *linked]))
        look = look[look >= 0]
        look = look[segment[look] >= 0]
    return low[live], high[live]


class _Blocks:
    """Names of all stretches of 1, 2, 4, ... words: a 64-bit mix of the names of both halves."""

    def __init__(self, words: np.ndarray):
        self.names = [_mixed(words.astype(np.uint64))]

    def double(self, until: int) -> None:
        """Adds the names of twice the width, for the words up to `until`."""
        half, width = self.names[-1], 1 << (len(self.names) - 1)
        count = max(0, min(until - 2 * width + 1, len(half) - width))
        self.names.append(_mixed(half[:count] * np.uint64(0xC2B2AE3D27D4EB4F) + half[width : width + count]))

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, way: int) -> np.ndarray:
        """Words that are the same from a and b on (way 1), or before them (way -1); a < b."""
        out = np.zeros(len(a), np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            names, step = self.names[level], 1 << level
            fits = np.arange(len(a))
            while len(fits):
                fits = fits[out[fits] + step <= most[fits]]
                shift = out[fits] if way > 0 else -out[fits] - step
                one, two = a[fits] + shift, b[fits] + shift
                known = two < len(names)
                fits = fits[known][names[one[known]] == names[two[known]]]
                out[fits] += step
        return out


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values + np.uint64(BASE)) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(32))


def scan(
    words: np.ndarray, low: np.ndarray, high: np.ndarray, least: int = LEAST, copies: int = COPIES
) -> np.ndarray:
    """Rows (start, length, period) of the runs inside the segments, by start and period."""
    order = np.argsort(low - high, kind="stable")
    low, high = low[order], high[order]
    sizes = high - low
    ends = np.cumsum(sizes)
    starts = ends - sizes
    picked = words[_ranges(low, high)]
    blocks, width = _Blocks(picked), 1
    # The longest segments come first: those that can hold a run with this period are a prefix.
    untils = []
    while many := int(np.searchsorted(-sizes, -copies * width, side="right")):
        untils.append(int(ends[many - 1]))
        if width > 1:
            blocks.double(untils[-1])
        width *= 2
    base, limit = np.repeat(starts, sizes), np.repeat(ends, sizes)
    found = []
    # Furthest end of the runs, of any length, that start at or before each place.
    reach = np.zeros(len(picked) + 1, np.int64)
    for level, until in enumerate(untils):
        width, names = 1 << level, blocks.names[level]
        place = np.arange(min(until, len(names)))
        inside = place - base[: len(place)]
        block = base[: len(place)] + (inside // width - 1) * width
        fits = (inside >= width) & (place + width <= limit[: len(place)])
        place, block = place[fits], block[fits]
        hit = names[place] == names[block]
        block, period = block[hit], (place - block)[hit]
        # What a run with a shorter period covers has no smallest period as long as this.
        fresh = np.maximum.accumulate(reach)[block] < block + period + width
        block, period = block[fresh], period[fresh]
        order = np.lexsort((block, period))
        block, period = block[order], period[order]
        # Of neighbouring blocks with one lag the first is enough.
        first = np.ones(len(block), bool)
        first[1:] = (period[1:] != period[:-1]) | (block[1:] != block[:-1] + width)
        block, period = block[first], period[first]
        if len(block):
            back = blocks.common(block, block + period, block - base[block], -1)
            on = blocks.common(block, block + period, limit[block] - block - period, 1)
            rows = np.stack([block - back, back + on + period, period], axis=1)
            rows = rows[rows[:, 1] >= copies * rows[:, 2]]
            rows = _exact(picked, np.unique(rows, axis=0), base, limit, copies)
            np.maximum.at(reach, rows[:, 0], rows[:, 0] + rows[:, 1])
            found.append(rows)
    if not found:
        return np.zeros((0, 3), np.int64)
    rows = np.concatenate(found)
    rows = rows[rows[:, 1] >= least]
    # A stretch that has a period also has its multiples: the least is the run's.
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[fresh]
    segment = np.searchsorted(ends, rows[:, 0], side="right")
    rows[:, 0] += (low - starts)[segment] if len(segment) else 0
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _exact(words, rows, base, limit, copies):
    """The rows, compared word for word; where a hash was wrong, what the words say."""
    out = []
    for start, length, period in rows.tolist():
        end = start + length
        if np.array_equal(words[start : end - period], words[start + period : end]):
            out.append((start, length, period))
            continue
        low, high = int(base[start]), int(limit[start])
        odd = words[low : high - period] != words[low + period : high]
        edges = np.concatenate([[-1], np.flatnonzero(odd), [len(odd)]])
        for a, b in zip(edges[:-1] + 1, edges[1:]):
            if b - a + period >= copies * period and a < end - low and b + period > start - low:
                out.append((low + int(a), int(b - a) + period, period))
    return np.array(sorted(set(out)), np.int64).reshape(-1, 3)


def runs_of(texts: list[bytes], least: int = LEAST, copies: int = COPIES):
    """(words of each text, runs of each text, each text without the repetitions)."""
    words, before, spaced, places = words_of(texts)
    low, high = frequent_segments(words, before, least, copies)
    rows = scan(words, low, high, least, copies)
    owner = np.searchsorted(before, rows[:, 0], side="right") - 1
    kept = np.zeros(len(words) + 1, np.int64)
    np.add.at(kept, rows[:, 0] + rows[:, 2], 1)
    np.add.at(kept, rows[:, 0] + rows[:, 1], -1)
    stays = np.cumsum(kept)[:-1] == 0
    cut = np.append(0, np.cumsum(np.bincount(owner, minlength=len(texts))))
    rows[:, 0] -= before[owner]
    found = [rows[a:b] for a, b in zip(cut[:-1], cut[1:])]
    left = []
    for i, (a, b) in enumerate(zip(before[:-1], before[1:])):
        body = spaced[places[a] : places[b]]
        if len(found[i]):
            body = body[np.repeat(stays[a:b], np.diff(places[a : b + 1]))]
        left.append(body[:-1].tobytes())
    return np.diff(before), found, left


def periodic_runs(
    docs: DataFrame,
    least: int = LEAST,
    copies: int = COPIES,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per row of `docs`: (id, n_words, runs, collapsed).

    Words are what lies between ASCII white space, numbered from 0. `runs` has (start, length,
    period) of every run of at least `least` words and `copies` periods, by start and period.
    `collapsed` is the text's words joined by one space, without those that some run holds after
    its first period. A null or empty text has no words, no runs and an empty `collapsed`; a null
    id stays null; repeated rows are each judged; other columns of `docs` are not read; an empty
    table gives an empty one. Texts of any length are read whole. `copies` must be 3 or more: two
    periods need not hold a whole aligned block and its copy.
    """
    if copies < 3:
        raise ValueError("a run needs at least three periods")
    picked = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            texts = byte_values(batch.column(1))
            at = 0
            while at < len(texts):
                end, size = at + 1, len(texts[at])
                while end < len(texts) and size + len(texts[end]) <= TOGETHER:
                    size += len(texts[end])
                    end += 1
                yield _record(batch.column(0).slice(at, end - at), *runs_of(texts[at:end], least, copies))
                at = end

    return picked.mapInArrow(run, f"id long, n_words long, runs array<{RUN}>, collapsed string")


def _record(ids, counts, found, left):
    rows = np.concatenate(found)
    fields = [pa.array(np.ascontiguousarray(rows[:, i])) for i in range(3)]
    offsets = np.append(0, np.cumsum([len(f) for f in found])).astype(np.int32)
    runs = pa.ListArray.from_arrays(
        pa.array(offsets), pa.StructArray.from_arrays(fields, ["start", "length", "period"])
    )
    columns = [ids, pa.array(counts), runs, pa.array(left, pa.binary()).cast(pa.string())]
    return pa.record_batch(columns, ["id", "n_words", "runs", "collapsed"])


def strongest(runs: Column) -> Column:
    """The run with the greatest length in periods; of equal ones the first."""

    def better(best: Column, run: Column) -> Column:
        more = run["length"] * best["period"] > best["length"] * run["period"]
        return F.when(best.isNull() | more, run).otherwise(best)

    return F.aggregate(runs, F.lit(None).cast(RUN), better)


def runs_digest(runs: Column) -> Column:
    """SHA-256 of the lines `start,length,period` of all runs, each ended by a line feed."""
    line = F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return F.sha2(F.concat(F.array_join(line, "\n"), F.when(F.size(runs) > 0, "\n").otherwise("")), 256)


def with_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """`docs` as (id, text), where every tenth text by CRC-32 of its id ends in repetitions.

    Of such a text with n words, those from the place a on repeat the first p words from a on;
    a and p come from the rest of the hash. This gives the search runs of known form to find.
    """
    picked = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    hashed = picked.withColumn("hash", F.crc32(F.col("id").cast("string")))

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i, code in enumerate(batch.column(2).to_pylist()):
                words = texts[i].encode().split() if code is not None and code % 10 == 0 and texts[i] else []
                if words:
                    rest, n = code // 10, len(words)
                    a = rest % n
                    p = 1 + (n - a) // (3 + rest % 8)
                    part = words[a : a + p]
                    words[a:] = (part * -(-(n - a) // p))[: n - a]
                    texts[i] = b" ".join(words).decode()
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return hashed.mapInArrow(run, "id long, text string")

