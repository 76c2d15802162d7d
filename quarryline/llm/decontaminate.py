"""Benchmark decontamination: CGK embeddings, position sampling, unedited runs and edit verification."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.words import Words, mixed

# A passage whose edit distance to an item is at most this share of the item's words is a leak.
DISTANCE = 0.2
# Items of fewer words say too little to tell a leak from ordinary prose.
MIN_WORDS = 5
REPEATS = 6
# Longest run of unedited words that is looked for.
LONGEST_RUN = 8
# Characters of items that are searched for in one pass over the documents.
ITEM_CHARS_AT_ONCE = 2 << 20
# Words of a document looked at in one go; longer ones in overlapping stretches.
STRETCH = 200_000
BATCH_WORDS = 400_000


@dataclass(frozen=True)
class Walk:
    """Windows of one size: `steps` of the random walk, of which `sampled` make a key."""

    least: int  # words of the shortest item
    steps: int
    sampled: int
    stride: int  # words between the starts of document windows


# A walk of s steps covers about s / 2 words, so every item holds a whole document window.
WALKS = (Walk(12, 16, 6, 4), Walk(MIN_WORDS, 7, 4, 1))


def _odd(repeat: int) -> np.uint64:
    return np.uint64((0x9E3779B97F4A7C15 * (2 * repeat + 1)) & (2**64 - 1) | 1)


def _positions(walk: Walk, repeat: int) -> set[int]:
    """The sampled outputs of a walk: its first and others drawn anew in each repeat."""
    drawn = np.random.default_rng([walk.steps, repeat]).permutation(np.arange(1, walk.steps))
    return {0, *drawn[: walk.sampled - 1].tolist()}


def window_keys(hashes: np.ndarray, starts: np.ndarray, walk: Walk, repeat: int) -> np.ndarray:
    """Key of the window at every start.

    The walk emits the word it stands on and moves on if a random bit of (step, word) says so.
    Walks over two texts at small edit distance fall into step again after each edit, so most
    outputs agree; the sampled outputs make the key. `hashes` goes on for `steps` words behind
    the last start.
    """
    symbols = mixed(hashes * _odd(repeat))
    sampled = _positions(walk, repeat)
    at = starts.copy()
    keys = np.zeros(len(starts), np.uint64)
    for step in range(max(sampled) + 1):
        here = symbols[at]
        if step in sampled:
            keys = (keys ^ here) * np.uint64(0x9FB21C651E98DF25)
            keys ^= keys >> np.uint64(28)
        at += ((here >> np.uint64(step)) & np.uint64(1)).astype(at.dtype)
    return keys


def unedited(count: int, distance: float) -> int:
    """Words of a run that every passage at that distance of an item of `count` words still holds.

    k edits part the others of its words into k + 1 runs at most.
    """
    edits = int(distance * count)
    return max(1, min(LONGEST_RUN, -(-(count - edits) // (edits + 1))))


def run_keys(hashes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Key of the `size` words from every start on."""
    keys = np.zeros(len(starts), np.uint64)
    for step in range(size):
        keys = (keys ^ hashes[starts + step]) * np.uint64(0x9FB21C651E98DF25)
        keys ^= keys >> np.uint64(28)
    return keys


def edit_distance_within(item: list[int], text: list[int]) -> int:
    """Least edit distance of `item` to any substring of `text` (bit-parallel, exact)."""
    size = len(item)
    masks: dict[int, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << size) - 1, 1 << (size - 1)
    plus, minus, score = full, 0, size
    best = size
    for c in text:
        eq = masks.get(c, 0)
        x = eq | minus
        d = (((x & plus) + plus) ^ plus) | x
        up, down = minus | (full & ~(d | plus)), plus & d
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(d | up)), up & d
        if score < best:
            best = score
    return best


@dataclass
class Item:
    item_id: int | None
    hashes: np.ndarray
    words: list[int]


@dataclass
class Index:
    """Items of one pass, the keys of all their windows by walk and repeat, those of their runs by size."""

    items: list[Item] = field(default_factory=list)
    tables: list[tuple[Walk | None, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    @staticmethod
    def build(rows: list[tuple[int | None, str | None]], repeats: int, distance: float = DISTANCE) -> Index:
        index = Index()
        for item_id, text in rows:
            words = Words(text or "")
            if len(words) >= MIN_WORDS:
                index.items.append(Item(item_id, words.hashes, words.hashes.tolist()))
        for walk in WALKS:
            index._add(walk, repeats)
        index._add_runs(distance)
        return index

    def _add(self, walk: Walk, repeats: int) -> None:
        longer = min((w.least for w in WALKS if w.least > walk.least), default=1 << 60)
        numbers = [n for n, i in enumerate(self.items) if walk.least <= len(i.hashes) < longer]
        if not numbers:
            return
        hashes, starts, owners, offsets, at = [], [], [], [], 0
        for n in numbers:
            own = self.items[n].hashes
            # A window that begins too near the end would run out of the item.
            count = max(1, len(own) - walk.steps // 2 + 1)
            hashes += [own, np.zeros(walk.steps + 1, np.uint64)]
            starts.append(np.arange(at, at + count))
            owners.append(np.full(count, n))
            offsets.append(np.arange(count))
            at += len(own) + walk.steps + 1
        hashes, starts = np.concatenate(hashes), np.concatenate(starts)
        owners, offsets = np.concatenate(owners), np.concatenate(offsets)
        for repeat in range(repeats):
            self._keep(walk, repeat, window_keys(hashes, starts, walk, repeat), owners, offsets)

    def _add_runs(self, distance: float) -> None:
        sizes: dict[int, list[int]] = {}
        for n, item in enumerate(self.items):
            sizes.setdefault(unedited(len(item.hashes), distance), []).append(n)
        for size, numbers in sorted(sizes.items()):
            counts = [len(self.items[n].hashes) - size + 1 for n in numbers]
            offsets = np.concatenate([np.arange(c) for c in counts])
            keys = np.concatenate([run_keys(self.items[n].hashes, np.arange(c), size) for n, c in zip(numbers, counts)])
            self._keep(None, size, keys, np.repeat(numbers, counts), offsets)

    def _keep(self, walk: Walk | None, which: int, keys: np.ndarray, owners: np.ndarray, offsets: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        present = np.zeros(1 << 20, bool)
        present[keys & np.uint64((1 << 20) - 1)] = True
        self.tables.append((walk, which, keys[order], owners[order], offsets[order], present))

    def candidates(self, hashes: np.ndarray, starts_of) -> np.ndarray:
        """(document word, item number, item word) where a window's key is an item's."""
        out = []
        for walk, which, keys, owners, offsets, present in self.tables:
            starts = starts_of(walk.stride if walk else 1)
            own = window_keys(hashes, starts, walk, which) if walk else run_keys(hashes, starts, which)
            maybe = np.flatnonzero(present[own & np.uint64((1 << 20) - 1)])
            low = np.searchsorted(keys, own[maybe])
            many = np.searchsorted(keys, own[maybe], side="right") - low
            rows = np.repeat(np.arange(len(maybe)), many)
            inner = np.arange(len(rows)) - np.repeat(np.cumsum(many) - many, many)
            place = low[rows] + inner
            out.append(np.stack([starts[maybe[rows]], owners[place], offsets[place]], axis=1))
        return np.concatenate(out) if out else np.empty((0, 3), np.int64)


def leaks_in(texts: list[str | None], index: Index, distance: float) -> list[tuple[int, int, int, int]]:
    """(text number, item number, edit distance, first word of the place) for every leak found."""
    best: dict[tuple[int, int], tuple[int, int]] = {}
    pending, size = [], 0
    for number, text in enumerate(texts):
        words = Words(text or "")
        for base in range(0, len(words), STRETCH):
            pending.append((number, base, words))
            size += min(STRETCH, len(words) - base)
            if size >= BATCH_WORDS:
                _search(pending, index, distance, best)
                pending, size = [], 0
    if pending:
        _search(pending, index, distance, best)
    return [(t, i, d, at) for (t, i), (d, at) in sorted(best.items())]


def _search(pending, index: Index, distance: float, best: dict) -> None:
    """Finds leaks in stretches of texts laid end to end, with gaps that walks end in."""
    if not index.tables:
        return
    gap = max(LONGEST_RUN, *(w.steps for w in WALKS)) + 1
    parts, bounds, at = [], [], 0
    for _, base, words in pending:
        # Windows of the next stretch begin where this one's starts end; the tail is shared.
        own = words.hashes[base : base + STRETCH + gap]
        parts += [own, np.zeros(gap, np.uint64)]
        bounds.append((at, min(STRETCH, len(words) - base)))
        at += len(own) + gap
    hashes = np.concatenate(parts)
    origins = np.array([b[0] for b in bounds])

    def starts_of(stride: int) -> np.ndarray:
        return np.concatenate([np.arange(a, a + n, stride) for a, n in bounds])

    found = index.candidates(hashes, starts_of)
    if not len(found):
        return
    stretch = np.searchsorted(origins, found[:, 0], side="right") - 1
    # Candidates of one item that begin near each other are one place; items count whole, however long.
    first = found[:, 0] - origins[stretch] - found[:, 2]
    quarters = np.unique(np.stack([stretch, found[:, 1], first // 4], axis=1), axis=0)
    counts = np.array([len(i.words) for i in index.items])
    slacks = 4 + (counts * distance).astype(np.int64)
    same = (np.diff(quarters[:, :2], axis=0) == 0).all(axis=1)
    near = same & (4 * np.diff(quarters[:, 2]) <= slacks[quarters[1:, 1]])
    heads = np.flatnonzero(np.append(True, ~near))
    tails = np.append(heads[1:], len(quarters)) - 1
    for (s, number, low), high in zip(quarters[heads].tolist(), quarters[tails, 2].tolist()):
        text, base, words = pending[s]
        item = index.items[number]
        count, slack, allowed = len(item.words), int(slacks[number]), int(distance * len(item.words))
        begin = max(0, base + low * 4 - slack)
        end = min(len(words), base + high * 4 + 4 + count + slack)
        if end - begin < count - allowed:
            continue
        passage = words.hashes[begin:end].tolist()
        # An edit breaks one word at most, so the others must be there.
        there = set(passage)
        if sum(w not in there for w in item.words) > allowed:
            continue
        known = best.get((text, number))
        if known and known[0] == 0:
            continue
        d = edit_distance_within(item.words, passage)
        if d <= allowed and (known is None or d < known[0]):
            best[text, number] = (d, begin)


def _blocks(items: DataFrame, id_column: str, text_column: str, at_once: int) -> list[DataFrame]:
    """The items in parts of about `at_once` characters, by hash."""
    rows = items.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    chars = rows.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    count = -(-chars // at_once) or 1
    part = F.pmod(F.xxhash64("id", "text"), F.lit(count))
    return [rows.where(part == n) for n in range(count)]


def leaks(
    docs: DataFrame,
    items: DataFrame,
    distance: float = DISTANCE,
    repeats: int = REPEATS,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    item_chars_at_once: int = ITEM_CHARS_AT_ONCE,
) -> DataFrame:
    """(id, item_id, distance, similarity): every item of which a document holds a passage.

    Words are runs of letters and digits, lower-cased; a passage counts if its edit distance
    in words to the whole item is at most `distance` of the item's words. Such a passage holds a
    run of unedited words whose length follows from the item's; all these runs are looked for, so
    every such passage is found.
    Each pass over the documents takes items of about `item_chars_at_once` characters with it,
    so what tasks hold is bounded; a larger benchmark takes more passes. Null texts are empty
    and match nothing, null ids are returned as null, repeated rows are searched each. Items
    under five words are not searched.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    out = None
    for block in _blocks(items, item_column, item_text_column, item_chars_at_once):
        shared = _shared(block, repeats, distance)

        def run(batches, shared=shared):
            index = shared.value
            for batch in batches:
                keys = batch.column(0).to_pylist()
                found = leaks_in(batch.column(1).to_pylist(), index, distance)
                least: dict[tuple, tuple] = {}
                for t, number, d, _ in found:
                    item = index.items[number]
                    value = (1 - d / len(item.words), -d)
                    if value > least.get((t, item.item_id), (-1, 0)):
                        least[t, item.item_id] = value
                yield pa.record_batch(
                    [
                        pa.array([keys[t] for t, _ in least], pa.int64()),
                        pa.array([i for _, i in least], pa.int64()),
                        pa.array([-v[1] for v in least.values()], pa.int64()),
                        pa.array([round(v[0], 6) for v in least.values()], pa.float64()),
                    ],
                    ["id", "item_id", "distance", "similarity"],
                )

        found = rows.mapInArrow(run, "id long, item_id long, distance long, similarity double")
        out = found if out is None else out.union(found)
    return out


def _shared(block: DataFrame, repeats: int, distance: float):
    held = sorted(((r.id, r.text) for r in block.collect()), key=repr)
    return block.sparkSession.sparkContext.broadcast(Index.build(held, repeats, distance))


def without_leaks(
    docs: DataFrame,
    items: DataFrame,
    distance: float = DISTANCE,
    repeats: int = REPEATS,
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    item_chars_at_once: int = ITEM_CHARS_AT_ONCE,
) -> DataFrame:
    """The rows of `docs`, all columns, that hold no passage of any item; nothing is shuffled."""
    for block in _blocks(items, item_column, item_text_column, item_chars_at_once):
        shared = _shared(block, repeats, distance)

        def run(batches, shared=shared):
            for batch in batches:
                texts = batch.column(batch.schema.names.index(text_column)).to_pylist()
                leaked = {t for t, *_ in leaks_in(texts, shared.value, distance)}
                yield batch.filter(pa.array([n not in leaked for n in range(len(texts))], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
