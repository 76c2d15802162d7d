"""SimHash near-duplicates through Golay-code fuzzy keys."""

from __future__ import annotations

import itertools
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import arrow_map, byte_values, keep_rows, longs, text_mark, unsigned, written
from quarryline.llm.components import components

SHINGLE_WORDS = 4
SEED = 42
DISTANCE = 4
# Bit offset and width of the fingerprint segments; each fits a 23-bit Golay word.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
# Shingles hashed at a time: bounds memory for documents of any length.
SHINGLES_AT_ONCE = 100_000
# Keys of at most this many rows are searched in one go; larger ones in blocks of this size.
BLOCK = 4096
# Keys with more stored rows than this are searched by walking links instead of pairwise.
PAIRWISE = 8


def simhash(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of the shingles of `text` (A-Z lower-cased, ASCII white space)."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    span = min(words, len(tokens))
    starts, ends = starts[: len(tokens) - span + 1], ends[span - 1 :]
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), SHINGLES_AT_ONCE):
        stop = at + SHINGLES_AT_ONCE
        pairs = zip(starts[at:stop].tolist(), ends[at:stop].tolist())
        hashes = np.array([digest(joined[s:e], SEED) for s, e in pairs], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fingerprint bigint, mark) of every row; a text without words has fingerprint zero."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = np.array([simhash(t) for t in byte_values(batch.column(1))], np.uint64)
        return pa.record_batch(
            [batch.column(0), longs(values), batch.column(2)], ["id", "fingerprint", "mark"]
        )

    rows = docs.select(
        F.col(id_column).cast("long").alias("id"),
        F.col(text_column).alias("text"),
        text_mark(text_column).alias("mark"),
    )
    return arrow_map(rows, run, "id long, fingerprint long, mark long")


# --- Golay code ---------------------------------------------------------------------------

GENERATOR = 0xAE3  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def _syndromes(words: np.ndarray) -> np.ndarray:
    rest = words.copy()
    for bit in range(22, 10, -1):
        rest ^= ((rest >> bit) & 1) * (GENERATOR << (bit - 11))
    return rest


@cache
def _corrections() -> np.ndarray:
    """Error pattern of up to three bits for each of the 2,048 syndromes."""
    patterns = [0]
    for weight in (1, 2, 3):
        patterns += [sum(1 << b for b in c) for c in itertools.combinations(range(23), weight)]
    table = np.zeros(2048, np.int64)
    values = np.array(patterns, np.int64)
    table[_syndromes(values)] = values
    return table


def decode(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword within three bits of each 23-bit word."""
    return (words ^ _corrections()[_syndromes(words)]) >> 11


def nearby(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Codeword indices of a word and of all words one bit away, as (row, index) pairs.

    Words up to two bits apart share an index: both are one bit from a common word. A word
    one bit away has its own index among them. There are one to six indices per word.
    """
    flips = np.concatenate([[0], 1 << np.arange(width)])
    found = np.sort(decode((words[:, None] ^ flips[None, :]).ravel()).reshape(len(words), -1), axis=1)
    new = np.ones(found.shape, bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    rows, columns = np.nonzero(new)
    return rows, found[rows, columns]


def fuzzy_keys(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) pairs under which fingerprints at most four bits apart meet.

    Four errors leave two of the three segments with two errors in sum: one and one at most,
    or none and two. In the first case one side stores the pair of its own indices and the
    other asks for all nearby pairs; in the second both use the exact segment with the nearby
    indices of the other one. The lowest bit of a key is 1 for a row that only asks.
    """
    parts = [((values >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    own = [decode(p) for p in parts]
    near = [nearby(p, n) for p, (_, n) in zip(parts, SEGMENTS)]
    everyone = np.arange(len(values))
    rows, keys = [], []

    def add(kind, row, high, low, asks):
        rows.append(row)
        keys.append((((kind << 36) | (high << 12) | low) << 1) | asks)

    for kind, (i, j) in enumerate(itertools.combinations(range(3), 2)):
        add(kind, everyone, own[i], own[j], 0)
        row_i, index_i = near[i]
        row_j, index_j = near[j]
        first = np.searchsorted(row_j, row_i)
        many = np.searchsorted(row_j, row_i, side="right") - first
        left = np.repeat(np.arange(len(row_i)), many)
        inner = np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many)
        add(kind, row_i[left], index_i[left], index_j[first[left] + inner], 1)
    for kind, (i, j) in enumerate(itertools.permutations(range(3), 2), start=3):
        row_j, index_j = near[j]
        add(kind, row_j, parts[i][row_j], index_j, 0)
    return np.concatenate(rows), np.concatenate(keys)


# --- Links --------------------------------------------------------------------------------


def spanning_links(values: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all of `values` which chains of near pairs connect, one per value at most."""
    rest = np.unique(values)
    left, right, frontier = [], [], []
    while len(rest):
        if not frontier:
            frontier.append(rest[0])
            rest = rest[1:]
        node = frontier.pop()
        near = np.bitwise_count(rest ^ node) <= distance
        if near.any():
            found = rest[near]
            left.append(np.full(len(found), node))
            right.append(found)
            frontier.extend(found)
            rest = rest[~near]
    if not left:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate(left), np.concatenate(right)


def _links_of(keys: np.ndarray, values: np.ndarray, distance: int):
    """Links among complete, sorted groups of rows with the same key."""
    group = keys >> 1
    new = np.ones(len(keys), bool)
    new[1:] = group[1:] != group[:-1]
    starts = np.flatnonzero(new)
    number = np.cumsum(new) - 1
    stored = np.add.reduceat((keys & 1) == 0, starts)
    sizes = np.diff(np.append(starts, len(keys)))
    left, right = [], []
    small = (stored <= PAIRWISE) & (sizes > 1)
    for turn in range(PAIRWISE):
        rows = np.flatnonzero((small & (stored > turn))[number])
        target = starts[number[rows]] + turn
        rows, target = rows[rows > target], target[rows > target]
        apart = np.bitwise_count(values[rows] ^ values[target])
        near = (apart <= distance) & (apart > 0)
        left.append(values[target[near]])
        right.append(values[rows[near]])
    for g in np.flatnonzero(stored > PAIRWISE):
        a, b = spanning_links(values[starts[g] : starts[g] + sizes[g]], distance)
        left.append(a)
        right.append(b)
    return np.concatenate(left), np.concatenate(right)


def _link_batch(a, b, key=None):
    """A row is a link (a, b), or with a key a value of a group too large to hold."""
    unique = np.unique(np.stack([a, b], axis=1), axis=0) if key is None and len(a) else None
    if unique is not None:
        a, b = unique[:, 0], unique[:, 1]
    keys = pa.nulls(len(a), pa.int64()) if key is None else longs(key)
    return pa.record_batch([longs(a), longs(b), keys], ["a", "b", "key"])


def _search(distance: int, block: int):
    def run(batches):
        keys, values = np.empty(0, np.int64), np.empty(0, np.uint64)
        large = None
        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            values = np.concatenate([values, unsigned(batch.column(1))])
            if not len(keys):
                continue
            if large is not None:
                end = np.searchsorted(keys >> 1, large, side="right")
                yield _link_batch(values[:end], values[:end], keys[:end])
                keys, values = keys[end:], values[end:]
                if not len(keys):
                    continue
                large = None
            last = keys[-1] >> 1
            end = np.searchsorted(keys >> 1, last)
            if end:
                yield _link_batch(*_links_of(keys[:end], values[:end], distance))
                keys, values = keys[end:], values[end:]
            if len(keys) > block:
                large = last
                yield _link_batch(values, values, keys)
                keys, values = keys[:0], values[:0]
        if len(keys):
            yield _link_batch(*_links_of(keys, values, distance))

    return run


def links(values: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints in column `fingerprint`.

    Chains of links join exactly the fingerprints that chains of pairs at most `distance`
    (four at most) bits apart join. Rows meet by fuzzy key, sorted, in a stream; a key with
    more than `block` rows is cut into blocks, each pair of blocks being searched on its own,
    so no task holds more than two blocks.
    """
    if distance > DISTANCE:
        raise ValueError(f"the fuzzy keys bear {DISTANCE} differing bits, not {distance}")

    def emit(batches):
        for batch in batches:
            column = unsigned(batch.column(0))
            for at in range(0, len(column), 1000):
                part = column[at : at + 1000]
                rows, keys = fuzzy_keys(part)
                yield pa.record_batch([pa.array(keys), longs(part[rows])], ["key", "value"])

    # A fingerprint has over a hundred keys: its partitions are not to be merged for being small.
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = values.select("fingerprint").repartition(parts, "fingerprint")
    keyed = dealt.mapInArrow(emit, "key long, value long")
    grouped = keyed.repartition(F.shiftright("key", 1)).sortWithinPartitions("key")
    found = written(grouped.mapInArrow(_search(distance, block), "a long, b long, key long"), "near")
    small = found.where("key is null").select("a", "b")
    rest = found.where("key is not null").select(F.shiftright("key", 1).alias("key"), "a")
    blocks = rest.groupBy("key").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int")
    paired = (
        rest.join(blocks, "key")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "a")
        .repartition("key", "x", "y")
        .sortWithinPartitions("key", "x", "y")
    )
    large = paired.mapInArrow(_walk(distance), "a long, b long")
    return small.union(large).distinct()


def _walk(distance: int):
    def run(batches):
        held, name = [], None
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns[:3]]
            values = unsigned(batch.column(3))
            new = np.ones(len(values), bool)
            new[1:] = False
            for c in columns:
                new[1:] |= c[1:] != c[:-1]
            starts = [*np.flatnonzero(new).tolist(), len(values)]
            for s, e in zip(starts, starts[1:]):
                here = tuple(int(c[s]) for c in columns)
                if here != name and held:
                    a, b = spanning_links(np.concatenate(held), distance)
                    yield pa.record_batch([longs(a), longs(b)], ["a", "b"])
                    held = []
                name = here
                held.append(values[s:e])
        if held:
            a, b = spanning_links(np.concatenate(held), distance)
            yield pa.record_batch([longs(a), longs(b)], ["a", "b"])

    return run


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    distance: int = DISTANCE,
) -> DataFrame:
    """(id, fingerprint bigint, mark, component): one row per row of `docs`.

    The component is the smallest id that chains of fingerprints at most `distance` bits apart
    reach. Equal fingerprints are one node, so thousands of copies cost one. A null text counts
    as empty and has fingerprint zero; a null id gets a component like any other row but never
    names one (a component of null ids only is null); repeated rows are kept.
    """
    rows = written(fingerprints(docs, id_column, text_column), "fingerprints")
    nodes = rows.groupBy("fingerprint").agg(F.min("id").alias("least"))
    labels = components(links(nodes))
    named = nodes.join(labels, nodes.fingerprint == labels.node, "left").select(
        "fingerprint", "least", F.coalesce("component", "fingerprint").alias("class")
    )
    named = written(named, "classes")
    least = named.groupBy("class").agg(F.min("least").alias("component"))
    classes = named.join(least, "class").select("fingerprint", "component")
    return rows.join(classes, "fingerprint").select("id", "fingerprint", "mark", "component")


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, that stay: of each component the row with the least id."""
    found = near_duplicates(docs, id_column, text_column)
    first = found.where(F.col("id").eqNullSafe(F.col("component")))
    stay = first.groupBy(F.col("component").alias("id")).agg(F.min("mark").alias("mark"))
    return keep_rows(docs, stay, id_column, text_column)
