"""Exact top-k inner products from an impact-ordered index, score at a time.

The index is a table of blocks. A block holds some thousand vectors and, for every dimension,
posting segments: the members whose component has the same quantised impact, from the greatest
component down. A dimension is read from its front for a positive query component and from its
back for a negative one, so what a segment adds to a score never grows along the way.

A query adds up segments by descending quantised contribution, over all dimensions. After each
level, what an unread segment may add is bounded, and with it every vector's best possible score.
Reading stops when that proves that all but a few vectors stay below the k-th best score known;
those few are scored exactly. A first look at the highest levels of every block gives each
query its k-th best score so far, from which the second look starts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.functions.ranking import top_per_group
from quarryline.llm.common import written
from quarryline.llm.whole_vectors import SCALE, as_matrix, whole_vectors
from quarryline.operators.vector_search import in_batches

# Components and vectors of a block at most, and quantised impacts of a dimension.
BLOCK_COMPONENTS = 1 << 19
BLOCK_ROWS = 1 << 13
IMPACTS = 64
# Quantised contributions of a query; of these the first look reads the upper ones only.
LEVELS = 24
FIRST_LOOK = 12
# So few vectors that may still be members, or this share of a block, are scored exactly instead
# of reading on.
FEW = 64
FEW_SHARE = 8
# Queries that travel to the tasks at a time.
QUERIES_AT_A_TIME = 2048

BLOCK = "ids binary, vectors binary, members binary, starts binary, high binary, low binary, firsts binary"
NOTHING = np.iinfo(np.int64).min


def _block(ids: np.ndarray, vectors: np.ndarray) -> dict[str, bytes]:
    """One index block: the vectors and their posting segments."""
    if not vectors.shape[1]:
        vectors = np.zeros((len(vectors), 1), np.int64)
    order = np.argsort(-vectors, axis=0, kind="stable").T
    down = np.take_along_axis(vectors.T, order, axis=1)
    widths = np.maximum(1, -(-(down[:, :1] - down[:, -1:] + 1) // IMPACTS))
    impacts = (down - down[:, -1:]) // widths
    opens = np.ones(down.shape, bool)
    opens[:, 1:] = impacts[:, 1:] != impacts[:, :-1]
    closes = np.ones(down.shape, bool)
    closes[:, :-1] = opens[:, 1:]
    parts = {
        "ids": ids,
        "vectors": vectors.astype(np.int32),
        "members": order.astype(np.int16),
        "starts": np.append(np.flatnonzero(opens.ravel()), down.size).astype(np.int32),
        "high": down[opens].astype(np.int32),
        "low": down[closes].astype(np.int32),
        "firsts": np.append(0, np.cumsum(opens.sum(axis=1))).astype(np.int32),
    }
    return {name: np.ascontiguousarray(value).tobytes() for name, value in parts.items()}


def build(vectors: DataFrame) -> DataFrame:
    """Index blocks of the (id, vector) rows of every partition; ids are unique."""

    def run(batches):
        ids, held, width = [], [], 1
        for batch in batches:
            matrix = as_matrix(batch.column(1))
            numbers = batch.column(0).to_numpy()
            at = 0
            while at < len(numbers):
                width = max(width, matrix.shape[1])
                room = min(BLOCK_ROWS, max(1, BLOCK_COMPONENTS // width)) - sum(map(len, ids))
                if room <= 0:
                    yield _emit(ids, held)
                    ids, held, width = [], [], 1
                    continue
                ids.append(numbers[at : at + room])
                held.append(matrix[at : at + room])
                at += room
        if ids:
            yield _emit(ids, held)

    return vectors.select("id", "vector").mapInArrow(run, BLOCK)


def _emit(ids: list[np.ndarray], held: list[np.ndarray]) -> pa.RecordBatch:
    width = max(m.shape[1] for m in held)
    whole = np.concatenate([np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in held])
    block = _block(np.concatenate(ids), whole)
    return pa.record_batch([pa.array([b], pa.binary()) for b in block.values()], list(block))


@dataclass
class Block:
    ids: np.ndarray
    vectors: np.ndarray
    members: np.ndarray
    starts: np.ndarray
    high: np.ndarray
    low: np.ndarray
    firsts: np.ndarray
    lengths: np.ndarray
    dims: np.ndarray

    @classmethod
    def read(cls, row: dict[str, bytes]) -> Block:
        kinds = {"ids": np.int64, "members": np.int16}
        parts = {k: np.frombuffer(v, kinds.get(k, np.int32)) for k, v in row.items()}
        parts["vectors"] = parts["vectors"].reshape(len(parts["ids"]), -1).astype(np.int64)
        parts["high"], parts["low"] = parts["high"].astype(np.int64), parts["low"].astype(np.int64)
        parts["lengths"] = np.diff(parts["starts"])
        segments = np.diff(parts["firsts"])
        parts["dims"] = np.repeat(np.arange(len(segments)), segments)
        return cls(**parts)

    @property
    def width(self) -> int:
        return len(self.firsts) - 1

    def search(self, query: np.ndarray, own: int, k: int, least: int, levels: int):
        """(rows, exact scores) of at most k rows that reach `least`, not `own`.

        With all `levels` these are the block's best; with fewer, some that are good.
        """
        query = query[: self.width]
        if len(query) < self.width:
            query = np.pad(query, (0, self.width - len(query)))
        each = np.repeat(query, np.diff(self.firsts))
        up = each >= 0
        # What a segment adds at most, above the least that its dimension adds to any vector.
        ends = np.where(query >= 0, self.low[self.firsts[1:] - 1], self.high[self.firsts[:-1]])
        base = query * ends
        adds = each * np.where(up, self.high, self.low) - np.repeat(base, np.diff(self.firsts))
        most = np.where(query >= 0, adds[self.firsts[:-1]], adds[self.firsts[1:] - 1]).astype(float)
        unit = (int(most.max(initial=0)) + 1) / LEVELS
        level = np.minimum(adds / unit, LEVELS - 1).astype(np.int64)
        # Segments still unread add at most this much; those of weak dimensions not even that.
        bounds = [float(adds[level < at].max(initial=0)) for at in range(LEVELS)]
        rests = np.array([np.minimum(most, b).sum() for b in bounds])
        count, few = len(self.ids), max(FEW, len(self.ids) // FEW_SHARE)
        total, seen = np.zeros(count), np.zeros(count)
        possible = np.arange(count)
        lowest, wanted = LEVELS - levels, -np.inf
        at = lowest
        if least != NOTHING:
            # With room for what doubles round off.
            wanted = least - int(base.sum()) - 1e-12 * most.sum()
            # Before this level a vector that was never seen may be a member: nothing to prove yet.
            at = max(lowest, int(np.append(np.flatnonzero(rests < wanted), 0).max()))
        before = LEVELS
        while at >= lowest:
            read = np.flatnonzero((level >= at) & (level < before))
            if len(read):
                # A dimension's segments of these levels lie side by side.
                breaks = np.flatnonzero((np.diff(read) > 1) | (np.diff(self.dims[read]) > 0))
                begins, stops = read[np.append(0, breaks + 1)], read[np.append(breaks, len(read) - 1)] + 1
                hit = np.concatenate([self.members[a:b] for a, b in zip(self.starts[begins], self.starts[stops])])
                total += np.bincount(hit, np.repeat(adds[read].astype(float), self.lengths[read]), count)
                seen += np.bincount(hit, minlength=count)
            if least != NOTHING:
                possible = np.flatnonzero(total - bounds[at] * seen + rests[at] >= wanted)
                if len(possible) <= few:
                    break
            before, at = at, at - 1
        if lowest and len(possible) > k + 1:
            possible = np.argpartition(-total, min(k + 1, count - 1))[: k + 1]
        possible = possible[self.ids[possible] != own]
        scores = self.vectors[possible] @ query
        best = np.lexsort((self.ids[possible], -scores))[:k]
        best = best[scores[best] >= least]
        return possible[best], scores[best]


FOUND = "query_id long, vec_id long, score long"


def _look(index: DataFrame, asked: pa.Table, k: int, levels: int, least: dict[int, int]) -> DataFrame:
    """Rows of every block that a query may have among its best."""
    numbers = asked.column("query_id").to_numpy()
    matrix = as_matrix(asked.column("vector").combine_chunks())
    floors = np.array([least.get(int(n), NOTHING) for n in numbers], np.int64)
    shared = index.sparkSession.sparkContext.broadcast((numbers, matrix, floors))

    def run(batches):
        numbers, matrix, floors = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                block = Block.read(row)
                found = [block.search(q, n, k, f, levels) for q, n, f in zip(matrix, numbers, floors)]
                rows = np.concatenate([r for r, _ in found])
                columns = [
                    np.repeat(numbers, [len(r) for r, _ in found]),
                    block.ids[rows],
                    np.concatenate([s for _, s in found]),
                ]
                yield pa.record_batch([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])

    return index.mapInArrow(run, FOUND)


def search(index: DataFrame, queries: DataFrame, k: int = 5, at_a_time: int = QUERIES_AT_A_TIME) -> DataFrame:
    """The k best of the index for each (id, vector) query: (query_id, rank, vec_id, score).

    `at_a_time` queries travel to the tasks at a time; every task keeps k rows of a query.
    """
    order = [F.col("score").desc(), F.col("vec_id")]

    def batch(asked: pa.Table) -> DataFrame:
        if not asked.num_rows:
            return index.sparkSession.createDataFrame([], f"{FOUND}, rank int")
        first = top_per_group(_look(index, asked, k, FIRST_LOOK, {}), ["query_id"], order, k)
        # One score of each query of this batch.
        known = first.where(F.col("rank") == k).select("query_id", "score").collect()
        least = {r.query_id: r.score for r in known}
        return top_per_group(_look(index, asked, k, LEVELS, least), ["query_id"], order, k)

    asked = queries.select(F.col("id").alias("query_id"), "vector")
    found = in_batches(asked, at_a_time, batch)
    return found.select("query_id", "rank", "vec_id", "score")


def top_k(
    rows: DataFrame,
    is_query,
    k: int = 5,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    scale: int = SCALE,
) -> DataFrame:
    """The k greatest inner products of every query row: (query_id, rank, vec_id, score).

    Components are floor(scale * x). `is_query` is a condition on the column `id`; each of those
    rows is a query against all rows but those with its id. Ties go to the smaller id; fewer rows
    than k give all. Rows with a null id, and vectors that are null, hold a null or non-finite
    component or one of over 2^27 when scaled, take no part. Of rows with one id, that with the
    least vector counts. A vector that is shorter than a query counts as zero where it ends, and an
    empty one scores 0. An empty table, or one without queries, gives an empty one.
    """
    spark = rows.sparkSession
    vectors = whole_vectors(rows, id_column, vector_column, scale).where("id is not null")
    parts = max(spark.sparkContext.defaultParallelism, -(-rows.count() // BLOCK_ROWS))
    single = vectors.repartition(parts, "id").groupBy("id").agg(F.min("vector").alias("vector"))
    single = written(single, "vectors")
    index = written(build(single), "impact-index")
    return search(index, single.where(is_query), k)
