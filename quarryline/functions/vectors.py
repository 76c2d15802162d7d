"""Vector column functions and the per-task part of nearest-neighbour search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

DISTANCE_DIGITS = 6
QUERY_BLOCK = 256
# Hits that a task gathers before it keeps the best of them.
HITS_HELD = 1 << 20


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """Distance of two vectors in one row, rounded as search results are."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.round(F.lit(1.0) - F.try_divide(dot(a, b), norm), DISTANCE_DIGITS)


def relevance(distance: Column) -> Column:
    """Bounded relevance of a distance; 0 where there is none."""
    return F.coalesce(F.lit(1.0) / (F.lit(1.0) + distance), F.lit(0.0))


def similarity(distance: Column) -> Column:
    """1 - d inside [0, 1], else 1 / (1 + max(d, 0)); six decimals."""
    inside = (distance >= 0.0) & (distance <= 1.0)
    outside = F.lit(1.0) / (F.lit(1.0) + F.greatest(distance, F.lit(0.0)))
    known = F.when(distance.isNotNull(), F.when(inside, F.lit(1.0) - distance).otherwise(outside))
    return F.round(known, 6)


def matrix(vectors: pa.Array, dim: int | None = None) -> np.ndarray:
    """Equal-length Arrow lists as rows of a float64 matrix."""
    lengths = set(vectors.value_lengths().unique().to_pylist())
    if len(lengths) > 1 or (dim is not None and lengths not in (set(), {dim})):
        raise ValueError(f"vectors of different models: lengths {lengths}, expected {dim}")
    width = lengths.pop() if lengths else (dim or 0)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), width)


def unit_rows(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; zero rows become NaN, which no search returns early."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return rows / np.linalg.norm(rows, axis=1, keepdims=True)


class Nearest:
    """The k nearest rows of every query among the blocks seen, ties by chunk id.

    A running bound, the k-th best distance so far or the `bound` known before, keeps rows
    that are no nearer from being gathered at all.
    """

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int, bound: np.ndarray | None = None):
        self.ids, self.rows, self.k = ids, rows, k
        self.bound = np.full(len(ids), np.inf) if bound is None else bound.copy()
        self.held: list[pa.Table] = []
        self.size = 0

    def add(self, points: np.ndarray, payload: pa.RecordBatch, who: np.ndarray, allowed: np.ndarray | None = None):
        """Measures the rows `points` for the queries numbered `who`.

        `allowed` marks the (query, row) pairs a filter lets through.
        """
        for start in range(0, len(who), QUERY_BLOCK):
            some = who[start : start + QUERY_BLOCK]
            distance = np.round(1.0 - self.rows[some] @ points.T, DISTANCE_DIGITS)
            # What has no direction is infinitely far, yet may fill up to k.
            distance[np.isnan(distance)] = np.inf
            near = distance <= self.bound[some][:, None]
            if allowed is not None:
                near &= allowed[start : start + QUERY_BLOCK]
            many = np.flatnonzero(near.sum(axis=1) > self.k)
            if len(many):
                ranked = np.where(near[many], distance[many], np.inf)
                limit = np.partition(ranked, self.k - 1, axis=1)[:, self.k - 1 : self.k]
                near[many] &= distance[many] <= limit
            which, where = np.nonzero(near)
            if len(which):
                self._hold(some[which], distance[which, where], payload, where)

    def _hold(self, which: np.ndarray, distance: np.ndarray, payload: pa.RecordBatch, where: np.ndarray) -> None:
        hits = pa.Table.from_batches([payload]).take(pa.array(where))
        hits = hits.append_column("which", pa.array(which)).append_column("distance", pa.array(distance))
        self.held.append(hits)
        self.size += len(which)
        if self.size > max(HITS_HELD, 4 * self.k * len(self.ids)):
            self.settle()

    def settle(self) -> pa.Table | None:
        """Keeps the k best of every query; returns them."""
        if not self.held:
            return None
        hits = pa.concat_tables(self.held).combine_chunks()
        order = pc.sort_indices(
            hits, [("which", "ascending"), ("distance", "ascending"), ("chunk_id", "ascending")]
        ).to_numpy()
        which = hits["which"].to_numpy()[order]
        first = np.flatnonzero(np.append(True, which[1:] != which[:-1]))
        place = np.arange(len(which)) - np.repeat(first, np.diff(np.append(first, len(which))))
        order, place = order[place < self.k], place[place < self.k]
        hits = hits.take(pa.array(order))
        full = place == self.k - 1
        owner, reached = hits["which"].to_numpy()[full], hits["distance"].to_numpy()[full]
        self.bound[owner] = np.minimum(self.bound[owner], reached)
        self.held, self.size = [hits], len(hits)
        return hits

    def hits(self, columns: list[str]) -> pa.RecordBatch | None:
        """The rows kept, as (query_id, columns, distance); an infinite distance is null."""
        found = self.settle()
        if found is None:
            return None
        distance = found["distance"].to_numpy()
        return pa.RecordBatch.from_arrays(
            [
                pa.array(self.ids[found["which"].to_numpy()]),
                *(found[c].combine_chunks() for c in columns),
                pa.array(distance, mask=np.isinf(distance)),
            ],
            ["query_id", *columns, "distance"],
        )


def hyperplanes(dim: int, bits: int, seed: int) -> np.ndarray:
    """Random directions, the same for every task and every run."""
    return np.random.default_rng(seed).standard_normal((dim, bits))


def signatures(rows: np.ndarray, bits: int, seed: int) -> np.ndarray:
    """Bucket number of every row: one bit per side of a hyperplane."""
    sides = rows @ hyperplanes(rows.shape[1], bits, seed) >= 0
    return sides.astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))


def bucket(embedding: Column, bits: int, seed: int) -> Column:
    """LSH bucket of a vector column."""

    @F.arrow_udf("int")
    def bucket_of(batch: pa.Array) -> pa.Array:
        return pa.array(signatures(matrix(batch), bits, seed).astype(np.int32))

    return bucket_of(embedding)


def _slots(tokens: list[str], dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Position and sign of every token, from its md5."""
    digests = [hashlib.md5(token.encode("utf-8")).hexdigest() for token in tokens]
    places = np.array([int(d[:8], 16) % dim for d in digests], dtype=np.int64)
    signs = np.array([1.0 if int(d[8], 16) < 8 else -1.0 for d in digests])
    return places, signs


def hash_embedding(tokens: Column, dim: int) -> Column:
    """Signed feature hashing of a token array to a unit vector (zeros when empty).

    The token column is cut from text inside the JVM; batches arrive as Arrow.
    """

    @F.arrow_udf("array<double>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            spoken = batch.flatten().dictionary_encode()
            places, signs = _slots(spoken.dictionary.to_pylist(), dim)
            which = spoken.indices.to_numpy()
            lengths = pc.fill_null(batch.value_lengths(), 0).to_numpy()
            owner = np.repeat(np.arange(len(batch)), lengths)
            sums = np.bincount(
                owner * dim + places[which], weights=signs[which], minlength=dim * len(batch)
            )
            vectors = sums.reshape(len(batch), dim)
            norms = np.linalg.norm(vectors, axis=1, keepdims=True)
            vectors = vectors / np.where(norms == 0, 1.0, norms)
            offsets = np.arange(0, dim * (len(batch) + 1), dim, dtype=np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(vectors.ravel()))

    return embed(tokens)
