"""k-means in whole numbers, with a heap of distance gaps per cluster.

Vectors lie in blocks. For each cluster a block keeps a heap of its vectors by gap: the distance to
the second nearest centroid less that to the nearest, plus what the cluster had drifted when the
gap was measured. A round adds to a cluster's drift how far its centroid moved and the furthest
that any other moved; a vector can only change cluster once its gap is used up, so those on top of
the heap whose gap the drift has reached are popped, compared with all centroids exactly and
pushed again. All others keep their cluster unseen.

A round is one pass over the blocks, written as a table with the heaps and the sums of every
cluster; the sums are added up by Spark, and only the centroids and their drift go on to the next.
"""

from __future__ import annotations

import heapq
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import written
from quarryline.llm.whole_vectors import SCALE, as_matrix, whole_vectors

BLOCK_ROWS = 1 << 13
# What gaps lose and drifts gain, so that rounded roots never keep a vector wrongly.
SLACK = 1e-9
# Squares up to this sum are exact as doubles.
EXACT = 1 << 53

STATE = (
    "ids array<long>, vectors binary, nearest binary, keys binary, rows binary, starts binary, "
    "sums array<struct<cluster:int,size:long,total:array<long>>>, scanned long"
)


def blocks(vectors: DataFrame, dim: int) -> DataFrame:
    """The (id, vector) rows of every partition, some thousand to a row, yet in no cluster.

    A null id is kept as such.
    """

    def run(batches):
        ids, held, size = [], [], 0
        for batch in batches:
            numbers, matrix = batch.column(0), as_matrix(batch.column(1)).reshape(-1, dim)
            at = 0
            while at < batch.num_rows:
                room = BLOCK_ROWS - size
                ids.append(numbers.slice(at, room))
                held.append(matrix[at : at + room])
                size += len(held[-1])
                at += len(held[-1])
                if size == BLOCK_ROWS:
                    yield _block(ids, held)
                    ids, held, size = [], [], 0
        if size:
            yield _block(ids, held)

    return vectors.select("id", "vector").mapInArrow(run, "ids array<long>, vectors binary")


def _block(ids, held):
    numbers = pa.concat_arrays(ids)
    lists = pa.ListArray.from_arrays(pa.array([0, len(numbers)], pa.int32()), numbers)
    data = pa.array([np.concatenate(held).astype(np.int32).tobytes()], pa.binary())
    return pa.record_batch([lists, data], ["ids", "vectors"])


def squares(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all vectors to all centroids."""
    most = max(int(np.abs(vectors).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * most * most * vectors.shape[1] < EXACT:
        a, b = vectors.astype(float), centroids.astype(float)
        out = (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]
        return out.astype(np.int64)
    return np.stack([((vectors - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def _measured(vectors: np.ndarray, centroids: np.ndarray):
    """Nearest centroid of each vector, the least number of equal ones, and its gap to the second."""
    found = squares(vectors, centroids)
    nearest = found.argmin(axis=1)
    at = np.arange(len(found))
    own = np.sqrt(found[at, nearest].astype(float))
    if found.shape[1] == 1:
        return nearest, np.full(len(found), np.inf)
    found[at, nearest] = np.iinfo(np.int64).max
    second = np.sqrt(found.min(axis=1).astype(float))
    return nearest, second - own - SLACK * (second + own + 1)


class Heaps:
    """The heaps of one block: (gap plus drift at that time, row), by cluster."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray, starts: np.ndarray):
        self.keys, self.rows, self.starts = keys, rows, starts

    @classmethod
    def empty(cls, count: int) -> Heaps:
        return cls(np.zeros(0), np.zeros(0, np.int32), np.zeros(count + 1, np.int32))

    def expired(self, drift: np.ndarray):
        """Pops the rows whose gap the drift has used up; (them, open heaps by cluster)."""
        first, end = self.starts[:-1], self.starts[1:]
        full = np.flatnonzero(end > first)
        due = full[self.keys[first[full]] <= drift[full]]
        popped, opened = [], {}
        for c in due.tolist():
            a, b = int(first[c]), int(end[c])
            heap = list(zip(self.keys[a:b].tolist(), self.rows[a:b].tolist()))
            limit = float(drift[c])
            while heap and heap[0][0] <= limit:
                popped.append(heapq.heappop(heap)[1])
            opened[c] = heap
        return np.array(popped, np.int64), opened

    def pushed(self, opened: dict, clusters: np.ndarray, keys: np.ndarray, rows: np.ndarray) -> Heaps:
        """The heaps with the rows pushed to those of their clusters."""
        for c, key, row in zip(clusters.tolist(), keys.tolist(), rows.tolist()):
            if c not in opened:
                a, b = int(self.starts[c]), int(self.starts[c + 1])
                opened[c] = list(zip(self.keys[a:b].tolist(), self.rows[a:b].tolist()))
            heapq.heappush(opened[c], (key, row))
        parts = []
        for c in range(len(self.starts) - 1):
            if c in opened:
                pairs = opened[c]
                parts.append((np.array([k for k, _ in pairs]), np.array([r for _, r in pairs], np.int32)))
            else:
                a, b = int(self.starts[c]), int(self.starts[c + 1])
                parts.append((self.keys[a:b], self.rows[a:b]))
        sizes = np.append(0, np.cumsum([len(k) for k, _ in parts])).astype(np.int32)
        keys, rows = (np.concatenate(x) for x in zip(*parts))
        return Heaps(keys.astype(float), rows.astype(np.int32), sizes)


def assigned(vectors, centroids, drift, nearest=None, heaps=None):
    """(nearest, heaps, vectors compared) of a block after one more round."""
    if nearest is None:
        nearest = np.zeros(len(vectors), np.int32)
        heaps, due, opened = Heaps.empty(len(centroids)), np.arange(len(vectors)), {}
    else:
        due, opened = heaps.expired(drift)
    if len(due):
        found, gaps = _measured(vectors[due], centroids)
        nearest = nearest.copy()
        nearest[due] = found
        heaps = heaps.pushed(opened, found, gaps + drift[found], due)
    return nearest, heaps, len(due)


def _round(state: DataFrame, centroids: np.ndarray, drift: np.ndarray) -> DataFrame:
    shared = state.sparkSession.sparkContext.broadcast((centroids, drift))
    first = "nearest" not in state.columns

    def run(batches):
        centroids, drift = shared.value
        for batch in batches:
            for i, row in enumerate(batch.select([n for n in batch.schema.names if n != "ids"]).to_pylist()):
                vectors = np.frombuffer(row["vectors"], np.int32).reshape(-1, centroids.shape[1]).astype(np.int64)
                if first:
                    nearest, heaps, scanned = assigned(vectors, centroids, drift)
                else:
                    heaps = Heaps(
                        np.frombuffer(row["keys"], float),
                        np.frombuffer(row["rows"], np.int32),
                        np.frombuffer(row["starts"], np.int32),
                    )
                    nearest, heaps, scanned = assigned(
                        vectors, centroids, drift, np.frombuffer(row["nearest"], np.int32), heaps
                    )
                order = np.argsort(nearest, kind="stable")
                present, begins = np.unique(nearest[order], return_index=True)
                totals = np.add.reduceat(vectors[order], begins, axis=0)
                sizes = np.diff(np.append(begins, len(order)))
                sums = [
                    {"cluster": int(c), "size": int(n), "total": t.tolist()}
                    for c, n, t in zip(present, sizes, totals)
                ]
                parts = (nearest, heaps.keys, heaps.rows, heaps.starts)
                kind = pa.list_(
                    pa.struct([("cluster", pa.int32()), ("size", pa.int64()), ("total", pa.list_(pa.int64()))])
                )
                yield pa.record_batch(
                    [
                        batch.column("ids").slice(i, 1),
                        pa.array([row["vectors"]], pa.binary()),
                        *(pa.array([np.ascontiguousarray(p).tobytes()], pa.binary()) for p in parts),
                        pa.array([sums], kind),
                        pa.array([scanned], pa.int64()),
                    ],
                    ["ids", "vectors", "nearest", "keys", "rows", "starts", "sums", "scanned"],
                )

    return state.mapInArrow(run, STATE)


def _moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """floor(sum / count) of every cluster that has vectors; Spark adds up the blocks' sums."""
    parts = state.select(F.explode("sums").alias("s"))
    places = parts.select("s.cluster", "s.size", F.posexplode("s.total").alias("place", "part"))
    floors = places.groupBy("cluster", "place").agg(F.sum("part").alias("total"), F.sum("size").alias("n"))
    out = centroids.copy()
    # One row of each component of each centroid.
    for row in floors.collect():
        out[row.cluster, row.place] = row.total // row.n
    return out


def _drift(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How far each centroid moved, plus the furthest that any other did."""
    moves = np.sqrt(((new - old) ** 2).sum(axis=1).astype(float))
    if len(moves) < 2:
        return moves * 0
    top = np.sort(moves)[-2:]
    others = np.where((moves == top[1]) & (moves > top[0]), top[0], top[1])
    return (moves + others) * (1 + SLACK) + SLACK * (moves + others > 0)


def seeds(vectors: DataFrame, count: int, salt: str) -> np.ndarray:
    """The vectors whose SHA-256 of `salt` and id is least, in that order; equal ones by vector."""
    key = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    rows = vectors.where("id is not null").select(key.alias("key"), "vector").orderBy("key", "vector").limit(count)
    return np.array([r.vector for r in rows.collect()], np.int64)


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def fit(vectors: DataFrame, start: np.ndarray, rounds: int) -> tuple[DataFrame, np.ndarray]:
    """The written state after `rounds` rounds and a last assignment, and the centroids."""
    centroids, drift = start, np.zeros(len(start))
    state = written(blocks(vectors, start.shape[1]), "blocks")
    for last in [False] * rounds + [True]:
        state = written(_round(state, centroids, drift), "clusters")
        if not last:
            moved = _moved(state, centroids)
            drift = drift + _drift(centroids, moved)
            centroids = moved
    return state, centroids


MEMBER = "id long, cluster int, distance long, centroid_sha256 string"


def clusters(
    rows: DataFrame,
    count: int = 40,
    rounds: int = 5,
    dim: int = 64,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    scale: int = SCALE,
    salt: str = "2:",
) -> DataFrame:
    """One row per vector of `dim` components: (id, cluster, distance, cluster_inertia, inertia,
    centroid_sha256).

    Components are floor(scale * x). The first centroids are the `count` vectors whose SHA-256 of
    `salt` and id is least. Each round assigns every vector to its nearest centroid by squared
    Euclidean distance (ties: the smaller number) and moves each centroid that has vectors to
    floor(sum / count); an empty one stays. `distance` is squared, to the last centroid; inertias
    are its sums over the cluster and over all.

    Vectors that are null, of another length, or hold a null or non-finite component or one of
    over 2^27 when scaled, take no part. A row with a null id does, but starts no centroid. Repeated
    rows count each. Fewer vectors than `count` start fewer centroids; an empty table, or one
    without an id, gives an empty one. Other columns are not read.
    """
    spark = rows.sparkSession
    vectors = whole_vectors(rows, id_column, vector_column, scale).where(F.size("vector") == dim)
    start = seeds(vectors, count, salt)
    empty = spark.createDataFrame([], f"{MEMBER}, cluster_inertia long, inertia long")
    order = ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    if not len(start):
        return empty.select(*order)
    state, centroids = fit(vectors, start, rounds)
    shared = spark.sparkContext.broadcast((centroids, [digest(c) for c in centroids]))

    def run(batches):
        centroids, digests = shared.value
        for batch in batches:
            for i, row in enumerate(batch.select(["vectors", "nearest"]).to_pylist()):
                vectors = np.frombuffer(row["vectors"], np.int32).reshape(-1, centroids.shape[1]).astype(np.int64)
                nearest = np.frombuffer(row["nearest"], np.int32)
                far = ((vectors - centroids[nearest]) ** 2).sum(axis=1)
                ids = batch.column("ids").slice(i, 1).flatten()
                names = pa.DictionaryArray.from_arrays(pa.array(nearest), pa.array(digests)).cast(pa.string())
                yield pa.record_batch(
                    [ids, pa.array(nearest), pa.array(far), names], ["id", "cluster", "distance", "centroid_sha256"]
                )

    members = state.select("ids", "vectors", "nearest").mapInArrow(run, MEMBER)
    per_cluster = members.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    # One row of each centroid, at most `count`.
    sums = {r.cluster: r.cluster_inertia for r in per_cluster.collect()}
    pairs = [(c, s, sum(sums.values())) for c, s in sorted(sums.items())]
    inertia = spark.createDataFrame(pairs, "cluster int, cluster_inertia long, inertia long")
    return members.join(F.broadcast(inertia), "cluster").select(*order)
