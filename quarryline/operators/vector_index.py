"""Nearest-neighbour index of cells, with bounds that keep exact search from most of them.

Unit vectors fall into cells, the nearest of k-means centroids; the number of cells grows with the
root of the corpus, and cells are a partition column. The index knows how many rows a cell has and
how far its furthest lies from the centroid. An approximate search reads the cells nearest to each
query, as many as a sample showed are needed. An exact search takes the distance of the k-th row of
its nearest cells as a bound, and then reads the cells whose centroid is no further off than the
bound and the cell's own reach together; only rows within the bound leave a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import vectors as vx
from quarryline.functions.ranking import top_per_group
from quarryline.operators.vector_search import (
    MAX_SHIPPED_QUERIES,
    PAYLOAD,
    TARGET_RECALL,
    in_batches,
    knn,
    wanted_queries,
)
from quarryline.session import materialise

SEED = 42
# Rows that k-means sees for each cell, and those that the probes are fitted on.
ROWS_PER_CELL = 64
FITTED_ROWS = 4096
ASKED_ROWS = 256
ITERATIONS = 8
# Neighbours that the probes are fitted for.
NEIGHBOURS = 10
# What rounded distances may be off.
SLACK = 2e-6


@dataclass(frozen=True)
class CellModel:
    """Centroids of the cells, and what reading the nearest cells finds.

    `found[i]` is the share of the nearest neighbours that lie in the i + 1 nearest cells.
    """

    centroids: np.ndarray
    found: np.ndarray

    @property
    def dim(self) -> int:
        return self.centroids.shape[1]

    def probes(self, recall: float) -> int:
        """Cells to read for the expected recall."""
        enough = np.flatnonzero(self.found >= recall)
        return int(enough[0]) + 1 if len(enough) else len(self.centroids)

    def distances(self, unit: np.ndarray) -> np.ndarray:
        """Distances of unit vectors to all centroids; infinite for what has no direction."""
        squares = 1 + (self.centroids**2).sum(axis=1)[None, :] - 2 * unit @ self.centroids.T
        return np.where(np.isnan(squares), np.inf, np.sqrt(np.maximum(squares, 0)))


def cells_for(rows: int) -> int:
    """Cells of a corpus: as many as a cell then has rows."""
    return max(1, math.isqrt(rows))


def fit(vectors: DataFrame, cells: int | None = None, seed: int = SEED) -> CellModel:
    """Cells and probes for the rows of `vectors` that have an embedding.

    k-means runs on Spark over a sample of about `ROWS_PER_CELL` rows a cell, those with the least
    hashes of their ids; the probes are fitted on about `FITTED_ROWS` of these. Every row is
    indexed, whatever was fitted on. All rows need vectors of one model and length.
    """
    present = vectors.where(F.col("embedding").isNotNull())
    rows = present.count()
    if not rows:
        return CellModel(np.zeros((1, 0)), np.ones(1))
    cells = cells or cells_for(rows)

    def sample(size: int) -> DataFrame:
        share = int(min(1.0, size / rows) * 2**62)
        hashed = F.xxhash64(F.lit(seed), "chunk_id").bitwiseAND(F.lit(2**62 - 1))
        raw = present.where(hashed <= share).select(array_to_vector("embedding").alias("raw"))
        return Normalizer(inputCol="raw", outputCol="features").transform(raw).select("features")

    trained = KMeans(k=cells, seed=seed, maxIter=ITERATIONS, initSteps=2).fit(sample(ROWS_PER_CELL * cells))
    kept = sample(FITTED_ROWS).limit(2 * FITTED_ROWS).collect()
    unit = np.array([r.features.toArray() for r in kept]).reshape(len(kept), -1)
    bare = CellModel(np.array(trained.clusterCenters()), np.ones(1))
    return CellModel(bare.centroids, _found(bare, unit))


def _found(model: CellModel, unit: np.ndarray) -> np.ndarray:
    """Share of the sample's nearest neighbours in the nearest cells, by number of cells.

    Neighbours within a sample lie further off than those in the corpus, so this errs low.
    """
    asked = unit[:ASKED_ROWS]
    far = -(asked @ unit.T)
    far[np.arange(len(asked)), np.arange(len(asked))] = np.inf
    near = np.argsort(far, axis=1)[:, : min(NEIGHBOURS, len(unit) - 1)]
    order = model.distances(asked).argsort(axis=1).argsort(axis=1)
    places = np.take_along_axis(order, model.distances(unit).argmin(axis=1)[near], axis=1)
    if not places.size:
        return np.ones(len(model.centroids))
    return np.cumsum(np.bincount(places.ravel(), minlength=len(model.centroids))) / places.size


def with_cells(vectors: DataFrame, model: CellModel) -> DataFrame:
    """Rows that have an embedding, with their `cell` and the distance `reach` to its centroid.

    A zero vector goes to cell 0.
    """
    present = vectors.where(F.col("embedding").isNotNull())
    sent = vectors.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<cell:int,reach:double>")
    def place(column: pa.Array) -> pa.Array:
        far = sent.value.distances(vx.unit_rows(vx.matrix(column, sent.value.dim)))
        reach = far.min(axis=1, initial=np.inf)
        columns = [pa.array(far.argmin(axis=1).astype(np.int32)), pa.array(np.where(np.isinf(reach), 0.0, reach))]
        return pa.StructArray.from_arrays(columns, ["cell", "reach"])

    return present.withColumn("_place", place("embedding")).select(*vectors.columns, "_place.*")


@dataclass(frozen=True)
class CellIndex:
    """An opened index: its rows, its model, and by collection the rows and reach of every cell."""

    vectors: DataFrame
    model: CellModel
    sizes: dict[str, np.ndarray]
    reach: dict[str, np.ndarray]


def write(vectors: DataFrame, model: CellModel, path: str, files_per_cell: int = 1) -> None:
    """Stores the index of `vectors` below `path`; a second call with the same model adds rows.

    `files_per_cell` spreads the rows of a hot cell over several files and tasks. The summary of
    the cells is written last: a reader sees either it or the one before.
    """
    spark = vectors.sparkSession
    salt = F.pmod(F.xxhash64("chunk_id"), F.lit(files_per_cell))
    keys = ["collection", "cell"]
    placed = with_cells(vectors, model).repartition(*keys, salt).sortWithinPartitions(*keys, "chunk_id")
    placed.write.mode("append").partitionBy(*keys).parquet(f"{path}/vectors")
    rows = [("centroid", i, c.tobytes()) for i, c in enumerate(model.centroids.astype(float))]
    rows += [("found", 0, model.found.astype(float).tobytes())]
    spark.createDataFrame(rows, "kind string, number int, value binary").coalesce(1).write.mode(
        "overwrite"
    ).parquet(f"{path}/model")
    stored = spark.read.parquet(f"{path}/vectors")
    stored.groupBy(*keys, "model_name").agg(F.count("*").alias("n"), F.max("reach").alias("reach")).coalesce(
        1
    ).write.mode("overwrite").parquet(f"{path}/cells")


def read(spark: SparkSession, path: str) -> CellIndex:
    """The index stored below `path`; its model and the summary of its cells come to the driver."""
    parts: dict[str, list] = {"centroid": [], "found": []}
    for row in spark.read.parquet(f"{path}/model").orderBy("kind", "number").collect():
        parts[row.kind].append(np.frombuffer(row.value, float))
    model = CellModel(np.array(parts["centroid"]), parts["found"][0])
    sizes: dict[str, np.ndarray] = {}
    reach: dict[str, np.ndarray] = {}
    models = set()
    for row in spark.read.parquet(f"{path}/cells").collect():
        for table, value in ((sizes, row.n), (reach, row.reach)):
            of_cells = table.setdefault(row.collection, np.zeros(len(model.centroids)))
            of_cells[row.cell] = max(of_cells[row.cell], value)
        models.add(row.model_name)
    if len(models) > 1:
        raise ValueError("the index mixes embedding models")
    return CellIndex(spark.read.parquet(f"{path}/vectors"), model, sizes, reach)


_HIT = "query_id long, chunk_id string, document_id string, sequence int, distance double"


def search(
    index: CellIndex,
    queries: DataFrame,
    k: int,
    *,
    collection: str,
    recall: float | None = TARGET_RECALL,
    max_shipped: int = MAX_SHIPPED_QUERIES,
) -> DataFrame:
    """k nearest chunks of a collection per query, with exact distances, ranked from 1.

    Each query reads its nearest cells, as many as the model expects `recall` of and at least
    those that hold k rows. With `recall` None the result is that of `knn`, from the cells that
    bounds cannot rule out. A query with a `document_id` is answered exactly, from that document's
    rows. More than `max_shipped` queries are searched in turn.
    """
    wanted = wanted_queries(queries)
    answer = _bounded if recall is None else _probed
    near = in_batches(
        wanted.where("document_id is null"), max_shipped, lambda asked: answer(index, asked, k, collection, recall)
    )
    near = near.withColumn("relevance", vx.relevance(F.col("distance")))
    filtered = wanted.where("document_id is not null")
    if filtered.isEmpty():
        return near
    return near.unionByName(knn(index.vectors, filtered, k, collection=collection, max_shipped=max_shipped))


class _Asked:
    """Shipped queries and their distances to the cells of one collection."""

    def __init__(self, index: CellIndex, asked: pa.Table, collection: str):
        self.ids = asked["query_id"].to_numpy()
        self.unit = vx.unit_rows(vx.matrix(asked["embedding"].combine_chunks(), index.model.dim))
        self.far = index.model.distances(self.unit)
        self.sizes, self.reach = index.sizes[collection], index.reach[collection]
        self.rows = index.vectors.where(F.col("collection") == collection)

    def nearest_cells(self, k: int, least: int) -> np.ndarray:
        """By query and cell: the `least` nearest cells, and those until k rows are in them."""
        order = self.far.argsort(axis=1, kind="stable")
        before = np.cumsum(self.sizes[order], axis=1) - self.sizes[order]
        read = (np.arange(order.shape[1]) < least) | (before < k)
        out = np.zeros(read.shape, bool)
        np.put_along_axis(out, order, read, axis=1)
        return out & (self.sizes > 0)[None, :]

    def scan(self, cells: np.ndarray, k: int, bound: np.ndarray | None = None) -> DataFrame:
        """The k best rows of every task for each query, from the cells marked for it."""
        ids, unit, far, reach = self.ids, self.unit, self.far, self.reach
        needed = [int(c) for c in np.flatnonzero(cells.any(axis=0))]
        sent = self.rows.sparkSession.sparkContext.broadcast((ids, unit, far, reach, cells, bound))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, unit, far, reach, cells, bound = sent.value
            nearest = vx.Nearest(ids, unit, k, bound)
            for batch in batches:
                of_row = batch.column("cell").to_numpy()
                for cell in np.unique(of_row):
                    # A cell beyond the bound and its own reach has no row within the bound.
                    close = far[:, cell] - reach[cell] <= np.sqrt(2 * (nearest.bound + SLACK))
                    who = np.flatnonzero(cells[:, cell] & (close | np.isinf(nearest.bound)))
                    if len(who):
                        part = batch.filter(pa.array(of_row == cell))
                        points = vx.unit_rows(vx.matrix(part.column("embedding"), unit.shape[1]))
                        nearest.add(points, part.select(PAYLOAD), who)
            if (hits := nearest.hits(PAYLOAD)) is not None:
                yield hits

        slim = self.rows.where(F.col("cell").isin(needed)).select(
            "chunk_id", "document_id", F.col("sequence").cast("int").alias("sequence"), "embedding", "cell"
        )
        return slim.mapInArrow(run, _HIT)


def _best(hits: DataFrame, k: int) -> DataFrame:
    return top_per_group(hits, ["query_id"], [F.col("distance").asc_nulls_last(), F.col("chunk_id")], k)


def _probed(index: CellIndex, asked: pa.Table, k: int, collection: str, recall: float) -> DataFrame:
    if not asked.num_rows or collection not in index.sizes:
        return index.vectors.sparkSession.createDataFrame([], f"{_HIT}, rank int")
    batch = _Asked(index, asked, collection)
    return _best(batch.scan(batch.nearest_cells(k, index.model.probes(recall)), k), k)


def _bounded(index: CellIndex, asked: pa.Table, k: int, collection: str, recall: None) -> DataFrame:
    if not asked.num_rows or collection not in index.sizes:
        return index.vectors.sparkSession.createDataFrame([], f"{_HIT}, rank int")
    batch = _Asked(index, asked, collection)
    first_cells = batch.nearest_cells(k, 1)
    first = materialise(_best(batch.scan(first_cells, k), k), "nearest-cells")
    # One distance of each shipped query.
    reached = {r.query_id: r.distance for r in first.where(F.col("rank") == k).collect()}
    bound = np.array([np.inf if reached.get(int(q)) is None else reached[int(q)] for q in batch.ids])
    possible = (batch.far - batch.reach <= np.sqrt(2 * (bound + SLACK))[:, None]) | np.isinf(bound)[:, None]
    rest = possible & ~first_cells & (batch.sizes > 0)
    if not rest.any():
        return first
    second = batch.scan(rest, k, bound)
    return _best(first.drop("rank").unionByName(second), k)
