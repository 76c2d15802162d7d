"""Exact top-k search and centroid clusters against plain computation."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.llm import centroid_clusters, impact_search, queries

INF, NAN = math.inf, math.nan


def plain_vector(vector, scale=256):
    if vector is None or any(x is None or not math.isfinite(x) or abs(x) > 2**27 / scale for x in vector):
        return None
    return [math.floor(scale * x) for x in vector]


def plain_top(rows, step=50, k=5):
    kept = {}
    for i, v in rows:
        if i is not None and (w := plain_vector(v)) is not None:
            kept[i] = min(kept.get(i, w), w)
    out = []
    for q in sorted(kept):
        if q % step == 0:
            scored = sorted((-sum(a * b for a, b in zip(kept[q], v)), i) for i, v in kept.items() if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return out


def made_rows(seed, count, dim=64, spread=0.3):
    draw = np.random.default_rng(seed)
    centres = draw.normal(0, 0.15, (12, dim))
    rows = centres[draw.integers(0, 12, count)] + draw.normal(0, spread * 0.15, (count, dim))
    return [(i, r.astype(np.float32).tolist()) for i, r in enumerate(rows)]


@pytest.mark.parametrize("scale,dim", [(200, 64), (3, 8), (1 << 26, 64), (1, 1)])
def test_a_block_finds_its_best(scale, dim):
    draw = np.random.default_rng(scale)
    vectors = (draw.normal(0, 1, (3000, dim)) * scale).clip(-(1 << 27), 1 << 27).astype(np.int64)
    vectors[1000:1500] = vectors[7]
    ids = draw.permutation(10_000)[:3000]
    row = impact_search._block(ids, vectors)
    block = impact_search.Block.read(row)
    stopped = 0
    for at in [7, 8, 1200, *range(60)]:
        scores = vectors @ vectors[at]
        order = [i for i in np.lexsort((ids, -scores)) if i != at][:5]
        for least in (impact_search.NOTHING, int(scores[order[-1]]), int(scores[order[0]])):
            found, got = block.search(vectors[at], ids[at], 5, least, impact_search.LEVELS)
            want = [i for i in order if scores[i] >= least]
            assert found.tolist() == want and got.tolist() == scores[want].tolist()
        found, got = block.search(vectors[at], ids[at], 5, impact_search.NOTHING, impact_search.FIRST_LOOK)
        assert got.tolist() == scores[found].tolist() and at not in found
        found, _ = block.search(vectors[at], ids[at], 5, int(scores[order[0]]) + 1, impact_search.LEVELS)
        stopped += not len(found)
    assert stopped == 63


def test_reading_stops_on_proof(monkeypatch):
    """Fewer postings are read than there are, and the fewer the higher the score to beat."""
    rows = made_rows(3, 4000)
    vectors = np.array([plain_vector(v) for _, v in rows])
    ids = np.arange(len(vectors))
    read = []
    count = np.bincount
    monkeypatch.setattr(np, "bincount", lambda *a, **k: (read.append(len(a[0])), count(*a, **k))[1])
    block = impact_search.Block.read(impact_search._block(ids, vectors))
    shares = []
    for at in range(50):
        scores = np.sort(np.delete(vectors @ vectors[at], at))
        read.clear()
        block.search(vectors[at], at, 5, int(scores[-5]), impact_search.LEVELS)
        shares.append(sum(read) / 2 / vectors.size)
    assert np.mean(shares) < 0.6


def test_top_k_query(spark, tmp_path):
    rows = made_rows(1, 700)
    rows += [(700 + i, rows[50][1]) for i in range(30)]
    rows += [
        (1000, None), (1050, []), (1100, [0.1, 0.2]), (1150, [NAN] + [0.1] * 63), (1200, [INF] * 64),
        (1250, [None] * 64), (1300, [1e30] * 64), (1350, [0.0] * 64), (1400, [500_000.0] * 64), (None, [0.5] * 64),
        (1450, [0.1] * 80), (50, rows[50][1]), (100, [-9.0] * 64),
    ]
    table = spark.createDataFrame([(*r, "x", 7) for r in rows], "vec_id long, embedding array<float>, score string, id int")
    table.repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = queries.QUERIES["op12_exact_top_k"](spark, str(tmp_path))
    assert found.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, found.collect())) == plain_top([(i, v and [x and float(np.float32(x)) for x in v]) for i, v in rows])


def test_top_k_in_blocks_and_batches(spark, monkeypatch):
    monkeypatch.setattr(impact_search, "BLOCK_ROWS", 64)
    rows = made_rows(2, 900, dim=16)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    whole = impact_search.whole_vectors(table, "vec_id", "embedding")
    index = impact_search.build(whole.repartition(3))
    assert index.count() > 12
    found = impact_search.search(index, whole.where("id % 5 = 0"), 3, at_a_time=40)
    assert sorted(map(tuple, found.collect())) == plain_top(rows, 5, 3)


def test_few_or_no_rows(spark):
    kind = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, -1.0]), (1, [0.5, 0.0]), (2, [-3.0, 0.0])], kind)
    found = impact_search.top_k(few, F.col("id") == 0).collect()
    assert [tuple(r) for r in found] == [(0, 1, 1, 32768), (0, 2, 2, -196608)]
    for none in (few.limit(0), few.where("vec_id = 2")):
        assert impact_search.top_k(none, F.col("id") == 0).collect() == []
        assert impact_search.top_k(none, F.lit(True)).collect() == []


def plain_clusters(rows, count=40, rounds=5, dim=64):
    kept = [(i, w) for i, v in rows if (w := plain_vector(v)) is not None and len(w) == dim]
    keyed = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in keyed[:count]]

    def assign():
        return [
            min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in kept
        ]

    for _ in range(rounds):
        near = assign()
        for j in range(len(centroids)):
            own = [v for (_, v), (_, c) in zip(kept, near) if c == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    near = assign()
    sums = {j: sum(d for d, c in near if c == j) for j in range(len(centroids))}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, c, d, sums[c], sum(sums.values()), names[c]) for (i, _), (d, c) in zip(kept, near)]


def test_clusters_query(spark, tmp_path):
    rows = made_rows(5, 400)
    rows += [(400 + i, rows[9][1]) for i in range(150)]
    rows += [
        (1000, None), (1001, []), (1002, [0.1] * 63), (1003, [NAN] + [0.1] * 63), (1004, [-INF] * 64),
        (1005, [None] * 64), (1006, [1e30] * 64), (1007, [0.0] * 64), (None, rows[3][1]), (9, rows[9][1]), (9, rows[8][1]),
    ]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, cluster int, vector string")
    table.repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = queries.QUERIES["op13_centroid_clusters"](spark, str(tmp_path))
    assert found.dtypes == [
        ("vec_id", "bigint"), ("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"),
        ("inertia", "bigint"), ("centroid_sha256", "string"),
    ]
    plain = plain_clusters([(i, v and [x and float(np.float32(x)) for x in v]) for i, v in rows])
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(plain, key=repr)


@pytest.mark.parametrize("scale", [30, 1 << 26])
def test_only_expired_vectors_are_compared_again(scale):
    draw = np.random.default_rng(scale)
    centres = draw.normal(0, scale, (9, 64))
    vectors = (centres[draw.integers(0, 9, 3000)] + draw.normal(0, scale / 6, (3000, 64))).clip(-(1 << 27), 1 << 27)
    vectors = vectors.astype(np.int64)
    centroids = vectors[draw.permutation(3000)[:12]]
    drift, nearest, heaps = np.zeros(12), None, None
    compared = []
    for _ in range(9):
        nearest, heaps, scanned = centroid_clusters.assigned(vectors, centroids, drift, nearest, heaps)
        compared.append(scanned)
        exact = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(v, c)) for c in centroids] for v in vectors[:40]])
        assert nearest[:40].tolist() == exact.argmin(axis=1).tolist()
        assert (nearest == centroid_clusters.squares(vectors, centroids).argmin(axis=1)).all()
        assert sorted(heaps.rows.tolist()) == list(range(3000))
        for c in range(12):
            keys = heaps.keys[heaps.starts[c] : heaps.starts[c + 1]]
            assert all(keys[(i - 1) // 2] <= keys[i] for i in range(1, len(keys)))
            assert (nearest[heaps.rows[heaps.starts[c] : heaps.starts[c + 1]]] == c).all()
        moved = np.array([vectors[nearest == c].sum(axis=0) // max(1, (nearest == c).sum()) for c in range(12)])
        moved[np.bincount(nearest, minlength=12) == 0] = centroids[np.bincount(nearest, minlength=12) == 0]
        drift = drift + centroid_clusters._drift(centroids, moved)
        centroids = moved
    assert compared[0] == 3000 and min(compared) < 1000


def test_ties_go_to_the_smaller_centroid(spark):
    points = [(i, [float(x), 0.0]) for i, x in enumerate([0, 2, 4, 1, 3, 1, 3] * 3)]
    table = spark.createDataFrame(points, "vec_id long, embedding array<float>")
    found = centroid_clusters.clusters(table, count=3, rounds=3, dim=2, scale=1)
    kept = [(i, [x / 256 for x in v]) for i, v in points]
    mine = sorted((r.id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in found.collect())
    assert mine == sorted(plain_clusters(kept, 3, 3, 2))


def test_clusters_of_few_or_no_vectors(spark):
    kind = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(1, [1.0] * 64), (2, [0.0] * 64), (None, [2.0] * 64)], kind)
    assert len(centroid_clusters.clusters(few).select("cluster").distinct().collect()) == 2
    for none in (few.limit(0), few.where("vec_id is null")):
        assert centroid_clusters.clusters(none).collect() == []
