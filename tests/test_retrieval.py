from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.operators import blocks, fulltext, fusion, index, vector_index, vector_search
from quarryline.session import fresh_path

SF = "/root/testdata/sf0.001"
VECTORS = "chunk_id string, document_id string, sequence int, collection string, model_name string, embedding array<float>"


def vectors_of(spark, rows, collection="c", model="m"):
    return spark.createDataFrame(
        [(str(i), f"d{i % 3}", i, collection, model, [float(x) for x in r]) for i, r in enumerate(rows)], VECTORS
    )


def queries_of(spark, rows, documents=None):
    documents = documents or [None] * len(rows)
    return spark.createDataFrame(
        [(i, [float(x) for x in r], d) for i, (r, d) in enumerate(zip(rows, documents))],
        "query_id long, embedding array<float>, document_id string",
    )


def brute(points, asked, k, documents=None):
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    distance = np.round(1 - unit(asked) @ unit(points).T, 6)
    out = set()
    for q, row in enumerate(distance):
        order = sorted((d, str(i)) for i, d in enumerate(row) if not documents or not documents[q] or documents[q] == f"d{i % 3}")
        out |= {(q, chunk, float(d)) for d, chunk in order[:k]}
    return out


def found(hits):
    return {(r.query_id, r.chunk_id, r.distance) for r in hits.collect()}


@pytest.mark.parametrize("shipped", [100, 3])
def test_knn_is_exact_with_many_copies_and_filters(spark, shipped):
    rng = np.random.default_rng(1)
    points = rng.standard_normal((300, 8)).astype(np.float32).astype(float)
    points[::3] = points[0]
    asked = np.vstack([points[0], rng.standard_normal((6, 8))]).astype(np.float32).astype(float)
    documents = [None, "d1", None, "d2", "nowhere", None, None]
    hits = vector_search.knn(
        vectors_of(spark, points).repartition(5), queries_of(spark, asked, documents), 7, max_shipped=shipped
    )
    assert found(hits) == brute(points, asked, 7, documents)


def test_models_and_lengths_do_not_mix(spark):
    mixed = vectors_of(spark, np.eye(3)).unionByName(vectors_of(spark, np.eye(3), model="other"))
    asked = queries_of(spark, np.eye(3)[:1])
    with pytest.raises(ValueError):
        vector_search.knn(mixed, asked, 2)
    assert vector_search.knn(mixed, asked, 2, model="m").count() == 2


def test_empty_and_null_inputs(spark):
    table = vectors_of(spark, np.eye(3))
    assert vector_search.knn(table, queries_of(spark, np.eye(3)).limit(0), 2).count() == 0
    empty = table.withColumn("embedding", F.lit(None).cast("array<float>"))
    assert vector_search.knn(empty, queries_of(spark, np.eye(3)), 2).count() == 0


def test_approximate_search_has_full_k_and_recall(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").select(
        F.col("vec_id").cast("string").alias("chunk_id"), F.lit("d").alias("document_id"),
        F.lit(1).alias("sequence"), F.lit("c").alias("collection"), F.lit("m").alias("model_name"), "embedding",
    )
    asked = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = found(vector_search.knn(table, asked, 10))
    near = found(vector_search.approximate_knn(index.with_buckets(table), asked, 10))
    assert len(near) == len(exact)
    assert len(near & exact) / len(exact) >= 0.9


def test_approximate_search_keeps_filters_in_batches(spark):
    rng = np.random.default_rng(5)
    points, asked = rng.standard_normal((200, 8)), rng.standard_normal((9, 8))
    table = vectors_of(spark, points)
    documents = [f"d{i % 3}" if i % 2 else None for i in range(9)]
    wanted = queries_of(spark, asked, documents)
    exact = found(vector_search.knn(table, wanted, 4))
    for bits in (1, 4):
        indexed = index.with_buckets(table, bits)
        for shipped in (4, 4096):
            near = vector_search.approximate_knn(indexed, wanted, 4, bits=bits, recall=1.0, max_shipped=shipped)
            assert found(near) == exact
    with_models = index.with_buckets(table, 2).withColumn("model_name", F.lit("a"))
    mixed = with_models.unionByName(with_models.withColumn("model_name", F.lit("b")))
    with pytest.raises(ValueError):
        vector_search.approximate_knn(mixed, wanted, 4, bits=2)


def test_buckets_grow_with_the_corpus():
    assert [index.bits_for(n) for n in (0, 1000, 2000, 4001, 10**6, 10**12)] == [1, 1, 1, 3, 10, 16]


def test_clustered_vectors_need_few_buckets_and_short_queries_many(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((4, 8))
    points = np.repeat(centres, 30, axis=0) + 0.01 * rng.standard_normal((120, 8))
    asked = np.vstack([centres, rng.standard_normal((1, 8))])
    table = index.with_buckets(vectors_of(spark, points))
    got = found(vector_search.approximate_knn(table, queries_of(spark, asked), 10))
    exact = brute(points.astype(np.float32).astype(float), asked.astype(np.float32).astype(float), 10)
    assert len(got) == 50 and len(got & exact) >= 45
    assert vector_search.flips_needed(0.0, 8, 0.95) == 0
    assert vector_search.flips_needed(0.0005, 8, 0.95) == 1
    assert vector_search.flips_needed(1.0, 8, 0.95) == 6
    assert vector_search.flips_needed(None, 8, 0.95) == 8


def indexed(spark, table, cells=None, **options):
    path = fresh_path(spark, "cells")
    vector_index.write(table, vector_index.fit(table, cells), path, **options)
    return path, vector_index.read(spark, path)


def clustered(seed, centres=9, each=40, dim=8):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((centres, dim))
    points = np.repeat(middle, each, axis=0) + 0.1 * rng.standard_normal((centres * each, dim))
    asked = middle + 0.1 * rng.standard_normal((centres, dim))
    return points.astype(np.float32).astype(float), asked.astype(np.float32).astype(float)


@pytest.mark.parametrize("shipped", [100, 4])
def test_cells_with_bounds_are_exact(spark, shipped):
    points, asked = clustered(1)
    points[::3] = points[0]
    asked = np.vstack([asked, points[:1]])
    documents = [None, "d1", None, "d2", "nowhere", *[None] * 5]
    _, opened = indexed(spark, vectors_of(spark, points), 7, files_per_cell=2)
    hits = vector_index.search(
        opened, queries_of(spark, asked, documents), 7, collection="c", recall=None, max_shipped=shipped
    )
    assert found(hits) == brute(points, asked, 7, documents)


def test_cells_reach_recall_and_read_few_partitions(spark):
    points, asked = clustered(2)
    _, opened = indexed(spark, vectors_of(spark, points))
    assert len(opened.model.centroids) == index_cells(360) and opened.sizes["c"].sum() == 360
    near = vector_index.search(opened, queries_of(spark, asked), 10, collection="c")
    exact = brute(points, asked, 10)
    assert len(found(near)) == 90 and len(found(near) & exact) >= 85
    one = vector_index.search(opened, queries_of(spark, asked[:1]), 10, collection="c")
    plan = one._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") :].split("]")[0]
    assert "collection" in filters and "cell" in filters
    read = {f.split("cell=")[1].split("/")[0] for f in one.inputFiles() if "cell=" in f}
    assert read and filters.count("cell") and len(filters) < 2000


def index_cells(rows):
    return vector_index.cells_for(rows)


def test_bounds_rule_out_cells_and_rows(spark):
    points, asked = clustered(3, centres=20, each=50)
    _, opened = indexed(spark, vectors_of(spark, points), 20)
    batch = vector_index._Asked(
        opened, queries_of(spark, asked).withColumn("document_id", F.lit(None).cast("string")).toArrow(), "c"
    )
    first = batch.nearest_cells(5, 1)
    assert first.sum(axis=1).max() <= 2
    bound = np.sort(1 - batch.unit @ (points / np.linalg.norm(points, axis=1, keepdims=True)).T, axis=1)[:, 4]
    bound = np.round(bound, 6)
    left = batch.scan(np.ones_like(first), 5, bound).count()
    assert 5 * len(asked) <= left <= 6 * len(asked)
    possible = batch.far - batch.reach <= np.sqrt(2 * (bound + vector_index.SLACK))[:, None]
    assert possible.sum() < 0.3 * possible.size


def test_cell_index_of_odd_rows(spark):
    points, asked = clustered(4, centres=3, each=10)
    points[5] = 0.0
    table = vectors_of(spark, points).unionByName(vectors_of(spark, points[:4], collection="other"))
    nulls = table.limit(2).withColumn("embedding", F.lit(None).cast("array<float>"))
    path, opened = indexed(spark, table.unionByName(nulls), 4)
    assert opened.sizes["c"].sum() == 30 and opened.sizes["other"].sum() == 4
    wanted = queries_of(spark, asked)
    for recall in (0.95, None):
        assert vector_index.search(opened, wanted, 50, collection="c", recall=recall).count() == 90
        assert vector_index.search(opened, wanted, 50, collection="other", recall=recall).count() == 12
        assert vector_index.search(opened, wanted, 5, collection="absent", recall=recall).count() == 0
        assert vector_index.search(opened, wanted.limit(0), 5, collection="c", recall=recall).count() == 0
    vector_index.write(vectors_of(spark, points[:4], collection="c").withColumn("chunk_id", F.concat(F.lit("n"), "chunk_id")), opened.model, path)
    assert vector_index.read(spark, path).sizes["c"].sum() == 34
    vector_index.write(vectors_of(spark, points[:4], model="b"), opened.model, path)
    with pytest.raises(ValueError):
        vector_index.read(spark, path)
    empty = vectors_of(spark, points).limit(0)
    assert vector_index.fit(empty).dim == 0


def test_similarity_branches(one):
    from quarryline.functions.vectors import relevance, similarity

    for distance, score in ((-3e-8, 1.0), (0.25, 0.75), (1.5, 0.4), (None, None)):
        assert one(similarity(F.col("x")), x=F.lit(distance).cast("double")) == score
    assert one(relevance(F.lit(None).cast("double"))) == 0.0


def brute_density(places):
    """Minimal covers by definition: windows holding all terms with no smaller one inside."""
    spots = sorted({p for ps in places for p in ps})
    holds = lambda a, b: all(any(a <= p <= b for p in ps) for ps in places)
    covers = [
        (a, b) for a in spots for b in spots
        if a <= b and holds(a, b) and not any(holds(x, y) for x in spots for y in spots if a <= x <= y <= b and (x, y) != (a, b))
    ]
    return round(sum(0.1 / (1 + (b - a) - (sum(a <= p <= b for p in spots) - 1)) for a, b in covers), 6)


def test_cover_density_against_the_definition(spark):
    rng = np.random.default_rng(3)
    rows = []
    for n in range(60):
        spots = rng.permutation(30)[: rng.integers(3, 14)] + 1
        owner = rng.integers(0, 1 + n % 3 + 1, len(spots))
        places = [sorted(int(s) for s, o in zip(spots, owner) if o == t) for t in sorted(set(owner))]
        rows.append((n, places))
    table = spark.createDataFrame(rows, "n int, places array<array<int>>")
    got = {r.n: r.score for r in table.select("n", fulltext.cover_density(F.col("places")).alias("score")).collect()}
    assert got == {n: pytest.approx(brute_density(places), abs=1e-6) for n, places in rows}


def chunks_of(spark, texts):
    return spark.createDataFrame(
        [(str(i), f"d{i}", "rag_chunks_v1", t) for i, t in enumerate(texts)],
        "chunk_id string, document_id string, collection string, content string",
    )


def test_all_terms_must_occur_and_stop_words_do_not_count(spark):
    texts = ["red apple and the pear", "red pear", "apple", "the and of", "Red, red APPLE!"] + ["red filler"] * 200
    asked = spark.createDataFrame([(1, "the red apple"), (2, "of the"), (3, "apple"), (4, "red unicorn")], "query_id long, text string")
    got = fulltext.search(index.postings(chunks_of(spark, texts)), asked, 300)
    assert {(r.query_id, r.chunk_id) for r in got.collect()} == {(1, "0"), (1, "4"), (3, "0"), (3, "2"), (3, "4")}


def test_document_filter_comes_before_the_cut(spark):
    texts = ["apple apple apple"] * 20 + ["apple"]
    asked = spark.createDataFrame([(1, "apple", "d20")], "query_id long, text string, document_id string")
    got = fulltext.search(index.postings(chunks_of(spark, texts)), asked, 3).collect()
    assert [(r.chunk_id, r.rank) for r in got] == [("20", 1)]


def test_postings_count_stop_words_as_places(spark):
    got = {r.term: (r.tf, r.positions) for r in index.postings(chunks_of(spark, ["a red the red fox"])).collect()}
    assert got == {"red": (2, [2, 4]), "fox": (1, [5])}


LEG = "query_id long, chunk_id string, document_id string, sequence int, score double, rank int"


def test_fusion_scores_and_ties(spark):
    vector = spark.createDataFrame([(1, "a", "d", 1, 0.5, 1), (1, "b", "d", 2, 0.4, 2)], LEG)
    words = spark.createDataFrame([(1, "b", "d", None, 0.1, 1), (1, None, "e", 7, 0.5, 1)], LEG)
    got = [(r.key, r.score) for r in fusion.fuse([vector, words]).orderBy("rank").collect()]
    assert got == [
        ("b", round(0.4 + 1 / 62 + 0.1 + 1 / 61, 6)), ("a", round(0.5 + 1 / 61, 6)), ("e/7", round(0.5 + 1 / 61, 6)),
    ]
    pure = [(r.key, r.score) for r in fusion.fuse([vector, words], mode="rrf").orderBy("rank").collect()]
    assert pure[0] == ("b", round(1 / 62 + 1 / 61, 6)) and pure[1][0] == "a"
    only = fusion.fuse([vector, words.limit(0)]).orderBy("rank").collect()
    assert [r.key for r in only] == ["a", "b"]


def test_variant_fusion_ranks_from_zero(spark):
    rows = [(1, 0, 0, "a", "d", None), (1, 1, 0, "b", "d", None), (1, 1, 1, "a", "d", None), (1, 1, 2, None, None, "text")]
    ranked = spark.createDataFrame(rows, "question_id long, variant int, position int, chunk_id string, document_id string, content string")
    got = [(r.key, r.score) for r in fusion.fuse_variants(ranked, 5).orderBy("rank").collect()]
    assert got[0] == ("d:a", round(1 / 60 + 1 / 61, 6)) and got[1] == ("d:b", round(1 / 60, 6))
    assert got[2][0] == "1cb251ec0d568de6a929b520c4aed8d1"


def test_weights_must_sum_to_one():
    with pytest.raises(ValueError):
        fusion.check_weights([0.7, 0.2])
    fusion.check_weights([0.7, 0.3005])


def test_unknown_search_options_raise(spark):
    with pytest.raises(ValueError):
        fusion.fuse([], mode="other")
    with pytest.raises(ValueError):
        vector_search.predicate("a", "like", 1)


def made_chunks(spark, seed, count=900):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(40)]
    weight = 1 / np.arange(1, 41)
    texts = [
        " ".join(["hot"] * int(rng.integers(0, 4)) + list(rng.choice(words, rng.integers(1, 30), p=weight / weight.sum())))
        for _ in range(count)
    ]
    return chunks_of(spark, texts)


def blocked(spark, chunks, size):
    path = fresh_path(spark, "blocks")
    stored = fresh_path(spark, "postings")
    index.postings(chunks).write.parquet(stored)
    blocks.write_blocks(blocks.blocks(spark.read.parquet(stored), size, 16), path)
    return blocks.read_blocks(spark, path)


def test_block_search_gives_the_rows_of_the_plain_search(spark):
    chunks = made_chunks(spark, 1)
    table = blocked(spark, chunks, 16)
    rows = [
        (1, "hot", None), (2, "w0 w1", None), (3, "w0 w1 w2 w3", None), (4, "w30", None), (5, "w5 absent", None),
        (6, "the of", None), (7, "hot w0", "d7"), (8, "w39 w38", None), (9, "w0", "d11"), (10, "w1 hot w2", None),
    ]
    asked = spark.createDataFrame(rows, "query_id long, text string, document_id string")
    for queries in (asked, asked.drop("document_id")):
        plain = fulltext.search(index.postings(chunks), queries, 6)
        want = {(r.query_id, r.chunk_id, r.document_id, r.score, r.rank) for r in plain.collect()}
        for at_once in (0, 10**9):
            got = blocks.search(table, queries, 6, buckets=16, first_blocks=2, at_once=at_once)
            assert {(r.query_id, r.chunk_id, r.document_id, r.score, r.rank) for r in got.collect()} == want
    none = blocks.search(table, asked.limit(0), 6, buckets=16)
    assert none.count() == 0


def shuffled_rows(spark, frame):
    """Rows that the exchanges of a plan moved, once it ran."""
    frame.collect()
    plan, moved = frame._jdf.queryExecution().executedPlan(), 0
    todo = [plan.executedPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan]
    while todo:
        node = todo.pop()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
        if "QueryStage" in node.nodeName():
            todo.append(node.plan())
        if node.nodeName() == "Exchange":
            moved += node.metrics().apply("shuffleRecordsWritten").value()
    return moved


def test_many_candidates_are_cut_before_common_terms_are_looked_up(spark, monkeypatch):
    texts = [f"common frequent often r{i % 7} s{i % 5} t{i % 3} u{i} v{i} x{i} y{i}" for i in range(600)]
    stored = fulltext.materialise(index.postings(chunks_of(spark, texts)), "postings")
    rows = [(q, f"common r{q % 7} s{q % 5} often t{q % 3}") for q in range(8)]
    rows += [(20, "common often"), (21, "common absent"), (22, "frequent"), (23, "r1 s1"), (23, "t1 often")]
    terms = fulltext.query_terms(spark.createDataFrame(rows, "query_id long, text string"))
    found = lambda frame: sorted((r.query_id, r.chunk_id, sorted(map(tuple, r.places))) for r in frame.collect())
    want = found(fulltext.match(stored, terms))
    assert {q for q, *_ in want} == {*range(8), 20, 22, 23}
    monkeypatch.setattr(fulltext, "MAX_BROADCAST_TERMS", 25)
    matched = fulltext.match(stored, terms)
    assert found(matched) == want
    # Terms that nobody asked for, over half of the postings, do not move.
    assert shuffled_rows(spark, matched) < stored.count()


def test_blocks_are_bounded_and_skipped(spark):
    chunks = made_chunks(spark, 2)
    table = blocked(spark, chunks, 16)
    whole = index.postings(chunks)
    assert table.agg(F.sum("n"), F.max("n")).first()[:] == (whole.count(), 16)
    entries = table.select("term", "tf", "first_chunk", F.explode("entries").alias("e"))
    assert entries.filter("size(e.positions) <> tf or e.chunk_id < first_chunk").count() == 0
    asked = spark.createDataFrame([(1, "hot"), (2, "w0"), (3, "w0 w1")], "query_id long, text string")
    terms = fulltext.query_terms(asked)
    planned = blocks.planned_blocks(table, terms)
    first = blocks.scored(table, terms, planned.filter("place <= 2"))
    order = [F.col("score").desc(), F.col("chunk_id")]
    best = blocks.top_per_group(first, ["query_id"], order, 5)
    rest = planned.filter("place > 2")
    needed = {r.query_id: r.n for r in blocks.needed_blocks(rest, best, 5).groupBy("query_id").agg(F.count("*").alias("n")).collect()}
    there = {r.query_id: r.n for r in rest.groupBy("query_id").agg(F.count("*").alias("n")).collect()}
    assert there[1] > 25 and needed.get(1, 0) <= 1
    assert there[2] > 20 and needed.get(2, 0) <= there[2] / 4


def test_no_chunk_scores_over_its_bound(spark):
    rng = np.random.default_rng(9)
    rows = []
    for n in range(200):
        spots = rng.permutation(24)[: rng.integers(2, 20)] + 1
        owner = rng.integers(0, 1 + n % 4, len(spots))
        rows.append((n, [sorted(int(s) for s, o in zip(spots, owner) if o == t) for t in sorted(set(owner))]))
    table = spark.createDataFrame(rows, "n int, places array<array<int>>")
    least = F.array_min(F.transform("places", lambda p: F.size(p)))
    over = table.filter(fulltext.cover_density(F.col("places")) > blocks.bound(F.size("places"), least))
    assert over.count() == 0
