from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quarryline.functions.ranking import positions
from quarryline.operators import answer, catalog, costs, grade, requests

GRADES = "query_id long, rank int, chunk_id string, relevance double, supportiveness double, usefulness double"


def graded(spark, scores):
    return spark.createDataFrame([(1, i + 1, str(i + 1), r, s, 0.0) for i, (r, s) in enumerate(scores)], GRADES)


def test_fast_filter_falls_back_to_the_first_five(spark):
    kept = lambda scores: sorted(r["rank"] for r in grade.filter_fast(graded(spark, scores)).collect())
    assert kept([(0.1, 0.1)] * 7) == [1, 2, 3, 4, 5]
    assert kept([(0.1, 0.1), (0.6, 0.5), (0.9, 0.4)]) == [2]
    assert kept([(0.1, 0.1)] * 5 + [(0.9, 0.9)]) == [1, 2, 3, 4, 5]


def test_score_parsing(spark):
    texts = [
        ('{"relevance": "0.5", "supportiveness": true}', (0.5, 1.0, 0.0)), ("nope", (0.0, 0.0, 0.0)),
        ('{"relevance": null, "usefulness": 1}', (0.0, 0.0, 0.0)), ('{"relevance": [1]}', (0.0, 0.0, 0.0)),
        ('{"usefulness": 1e-1}', (0.0, 0.0, 0.1)), ("[]", (0.0, 0.0, 0.0)),
    ]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "i int, raw string")
    got = {r.i: (r.relevance, r.supportiveness, r.usefulness) for r in grade.parse_scores(rows).collect()}
    assert got == {i: want for i, (_, want) in enumerate(texts)}


def test_evidence_needs_two_or_takes_the_best_five(spark):
    def chosen(scores):
        ordered = grade.sort_graded(graded(spark, scores))
        return sorted(int(r.chunk_id) for r in grade.select_evidence(ordered).collect())

    assert chosen([(0.9, 0.9), (0.1, 0.1), (0.8, 0.8)]) == [1, 3]
    assert chosen([(0.9, 0.9)] + [(0.1, 0.1)] * 6) == [1, 2, 3, 4, 5]
    assert chosen([(0.9, 0.9)]) == [1]
    assert chosen([(0.9, 0.9)] * 8) == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("words, score", [(9, 0.8), (10, 0.7), (20, 0.9), (200, 0.9), (201, 0.8), (301, 0.7)])
def test_confidence_length_bands(one, words, score):
    assert one(answer.confidence(F.col("x"), F.lit(5)), x="w " * words) == pytest.approx(score)


def test_confidence_is_clamped(one):
    doubt = "maybe possibly unclear not sure i don't know"
    assert one(answer.confidence(F.col("x"), F.lit(0)), x=doubt) == pytest.approx(0.1)
    assert one(answer.confidence(F.col("x"), F.lit(0)), x="") == pytest.approx(0.5)


def test_templates_leave_other_braces_alone(one):
    assert one(answer.fill('{"a": 1} {q} {q}', q=F.lit("x"))) == '{"a": 1} x x'


@pytest.mark.parametrize("tokens, cost", [((3, 1), ("0.0000", "0.0001", "0.0001")), ((10, 0), ("0.0002", "0.0000", "0.0002"))])
def test_costs_round_half_up(spark, tokens, cost):
    parts = costs.call_costs(F.lit(tokens[0]), F.lit(tokens[1]))
    assert tuple(str(v) for v in spark.range(1).select(*parts).first()) == cost


def test_unknown_columns_raise(spark):
    rows = spark.createDataFrame([("a", 1)], "id string, n int")
    with pytest.raises(ValueError):
        catalog.matching(rows, doc_type="x")
    with pytest.raises(ValueError):
        catalog.list_rows(rows, order_by="-created_at")
    assert catalog.count(rows, n=None) == 1 and catalog.exists(rows, n=[1, 2]) and not catalog.exists(rows, n=3)


def test_positions_split_hot_groups_and_stay_exact(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).alias("g"), (F.col("id") * 3).alias("o"))
    ranked = positions(rows, ["g"], "o", width=100).collect()
    seen = {}
    for r in sorted(ranked, key=lambda r: (r.g, r.o)):
        seen[r.g] = seen.get(r.g, 0) + 1
        assert r.position == seen[r.g]


@pytest.mark.parametrize("folded", [0, 40, 10**6])
def test_accepted_requests_follow_the_one_by_one_rule(spark, folded):
    rng = random.Random(5)
    rows, at = [], 0
    for i in range(3000):
        at += rng.choice([0, 1, 5, 20, 90]) if i % 400 else 9000
        rows.append((i, "hot" if rng.random() < 0.5 else rng.choice("abc"), at))
    last, want = {}, set()
    for i, key, at in sorted(rows, key=lambda r: (r[2], r[0])):
        if key not in last or at - last[key] >= 100:
            last[key] = at
            want.add(i)
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "request_id long, key string, at long").withColumn("ts", F.timestamp_seconds("at"))
    got = {r.request_id for r in requests.accept_first(table, 100, folded=folded).filter("accepted").collect()}
    assert got == want


def test_idempotency_key_ignores_argument_order(spark):
    rows = spark.createDataFrame([({"a": "1", "b": "2"},), ({"b": "2", "a": "1"},)], "args map<string,string>")
    keys = {r[0] for r in rows.select(requests.idempotency_key(F.lit("t"), F.col("args"))).collect()}
    assert len(keys) == 1


def test_cascade_flags(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "id string")
    chunks = spark.createDataFrame([("1", "a"), ("2", "b")], "chunk_id string, document_id string")
    vectors = spark.createDataFrame([("1",), ("2",)], "chunk_id string")
    doomed = spark.createDataFrame([("a",)], "id string")
    size = lambda **o: {k: v.count() for k, v in catalog.delete_cascade(doomed, rows, chunks, vectors, **o).items()}
    assert size() == {"catalog": 1, "chunks": 1, "vectors": 1}
    assert size(delete_embeddings=False) == {"catalog": 1, "chunks": 1, "vectors": 2}
    assert size(delete_chunks=False) == {"catalog": 1, "chunks": 2, "vectors": 2}


def test_every_wording_has_a_number_of_its_own(spark):
    from quarryline.plans.self_rag import numbered_wordings

    rows = spark.range(700).selectExpr("id % 5 as query_id", "cast(floor(id / 5) as int) as variant", "'x' as text")
    numbered = numbered_wordings(rows.repartition(7)).collect()
    assert len({r.wording for r in numbered}) == 700
    assert {(r.query_id, r.variant) for r in numbered} == {(i % 5, i // 5) for i in range(700)}
