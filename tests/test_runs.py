from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quarryline.operators import costs, partials
from quarryline.session import fresh_path
from quarryline.sources import runs


def ids(spark, path, table):
    return sorted(r.id for r in runs.read(spark, path, table).collect())


def test_a_run_that_fails_between_two_tables_shows_nothing(spark):
    path = fresh_path(spark, "runs")
    with pytest.raises(ValueError):
        runs.read(spark, path, "vectors")
    runs.commit(spark, path, "a", {"vectors": spark.range(3), "status": spark.range(1)})
    broken = spark.range(9).select(F.raise_error(F.lit("lost")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        runs.commit(spark, path, "b", {"vectors": spark.range(10, 12), "status": broken})
    assert ids(spark, path, "vectors") == [0, 1, 2] and ids(spark, path, "status") == [0]
    runs.commit(spark, path, "b", {"vectors": spark.range(10, 12), "status": spark.range(5, 6)})
    assert ids(spark, path, "vectors") == [0, 1, 2, 10, 11] and ids(spark, path, "status") == [0, 5]
    runs.commit(spark, path, "a", {"vectors": spark.range(1), "status": spark.range(0)})
    assert ids(spark, path, "vectors") == [0, 10, 11] and ids(spark, path, "status") == [5]


def test_readers_read_marked_folders_only(spark, monkeypatch):
    path = fresh_path(spark, "runs")
    for run in "abc":
        runs.commit(spark, path, run, {"t": spark.range(2)})
    runs.commit(spark, path, "a", {"t": spark.range(7, 8)})
    read = runs.read(spark, path, "t", with_run=True)
    assert len(read.inputFiles()) >= 4 and "PartitionFilters: [attempt" in read._jdf.queryExecution().toString()
    want = sorted((r.id, r.run) for r in read.collect())
    monkeypatch.setattr(runs, "NAMED_ATTEMPTS", 1)
    assert sorted((r.id, r.run) for r in runs.read(spark, path, "t", with_run=True).collect()) == want
    assert want == [(0, "b"), (0, "c"), (1, "b"), (1, "c"), (7, "a")]


def test_names_and_columns_that_clash(spark):
    path = fresh_path(spark, "runs")
    with pytest.raises(ValueError):
        runs.commit(spark, path, "a/b", {"t": spark.range(1)})
    with pytest.raises(ValueError):
        runs.commit(spark, path, "a", {"t": spark.range(1).withColumnRenamed("id", "Run")})


EVENTS = "ts timestamp, provider string, model string, route string, tenant int, total_tokens long, cost_total_usd decimal(12,6)"


def events(spark, rows):
    return spark.createDataFrame(rows, EVENTS)


def test_batches_merge_to_the_rollup_of_all(spark):
    import datetime as dt
    import random
    from decimal import Decimal

    rng = random.Random(3)
    rows = [
        (
            None if i % 97 == 0 else dt.datetime(2024, 1, 1 + rng.randrange(6), rng.randrange(24)),
            "p", rng.choice(["m1", "m2", None]), rng.choice("ab"), rng.randrange(40),
            rng.choice([None, rng.randrange(500)]), Decimal(rng.randrange(10**6)) / 10**6,
        )
        for i in range(600)
    ]
    path = fresh_path(spark, "partials")
    batches = [rows[:300], rows[300:500], rows[500:]]
    for i, batch in enumerate(batches):
        partials.append(spark, path, f"b{i}", events(spark, batch))
    partials.append(spark, path, "b1", events(spark, batches[1]))
    partials.append(spark, path, "none", events(spark, []))

    whole = {
        (r.period and r.period.date(), r.provider, r.model, r.route): (r.calls, r.tokens, r.spend)
        for r in costs.rollup(events(spark, rows)).collect()
    }

    def merged(**days):
        found = partials.rollup(spark, path, **days).collect()
        return {(r.day, r.provider, r.model, r.route): (r.calls, r.tokens, r.spend) for r in found}

    assert merged() == whole
    two = merged(first="2024-01-02", last="2024-01-03")
    assert two == {k: v for k, v in whole.items() if k[0] and dt.date(2024, 1, 2) <= k[0] <= dt.date(2024, 1, 3)}
    tenants = partials.rollup(spark, path, by=[], first="2024-01-02", last="2024-01-02").first()
    true = {r[4] for r in rows if r[0] and r[0].date() == dt.date(2024, 1, 2)}
    assert abs(tenants.distinct_values - len(true)) <= 1

    assert partials.fold(spark, path, "fold-1") == ["b0", "b1", "b2", "none"]
    assert merged() == whole
    with pytest.raises(ValueError):
        partials.append(spark, path, "b1", events(spark, batches[1]))
    late = [(dt.datetime(2024, 1, 2), "p", "m1", "a", 1, 5, Decimal("0.5"))]
    partials.append(spark, path, "late", events(spark, late))
    changed = {k: v for k, v in merged().items() if whole.get(k) != v}
    assert set(changed) == {(dt.date(2024, 1, 2), "p", "m1", "a")}


def test_an_ingest_is_published_at_once(spark):
    from quarryline.plans import ingest_job

    path = fresh_path(spark, "published")
    vectors = spark.createDataFrame([("c1", "d1")], "chunk_id string, document_id string")
    manifests = spark.createDataFrame([("d1", "r1")], "document_id string, run_id string")
    steps = spark.createDataFrame([("d1", 0, "indexed", "r1")], "id string, step int, status string, run_id string")
    done = ingest_job.Ingested(vectors, manifests, steps, steps)
    ingest_job.publish(done, path, "r1")
    broken = manifests.withColumn("run_id", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        ingest_job.publish(ingest_job.Ingested(vectors, broken, steps, steps), path, "r2")
    ingest_job.publish(done, path, "r1")
    assert {name: table.count() for name, table in ingest_job.published(spark, path).items()} == {
        "vectors": 1, "manifests": 1, "transitions": 1,
    }
