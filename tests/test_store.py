"""Stored tables in buckets: what a change touches, and what it leaves alone."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from quarryline.operators import catalog, index
from quarryline.session import fresh_path, work_dir
from quarryline.sources import store

ROW = "chunk_id string, document_id string, content string, metadata map<string,string>"


def rows_of(spark, documents, each=5, content="old"):
    return spark.createDataFrame(
        [(f"{d}:{c}", f"d{d}", content, {"n": str(c)}) for d in documents for c in range(each)], ROW
    )


def files_of(path):
    found = {}
    for folder, _, names in os.walk(f"{path.removeprefix('file:')}/rows"):
        found |= {f"{folder}/{n}": os.stat(f"{folder}/{n}").st_mtime_ns for n in names if n.endswith(".parquet")}
    return found


def content(table):
    return sorted((r.chunk_id, r.document_id, r.content, sorted(r.metadata.items())) for r in table.collect())


@pytest.mark.parametrize("files", [1, 3])
def test_an_upsert_rewrites_only_the_buckets_it_touches(spark, files):
    path = fresh_path(spark, "store")
    old = rows_of(spark, range(400))
    store.create(old, path, "document_id", 64, files)
    assert content(store.read(spark, path)) == content(old)
    before = files_of(path)
    new = rows_of(spark, [3, 4, 400, 401], content="new")
    touched = store.upsert(spark, path, new)
    after = files_of(path)
    gone = set(before) - set(after)
    assert 0 < len(gone) < len(before) / 10
    assert {f.split("bucket=")[1].split("/")[0] for f in gone} == {str(b) for b in touched}
    assert all(after[f] == before[f] for f in set(before) & set(after))
    want = content(index.upsert(old, new))
    assert content(store.read(spark, path)) == want
    # Once more changes nothing.
    store.upsert(spark, path, new)
    assert content(store.read(spark, path)) == want
    assert store.upsert(spark, path, new.limit(0)) == []


def test_deletes_empty_whole_buckets_and_cascade(spark):
    chunks, documents = fresh_path(spark, "chunks"), fresh_path(spark, "documents")
    rows = rows_of(spark, range(40))
    names = rows.select(F.col("document_id").alias("id")).distinct()
    store.create(rows, chunks, "document_id", 8)
    store.create(names, documents, "id", 8)
    first = store.read(spark, chunks).select("document_id").first()[0]
    bucket = store.touched(spark, chunks, spark.createDataFrame([(first,)], "document_id string"))
    doomed = names.filter(store.bucket_of("id", 8) == bucket[0])
    store.delete_cascade(spark, doomed, documents, [chunks])
    gone = {r.id for r in doomed.collect()}
    assert gone and not any(f"bucket={bucket[0]}/" in f for f in files_of(chunks))
    assert {r.id for r in store.read(spark, documents).collect()} == {f"d{i}" for i in range(40)} - gone
    assert store.read(spark, chunks).count() == 5 * (40 - len(gone))
    store.delete_cascade(spark, names, documents, [chunks])
    assert store.read(spark, chunks).count() == store.read(spark, documents).count() == 0
    store.upsert(spark, chunks, rows)
    assert content(store.read(spark, chunks)) == content(rows)


def test_stored_updates_are_those_of_the_batch(spark):
    path = fresh_path(spark, "catalog")
    rows = spark.range(300).select(F.col("id").cast("string").alias("id"), F.lit("new").alias("status"), F.lit(None).cast("timestamp").alias("updated_at"))
    store.create(rows, path, "id", 32)
    changes = spark.createDataFrame([("7", "done"), ("250", "done"), ("none", "done")], "id string, status string")
    now = F.timestamp_seconds(F.lit(5))
    before = files_of(path)
    store.update(spark, path, changes, now)
    assert len(set(before) - set(files_of(path))) <= 3
    mine = sorted(map(tuple, store.read(spark, path).collect()), key=str)
    assert mine == sorted(map(tuple, catalog.update(rows, changes, now).collect()), key=str)
    with pytest.raises(ValueError):
        store.change(spark, path, changes.select("id").limit(1), lambda part: part.withColumn("id", F.concat(F.lit("moved"), "id")))


def test_rows_that_differ_in_metadata_alone_have_an_order(spark):
    old = rows_of(spark, [1], 1)
    pair = spark.createDataFrame([("1:0", "d1", "x", {"a": "1", "b": "2"}), ("1:0", "d1", "x", {"a": "1", "b": "3"})], ROW)
    for incoming in (pair, pair.orderBy(F.desc(F.col("metadata")["b"]))):
        assert content(index.upsert(old, incoming.coalesce(1))) == [("1:0", "d1", "x", [("a", "1"), ("b", "3")])]


def test_buckets_follow_the_rows(spark):
    assert [store.buckets_for(n, 1000) for n in (0, 1, 1000, 1001, 10**9)] == [1, 1, 1, 2, 10**6]
    assert work_dir(spark)
