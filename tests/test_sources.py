from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import functions as F

from quarryline.operators import fulltext, index, vector_search
from quarryline.session import fresh_path
from quarryline.sources import readers, writers


def test_raw_objects_are_measured_and_found(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.pdf").write_bytes(b"one")
    (tmp_path / "y.pdf").write_bytes(b"")
    rows = {r.path.rsplit("/", 1)[1]: r for r in readers.measured(readers.raw_objects(spark, str(tmp_path))).collect()}
    assert rows["x.pdf"].size_bytes == 3 and rows["x.pdf"].sha256 == hashlib.sha256(b"one").hexdigest()
    listing = readers.raw_objects(spark, str(tmp_path))
    wanted = spark.createDataFrame([(rows["x.pdf"].path,), ("nowhere",)], "path string")
    assert {r.path: r.object_exists for r in readers.present(wanted, listing).collect()} == {rows["x.pdf"].path: True, "nowhere": False}


def test_text_objects_lie_in_few_folders_and_name_their_document(spark, tmp_path):
    path = str(tmp_path / "objects")
    rows = [(str(i), f"text {i}\n") for i in range(2000)] + [("a b", "one"), ("a b", "two"), ("7.8.txt", ""), (None, None)]
    writers.write_texts(spark.createDataFrame(rows, "document_id string, content string").coalesce(1), path)
    # A folder per document makes a writer and a listing go through as many folders as documents.
    assert sum(p.is_dir() for p in (tmp_path / "objects").rglob("*")) <= 256
    objects = readers.raw_objects(spark, path, "*.txt").withColumn("document_id", writers.object_owner(F.col("path")))
    found = {r.document_id: bytes(r.content) for r in objects.collect()}
    assert found.pop("a b") == b"one\ntwo\n" and found.pop("7.8.txt") == b"\n"
    assert found.pop(writers.DEFAULT_OWNER) == b"\n"
    assert found == {str(i): f"text {i}\n\n".encode() for i in range(2000)}


def test_objects_are_listed_by_tasks_and_are_those_of_sparks_reader(spark, tmp_path, monkeypatch):
    names = ["x.txt", "a/y z.txt", "a/_out.txt", "a/_k=1.txt", "a/_b/q.txt", ".h/p.txt", "_x=1/c d/m%20.txt", "a/e{1}.txt", "a/empty.txt", "a/n._COPYING_", "a/b/é.TXT"]
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"" if "empty" in name else name.encode() * 3)
    (tmp_path / "a" / "to_x.txt").symlink_to(tmp_path / "x.txt")
    (tmp_path / "a" / "to_nothing.txt").symlink_to(tmp_path / "nothing")
    rows = lambda frame: sorted((r.path, r.modificationTime, r.length, bytes(r.content)) for r in frame.collect())
    for pattern in ("*", "*.txt", "[a-n]*.{txt,TXT}"):
        plain = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(str(tmp_path))
        found = readers.raw_objects(spark, str(tmp_path), pattern)
        assert rows(found) == rows(plain) and found.schema == plain.schema
        # The driver knows the tables of the listing only, and contents are not read for paths.
        assert not [f for f in found.inputFiles() if str(tmp_path) in f]
        assert "_contents" not in found.select("path")._jdf.queryExecution().executedPlan().toString()
    (tmp_path / "none").mkdir()
    assert rows(readers.raw_objects(spark, str(tmp_path / "none"))) == []
    # Few entries and bytes at a time are the same entries and bytes.
    paths = [str(tmp_path / n) for n in names]
    monkeypatch.setattr(readers, "BYTES_AT_ONCE", 20)
    parts = list(readers._contents(iter([pa.array(paths[:4]), pa.array(paths[4:])])))
    assert len(parts) > 3 and [c for p in parts for c in p.to_pylist()] == [(tmp_path / n).read_bytes() for n in names]
    whole = [r for b in readers._entries(iter([pa.record_batch([[str(tmp_path), str(tmp_path / "a")]], ["path"])])) for r in b.to_pylist()]
    monkeypatch.setattr(readers, "ENTRIES_AT_ONCE", 2)
    few = list(readers._entries(iter([pa.record_batch([[str(tmp_path), str(tmp_path / "a")]], ["path"])])))
    assert max(b.num_rows for b in few) == 2 and [r for b in few for r in b.to_pylist()] == whole


def test_page_files_keep_page_order(spark, tmp_path):
    (tmp_path / "doc-1.txt").write_text("first\fsecond\nline")
    got = readers.page_files(spark, str(tmp_path)).orderBy("page_no").collect()
    assert [(r.document_id, r.page_no, r.text) for r in got] == [("doc-1", 1, "first"), ("doc-1", 2, "second\nline")]


def stored_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(
        F.col("vec_id").cast("string").alias("chunk_id"), F.lit("d").alias("document_id"), F.lit(1).alias("sequence"),
        F.when(F.col("label") < 5, "a").otherwise("b").alias("collection"), F.lit("m").alias("model_name"), "embedding",
    )
    path = fresh_path(spark, "vectors")
    writers.write_vectors(table, path, files=4)
    return table, spark.read.parquet(path)


def test_a_collection_scan_prunes_partitions(spark):
    table, stored = stored_vectors(spark)
    found = readers.collection(stored, "a")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(collection" in plan
    assert found.count() == table.filter("collection = 'a'").count()


def test_a_stored_bucket_index_gives_the_same_hits(spark):
    table, _ = stored_vectors(spark)
    indexed = index.with_buckets(table)
    path = fresh_path(spark, "buckets")
    index.write_buckets(indexed, path, files_per_bucket=1)
    asked = table.limit(5).select(F.col("chunk_id").cast("long").alias("query_id"), "embedding")
    hits = lambda source: {(r.query_id, r.chunk_id, r.distance) for r in vector_search.approximate_knn(source, asked, 5).collect()}
    assert hits(spark.read.parquet(path)) == hits(indexed)


def test_stored_postings_search_like_fresh_ones(spark):
    chunks = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(
        F.col("doc_id").cast("string").alias("chunk_id"), F.col("doc_id").cast("string").alias("document_id"),
        F.lit("rag_chunks_v1").alias("collection"), F.col("text").alias("content"),
    )
    path = fresh_path(spark, "postings")
    index.write_postings(index.postings(chunks), path, buckets=8, files_per_bucket=2)
    asked = spark.createDataFrame([(1, "erons"), (2, "whou the"), (3, "and")], "query_id long, text string")
    terms = fulltext.query_terms(asked)
    stored = index.read_postings(spark, path, terms, buckets=8)
    hits = lambda source: {(r.query_id, r.chunk_id, r.score) for r in fulltext.search(source, asked, 5).collect()}
    assert hits(stored) == hits(index.postings(chunks))


def test_empty_upserts_rewrite_nothing(spark):
    table, stored = stored_vectors(spark)
    assert writers.rewrite_vectors(stored, table.limit(0), fresh_path(spark, "none")) is stored


def test_search_reads_only_the_partitions_of_its_terms(spark, capfd):
    from quarryline.operators import fulltext

    chunks = spark.createDataFrame(
        [(str(i), "d", i, "c", f"word{i} common") for i in range(200)],
        "chunk_id string, document_id string, sequence int, collection string, content string",
    )
    path = fresh_path(spark, "postings")
    index.write_postings(index.postings(chunks), path, buckets=32, files_per_bucket=1)
    asked = spark.createDataFrame([(1, "word7"), (2, "word9")], "query_id long, text string")
    stored = index.read_postings(spark, path)
    found = fulltext.search(stored, asked, 5, collection="c", buckets=32)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [term_bucket" in plan.replace("isnotnull(term_bucket#", "term_bucket")
    assert {(r.query_id, r.chunk_id, r.sequence) for r in found.collect()} == {(1, "7", 7), (2, "9", 9)}


def test_stemmed_postings_find_other_forms(spark, one):
    from quarryline.functions.text import stem
    from quarryline.operators import fulltext

    groups = (("revenue", "revenues"), ("price", "priced", "pricing", "prices"), ("company", "companies"), ("plan", "planned", "planning"), ("process", "processes"))
    for forms in groups:
        assert len({one(stem(F.col("x")), x=f) for f in forms}) == 1, forms
    assert one(stem(F.col("x")), x="bus") == "bus" and one(stem(F.col("x")), x="red") == "red"
    chunks = spark.createDataFrame([("1", "d", 1, "c", "Revenues grew")], "chunk_id string, document_id string, sequence int, collection string, content string")
    asked = spark.createDataFrame([(1, "revenue")], "query_id long, text string")
    found = lambda s: fulltext.search(index.postings(chunks, stem=s), asked, 5, collection="c", stem=s).count()
    assert (found(True), found(False)) == (1, 0)


def test_no_file_of_stored_postings_grows_with_the_table(spark, tmp_path):
    texts = spark.range(6000).select(
        F.col("id").cast("string").alias("chunk_id"), F.concat_ws(" ", *(F.sha2((F.col("id") * 9 + i).cast("string"), 256) for i in range(9))).alias("content")
    )
    table, path = index.postings(texts.repartition(8)), str(tmp_path / "postings")
    with_small_parts = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "200k"}
    for key, value in with_small_parts.items():
        spark.conf.set(key, value)
    try:
        index.write_postings(table, path, buckets=2, files_per_bucket=1)
    finally:
        for key in with_small_parts:
            spark.conf.unset(key)
    stored = spark.read.parquet(path)
    rows = [r["count"] for r in stored.groupBy(F.input_file_name()).count().collect()]
    assert sum(rows) == 54_000 and len(rows) > 8 and max(rows) < 54_000 / 8
    assert sorted(map(tuple, stored.select("chunk_id", "term", "tf").collect())) == sorted(map(tuple, table.select("chunk_id", "term", "tf").collect()))
