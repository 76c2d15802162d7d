from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.operators.index import upsert
from quarryline.plans.corpus import ingest
from quarryline.session import fresh_path
from quarryline.streaming import ingest as streamed


def pages(spark):
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("transcript", "release", "slides", "press")]), (F.col("doc_id") % 4 + 1).cast("int"))
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(
        F.col("doc_id").cast("string").alias("document_id"), kinds.alias("document_type"), F.lit(1).alias("page_no"), "text"
    )


def content(table):
    return sorted((r.chunk_id, r.document_id, r.sequence, r.content) for r in table.collect())


def test_stream_equals_batch_and_a_second_arrival_changes_nothing(spark):
    source, target, checkpoint = (fresh_path(spark, n) for n in ("pages", "target", "checkpoint"))
    pages(spark).repartition(3, "document_id").write.parquet(source)
    run = lambda: streamed.ingest_stream(
        streamed.page_stream(spark, source, files_per_batch=1), target, checkpoint, files=2
    ).awaitTermination()
    run()
    batch = content(ingest(pages(spark)))
    assert content(streamed.latest_rows(spark, target)) == batch
    pages(spark).limit(20).coalesce(1).write.mode("append").parquet(source)
    run()
    assert content(streamed.latest_rows(spark, target)) == batch


def test_a_document_whose_pages_come_in_several_batches_is_ingested_whole(spark):
    source, target, checkpoint = (fresh_path(spark, n) for n in ("pages", "target", "checkpoint"))
    schema = "document_id string, document_type string, page_no int, text string"
    rows = [("a", "press", 1, "first page"), ("a", "press", 2, "second page"), ("b", "press", 1, "other"), ("a", "press", 1, "changed page")]
    for row in rows:
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(source)
        streamed.ingest_stream(streamed.page_stream(spark, source), target, checkpoint, buckets=4).awaitTermination()
    whole = spark.createDataFrame([rows[3], rows[1], rows[2]], schema)
    assert content(streamed.latest_rows(spark, target)) == content(ingest(whole))


def test_upsert_twice_is_upsert_once(spark):
    table = ingest(pages(spark))
    new = table.limit(50).withColumn("content", F.lit("new"))
    once = upsert(table, new)
    assert once.count() == table.count()
    assert content(upsert(once, new)) == content(once)


def test_streamed_requests_follow_the_batch_rule_over_several_batches(spark):
    from quarryline.operators.requests import accept_first
    from quarryline.streaming import dedup

    rows = spark.range(2000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 11).cast("string")).alias("key"),
        F.col("id").alias("request_id"),
        F.timestamp_seconds(F.col("id") * 37).alias("ts"),
    )
    source, target, checkpoint = (fresh_path(spark, n) for n in ("requests", "accepted", "checkpoint"))

    def run():
        stream = spark.readStream.schema("key string, request_id long, ts timestamp").parquet(source)
        dedup.accept_first_stream(stream, target, checkpoint).awaitTermination()

    for low in range(0, 2000, 500):
        rows.filter(F.col("request_id").between(low, low + 499)).coalesce(1).write.mode("append").parquet(source)
        run()
    run()
    want = {r.request_id for r in accept_first(rows).filter("accepted").collect()}
    assert {r.request_id for r in dedup.accepted_rows(spark, target).collect()} == want


def requests_of(spark):
    return spark.range(1500).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 11).cast("string")).alias("key"),
        F.col("id").alias("request_id"),
        F.timestamp_seconds(F.col("id") * 37 + 1_000_000).alias("ts"),
    )


def test_a_batch_reads_the_state_of_the_one_before_and_no_output(spark):
    from quarryline.operators.requests import accept_first
    from quarryline.streaming import dedup

    rows = requests_of(spark)
    source, target, checkpoint = (fresh_path(spark, n) for n in ("requests", "accepted", "checkpoint"))
    got = set()
    for number, low in enumerate(range(0, 1500, 500)):
        rows.filter(F.col("request_id").between(low, low + 499)).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("key string, request_id long, ts timestamp").parquet(source)
        dedup.accept_first_stream(stream, target, checkpoint, keep_seconds=7200).awaitTermination()
        output = f"{target}/batch={number}"
        got |= {r.request_id for r in spark.read.parquet(output).collect()}
        # What was accepted is not looked at again.
        spark.createDataFrame([], "key string, request_id long, ts timestamp").write.mode("overwrite").parquet(output)
    assert got == {r.request_id for r in accept_first(rows).filter("accepted").collect()}
    state = spark.read.parquet(f"{target}/_state/batch=2")
    spread = state.agg(F.unix_seconds(F.max("last")) - F.unix_seconds(F.min("last")), F.count("*")).first()
    assert spread[0] < 7200 and 0 < spread[1] <= 12


def test_keyed_state_follows_the_batch_rule_and_is_cleared(spark):
    from quarryline.operators.requests import accept_first
    from quarryline.streaming import dedup

    rows = requests_of(spark)
    once = rows.unionByName(spark.createDataFrame([("once", 5000, 1_000_000)], "key string, request_id long, s long").select("key", "request_id", F.timestamp_seconds("s").alias("ts")))
    source, target, checkpoint = (fresh_path(spark, n) for n in ("requests", "keyed", "checkpoint"))
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for low in range(0, 1500, 500):
            part = once.filter(F.col("ts").between(F.timestamp_seconds(F.lit(low * 37 + 1_000_000)), F.timestamp_seconds(F.lit((low + 499) * 37 + 1_000_000))))
            part.orderBy(F.rand(1)).coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema("key string, request_id long, ts timestamp").parquet(source)
            query = dedup.accept_first_keyed(stream).writeStream.option("checkpointLocation", checkpoint).trigger(
                availableNow=True
            ).format("parquet").start(target)
            query.awaitTermination()
        left = spark.read.format("statestore").option("stateVarName", "last").load(checkpoint)
        keys = {r.key.key for r in left.collect()}
    finally:
        spark.conf.set(provider, before)
    got = [r.request_id for r in spark.read.parquet(target).collect()]
    want = {r.request_id for r in accept_first(once).filter("accepted").collect()}
    assert len(got) == len(set(got)) and set(got) == want
    assert "once" not in keys and "hot" in keys
