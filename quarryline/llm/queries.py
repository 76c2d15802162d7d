"""Registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm import (
    centroid_clusters,
    decontaminate,
    exact_dedup,
    html_text,
    impact_search,
    langid,
    packing,
    periodic_runs,
    simhash,
    substring_dedup,
    suffix_dedup,
    url_filter,
    warc,
)
from quarryline.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(build):
    QUERIES[build.__name__] = build
    return build


@query
def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


@query
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        "kept",
        F.col("sha256").alias("text_sha256"),
    )


SQL["op5_exact_dedup"] = """
WITH texts AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
  FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY body) AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY body) AS kept,
       sha256(body) AS text_sha256
FROM texts
"""


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs, ~langid.held_out())
    rows = docs.select("doc_id", "text", langid.held_out().alias("held_out"))
    return langid.predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")


@query
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return found.select(
        F.col("id").alias("doc_id"),
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


@query
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


@query
def op1_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.write(table(spark, sf_dir, "pages"))
    found = warc.read(spark, archive)
    return found.select(
        "page_id",
        "payload_bytes",
        "payload_digest",
        "record_type",
        "refers_to",
        F.length("record").cast("long").alias("record_bytes"),
    )


SQL["op1_warc_archive"] = """
WITH bodies AS (
  SELECT page_id, url, coalesce(html, '') AS body, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
typed AS (
  SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY body) END AS original FROM bodies),
known AS (SELECT *, original > page_id AS revisit FROM typed)
SELECT page_id,
       CAST(n AS bigint) AS payload_bytes,
       sha1(body) AS payload_digest,
       CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN revisit THEN original END AS refers_to,
       CAST(octet_length(encode('WARC/1.1' || 'WARC-Type: ' || CASE WHEN revisit THEN 'revisit' ELSE 'response' END
         || 'WARC-Record-ID: <urn:uuid:' || repeat('x', 36) || '>'
         || 'WARC-Date: 1970-01-01T00:00:00Z'
         || coalesce('WARC-Target-URI: ' || url || 'rn', '')
         || 'WARC-Payload-Digest: sha1:' || repeat('x', 40)
         || 'X-Payload-SHA256: ' || repeat('x', 64)
         || coalesce('X-Page-ID: ' || page_id || 'rn', '')
         || CASE WHEN revisit THEN 'WARC-Refers-To: <urn:uuid:' || repeat('x', 36) || '>rn'
              || 'X-Refers-To-Page: ' || original || 'rn'
              || 'WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digestrn' ELSE '' END
         || 'Content-Type: text/html; charset=utf-8'
         || 'Content-Length: ' || CASE WHEN revisit THEN 0 ELSE n END))
         + CASE WHEN revisit THEN 0 ELSE n END + 9 * 2 + 4 AS bigint) AS record_bytes
FROM known
"""


@query
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.without_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        "n_removed",
        "n_spans",
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages)


@query
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("id", "doc_id")


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.with_repeats(table(spark, sf_dir, "documents"))
    found = periodic_runs.periodic_runs(docs, id_column="id")
    best = periodic_runs.strongest(F.col("runs"))
    return found.withColumn("best", best).select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        periodic_runs.runs_digest(F.col("runs")).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query
def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_search.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


WHOLE_VECTORS = """
numbers AS (
  SELECT vec_id, embedding, list_transform(embedding, lambda x: floor(256 * CAST(x AS double))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding))
"""

SQL["op12_exact_top_k"] = f"""
WITH {WHOLE_VECTORS},
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS bigint) AS score
  FROM numbers q JOIN numbers c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS integer) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query
def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroid_clusters.clusters(table(spark, sf_dir, "embeddings"))
    return found.withColumnRenamed("id", "vec_id")


def _cluster_sql(count: int = 40, rounds: int = 5, dim: int = 64) -> str:
    """k-means as one pair of common table expressions a round."""
    steps = [
        WHOLE_VECTORS.strip().removesuffix(")") + f" AND len(embedding) = {dim})",
        f"""c0 AS (
  SELECT CAST(row_number() OVER (ORDER BY key) - 1 AS integer) AS cluster, v
  FROM (SELECT sha256('2:' || vec_id) AS key, v FROM numbers ORDER BY key LIMIT {count}))""",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} AS MATERIALIZED (
  SELECT n.vec_id, n.v, min(struct_pack(
           d := CAST(list_sum(list_transform(list_zip(n.v, c.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS bigint),
           cluster := c.cluster)) AS near
  FROM numbers n CROSS JOIN c{r} c GROUP BY n.vec_id, n.v)"""
        )
        if r < rounds:
            steps.append(
                f"""c{r + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(m.v, c.v) AS v
  FROM c{r} c LEFT JOIN (
    SELECT cluster, list(floor(total / n) ORDER BY place) AS v FROM (
      SELECT near.cluster AS cluster, place, sum(v[place]) AS total, count(*) AS n
      FROM a{r}, range(1, {dim + 1}) AS places(place) GROUP BY ALL)
    GROUP BY cluster) m ON m.cluster = c.cluster)"""
            )
    return f"""
WITH {", ".join(steps)}
SELECT a.vec_id, a.near.cluster AS cluster, a.near.d AS distance,
       CAST(sum(a.near.d) OVER (PARTITION BY a.near.cluster) AS bigint) AS cluster_inertia,
       CAST(sum(a.near.d) OVER () AS bigint) AS inertia,
       sha256(array_to_string(list_transform(c.v, lambda x: CAST(CAST(x AS bigint) AS varchar)), ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.cluster = a.near.cluster
"""


SQL["op13_centroid_clusters"] = _cluster_sql()
