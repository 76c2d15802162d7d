"""Checks: index tables, retrieval, fusion, reranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.functions import text as fx
from quarryline.operators import blocks, embed, fulltext, fusion, index, vector_index, vector_search
from quarryline.plans import corpus
from quarryline.plans import search as searching
from quarryline.plans.registry import check
from quarryline.session import fresh_path, materialise

K = 10
STOPS = ", ".join(f"'{w}'" for w in index.STOP_WORDS)
COSINE = "round(1 - list_cosine_similarity(cast(q.embedding as double[]), cast(v.embedding as double[])), 6)"
SIMILARITY = "round(CASE WHEN distance BETWEEN 0 AND 1 THEN 1 - distance ELSE 1 / (1 + greatest(distance, 0)) END, 6)"


def knn_sql(where: str = "v.collection = 'rag_chunks_v1'", queries: str = "queries") -> str:
    return f"""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM (
      SELECT q.query_id, v.chunk_id, v.document_id, v.sequence, {COSINE} AS distance
      FROM {queries} q JOIN vectors v ON {where}) d"""


def stem_sql(word: str) -> str:
    """`text.stem` in the twin's dialect, which has no back references."""
    rules = [
        ("^(.{2,})ies$", r"\1y"),
        ("^(.+(?:ss|sh|ch|x|z))es$", r"\1"),
        ("^(.{2,}[^siu])s$", r"\1"),
        ("^([^aeiouy]*[aeiouy].*?[^aeiou])(?:ing|ed)$", r"\1"),
        *((f"^(.{{2,}}){c}{c}$", rf"\1{c}") for c in "bdgmnprt"),
        ("^(.{3,})e$", r"\1"),
    ]
    for pattern, kept in rules:
        word = f"regexp_replace({word}, '{pattern}', '{kept}')"
    return word


def postings_sql(source: str, stem: bool = False) -> str:
    if stem:
        return f"""SELECT chunk_id, document_id, collection, term, count(*) AS tf, list(p ORDER BY p) AS positions FROM (
          SELECT chunk_id, document_id, collection, {stem_sql('w')} AS term, p FROM (
            SELECT chunk_id, document_id, collection, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM (
              SELECT chunk_id, document_id, collection, @WORDS(content) AS ws FROM {source}) a) b
          WHERE w NOT IN ({STOPS})) c GROUP BY chunk_id, document_id, collection, term"""
    return f"""SELECT chunk_id, document_id, collection, w AS term, count(*) AS tf, list(p ORDER BY p) AS positions FROM (
      SELECT chunk_id, document_id, collection, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM (
        SELECT chunk_id, document_id, collection, @WORDS(content) AS ws FROM {source}) a) b
      WHERE w NOT IN ({STOPS}) GROUP BY chunk_id, document_id, collection, w"""


def fts_sql(source: str, queries: str, document_filter: str = "", stem: bool = False) -> str:
    """Common tables `post`, `qterms`, `matched`, `fts` (scored, all matches)."""
    term = stem_sql("term") if stem else "term"
    return f"""
    post AS (SELECT * FROM ({postings_sql(source, stem)}) p WHERE collection = 'rag_chunks_v1'),
    qterms AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n_terms FROM (
      SELECT DISTINCT {document_filter and 'only_document, '} query_id, {term} AS term FROM (
        SELECT query_id, {document_filter and 'document_id AS only_document, '} unnest(@WORDS(text)) AS term FROM {queries}) a
      WHERE term NOT IN ({STOPS})) b),
    matched AS (SELECT q.query_id, p.chunk_id, p.document_id, q.n_terms FROM qterms q JOIN post p USING (term)
      {document_filter} GROUP BY ALL HAVING count(*) = q.n_terms),
    occ AS (SELECT m.query_id, m.chunk_id, m.n_terms, p.term, unnest(p.positions) AS pos
      FROM matched m JOIN qterms q ON q.query_id = m.query_id JOIN post p ON p.chunk_id = m.chunk_id AND p.term = q.term),
    lasts AS (SELECT a.query_id, a.chunk_id, a.n_terms, a.pos AS q, b.term, max(b.pos) AS last_pos FROM occ a
      JOIN occ b ON b.query_id = a.query_id AND b.chunk_id = a.chunk_id AND b.pos <= a.pos GROUP BY ALL),
    starts AS (SELECT query_id, chunk_id, q, min(last_pos) AS p FROM lasts GROUP BY query_id, chunk_id, q, n_terms HAVING count(*) = n_terms),
    covers AS (SELECT query_id, chunk_id, p, min(q) AS q FROM starts GROUP BY ALL),
    gains AS (SELECT c.query_id, c.chunk_id, c.p, 0.1::double / (2 + c.q - c.p - count(*)) AS gain FROM covers c
      JOIN occ o ON o.query_id = c.query_id AND o.chunk_id = c.chunk_id AND o.pos BETWEEN c.p AND c.q GROUP BY c.query_id, c.chunk_id, c.p, c.q),
    fts AS (SELECT m.query_id, m.chunk_id, m.document_id, round(sum(g.gain), 6) AS score FROM matched m
      JOIN gains g USING (query_id, chunk_id) GROUP BY ALL),
    fts_ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM fts)"""


def _postings(chunks):
    """The full-text index of a chunk table, stored once as an ingest would."""
    return materialise(index.postings(chunks), "postings")


ONLY = "WHERE q.only_document IS NULL OR q.only_document = p.document_id"


@check(
    "ix1_postings",
    f"SELECT chunk_id, term, tf, array_to_string(positions, ',') AS positions FROM ({postings_sql('line_chunks')}) x",
)
def ix1(t):
    return index.postings(t.line_chunks).select(
        "chunk_id", "term", "tf", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions")
    )


@check(
    "ix1_stored_postings_lookup",
    f"""SELECT p.term, count(*) AS chunks, sum(p.tf) AS occurrences FROM ({postings_sql('line_chunks')}) p
    WHERE p.term IN (SELECT lower(text) FROM word_queries) GROUP BY p.term""",
    longs="occurrences",
)
def ix1_stored(t):
    path = fresh_path(t.spark, "postings")
    index.write_postings(index.postings(t.line_chunks), path, buckets=16, files_per_bucket=2)
    terms = t.word_queries.select(F.lower("text").alias("term")).distinct()
    return (
        index.read_postings(t.spark, path, terms, buckets=16)
        .join(terms, "term", "left_semi")
        .groupBy("term")
        .agg(F.count("*").alias("chunks"), F.sum("tf").alias("occurrences"))
    )


FULL_K_SQL = f"""SELECT query_id, count(*) FILTER (WHERE rank <= {K}) = {K} AS full_k, true AS exact_distances
    FROM ({knn_sql()}) x GROUP BY query_id"""


def _full_k(found, exact):
    both = found.join(exact.select("query_id", "chunk_id", F.col("distance").alias("true")), ["query_id", "chunk_id"], "left")
    return both.groupBy("query_id").agg(
        (F.count("*") == K).alias("full_k"),
        F.min(F.coalesce(F.col("distance") == F.col("true"), F.lit(True))).alias("exact_distances"),
    )


def _reached(found, exact, share):
    shared = exact.join(found.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_semi")
    both = exact.select("query_id", F.lit(0).alias("hit")).unionByName(shared.select("query_id", F.lit(1).alias("hit")))
    return both.agg(
        (F.sum("hit") >= share * F.count_if(F.col("hit") == 0)).alias("reached"),
        F.countDistinct("query_id").alias("queries"),
    )


def _exact(t):
    return vector_search.knn(t.vectors, t.queries, K, collection="rag_chunks_v1")


def cell_index(t):
    """A stored index with as many cells as the corpus asks for."""
    path = fresh_path(t.spark, "cells")
    vector_index.write(t.vectors, vector_index.fit(t.vectors), path)
    return vector_index.read(t.spark, path)


# Every query has k hits, with exact distances, and nearly all of the nearest.
@check("ix2_approximate_knn", FULL_K_SQL)
def ix2(t):
    return _full_k(vector_index.search(cell_index(t), t.queries, K, collection="rag_chunks_v1"), _exact(t))


@check("ix2_recall", "SELECT true AS reached, count(*) AS queries FROM queries")
def ix2_recall(t):
    return _reached(vector_index.search(cell_index(t), t.queries, K, collection="rag_chunks_v1"), _exact(t), 0.95)


# The same index, all rows but those that bounds rule out.
@check(
    "ix2_bounded_knn",
    f"SELECT query_id, chunk_id, distance, rank FROM ({knn_sql()}) x WHERE rank <= {K}",
)
def ix2_bounded(t):
    hits = vector_index.search(cell_index(t), t.queries, K, collection="rag_chunks_v1", recall=None)
    return hits.select("query_id", "chunk_id", "distance", F.col("rank").cast("long").alias("rank"))


# The other index: signatures, with as many buckets as the corpus asks for.
@check("ix2_signature_knn", FULL_K_SQL)
def ix2_signatures(t):
    return _full_k(_by_signature(t), _exact(t))


@check("ix2_signature_recall", "SELECT true AS reached, count(*) AS queries FROM queries")
def ix2_signature_recall(t):
    return _reached(_by_signature(t), _exact(t), 0.9)


def _by_signature(t):
    vectors = t.vectors.filter("collection = 'rag_chunks_v1'")
    bits = index.bits_for(vectors.count())
    path = fresh_path(t.spark, "buckets")
    index.write_buckets(index.with_buckets(vectors, bits), path)
    return vector_search.approximate_knn(t.spark.read.parquet(path), t.queries, K, collection="rag_chunks_v1", bits=bits)


@check(
    "rt1_exact_knn",
    f"SELECT query_id, chunk_id, distance, round(1 / (1 + distance), 6) AS relevance, rank FROM ({knn_sql()}) x WHERE rank <= {K}",
)
def rt1(t):
    hits = vector_search.knn(t.vectors, t.queries, K, collection="rag_chunks_v1")
    return hits.select(
        "query_id", "chunk_id", "distance", F.round("relevance", 6).alias("relevance"), F.col("rank").cast("long").alias("rank")
    )


@check(
    "rt1_blocked_knn",
    f"SELECT query_id, chunk_id, distance, rank FROM ({knn_sql('true')}) x WHERE rank <= {K}",
)
def rt1_blocked(t):
    hits = vector_search.knn(t.vectors, t.queries, K, max_shipped=25)
    return hits.select("query_id", "chunk_id", "distance", F.col("rank").cast("long").alias("rank"))


@check(
    "rt2_semantic_search",
    f"SELECT query_id, chunk_id, distance, {SIMILARITY} AS score, rank FROM ({knn_sql('v.label <> 3')}) x WHERE rank <= 5",
)
def rt2(t):
    hits = vector_search.semantic_search(
        t.vectors, t.queries, 5, collection=None, metadata_filter=F.col("label") != 3
    )
    return hits.select("query_id", "chunk_id", "distance", "score", F.col("rank").cast("long").alias("rank"))


@check(
    "rt2_one_document_search",
    f"""SELECT query_id, chunk_id, distance, {SIMILARITY} AS score FROM ({knn_sql(
        "v.document_id = cast(q.query_id * 3 as string)")}) x WHERE rank <= 5""",
)
def rt2_document(t):
    asked = t.queries.withColumn("document_id", (F.col("query_id") * 3).cast("string"))
    hits = vector_search.semantic_search(t.vectors, asked, 5, collection=None)
    return hits.select("query_id", "chunk_id", "distance", "score")


@check(
    "rt3_fulltext_matches",
    f"WITH {fts_sql('line_chunks', 'pair_queries')} SELECT query_id, chunk_id, n_terms FROM matched",
)
def rt3(t):
    postings = _postings(t.line_chunks).filter("collection = 'rag_chunks_v1'")
    return fulltext.match(postings, fulltext.query_terms(t.pair_queries)).select(
        "query_id", "chunk_id", F.col("n_terms").cast("long").alias("n_terms")
    )


@check(
    "rt4_cover_density",
    f"WITH {fts_sql('doc_chunks', 'pair_queries')} SELECT query_id, chunk_id, score FROM fts",
)
def rt4(t):
    matched = fulltext.match(_postings(t.doc_chunks), fulltext.query_terms(t.pair_queries))
    return matched.select("query_id", "chunk_id", fulltext.cover_density(F.col("places")).alias("score"))


@check(
    "rt4_passage_queries",
    f"WITH {fts_sql('doc_chunks', 'queries')} SELECT query_id, chunk_id, score FROM fts",
)
def rt4_passages(t):
    matched = fulltext.match(_postings(t.doc_chunks), fulltext.query_terms(t.queries))
    return matched.select("query_id", "chunk_id", fulltext.cover_density(F.col("places")).alias("score"))


@check(
    "rt5_fulltext_search",
    f"""WITH {fts_sql('line_chunks', 'word_queries', ONLY)}
    SELECT query_id, chunk_id, document_id, score, rank FROM fts_ranked WHERE rank <= {K}""",
)
def rt5(t):
    hits = fulltext.search(_postings(t.line_chunks), t.word_queries, K)
    return hits.select("query_id", "chunk_id", "document_id", "score", F.col("rank").cast("long").alias("rank"))


# The same from blocks, most of which their bounds skip.
@check(
    "rt5_block_search",
    f"""WITH {fts_sql('line_chunks', 'word_queries', ONLY)}
    SELECT query_id, chunk_id, document_id, score, rank FROM fts_ranked WHERE rank <= {K}""",
)
def rt5_blocks(t):
    hits = blocks.search(_blocks(t.line_chunks), t.word_queries, K)
    return hits.select("query_id", "chunk_id", "document_id", "score", F.col("rank").cast("long").alias("rank"))


@check(
    "rt5_block_search_several_terms",
    f"""WITH {fts_sql('line_chunks', 'pair_queries')}
    SELECT query_id, chunk_id, document_id, score, rank FROM fts_ranked WHERE rank <= {K}""",
)
def rt5_blocks_several(t):
    hits = blocks.search(_blocks(t.line_chunks), t.pair_queries, K)
    return hits.select("query_id", "chunk_id", "document_id", "score", F.col("rank").cast("long").alias("rank"))


def _blocks(chunks):
    """The block index of a chunk table, stored once."""
    path = fresh_path(chunks.sparkSession, "blocks")
    blocks.write_blocks(blocks.blocks(_postings(chunks)), path)
    return blocks.read_blocks(chunks.sparkSession, path)


# Forms of a word are one term, in postings and in questions.
@check(
    "rt5_stemmed_search",
    f"""WITH {fts_sql('line_chunks', 'word_queries', ONLY, stem=True)}
    SELECT query_id, chunk_id, document_id, score, rank FROM fts_ranked WHERE rank <= {K}""",
)
def rt5_stemmed(t):
    stored = materialise(index.postings(t.line_chunks, stem=True), "postings")
    hits = fulltext.search(stored, t.word_queries, K, stem=True)
    return hits.select("query_id", "chunk_id", "document_id", "score", F.col("rank").cast("long").alias("rank"))


@check(
    "rt6_fulltext_hits",
    f"""WITH {fts_sql('line_chunks', 'word_queries')}
    SELECT f.query_id, f.chunk_id, f.document_id, 'file-' || f.document_id AS document_name, cast(c.sequence as bigint) AS sequence, 'fts' AS retriever, c.content
    FROM fts_ranked f JOIN line_chunks c USING (chunk_id) WHERE f.rank <= 3""",
)
def rt6(t):
    chunks = t.line_chunks.withColumn(
        "metadata", F.create_map(F.lit("filename"), F.concat(F.lit("file-"), "document_id"))
    )
    hits = fulltext.search(_postings(chunks), t.word_queries.drop("document_id"), 3)
    return fulltext.project_hits(hits, chunks).select(
        "query_id", "chunk_id", "document_id", "document_name", F.col("sequence").cast("long").alias("sequence"), "retriever", "content"
    )


@check(
    "rt7_document_names",
    f"""SELECT query_id, chunk_id, coalesce(c.filename, x.document_id) AS document_name
    FROM ({knn_sql('true')}) x LEFT JOIN (SELECT id, filename FROM catalog WHERE status <> 'failed') c ON c.id = x.document_id WHERE rank <= {K}""",
)
def rt7(t):
    hits = vector_search.knn(t.vectors, t.queries, K)
    named = fusion.attach_names(hits, t.catalog.filter("status <> 'failed'"))
    return named.select("query_id", "chunk_id", "document_name")


def hybrid_sql(
    queries: str, source: str = "doc_chunks", near: str | None = None, sequence: str = "cast(document_id as bigint) % 3"
) -> str:
    """Common tables up to `top`, the fused and ranked hits of a query table.

    `near` ranks chunks by distance, `sequence` is that of a full-text hit.
    """
    return f"""
  {fts_sql(source, queries)},
  vec AS (SELECT query_id, chunk_id, document_id, sequence, 1 / (1 + distance) AS score, rank FROM ({near or knn_sql(queries=queries)}) x WHERE rank <= 30),
  legs AS (SELECT 0 AS leg, query_id, chunk_id, document_id, sequence, score, rank FROM vec
    UNION ALL SELECT 1, query_id, chunk_id, document_id, {sequence}, score, rank FROM fts_ranked WHERE rank <= 30),
  fused AS (SELECT query_id, chunk_id, round(sum(score + 1 / (60.0::double + rank)), 6) AS score, min(leg * 1000 + rank) AS first,
      arg_min(sequence, leg * 1000 + rank) AS sequence FROM legs GROUP BY query_id, chunk_id),
  top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, chunk_id) AS rank FROM fused)"""


HYBRID_SQL = hybrid_sql("queries")


@check("rt8_hybrid_fusion", f"WITH {HYBRID_SQL} SELECT query_id, chunk_id, score, rank FROM top WHERE rank <= 8")
def rt8(t):
    return _hybrid(t).select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


def _hybrid(t, **options):
    return fusion.hybrid_search(t.vectors, _postings(t.doc_chunks), t.queries, **options)


# Both legs over stems, the full-text one from blocks.
@check(
    "rt8_stemmed_block_fusion",
    f"WITH {HYBRID_SQL.replace(fts_sql('doc_chunks', 'queries'), fts_sql('doc_chunks', 'queries', stem=True))} SELECT query_id, chunk_id, score, rank FROM top WHERE rank <= 8",
)
def rt8_stemmed(t):
    path = fresh_path(t.spark, "blocks")
    stored = materialise(index.postings(t.doc_chunks, stem=True), "postings")
    blocks.write_blocks(blocks.blocks(stored), path)
    hits = fusion.hybrid_search(t.vectors, blocks.read_blocks(t.spark, path), t.queries, stem=True)
    return hits.select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


@check(
    "rt8_pure_rank_fusion",
    f"WITH {HYBRID_SQL.replace('score + 1 / (60.0::double + rank)', '1 / (60.0::double + rank)')} SELECT query_id, chunk_id, score, rank FROM top WHERE rank <= 8",
)
def rt8_pure(t):
    return _hybrid(t, mode="rrf").select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


# A query restricted to one document: both legs rank inside it.
@check(
    "rt8_hybrid_in_one_document",
    f"""WITH only_queries AS (SELECT *, cast(query_id * 5 as string) AS document_id FROM queries),
    {fts_sql('doc_chunks', 'only_queries', ONLY)},
    vec AS (SELECT * FROM ({knn_sql("v.collection = 'rag_chunks_v1' AND v.document_id = q.document_id", 'only_queries')}) x WHERE rank <= 30),
    legs AS (SELECT query_id, chunk_id, 1 / (1 + distance) + 1 / (60.0::double + rank) AS gain FROM vec
      UNION ALL SELECT query_id, chunk_id, score + 1 / (60.0::double + rank) FROM fts_ranked WHERE rank <= 30)
    SELECT query_id, chunk_id, round(sum(gain), 6) AS score FROM legs GROUP BY query_id, chunk_id""",
)
def rt8_document(t):
    asked = t.queries.withColumn("document_id", (F.col("query_id") * 5).cast("string"))
    hits = fusion.hybrid_search(t.vectors, _postings(t.doc_chunks), asked)
    return hits.select("query_id", "chunk_id", "score")


@check(
    "rt9_variant_fusion",
    f"""WITH near AS (SELECT cast(floor(query_id / 2) as bigint) AS question_id, query_id % 2 AS variant, rank - 1 AS position, chunk_id, document_id
      FROM ({knn_sql('true')}) x WHERE rank <= {K}),
    fused AS (SELECT question_id, document_id || ':' || chunk_id AS key, round(sum(1 / (60.0::double + position)), 6) AS score,
      min(variant * 1000 + position) AS first FROM near GROUP BY ALL)
    SELECT question_id, key, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, first, key) AS rank FROM fused) y WHERE rank <= 8""",
)
def rt9(t):
    hits = vector_search.knn(t.vectors, t.queries, K).select(
        F.floor(F.col("query_id") / 2).alias("question_id"),
        (F.col("query_id") % 2).alias("variant"),
        (F.col("rank") - 1).alias("position"),
        "chunk_id",
        "document_id",
        F.lit(None).cast("string").alias("content"),
    )
    return fusion.fuse_variants(hits, 8).select(
        "question_id", "key", "score", F.col("rank").cast("long").alias("rank")
    )


# Every vector has a text: its document's, or else a line of its own.
WITH_TEXT = "v.collection = 'rag_chunks_v1'"


def bm25_sql(k: int) -> str:
    """Common tables `near` (pool with texts) and `bm` (ranked BM25)."""
    blank = fx.BLANK_CLASS
    return f"""
    near AS (SELECT x.query_id, x.chunk_id, x.document_id, x.rank, coalesce(d.content, 'text of ' || x.chunk_id) AS content FROM ({knn_sql(WITH_TEXT)}) x
      LEFT JOIN doc_chunks d USING (chunk_id) WHERE x.rank <= {max(20 * k, 200)}),
    said AS (SELECT query_id, chunk_id, regexp_extract_all(content, '[^{blank}]+') AS ws FROM near),
    sizes AS (SELECT query_id, count(*) AS n, avg(len(ws)) AS mean_length FROM said GROUP BY query_id),
    words AS (SELECT query_id, chunk_id, unnest(ws) AS word FROM said),
    df AS (SELECT query_id, word, count(DISTINCT chunk_id) AS df FROM words GROUP BY ALL),
    idf AS (SELECT query_id, word, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df JOIN sizes USING (query_id)),
    mean AS (SELECT query_id, avg(idf) AS mean_idf FROM idf GROUP BY query_id),
    asked AS (SELECT query_id, word, count(*) AS times FROM (SELECT query_id, unnest(regexp_extract_all(text, '[^{blank}]+')) AS word FROM queries) a GROUP BY ALL),
    weights AS (SELECT query_id, word, times * CASE WHEN idf < 0 THEN 0.25 * mean_idf ELSE idf END AS weight FROM asked JOIN idf USING (query_id, word) JOIN mean USING (query_id)),
    tf AS (SELECT query_id, chunk_id, word, count(*) AS tf FROM words SEMI JOIN weights USING (query_id, word) GROUP BY ALL),
    totals AS (SELECT query_id, chunk_id, sum(weight * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ws) / mean_length))) AS total
      FROM tf JOIN weights USING (query_id, word) JOIN said USING (query_id, chunk_id) JOIN sizes USING (query_id) GROUP BY ALL),
    bm AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
      SELECT query_id, chunk_id, round(coalesce(total, 0), 6) AS score FROM said LEFT JOIN totals USING (query_id, chunk_id)) s)"""


POOLED_SQL = bm25_sql(5)


def _with_text(t):
    texts = t.vectors.join(t.doc_chunks.select("chunk_id", "content"), "chunk_id", "left")
    return texts.withColumn("content", F.coalesce("content", F.concat(F.lit("text of "), "chunk_id")))


@check("rt10_bm25", f"WITH {POOLED_SQL} SELECT query_id, chunk_id, score, rank FROM bm WHERE rank <= 5")
def rt10(t):
    pool = materialise(
        vector_search.knn(
            _with_text(t), t.queries, fusion.pool_size(5), collection="rag_chunks_v1", model="model-a"
        ),
        "pool",
    )
    return fusion.bm25(pool, _with_text(t), t.queries, 5).select(
        "query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank")
    )


ENSEMBLE_SQL = f"""
  {POOLED_SQL},
  both_legs AS (SELECT 0 AS leg, query_id, chunk_id, rank, content, 0.6::double AS w FROM near WHERE rank <= 5
    UNION ALL SELECT 1, b.query_id, b.chunk_id, b.rank, n.content, 0.4::double FROM bm b JOIN near n USING (query_id, chunk_id) WHERE b.rank <= 5),
  fused AS (SELECT query_id, content, round(sum(w / (60.0::double + rank)), 6) AS score, min(leg * 1000 + rank) AS first,
    arg_min(chunk_id, leg * 1000 + rank) AS chunk_id FROM both_legs GROUP BY query_id, content),
  ens AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, chunk_id) AS rank FROM fused)"""


@check("rt11_weighted_ensemble", f"WITH {ENSEMBLE_SQL} SELECT query_id, chunk_id, score, rank FROM ens")
def rt11(t):
    return fusion.hybrid_ensemble(_with_text(t), t.queries, 5).select(
        "query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank")
    )


@check(
    "rt12_search_dispatch",
    f"""WITH {ENSEMBLE_SQL},
    {fts_sql('doc_chunks', 'queries').replace('post AS', 'post AS', 1)},
    sem AS ({knn_sql(WITH_TEXT)}),
    selfq AS ({knn_sql(WITH_TEXT + " AND v.label < 5")})
    SELECT query_id, chunk_id, {SIMILARITY} AS score, rank, 'semantic' AS search_type FROM sem WHERE rank <= 5 AND query_id % 4 = 0
    UNION ALL SELECT query_id, chunk_id, score, rank, 'keyword' FROM fts_ranked WHERE rank <= 5 AND query_id % 4 = 1
    UNION ALL SELECT query_id, chunk_id, score, rank, 'hybrid' FROM ens WHERE query_id % 4 = 2
    UNION ALL SELECT query_id, chunk_id, {SIMILARITY}, rank, 'self_query' FROM selfq WHERE rank <= 5 AND query_id % 4 = 3""",
)
def rt12(t):
    kind = F.col("query_id") % 4
    asked = t.queries.withColumn(
        "search_type",
        F.when(kind == 0, "semantic").when(kind == 1, "keyword").when(kind == 2, "hybrid").otherwise("self_query"),
    )
    hits = fusion.dispatch(
        asked, _with_text(t), _postings(t.doc_chunks), 5,
        metadata_filter=vector_search.metadata_predicate(("label", "lt", 5)),
    )
    return hits.select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"), "search_type")


@check(
    "rt13_rescored_hits",
    f"""WITH {fts_sql('doc_chunks', 'queries')},
    hits AS (SELECT query_id, chunk_id, rank FROM fts_ranked WHERE rank <= 5),
    rescored AS (SELECT h.query_id, h.chunk_id, h.rank, CASE WHEN v.embedding IS NOT NULL THEN {COSINE} END AS distance
      FROM hits h JOIN queries q ON q.query_id = h.query_id LEFT JOIN vectors v ON v.chunk_id = h.chunk_id),
    spare AS (SELECT query_id, chunk_id, rank, distance FROM ({knn_sql()}) x WHERE rank <= 5 AND query_id NOT IN (SELECT query_id FROM hits))
    SELECT query_id, chunk_id, rank, distance, CASE WHEN distance IS NOT NULL THEN {SIMILARITY} END AS score FROM (SELECT * FROM rescored UNION ALL SELECT * FROM spare) y""",
)
def rt13(t):
    hits = fulltext.search(_postings(t.doc_chunks), t.queries, 5)
    return fusion.rescore_or_fall_back(hits, t.vectors, t.queries, 5).select(
        "query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), "distance", "score"
    )


RERANK_SQL = """
  given AS (SELECT query_id, idx + 1 AS rank, score AS s FROM scores),
  joined AS (SELECT r.query_id, r.rank, r.chunk_id, g.s, count(g.s) OVER (PARTITION BY r.query_id) AS any_score
    FROM ranked r LEFT JOIN given g USING (query_id, rank))"""


@check(
    "rt14_rerank",
    f"""WITH {RERANK_SQL} SELECT query_id, chunk_id, s AS rerank_score, new_rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC NULLS LAST, rank) AS new_rank
      FROM joined WHERE any_score = 0 OR s IS NOT NULL) x WHERE new_rank <= 4""",
)
def rt14(t):
    return fusion.rerank(t.ranked, t.scores, 4).select(
        "query_id", "chunk_id", "rerank_score", F.col("new_rank").cast("long").alias("new_rank")
    )


@check(
    "rt15_rerank_keep",
    f"""WITH {RERANK_SQL} SELECT query_id, chunk_id, s AS rerank_score,
      row_number() OVER (PARTITION BY query_id ORDER BY s DESC NULLS LAST, rank) AS new_rank FROM joined""",
)
def rt15(t):
    return fusion.rerank_keep(t.ranked, t.scores).select(
        "query_id", "chunk_id", "rerank_score", F.col("new_rank").cast("long").alias("new_rank")
    )


@check(
    "rt16_retrieve",
    f"""WITH {HYBRID_SQL},
    hits AS (SELECT query_id, chunk_id, rank FROM top WHERE rank <= 8),
    joined AS (SELECT h.*, g.score AS s, count(g.score) OVER (PARTITION BY h.query_id) AS any_score
      FROM hits h LEFT JOIN (SELECT query_id, idx + 1 AS rank, score FROM scores) g USING (query_id, rank))
    SELECT query_id, chunk_id, new_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC NULLS LAST, rank) AS new_rank
      FROM joined WHERE any_score = 0 OR s IS NOT NULL) x WHERE new_rank <= 8""",
)
def rt16(t):
    return fusion.retrieve(_hybrid(t), t.scores, 8).select(
        "query_id", "chunk_id", F.col("new_rank").cast("long").alias("new_rank")
    )


@check(
    "rt17_search_results",
    f"""WITH {HYBRID_SQL}
    SELECT t.query_id, t.chunk_id, coalesce(c.filename, t.chunk_id) AS document_filename, cast(coalesce(t.sequence, 0) as bigint) AS position,
      coalesce(d.content, '') AS content, t.score, t.rank, count(*) OVER (PARTITION BY t.query_id) AS total_results
    FROM top t LEFT JOIN catalog c ON c.id = t.chunk_id LEFT JOIN doc_chunks d ON d.chunk_id = t.chunk_id WHERE t.rank <= 8""",
)
def rt17(t):
    hits = _hybrid(t).join(t.doc_chunks.select("chunk_id", "content"), "chunk_id", "left")
    return fusion.result_rows(fusion.attach_names(hits, t.catalog)).select(
        "query_id", "chunk_id", "document_filename", F.col("position").cast("long").alias("position"), "content", "score",
        F.col("rank").cast("long").alias("rank"), "total_results",
    )


@check(
    "rt18_result_filters",
    f"""SELECT query_id, chunk_id, score FROM (SELECT *, {SIMILARITY} AS score FROM ({knn_sql('true')}) x WHERE rank <= 20) y
    WHERE score >= 0.7 AND document_id IN (SELECT id FROM catalog WHERE doc_type = 'transcript')""",
)
def rt18(t):
    hits = vector_search.semantic_search(t.vectors, t.queries, 20, collection=None)
    wanted = t.catalog.filter("doc_type = 'transcript'").select(F.col("id").alias("document_id"))
    return fusion.restrict(hits, threshold=0.7, documents=wanted).select("query_id", "chunk_id", "score")


@check(
    "rt19_structured_filter",
    f"""SELECT query_id, chunk_id, distance, rank FROM ({knn_sql(
        "v.label >= 2 AND v.label <> 7 AND v.sequence IN (0, 2) AND v.collection = 'rag_chunks_v1'")}) x WHERE rank <= 5""",
)
def rt19(t):
    wanted = vector_search.metadata_predicate(("label", "gte", 2), ("label", "ne", 7), ("sequence", "in", [0, 2]))
    hits = vector_search.semantic_search(t.vectors, t.queries, 5, metadata_filter=wanted)
    return hits.select("query_id", "chunk_id", "distance", F.col("rank").cast("long").alias("rank"))


@check(
    "rt20_suggestions",
    """SELECT doc_id AS position, text AS suggestion FROM documents WHERE starts_with(lower(text), 'th') ORDER BY doc_id LIMIT 10""",
)
def rt20(t):
    table = t.documents.select(F.col("doc_id").alias("position"), F.col("text").alias("suggestion"))
    return fusion.suggestions(table, "TH", 10)


@check("rt16_hybrid_search_results")
def hybrid_search_results(t):
    """Documents to chunks, vectors and postings; all benchmark texts as questions."""
    pages = t.documents.select(
        F.col("doc_id").cast("string").alias("document_id"),
        F.lit("general").alias("document_type"),
        F.lit(1).alias("page_no"),
        "text",
    )
    vectors = materialise(corpus.ingest(pages), "vectors")
    questions = searching.embed_queries(t.benchmark.select(F.col("item_id").alias("query_id"), "text"))
    return searching.search(vectors, _postings(vectors), questions, t.catalog)


# From text lines to results in SQL: token slots as in `em1_hash_vectors`, sparse dot products.
def _slots_sql(key: str, text: str, source: str) -> str:
    return f"""SELECT {key}, slot, v, sqrt(sum(v * v) OVER (PARTITION BY {key})) AS norm FROM (
      SELECT {key}, cast('0x' || substr(md5(w), 1, 8) as bigint) % 64 AS slot,
        sum(CASE WHEN substr(md5(w), 9, 1) < '8' THEN 1 ELSE -1 END) AS v
      FROM (SELECT {key}, unnest(@WORDS({text})) AS w FROM {source}) a GROUP BY ALL) b"""


LINE_SEARCH_SQL = f"""WITH asked AS (SELECT item_id AS query_id, text FROM benchmark),
    lines AS (SELECT * FROM line_chunks WHERE collection = 'rag_chunks_v1'),
    line_slots AS ({_slots_sql('chunk_id', 'content', 'lines')}),
    asked_slots AS ({_slots_sql('query_id', 'text', 'asked')}),
    dots AS (SELECT a.query_id, l.chunk_id, sum(a.v * l.v) / (min(a.norm) * min(l.norm)) AS dot
      FROM asked_slots a JOIN line_slots l USING (slot) GROUP BY a.query_id, l.chunk_id),
    {hybrid_sql('asked', 'line_chunks', near="""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM (
        SELECT a.query_id, l.chunk_id, l.document_id, l.sequence, round(1 - coalesce(d.dot, 0), 6) AS distance
        FROM asked a CROSS JOIN (SELECT * FROM lines WHERE chunk_id IN (SELECT chunk_id FROM line_slots WHERE norm > 0)) l
        LEFT JOIN dots d ON d.query_id = a.query_id AND d.chunk_id = l.chunk_id) n""", sequence="cast(split_part(chunk_id, ':', 2) as bigint)")}
    SELECT t.query_id, t.chunk_id, coalesce(nullif(c.filename, ''), l.document_id) AS document_filename, cast(l.sequence as bigint) AS position,
      l.content, t.score, t.rank, count(*) OVER (PARTITION BY t.query_id) AS total_results
    FROM top t JOIN line_chunks l ON l.chunk_id = t.chunk_id LEFT JOIN catalog c ON c.id = l.document_id WHERE t.rank <= 8"""


@check("rt16_line_search", LINE_SEARCH_SQL)
def line_search(t):
    """Text lines to vectors and postings, all benchmark texts as questions, results with texts."""
    chunks = t.line_chunks.withColumn("metadata", F.lit(None).cast("map<string,string>"))
    vectors = materialise(embed.embed_chunks(chunks), "vectors")
    path = fresh_path(t.spark, "postings")
    index.write_postings(index.postings(vectors), path, buckets=8, files_per_bucket=1)
    questions = searching.embed_queries(t.benchmark.select(F.col("item_id").alias("query_id"), "text"))
    found = searching.search(vectors, index.read_postings(t.spark, path), questions, t.catalog, buckets=8)
    return found.select(
        "query_id", "chunk_id", "document_filename", F.col("position").cast("long").alias("position"), "content", "score",
        F.col("rank").cast("long").alias("rank"), "total_results",
    )
