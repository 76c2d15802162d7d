"""Fusing ranked lists, BM25 over a candidate pool, reranking, result shaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions import text as fx
from quarryline.functions import vectors as vx
from quarryline.functions.ranking import broadcast_if_small, top_per_group
from quarryline.operators import blocks, fulltext, vector_search
from quarryline.operators.index import TERM_BUCKETS
from quarryline.schemas import DEFAULT_COLLECTION
from quarryline.session import materialise

# Fixed values.
RRF_K = 60
LEG_DEPTH = 30
FUSED_K = 8
POOL_FACTOR, POOL_MIN = 20, 200
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
VECTOR_WEIGHT, KEYWORD_WEIGHT = 0.6, 0.4
WEIGHT_TOLERANCE = 0.001
SCORE_DIGITS = 6
MAX_BROADCAST_NAMES = 500_000


def hit_key(chunk_id: Column, document_id: Column, sequence: Column) -> Column:
    """Chunk id, else document and sequence."""
    return F.coalesce(
        fx.truthy(chunk_id),
        F.concat(
            F.coalesce(document_id, F.lit("")),
            F.lit("/"),
            F.coalesce(sequence.cast("string"), F.lit("")),
        ),
    )


def variant_key(chunk_id: Column, document_id: Column, content: Column) -> Column:
    """document:chunk, else the md5 of the content."""
    document, chunk = F.coalesce(document_id, F.lit("")), F.coalesce(chunk_id, F.lit(""))
    return F.when(
        (document != "") | (chunk != ""), F.concat(document, F.lit(":"), chunk)
    ).otherwise(F.md5(F.coalesce(content, F.lit(""))))


def reciprocal_rank(rank: Column, k: int = RRF_K) -> Column:
    return F.lit(1.0) / (F.lit(float(k)) + rank)


def attach_names(hits: DataFrame, catalog: DataFrame) -> DataFrame:
    """Document name of every hit in one join; the id where no name is known.

    The catalog is broadcast only when a count proves it small.
    """
    names = catalog.select(
        F.col("id").alias("document_id"), fx.truthy(F.col("filename")).alias("_name")
    )
    named = hits.join(broadcast_if_small(names, MAX_BROADCAST_NAMES), "document_id", "left")
    return named.withColumn(
        "document_name", F.coalesce(F.col("_name"), F.col("document_id"))
    ).drop("_name")


def fuse(legs: list[DataFrame], k: int = FUSED_K, *, mode: str = "score_plus_rrf", rrf_k: int = RRF_K) -> DataFrame:
    """Sum of per-leg scores per chunk key, top k per query.

    Each leg has query_id, chunk_id, document_id, sequence, score and rank from 1.
    `score_plus_rrf` adds the leg's own score to 1/(rrf_k + rank); `rrf` does not.
    Ties keep the first leg first, then the better rank. Legs are at most their depth
    per query, so grouping on (query, key) is small however large the corpus.
    """
    if mode not in ("score_plus_rrf", "rrf"):
        raise ValueError(f"unknown fusion mode: {mode}")
    rows = None
    for number, leg in enumerate(legs):
        gain = reciprocal_rank(F.col("rank"), rrf_k)
        if mode == "score_plus_rrf":
            gain = F.col("score") + gain
        part = leg.select(
            "query_id",
            hit_key(F.col("chunk_id"), F.col("document_id"), F.col("sequence")).alias("key"),
            gain.alias("gain"),
            F.struct(
                F.lit(number).alias("leg"),
                F.col("rank").alias("rank"),
                "chunk_id",
                "document_id",
                "sequence",
            ).alias("seen"),
        )
        rows = part if rows is None else rows.unionByName(part)
    fused = rows.groupBy("query_id", "key").agg(
        F.round(F.sum("gain"), SCORE_DIGITS).alias("score"), F.min("seen").alias("first")
    )
    order = [F.col("score").desc(), F.col("first.leg"), F.col("first.rank"), F.col("key")]
    return top_per_group(fused, ["query_id"], order, k).select(
        "query_id",
        "key",
        F.col("first.chunk_id").alias("chunk_id"),
        F.col("first.document_id").alias("document_id"),
        F.col("first.sequence").alias("sequence"),
        "score",
        "rank",
    )


def vector_leg(vectors: DataFrame, queries: DataFrame, depth: int = LEG_DEPTH, **options) -> DataFrame:
    hits = vector_search.knn(vectors, queries, depth, **options)
    return hits.select(
        "query_id", "chunk_id", "document_id", "sequence", F.col("relevance").alias("score"), "rank"
    )


def fulltext_leg(postings: DataFrame, queries: DataFrame, depth: int = LEG_DEPTH, **options) -> DataFrame:
    """Full-text hits from postings or, where the table holds them, from blocks of postings."""
    search = blocks.search if blocks.is_blocked(postings) else fulltext.search
    hits = search(postings, queries, depth, **options)
    return hits.select("query_id", "chunk_id", "document_id", "sequence", "score", "rank")


def hybrid_search(
    vectors: DataFrame,
    postings: DataFrame,
    queries: DataFrame,
    k: int = FUSED_K,
    *,
    collection: str = DEFAULT_COLLECTION,
    mode: str = "score_plus_rrf",
    vector_depth: int = LEG_DEPTH,
    fulltext_depth: int = LEG_DEPTH,
    buckets: int = TERM_BUCKETS,
    stem: bool = False,
) -> DataFrame:
    """Vector and full-text legs over one collection, fused.

    A query's `document_id` filters both legs before they rank. `postings` are rows or blocks;
    `buckets` is the number of term buckets they were written with, `stem` whether their terms
    are stems.
    """
    return fuse(
        [
            vector_leg(vectors, queries, vector_depth, collection=collection),
            fulltext_leg(
                postings, queries, fulltext_depth, collection=collection, buckets=buckets, stem=stem
            ),
        ],
        k,
        mode=mode,
    )


def fuse_variants(ranked: DataFrame, k: int) -> DataFrame:
    """Fusion of the ranked lists of a question's query variants.

    `ranked` has question_id, variant, position (from 0), chunk_id, document_id, content.
    """
    keyed = ranked.withColumn(
        "key", variant_key(F.col("chunk_id"), F.col("document_id"), F.col("content"))
    )
    fused = keyed.groupBy("question_id", "key").agg(
        F.round(F.sum(reciprocal_rank(F.col("position"))), SCORE_DIGITS).alias("score"),
        F.min(F.struct("variant", "position", "chunk_id", "document_id")).alias("first"),
    )
    order = [F.col("score").desc(), F.col("first.variant"), F.col("first.position"), F.col("key")]
    return top_per_group(fused, ["question_id"], order, k).select(
        "question_id",
        "key",
        F.col("first.chunk_id").alias("chunk_id"),
        F.col("first.document_id").alias("document_id"),
        "score",
        "rank",
    )


def pool_size(k: int) -> int:
    return max(k * POOL_FACTOR, POOL_MIN)


def bm25(pool: DataFrame, chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Okapi BM25 of each query over its own candidate pool, top k.

    `pool` has query_id, chunk_id, document_id (at most `pool_size(k)` rows a query),
    `chunks` the texts. Words are blank-separated and keep their case; a repeated query
    word counts again; words in at most half the pool keep their idf, others get 0.25 of
    the pool's mean idf. Each pooled text is cut into words once, whatever the number of
    queries that pooled it, and its counts are made inside its row.
    """
    pooled = pool.select("query_id", "chunk_id", "document_id")
    texts = chunks.select("chunk_id", "content").join(
        pooled.select("chunk_id").distinct(), "chunk_id", "left_semi"
    )
    spoken = texts.select("chunk_id", fx.words(F.col("content")).alias("words"))
    lengths = spoken.select("chunk_id", F.size("words").alias("length"))
    counts = spoken.select("chunk_id", F.inline(fx.word_counts(F.col("words"))))
    members = pooled.join(lengths, "chunk_id")
    sizes = members.groupBy("query_id").agg(
        F.count("*").alias("n"), F.avg("length").alias("mean_length")
    )
    asked = queries.select(
        "query_id", F.inline(fx.word_counts(fx.words(F.col("text"))))
    ).withColumnRenamed("tf", "times")

    def idfs(pairs: DataFrame) -> DataFrame:
        """idf of (query, chunk, word) rows' words within the query's pool."""
        frequency = pairs.groupBy("query_id", "word").agg(F.count("*").alias("df"))
        return frequency.join(sizes.select("query_id", "n"), "query_id").select(
            "query_id",
            "word",
            (F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)).alias("idf"),
        )

    places = pooled.select("query_id", "chunk_id")
    known = idfs(
        places.join(asked.select("query_id", "word"), "query_id").join(counts, ["chunk_id", "word"])
    )
    # Only a query with a word in over half its pool needs the mean over all the pool's words.
    common = known.filter(F.col("idf") < 0).select("query_id").distinct()
    everything = places.join(common, "query_id", "left_semi").join(counts, "chunk_id")
    means = idfs(everything).groupBy("query_id").agg(F.avg("idf").alias("mean_idf"))
    chosen = F.when(F.col("idf") < 0, F.lit(BM25_EPSILON) * F.col("mean_idf")).otherwise(F.col("idf"))
    weights = (
        known.join(asked, ["query_id", "word"])
        .join(means, "query_id", "left")
        .select("query_id", "word", (F.col("times") * chosen).alias("weight"))
    )
    norm = F.lit(1 - BM25_B) + F.lit(BM25_B) * F.col("length") / F.col("mean_length")
    totals = (
        members.select("query_id", "chunk_id", "length")
        .join(sizes.select("query_id", "mean_length"), "query_id")
        .join(weights, "query_id")
        .join(counts, ["chunk_id", "word"])
        .groupBy("query_id", "chunk_id")
        .agg(
            F.sum(
                F.col("weight") * F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + F.lit(BM25_K1) * norm)
            ).alias("total")
        )
    )
    scored = pooled.join(totals, ["query_id", "chunk_id"], "left").select(
        "query_id",
        "chunk_id",
        "document_id",
        F.round(F.coalesce("total", F.lit(0.0)), SCORE_DIGITS).alias("score"),
    )
    return top_per_group(scored, ["query_id"], [F.col("score").desc(), F.col("chunk_id")], k)


def check_weights(weights: list[float]) -> None:
    if abs(sum(weights) - 1.0) > WEIGHT_TOLERANCE:
        raise ValueError("weights must sum to 1.0")


def ensemble(legs: list[DataFrame], weights: list[float], k: int | None = None) -> DataFrame:
    """Weighted reciprocal rank fusion: the sum of weight / (60 + rank), rank from 1.

    Each leg has query_id, chunk_id, document_id, content and rank; equal contents count
    as one result. Without `k` every fused row is returned, ranked.
    """
    check_weights(weights)
    rows = None
    for number, (leg, weight) in enumerate(zip(legs, weights, strict=True)):
        part = leg.select(
            "query_id",
            F.sha2(F.coalesce("content", F.lit("")), 256).alias("_text"),
            (F.lit(float(weight)) * reciprocal_rank(F.col("rank"))).alias("gain"),
            F.struct(F.lit(number).alias("leg"), "rank", "chunk_id", "document_id").alias("seen"),
        )
        rows = part if rows is None else rows.unionByName(part)
    fused = rows.groupBy("query_id", "_text").agg(
        F.round(F.sum("gain"), SCORE_DIGITS).alias("score"), F.min("seen").alias("first")
    )
    order = [F.col("score").desc(), F.col("first.leg"), F.col("first.rank"), F.col("first.chunk_id")]
    window = Window.partitionBy("query_id").orderBy(*order)
    ranked = (
        top_per_group(fused, ["query_id"], order, k)
        if k is not None
        else fused.withColumn("rank", F.row_number().over(window))
    )
    return ranked.select(
        "query_id",
        F.col("first.chunk_id").alias("chunk_id"),
        F.col("first.document_id").alias("document_id"),
        "score",
        "rank",
    )


def hybrid_ensemble(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    *,
    collection: str = DEFAULT_COLLECTION,
    weights: tuple[float, float] = (VECTOR_WEIGHT, KEYWORD_WEIGHT),
) -> DataFrame:
    """Vector top k and BM25 top k over a vector-prefetched pool, fused by weight.

    One search serves both legs: the vector leg is the head of the pool.
    """
    hits = materialise(
        vector_search.knn(vectors, queries, pool_size(k), collection=collection), "pool"
    )
    texts = vectors.select("chunk_id", "content")
    legs = [hits.filter(F.col("rank") <= k), bm25(hits, texts, queries, k)]
    return ensemble([leg.join(texts, "chunk_id") for leg in legs], list(weights))


def rerank(hits: DataFrame, scores: DataFrame, top_n: int) -> DataFrame:
    """Order by external scores, cut to `top_n`; queries without a valid score keep theirs.

    `hits` has query_id and rank from 1; `scores` has query_id, idx from 0, score. An
    index outside the list matches nothing. Unscored hits of a scored query drop out.
    """
    return _rescored(hits, scores, top_n, keep_unscored=False)


def rerank_keep(hits: DataFrame, scores: DataFrame) -> DataFrame:
    """Scored hits first by score, then the unscored in their order; nothing is dropped."""
    return _rescored(hits, scores, None, keep_unscored=True)


def _rescored(hits: DataFrame, scores: DataFrame, top_n: int | None, keep_unscored: bool) -> DataFrame:
    given = scores.filter(F.col("score").isNotNull()).select(
        "query_id", (F.col("idx") + 1).cast("int").alias("rank"), F.col("score").alias("rerank_score")
    )
    joined = hits.join(given, ["query_id", "rank"], "left")
    if not keep_unscored:
        any_score = F.count("rerank_score").over(Window.partitionBy("query_id"))
        joined = joined.withColumn("_any", any_score).filter(
            (F.col("_any") == 0) | F.col("rerank_score").isNotNull()
        ).drop("_any")
    order = [F.col("rerank_score").desc_nulls_last(), F.col("rank")]
    window = Window.partitionBy("query_id").orderBy(*order)
    ranked = joined.withColumn("new_rank", F.row_number().over(window))
    return ranked if top_n is None else ranked.filter(F.col("new_rank") <= top_n)


def retrieve(hits: DataFrame, scores: DataFrame | None, k: int = FUSED_K) -> DataFrame:
    """Fused hits, reranked where scores are given, cut to k."""
    if scores is None:
        return hits.filter(F.col("rank") <= k).withColumn("new_rank", F.col("rank"))
    return rerank(hits, scores, k)


def result_rows(hits: DataFrame) -> DataFrame:
    """Search results as shown: first non-empty of the alternative fields, and the total.

    Missing columns count as null. The total is per query, over its k results.
    """
    def field(*names: str) -> Column:
        present = [fx.truthy(F.col(n).cast("string")) for n in names if n in hits.columns]
        return F.coalesce(*present) if present else F.lit(None).cast("string")

    position = [F.nullif(F.col(n).cast("int"), F.lit(0)) for n in ("chunk_index", "sequence") if n in hits.columns]
    return hits.select(
        "query_id",
        "rank",
        field("chunk_id", "id").alias("chunk_id"),
        field("document_id").alias("document_id"),
        F.coalesce(field("document_name"), F.lit("")).alias("document_filename"),
        F.coalesce(*position, F.lit(0)).alias("position"),
        F.coalesce(field("content"), F.lit("")).alias("content"),
        (F.col("metadata") if "metadata" in hits.columns else F.lit(None).cast("map<string,string>")).alias("metadata"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
        F.count("*").over(Window.partitionBy("query_id")).alias("total_results"),
    )


def restrict(
    hits: DataFrame,
    *,
    threshold: float | None = None,
    documents: DataFrame | None = None,
    metadata: dict[str, str] | None = None,
) -> DataFrame:
    """Optional filters on hits: least score, document id list, metadata values."""
    if threshold is not None:
        hits = hits.filter(F.col("score") >= threshold)
    if documents is not None:
        hits = hits.join(documents.select("document_id").distinct(), "document_id", "left_semi")
    for key, value in (metadata or {}).items():
        hits = hits.filter(F.col("metadata")[key] == value)
    return hits


def with_semantic_scores(hits: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """Distance and score between each hit and its query, matched by chunk."""
    asked = queries.select("query_id", F.col("embedding").alias("_query"))
    stored = vectors.select("chunk_id", F.col("embedding").alias("_chunk"))
    return (
        hits.drop("score", "distance")
        .join(asked, "query_id", "left")
        .join(stored, "chunk_id", "left")
        .withColumn("distance", vx.cosine_distance(F.col("_query"), F.col("_chunk")))
        .withColumn("score", vx.similarity(F.col("distance")))
        .drop("_query", "_chunk")
    )


def rescore_or_fall_back(hits: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, *, collection: str | None = DEFAULT_COLLECTION) -> DataFrame:
    """Semantic scores on every hit; queries without any hit get semantic results."""
    columns = ["query_id", "chunk_id", "document_id", "rank", "distance", "score"]
    # Both branches need the hits; without a table each would search for them.
    hits = materialise(hits, "hits")
    rescored = with_semantic_scores(hits, vectors, queries).select(*columns)
    empty = queries.join(hits.select("query_id").distinct(), "query_id", "left_anti")
    fallback = vector_search.semantic_search(vectors, empty, k, collection=collection)
    return rescored.unionByName(fallback.select(*columns))


def dispatch(
    queries: DataFrame,
    vectors: DataFrame,
    postings: DataFrame,
    k: int = 5,
    *,
    collection: str = DEFAULT_COLLECTION,
    metadata_filter: Column | None = None,
) -> DataFrame:
    """Routes each query by `search_type`: semantic, keyword, hybrid or self_query.

    self_query is semantic search under `metadata_filter`. Every leg reads only its
    own queries.
    """
    of = {t: queries.filter(F.col("search_type") == t) for t in ("semantic", "keyword", "hybrid", "self_query")}
    columns = ["query_id", "chunk_id", "document_id", "score", "rank"]
    legs = [
        vector_search.semantic_search(vectors, of["semantic"], k, collection=collection),
        fulltext.search(postings, of["keyword"], k, collection=collection),
        hybrid_ensemble(vectors, of["hybrid"], k, collection=collection),
        vector_search.semantic_search(
            vectors, of["self_query"], k, collection=collection, metadata_filter=metadata_filter
        ),
    ]
    joined = None
    for name, leg in zip(of, legs):
        part = leg.select(*columns).withColumn("search_type", F.lit(name))
        joined = part if joined is None else joined.unionByName(part)
    return joined


def suggestions(table: DataFrame, prefix: str = "", limit: int = 10) -> DataFrame:
    """Suggestions beginning with `prefix`, any case, in list order, with the total shown.

    `table` has position and suggestion.
    """
    found = table.filter(F.lower("suggestion").startswith(prefix.lower())) if prefix else table
    return found.orderBy("position").limit(limit)
