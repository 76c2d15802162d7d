"""Self-reflective retrieval of a whole table of questions, model replies coming in as tables.

First round: questions that need documents are searched, the hits reranked and graded, the
sound ones kept. Questions with too little evidence go a second round, in which every wording
of theirs is searched anew and the lists are fused, reranked and graded alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.operators import fusion, grade
from quarryline.schemas import DEFAULT_COLLECTION
from quarryline.session import materialise


def _reranked(hits: DataFrame, scores: DataFrame | None) -> DataFrame:
    """Scored hits first (nothing is dropped), ranked from 1."""
    if scores is None:
        return hits
    ordered = fusion.rerank_keep(hits, scores)
    return ordered.withColumn("rank", F.col("new_rank")).drop("new_rank", "rerank_score")


def graded(hits: DataFrame, grades: DataFrame, k: int = grade.TOP_K) -> DataFrame:
    """The first k hits with the model's grades, in graded order; ungraded hits drop out."""
    sent = grade.graded_top(hits, k).select("query_id", "chunk_id", "document_id", "rank")
    keys = [c for c in ("query_id", "chunk_id") if c in grades.columns]
    return grade.sort_graded(grade.parse_grades(sent.join(grades.select(*keys, "raw"), keys)))


def first_round(
    vectors: DataFrame,
    postings: DataFrame,
    questions: DataFrame,
    scores: DataFrame | None,
    k: int,
    collection: str,
) -> DataFrame:
    depth = grade.retrieve_depth(k, scores is not None)
    return _reranked(fusion.hybrid_search(vectors, postings, questions, depth, collection=collection), scores)


def numbered_wordings(variants: DataFrame) -> DataFrame:
    """`variants` with `wording`, a number for each (query_id, variant), however many there are."""
    ranged = variants.repartitionByRange("query_id", "variant").withColumn("_part", F.spark_partition_id())
    in_part = F.row_number().over(Window.partitionBy("_part").orderBy("query_id", "variant")).cast("long")
    return ranged.withColumn("wording", F.shiftleft(F.col("_part").cast("long"), 40) + in_part).drop("_part")


def variant_round(
    vectors: DataFrame,
    postings: DataFrame,
    variants: DataFrame,
    scores: DataFrame | None,
    k: int,
    collection: str,
) -> DataFrame:
    """Hits of every wording, fused per question. `variants`: query_id, variant, text, embedding."""
    depth = grade.retrieve_depth(k, scores is not None)
    # Searches take whole numbers: each wording gets one of its own, kept beside it.
    numbered = materialise(numbered_wordings(variants), "wordings")
    asked = numbered.withColumn("query_id", F.col("wording")).drop("variant", "wording")
    hits = fusion.hybrid_search(vectors, postings, asked, depth, collection=collection)
    own = numbered.select(F.col("wording").alias("query_id"), F.col("query_id").alias("question_id"), "variant")
    ranked = hits.join(own, "query_id").select(
        "question_id",
        "variant",
        (F.col("rank") - 1).alias("position"),
        "chunk_id",
        "document_id",
        F.lit(None).cast("string").alias("content"),
    )
    fused = fusion.fuse_variants(ranked, depth).withColumnRenamed("question_id", "query_id")
    return _reranked(fused.drop("key"), scores)


def self_rag(
    vectors: DataFrame,
    postings: DataFrame,
    questions: DataFrame,
    variants: DataFrame,
    grades: DataFrame,
    *,
    scores: DataFrame | None = None,
    second_scores: DataFrame | None = None,
    k: int = grade.TOP_K,
    collection: str = DEFAULT_COLLECTION,
    max_rewrite: int = grade.MAX_REWRITE,
) -> DataFrame:
    """Evidence of every question: query_id, chunk_id, grade_rank, score, round.

    `questions` has query_id, text, embedding and needed_raw (the model's retrieval flag);
    `variants` all wordings of all questions with their embeddings, of which those of weak
    questions are used; `grades` the replies by chunk_id or (query_id, chunk_id); `scores` those of a
    reranker by (query_id, idx) for either round.
    """
    needed = questions.filter(grade.retrieval_needed(F.col("needed_raw"))).drop("needed_raw")
    hits = materialise(first_round(vectors, postings, needed, scores, k, collection), "first-round")
    evidence = grade.select_evidence(graded(hits, grades, k))
    decisions = materialise(grade.needs_rewrite(needed.select("query_id"), evidence, max_rewrite), "decisions")
    weak = decisions.filter("rewrite").select("query_id")
    reworded = variants.join(weak, "query_id", "left_semi")
    again = variant_round(vectors, postings, reworded, second_scores, k, collection)
    second = grade.select_evidence(graded(again, grades, k))
    return grade.second_round(evidence, decisions, second)
