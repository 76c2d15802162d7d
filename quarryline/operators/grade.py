"""Grading retrieved chunks, choosing evidence, query variants; model text comes as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions import jsontext as jx
from quarryline.functions.binding import bind
from quarryline.functions.ranking import top_per_group

# Fixed values.
TOP_K = 8
TOP_M = 5
RELEVANCE_THRESHOLD = 0.6
SUPPORT_THRESHOLD = 0.5
MIN_EVIDENCE = 2
MAX_REWRITE = 1
FUSION_QUERIES = 3
RERANKED_DEPTH = 20
MAX_VARIANT_CHARS = 200
MAX_KEYWORDS = 12
SCORE_WEIGHTS = {"relevance": 0.6, "supportiveness": 0.3, "usefulness": 0.1}
GRADE_WEIGHTS = {"relevance": 1.0, "supportiveness": 1.0, "usefulness": 0.5}
GRADE_KEYS = ("relevance", "supportiveness", "usefulness")
SCORE_DIGITS = 6


def _scores(text: Column, sound: Column, unreadable: Column) -> Column:
    """Struct of the three scores; all `unreadable` unless `sound` and all can be read."""

    def settled(read: Column) -> Column:
        good = sound
        for key in GRADE_KEYS:
            good = good & read[key].isNotNull()
        return F.struct(*[F.when(good, read[k]).otherwise(unreadable).alias(k) for k in GRADE_KEYS])

    return bind(
        F.struct(*[jx.number_at(text, f"$.{key}").alias(key) for key in GRADE_KEYS]), settled
    )


def parse_scores(grades: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds the three scores; a missing key is 0, anything unreadable makes all three 0."""
    text = F.col(raw)
    found = _scores(text, F.try_parse_json(text).isNotNull(), F.lit(0.0))
    return grades.select("*", F.inline(F.array(found)))


def parse_grades(grades: DataFrame, raw: str = "raw") -> DataFrame:
    """Lenient variant: surrounding prose is cut off; unreadable text counts as all zero,
    a readable answer of the wrong shape leaves nulls (a failed grading)."""
    found = bind(
        F.coalesce(jx.lenient_json(F.col(raw)), F.lit("{}")),
        lambda text: bind(
            F.when(jx.is_falsy(text), F.lit("{}")).otherwise(text),
            lambda kept: _scores(
                kept, jx.json_kind(kept) == "OBJECT", F.lit(None).cast("double")
            ),
        ),
    )
    return grades.select("*", F.inline(F.array(found)))


def _weighted(weights: dict[str, float]) -> Column:
    total = F.lit(0.0)
    for key, weight in weights.items():
        total = total + F.lit(weight) * F.col(key)
    return F.round(total, SCORE_DIGITS)


def combined_score() -> Column:
    """0.6 relevance + 0.3 supportiveness + 0.1 usefulness."""
    return _weighted(SCORE_WEIGHTS)


def passes(relevance: float = RELEVANCE_THRESHOLD, support: float = SUPPORT_THRESHOLD) -> Column:
    return (F.col("relevance") >= relevance) & (F.col("supportiveness") >= support)


def diagnostics(graded: DataFrame) -> DataFrame:
    """Scores of every graded chunk with their combination."""
    return graded.select(
        "query_id",
        "rank",
        "chunk_id",
        combined_score().alias("score"),
        F.col("relevance").alias("r"),
        F.col("supportiveness").alias("s"),
        F.col("usefulness").alias("u"),
    )


def filter_fast(
    graded: DataFrame,
    top_m: int = TOP_M,
    relevance: float = RELEVANCE_THRESHOLD,
    support: float = SUPPORT_THRESHOLD,
) -> DataFrame:
    """Of the first `top_m` hits those that pass; all of them where none does."""
    flagged = graded.filter(F.col("rank") <= top_m).withColumn("passes", passes(relevance, support))
    any_pass = F.max("passes").over(Window.partitionBy("query_id"))
    return (
        flagged.withColumn("_any", any_pass)
        .filter(F.col("passes") | ~F.col("_any"))
        .withColumn("fallback", ~F.col("_any"))
        .drop("_any")
    )


def sort_graded(graded: DataFrame) -> DataFrame:
    """Sound gradings by relevance + supportiveness + half usefulness, ties in input order."""
    scored = graded.filter(F.col("relevance").isNotNull()).withColumn("score", _weighted(GRADE_WEIGHTS))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("rank"))
    return scored.withColumn("grade_rank", F.row_number().over(order))


def select_evidence(ordered: DataFrame, top_m: int = TOP_M) -> DataFrame:
    """Passing chunks in order, at most `top_m`; with too few, the `top_m` best instead."""
    query = Window.partitionBy("query_id")
    so_far = query.orderBy("grade_rank").rowsBetween(Window.unboundedPreceding, 0)
    passing = F.when(passes(), 1).otherwise(0)
    return (
        ordered.withColumn("_passing", passing)
        .withColumn("_seen", F.sum("_passing").over(so_far))
        .withColumn("_chosen", F.least(F.sum("_passing").over(query), F.lit(top_m)))
        .withColumn("_needed", F.least(F.count("*").over(query), F.lit(MIN_EVIDENCE)))
        .filter(
            F.when(F.col("_chosen") < F.col("_needed"), F.col("grade_rank") <= top_m).otherwise(
                (F.col("_passing") == 1) & (F.col("_seen") <= top_m)
            )
        )
        .drop("_passing", "_seen", "_chosen", "_needed")
    )


def hyde_keywords(question: Column, raw: Column, keep: int | None = MAX_KEYWORDS) -> Column:
    """First keywords of the model's JSON joined by commas (None: all), else the question."""
    keywords = F.from_json(
        F.get_json_object(jx.lenient_json(raw), "$.keywords"), "array<string>"
    )
    return bind(
        keywords,
        lambda found: F.when(
            F.size(found) > 0,
            F.array_join(found if keep is None else F.slice(found, 1, keep), ", ", "None"),
        ).otherwise(question),
    )


def variant_list(
    question: Column, raw: Column, n: int = FUSION_QUERIES, chars: int | None = MAX_VARIANT_CHARS
) -> Column:
    """Up to n alternative queries of a JSON list, each cut to `chars` characters (None: whole)."""
    listed = bind(
        jx.lenient_json(raw),
        lambda text: F.when(jx.json_kind(text) == "ARRAY", F.from_json(text, "array<string>")),
    )

    def chosen(found: Column) -> Column:
        cut = F.slice(found, 1, n)
        if chars is not None:
            cut = F.transform(cut, lambda q: F.substring(q, 1, chars))
        return F.when(F.size(found) > 0, cut).otherwise(F.array(question))

    return bind(listed, chosen)


def query_variants(questions: DataFrame, n: int = FUSION_QUERIES) -> DataFrame:
    """One row per distinct query of a question: itself, its variants, its HyDE text.

    `questions` has query_id, question, variants_raw, hyde_raw.
    """
    question = F.col("question")
    merged = F.array_distinct(
        F.concat(
            F.array(question),
            variant_list(question, F.col("variants_raw"), n),
            F.array(hyde_keywords(question, F.col("hyde_raw"))),
        )
    )
    return questions.select("query_id", F.posexplode(merged).alias("variant", "text"))


def retrieval_needed(raw: Column) -> Column:
    """The model's flag by truthiness; true where it is missing or unreadable."""
    text = F.coalesce(jx.lenient_json(raw), F.lit("{}"))
    return F.coalesce(~jx.is_falsy(text, "$.retrieval_needed"), F.lit(True))


def retrieve_depth(k: int, reranked: bool) -> int:
    return max(k, TOP_K, RERANKED_DEPTH if reranked else 0)


def needs_rewrite(queries: DataFrame, evidence: DataFrame, max_rewrite: int = MAX_REWRITE) -> DataFrame:
    """Adds `selected_count` and `rewrite`: fewer than two chunks chosen, a round allowed."""
    chosen = evidence.groupBy("query_id").agg(F.count("*").alias("_n"))
    return (
        queries.join(chosen, "query_id", "left")
        .withColumn("selected_count", F.coalesce("_n", F.lit(0)))
        .withColumn("rewrite", (F.col("selected_count") < MIN_EVIDENCE) & F.lit(max_rewrite > 0))
        .drop("_n")
    )


def second_round(evidence: DataFrame, decisions: DataFrame, second: DataFrame) -> DataFrame:
    """Evidence of the second round for rewritten queries, of the first for the others."""
    weak = decisions.filter("rewrite").select("query_id")
    columns = ["query_id", "chunk_id", "grade_rank", "score"]
    return (
        evidence.join(weak, "query_id", "left_anti")
        .select(*columns, F.lit(1).alias("round"))
        .unionByName(second.join(weak, "query_id", "left_semi").select(*columns, F.lit(2).alias("round")))
    )


def graded_top(hits: DataFrame, k: int = TOP_K) -> DataFrame:
    """The hits that are sent to grading."""
    return top_per_group(hits, ["query_id"], [F.col("rank")], k, rank="rank")
