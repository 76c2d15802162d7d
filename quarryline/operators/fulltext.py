"""Full-text search of a whole table of queries over the postings table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.binding import bind
from quarryline.functions.ranking import broadcast_if_small, top_per_group
from quarryline.operators.index import TERM_BUCKETS, lexemes, term_bucket
from quarryline.schemas import DEFAULT_COLLECTION
from quarryline.session import materialise

# Fixed value: weight of an unlabelled lexeme in the cover-density rank.
DEFAULT_WEIGHT = 0.1
SCORE_DIGITS = 6
# (query, term) rows that may be broadcast; checked before use, about 50 MB.
MAX_BROADCAST_TERMS = 500_000
# Further rare terms that cut too many candidates before all terms are looked up.
NARROWING = 3


def query_terms(queries: DataFrame, text: str = "text", stem: bool = False) -> DataFrame:
    """Distinct terms per query, with their number; queries of stop words only vanish."""
    keep = ["query_id"] + (["document_id"] if "document_id" in queries.columns else [])
    terms = F.array_distinct(F.transform(lexemes(F.col(text), stem), lambda t: t["term"]))
    return queries.select(*keys_as(keep), terms.alias("_terms")).select(
        *keep, F.size("_terms").alias("n_terms"), F.explode("_terms").alias("term")
    )


def keys_as(names: list[str]) -> list[Column]:
    return [F.col(n).cast("string").alias(n) if n == "document_id" else F.col(n) for n in names]


def anchors(postings: DataFrame, terms: DataFrame, small: bool) -> DataFrame:
    """Rarest term of every query; queries with a term that occurs nowhere vanish.

    Only the term column of the postings is read, and counted per task first.
    """
    hint = F.broadcast if small else (lambda df: df)
    wanted = hint(terms.select("term").distinct())
    frequency = postings.join(wanted, "term", "left_semi").groupBy("term").agg(
        F.count("*").alias("df")
    )
    found = terms.join(frequency, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    keep = ["query_id", "n_terms"] + (["document_id"] if "document_id" in terms.columns else [])
    return (
        found.groupBy(*keep)
        .agg(F.min(F.struct("df", "term")).alias("rarest"))
        .filter(F.col("rarest.df") > 0)
        .select(*keep, F.col("rarest.term").alias("term"))
    )


def pruned(postings: DataFrame, terms: DataFrame, buckets: int = TERM_BUCKETS) -> DataFrame:
    """Stored postings cut to the partitions that the terms lie in.

    At most `buckets` numbers come to the driver, so the scan has a partition filter.
    """
    if "term_bucket" not in postings.columns:
        return postings
    needed = terms.select(term_bucket(F.col("term"), buckets).alias("b")).distinct().collect()
    return postings.filter(F.col("term_bucket").isin(sorted(r.b for r in needed)))


def match(postings: DataFrame, terms: DataFrame, buckets: int = TERM_BUCKETS) -> DataFrame:
    """Chunks holding every term of a query, with the positions of each term.

    A query of one term takes that term's postings. A query of several can only match
    where its rarest term occurs, so its candidates come from that term's postings alone
    and the other terms are looked up by (chunk, term): common terms never produce
    (query, chunk) rows of their own. The query side is broadcast only when its count
    proves it small (anchors and distinct terms are never more rows than it), the
    looked-up pairs only when theirs does; too many candidates are first cut by the next
    rarest terms (`all_places`). Several terms read the postings at least three times
    and store the candidates: pass a stored table, of which only the partitions of the
    asked terms are read (`buckets` is the number it was written with).
    """
    postings = pruned(postings, terms, buckets)
    if "sequence" not in postings.columns:
        postings = postings.withColumn("sequence", F.lit(None).cast("int"))
    counts = terms.agg(
        F.count("*").alias("all"), F.count_if(F.col("n_terms") > 1).alias("several")
    ).first()
    small = counts["all"] <= MAX_BROADCAST_TERMS
    keys = ["query_id", "chunk_id", "document_id", "sequence", "n_terms"]
    single = _candidates(postings, terms.filter("n_terms = 1"), small).select(
        *keys, F.array("positions").alias("places")
    )
    if not counts["several"]:
        return single
    compound = terms.filter("n_terms > 1")
    pairs = materialise(
        _candidates(postings, anchors(postings, compound, small), small).select(*keys), "candidates"
    )

    def read(asked: DataFrame) -> DataFrame:
        return postings.select("chunk_id", "term", "positions").join(F.broadcast(asked) if small else asked, "term")

    def counted() -> DataFrame:
        wanted = compound.select("term").distinct()
        return read(wanted).groupBy("term").agg(F.count("*").alias("df"))

    return single.unionByName(all_places(read, counted, compound, pairs, keys, small))


def all_places(
    read: Callable[[DataFrame], DataFrame],
    counted: Callable[[], DataFrame],
    compound: DataFrame,
    pairs: DataFrame,
    keys: list[str],
    small: bool,
) -> DataFrame:
    """Candidates that hold every term of their query, with the places of each.

    `read` joins the postings (chunk_id, term, positions) to a table with terms, `counted` gives
    the frequency (term, df) of all terms. While the (candidate, term) rows are too many to
    broadcast, the candidates are cut by their query's next rarest term, which moves that term's
    postings alone; those of common terms are only looked up for what is left, and postings of
    terms that nobody asked for never move.
    """
    asked = compound.select("query_id", "term")
    pairs = narrowed(read, counted, compound, pairs)
    wanted = pairs.join(F.broadcast(asked) if small else asked, "query_id")
    return (
        read(asked.select("term").distinct())
        .join(broadcast_if_small(wanted, MAX_BROADCAST_TERMS), ["chunk_id", "term"])
        .groupBy(*keys)
        .agg(F.collect_list("positions").alias("places"))
        .filter(F.size("places") == F.col("n_terms"))
    )


def narrowed(
    read: Callable[[DataFrame], DataFrame], counted: Callable[[], DataFrame], compound: DataFrame, pairs: DataFrame
) -> DataFrame:
    """Stored candidates without those that lack one of the next rarest terms of their query.

    A query's last term is left to the look-up, and so are all terms of queries that share their id.
    """
    ranked = None
    for place in range(2, 2 + NARROWING):
        if (pairs.agg(F.sum("n_terms")).first()[0] or 0) <= MAX_BROADCAST_TERMS:
            break
        if ranked is None:
            alone = compound.withColumn("_rows", F.count("*").over(Window.partitionBy("query_id")))
            alone = alone.filter(F.col("_rows") == F.col("n_terms")).select("query_id", "n_terms", "term")
            rarity = Window.partitionBy("query_id").orderBy("df", "term")
            known = alone.join(counted(), "term").withColumn("_place", F.row_number().over(rarity))
            ranked = materialise(known, "ranked-terms")
        cutting = ranked.filter((F.col("_place") == place) & (F.col("n_terms") > place)).select("query_id", "term")
        if cutting.isEmpty():
            break
        cut = pairs.join(read(cutting).select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_semi")
        others = pairs.join(cutting.select("query_id"), "query_id", "left_anti")
        pairs = materialise(cut.unionByName(others), "candidates")
    return pairs


def _candidates(postings: DataFrame, terms: DataFrame, small: bool) -> DataFrame:
    """Postings of the terms, kept to the document a query names."""
    filtered = "document_id" in terms.columns
    asked = terms.withColumnRenamed("document_id", "_only") if filtered else terms
    found = postings.join(F.broadcast(asked) if small else asked, "term")
    if not filtered:
        return found
    return found.filter(F.col("_only").isNull() | (F.col("_only") == F.col("document_id")))


def cover_density(places: Column) -> Column:
    """Rank by minimal covers: 0.1 / (1 + words in between) each.

    `places` holds one sorted position list per term. One pass over all occurrences in order
    keeps the last place of every term: the least of these begins the latest cover that ends
    here, and of the occurrences with the same begin the first ends the cover.
    """
    spots = F.array_sort(
        F.flatten(
            F.transform(
                places,
                lambda p, term: F.transform(p, lambda x: F.struct(x.cast("int").alias("at"), term.alias("term"))),
            )
        )
    )
    numbered = F.transform(
        spots, lambda s, i: F.struct(s["at"].alias("at"), s["term"].alias("term"), i.alias("index"))
    )

    def step(state: Column, spot: Column) -> Column:
        last = F.transform(
            state["last"], lambda v, term: F.when(term == spot["term"], spot["index"]).otherwise(v)
        )
        return bind(last, lambda found: advanced(state, spot, found, F.array_min(found)))

    def advanced(state: Column, spot: Column, found: Column, begin: Column) -> Column:
        def gain(all_spots: Column) -> Column:
            words = spot["at"] - F.get(all_spots, begin)["at"]
            inside = spot["index"] - begin + 1
            return F.lit(DEFAULT_WEIGHT) / (F.lit(2) + words - inside)

        covers = (begin >= 0) & (begin != state["begin"])
        added = F.when(covers, gain(state["spots"])).otherwise(F.lit(0.0))
        return F.struct(
            found.alias("last"),
            F.greatest(begin, state["begin"]).alias("begin"),
            (state["total"] + added).alias("total"),
            state["spots"].alias("spots"),
        )

    def total(all_spots: Column) -> Column:
        start = F.struct(
            F.transform(places, lambda _: F.lit(-1)).alias("last"),
            F.lit(-1).alias("begin"),
            F.lit(0.0).alias("total"),
            all_spots.alias("spots"),
        )
        return F.aggregate(all_spots, start, step, lambda state: state["total"])

    single = F.size(F.element_at(places, 1)) * F.lit(DEFAULT_WEIGHT)
    several = bind(numbered, total)
    return F.round(F.when(F.size(places) == 1, single).otherwise(several), SCORE_DIGITS)


def search(
    postings: DataFrame,
    queries: DataFrame,
    k: int = 10,
    *,
    collection: str | None = DEFAULT_COLLECTION,
    buckets: int = TERM_BUCKETS,
    stem: bool = False,
) -> DataFrame:
    """Top k chunks per query by cover density, ties by chunk id.

    `stem` is for postings built with it.

    A `document_id` column of `queries` restricts a query to one document, before ranking.
    """
    if collection is not None:
        postings = postings.filter(F.col("collection") == collection)
    scored = match(postings, query_terms(queries, stem=stem), buckets).select(
        "query_id", "chunk_id", "document_id", "sequence", cover_density(F.col("places")).alias("score")
    )
    return top_per_group(scored, ["query_id"], [F.col("score").desc(), F.col("chunk_id")], k)


def project_hits(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hit rows as search results: document name, sequence (0 where unknown), source leg.

    Hits are at most k per query; the chunk table is matched on its unique id.
    """
    payload = chunks.select(
        "chunk_id",
        F.col("content"),
        F.col("metadata")["filename"].alias("document_name"),
        F.coalesce(F.col("sequence").cast("int"), F.lit(0)).alias("sequence"),
    )
    return hits.drop("sequence").join(payload, "chunk_id", "left").withColumn("retriever", F.lit("fts"))
