"""The ingest of a whole batch of uploads, with its bookkeeping."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import catalog as store
from quarryline.operators import intake
from quarryline.plans.corpus import ingest
from quarryline.schemas import DEFAULT_COLLECTION
from quarryline.session import materialise
from quarryline.sources import runs
from quarryline.sources.writers import run_manifests

DUPLICATE, NO_TEXT = "duplicate of an earlier document", "no text was extracted"
# What a document passes on its way into the index.
STAGES = ("processing", "processed", "chunked", "embedded", "indexed")


@dataclass(frozen=True)
class Ingested:
    """Vector rows, one manifest row per document, the catalog after, and status changes."""

    vectors: DataFrame
    manifests: DataFrame
    catalog: DataFrame
    transitions: DataFrame


def run(
    catalog: DataFrame,
    pages: DataFrame,
    registered: DataFrame,
    run_id: str,
    finished_at: Column,
    *,
    tables: DataFrame | None = None,
    latency_ms: Column | None = None,
    collection: str = DEFAULT_COLLECTION,
    force: bool = False,
) -> Ingested:
    """Ingests the documents of `catalog` that are neither copies nor indexed already.

    Of equal checksums the earliest document goes on, the others fail as duplicates;
    documents whose id is in `registered` (column id) are skipped unless `force`; documents
    without a page with text fail. Everything else goes from pages to vectors, its status
    to `indexed`.
    """
    uploads = intake.register(intake.reject_duplicates(catalog), registered, force)
    texts = pages.filter(F.trim(F.col("text")) != "").select(F.col("document_id").alias("id")).distinct()
    known = uploads.join(texts.withColumn("_text", F.lit(True)), "id", "left")
    error = F.when(~F.col("unique"), DUPLICATE).when(F.col("_text").isNull(), NO_TEXT)
    judged = materialise(
        known.select(
            F.col("id").alias("document_id"),
            F.col("doc_type").alias("document_type"),
            "register_status",
            error.alias("error"),
        ),
        "uploads",
    )
    wanted = judged.filter(F.col("error").isNull() & (F.col("register_status") == "completed"))
    ours = pages.join(wanted.select("document_id"), "document_id", "left_semi")
    vectors = materialise(ingest(ours, tables, collection), "vectors")
    moment = finished_at
    manifests = run_manifests(judged, vectors, run_id, moment, F.lit(0) if latency_ms is None else latency_ms)
    reached = judged.filter("register_status = 'completed'").select(
        F.col("document_id").alias("id"),
        F.when(F.col("error").isNotNull(), "failed").otherwise(STAGES[-1]).alias("status"),
        F.col("error").alias("error_message"),
    )
    passed = F.when(F.col("status") == "failed", F.array(F.lit(STAGES[0]), F.lit("failed"))).otherwise(
        F.array(*[F.lit(s) for s in STAGES])
    )
    transitions = reached.select("id", F.posexplode(passed).alias("step", "status"), F.lit(run_id).alias("run_id"))
    return Ingested(vectors, manifests, store.update(catalog, reached, moment), transitions)


def publish(done: Ingested, path: str, run_id: str) -> None:
    """Stores what a run adds, all of it visible at once; the same run again takes its own place.

    Read with `published`. The catalog is a state and no addition: update it from the published
    transitions, which a failed run does not have.
    """
    tables = {"vectors": done.vectors, "manifests": done.manifests, "transitions": done.transitions}
    runs.commit(done.vectors.sparkSession, path, run_id, tables)


def published(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Vectors, manifests and transitions of all runs that came to their end."""
    return {name: runs.read(spark, path, name) for name in ("vectors", "manifests", "transitions")}
