"""Language identification by string kernels, Nyström landmarks and kernel ridge regression."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from quarryline.llm.common import arrow_map, written

UNKNOWN = "und"
# Orders of the blended spectrum and buckets that their n-grams are hashed to.
ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 15
# At most so many labelled rows of each language are learned from, and so many are landmarks.
SAMPLE = 400
LANDMARKS = 64
PARTS = 64
RIDGE = 1e-3
# Rows of one matrix product, and characters turned into n-grams at a time.
ROWS = 64
CHARACTERS = 1 << 20
# A text whose best score stays below this is in none of the learned languages, whatever its length.
REJECTED_BELOW = 0.1
# Nor is one that stays below halfway from an undecided score to the one that all but this share of
# the learned texts, and of their beginnings of so many characters, have in their own language, among
# those of about as many n-grams; where these are fewer than LEAST_JUDGED, of the next sizes too.
REJECTED_SHARE = 0.01
BEGINNINGS = (1, 2, 8, 16, 32, 64, 128, 256, 512)
LEAST_JUDGED = 50


@cache
def _letters() -> np.ndarray:
    """Lower-cased letter of every code point, 0 for anything else."""
    table = np.zeros(0x110000, np.uint32)
    for code in range(0x110000):
        character = chr(code)
        if character.isalpha():
            low = character.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


def presence(text: str, buckets: int = BUCKETS) -> np.ndarray | None:
    """Which n-grams of letters and word gaps a text has; None without a letter.

    Texts of any length are read whole, part by part.
    """
    found = np.zeros(buckets, bool)
    overlap = max(ORDERS) - 1
    letters = False
    for at in range(0, len(text) or 1, CHARACTERS):
        part = text[max(0, at - overlap) : at + CHARACTERS]
        codes = _letters()[np.frombuffer(part.encode("utf-32-le", "replace"), np.uint32)]
        letters = letters or bool(codes.any())
        if not at:
            codes = np.concatenate([[0], codes]).astype(np.uint32)
        if at + CHARACTERS >= len(text):
            codes = np.append(codes, np.uint32(0))
        value = np.zeros(len(codes), np.uint32)
        for order in range(1, max(ORDERS) + 1):
            value = value[: len(codes) - order + 1] * np.uint32(0x9E3779B1) + codes[order - 1 :] + np.uint32(order)
            if order in ORDERS and len(value):
                mixed = (value ^ (value >> np.uint32(15))) * np.uint32(0x85EBCA6B)
                found[(mixed >> np.uint32(8)) % np.uint32(buckets)] = True
    return found if letters else None


@dataclass(frozen=True)
class Model:
    """Languages and, by n-gram bucket, the weight that each language's ridge solution gives it.

    With presence rows X of norms |x| and landmarks Z, the scores X Zt A / |x| are the same as
    X W / |x| with W = Zt A, which is what a batch is multiplied with.
    """

    languages: tuple[str, ...]
    weights: np.ndarray
    # Least score of a text in a learned language, by the binary digits of its number of n-grams.
    floors: tuple[float, ...] = ()


def landmarks(features: np.ndarray, labels: np.ndarray, count: int) -> np.ndarray:
    """As many rows of every label as fit, in the order given."""
    chosen, kinds = [], np.unique(labels)
    for kind in kinds:
        chosen.append(np.flatnonzero(labels == kind)[: max(1, count // len(kinds))])
    return features[np.sort(np.concatenate(chosen))]


def train(
    present: list[np.ndarray | bytes], labels: list[str], count: int = LANDMARKS, ridge: float = RIDGE
) -> Model:
    """Fits one-versus-rest ridge regression on the Nyström features of normalised kernels.

    Presence rows may come packed, and are then held as numbers once.
    """
    if not present:
        return Model((), np.zeros((BUCKETS, 0), np.float32))
    features = np.empty((len(present), BUCKETS), np.float32)
    for row, bits in zip(features, present):
        row[:] = _unpacked(bits)
    features /= np.sqrt(features.sum(axis=1, keepdims=True))
    names = np.array(labels)
    languages = np.unique(names)
    marks = landmarks(features, names, count)
    between = (marks @ marks.T).astype(np.float64)
    values, vectors = np.linalg.eigh(between)
    kept = values > 1e-6 * values[-1]
    whiten = vectors[:, kept] / np.sqrt(values[kept])
    mapped = (features @ marks.T).astype(np.float64) @ whiten
    targets = (names[:, None] == languages[None, :]).astype(np.float64)
    # Languages count alike however many rows of each were learned from.
    share = 1 / (targets.sum(axis=0) @ targets.T)
    gram = mapped.T @ (mapped * share[:, None]) + ridge * np.eye(mapped.shape[1])
    solution = np.linalg.solve(gram, mapped.T @ (targets * share[:, None]))
    weights = marks.T.astype(np.float64) @ (whiten @ solution)
    return Model(tuple(languages.tolist()), weights.astype(np.float32))


def fit(
    docs: DataFrame,
    learned: Column | None = None,
    sample: int = SAMPLE,
    text_column: str = "text",
    lang_column: str = "lang",
) -> Model:
    """A model of the languages in `lang_column`, from a bounded sample of labelled rows.

    Of every language at most `sample` texts, those with the least hashes, are learned from,
    each whole; `learned` says which rows may be used. Rows without a text or language are not.
    """
    usable = F.col(text_column).isNotNull() & F.col(lang_column).isNotNull()
    if learned is not None:
        usable = usable & learned
    rows = docs.where(usable).select(
        F.col(text_column).alias("text"),
        F.col(lang_column).cast("string").alias("lang"),
        F.xxhash64(text_column).alias("mark"),
    )
    # The least of every part first, so that no task sees more than the parts' least.
    parted = rows.select("lang", "mark").withColumn("part", F.pmod(F.xxhash64("mark"), F.lit(PARTS)))
    chosen = parted
    for keys in (["lang", "part"], ["lang"]):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("mark"))
        chosen = chosen.withColumn("place", place).where(F.col("place") <= sample)
    chosen = chosen.select("lang", "mark").distinct()
    # At most `sample` keys of each language, so the broadcast is bounded.
    found = rows.join(F.broadcast(chosen), ["lang", "mark"]).dropDuplicates(["lang", "mark"])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(2).to_pylist()
        bits = [None if (f := presence(t)) is None else np.packbits(f).tobytes() for t in texts]
        begun = [[np.packbits(f).tobytes() for n in BEGINNINGS if n < len(t) and (f := presence(t[:n])) is not None] for t in texts]
        columns = [batch.column(0), batch.column(1), pa.array(bits, pa.binary()), pa.array(begun, pa.list_(pa.binary()))]
        return pa.record_batch(columns, ["lang", "mark", "bits", "begun"])

    features = arrow_map(
        found.select("lang", "mark", "text"), run, "lang string, mark long, bits binary, begun array<binary>"
    )
    # The sample comes in a partition at a time, and the beginnings once the model is there.
    stored = written(features.where("bits is not null"), "language-sample")
    taken = sorted((r.lang, r.mark, bytes(r.bits)) for r in stored.select("lang", "mark", "bits").toLocalIterator())
    present, labels = [t[2] for t in taken], [t[0] for t in taken]
    model = train(present, labels)
    rows = stored.select("lang", "mark", "begun").toLocalIterator()
    begun = {(r.lang, r.mark): [bytes(b) for b in r.begun] for r in rows}
    return replace(model, floors=floors(present, labels, [begun[t[:2]] for t in taken]))


def _unpacked(bits: np.ndarray | bytes) -> np.ndarray:
    if isinstance(bits, np.ndarray):
        return bits
    return np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)


def floors(present: list[np.ndarray | bytes], labels: list[str], begun: list[list[bytes]]) -> tuple[float, ...]:
    """Least scores by number of n-grams, from those of texts and beginnings in their own language.

    Every second text of each language is scored by a model of the others; a language's only text
    has no other to be learned from. Every size has a floor as soon as any text was scored.
    """
    scores: dict[int, list[float]] = {}
    order = np.argsort(np.array(labels), kind="stable") if labels else []
    for half in (order[0::2], order[1::2]):
        others = sorted(set(range(len(labels))) - set(half))
        model = train([present[i] for i in others], [labels[i] for i in others])
        for i in half:
            if labels[i] not in model.languages:
                continue
            rows = np.array([_unpacked(b) for b in (present[i], *begun[i])], np.float32)
            grams = rows.sum(axis=1)
            own = rows @ model.weights[:, model.languages.index(labels[i])] / np.sqrt(grams)
            for count, score in zip(grams.tolist(), own.tolist()):
                scores.setdefault(int(count).bit_length(), []).append(score)
    out = [0.0] * (BUCKETS.bit_length() + 1)
    for digits in range(1, len(out)):
        judged, away = list(scores.get(digits, [])), 0
        # Too few to tell: the next sizes, on both sides, tell with them.
        while len(judged) < LEAST_JUDGED and away < len(out):
            away += 1
            judged += scores.get(digits - away, []) + scores.get(digits + away, [])
        if judged:
            low = float(np.quantile(judged, REJECTED_SHARE))
            out[digits] = min(low, (low + 1 / len(set(labels))) / 2)
    return tuple(out)


def predict(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """`docs` with (lang_pred, score); a column of that name in `docs` gets out of the way.

    `score`, from 0 to 1, is the ridge score of the best language, cut to that range. A text
    that is null or has no letter is `und` with score 0, as is any text if nothing was learned.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]

    def run(batches):
        model = shared.value
        for batch in batches:
            texts = batch.column(kept.index(text_column)) if text_column in kept else None
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                names, scores = score_rows(texts.slice(at, ROWS).to_pylist(), model)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    [*kept, "lang_pred", "score"],
                )

    fields = [docs.schema[c] for c in kept]
    added = [StructField("lang_pred", StringType()), StructField("score", DoubleType())]
    return docs.select(*kept).mapInArrow(run, StructType([*fields, *added]))


def _scored(texts: list[str | None], model: Model) -> list[tuple[int, int, float, int]]:
    """(text number, language number, score, n-grams) of the texts with letters."""
    if not model.languages:
        return []
    found = [(i, p) for i, t in enumerate(texts) if t and (p := presence(t)) is not None]
    if not found:
        return []
    rows = np.array([p for _, p in found], np.float32)
    grams = rows.sum(axis=1, keepdims=True)
    results = (rows @ model.weights) / np.sqrt(grams)
    best = results.argmax(axis=1)
    return [(i, b, float(r[b]), int(g)) for (i, _), b, r, (g,) in zip(found, best, results, grams)]


def score_rows(texts: list[str | None], model: Model) -> tuple[list[str], list[float]]:
    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    for i, language, score, _ in _scored(texts, model):
        names[i] = model.languages[language]
        scores[i] = float(min(1.0, max(0.0, round(score, 6))))
    return names, scores


def held_out(id_column: str = "doc_id") -> Column:
    """Rows kept for measuring: CRC-32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 4 == 2, F.lit(False))


def in_known_language(
    docs: DataFrame, model: Model, below: float = REJECTED_BELOW, text_column: str = "text"
) -> DataFrame:
    """The rows of `docs` that have letters and a best score of at least `below`.

    The score must also reach the model's floor for texts of about as many n-grams.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                known = np.zeros(part.num_rows, bool)
                texts = part.column(part.schema.names.index(text_column)).to_pylist()
                for i, _, score, grams in _scored(texts, model):
                    floor = model.floors[grams.bit_length()] if model.floors else below
                    known[i] = score >= max(below, floor)
                yield part.filter(pa.array(known))

    return docs.mapInArrow(run, docs.schema)
