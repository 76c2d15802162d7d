"""URL filter: host and path rules, then the ratio of two character language models."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import arrow_map, byte_values

# Longest n-gram of the models, buckets per order, and weight of the next shorter order.
ORDER = 6
BUCKETS = 1 << 16
BACKOFF = 4.0
# Scores are calibrated on a histogram of this many bins, `WIDTH` to either side of zero.
BINS = 4000
WIDTH = 4.0
# Host words that mark a rejected URL to learn from: a plain list, replaceable by the caller.
REJECTED_WORDS = (
    "ad ads adserver adult affiliate banner bet bets betting bingo bonus casino cheap click clicks "
    "dating escort free gambling jackpot loan loans lottery malware pharma phish phishing pill pills "
    "poker popup porn promo sex slots spam track tracker tracking viagra warez win xxx"
).split()
RULES = (
    ("net/", "block"),
    ("example.net/en/", "allow"),
    ("example.com/de/", "block"),
    ("org/fr/", "allow"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without "://"."""
    text = F.coalesce(url, F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substr(text, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def matching_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        name = F.when(fits, F.lit(rule)).otherwise(name)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def has_word(host: Column, words) -> Column:
    """Whether a part of the host, cut at anything but letters and digits, is one of `words`."""
    return F.arrays_overlap(F.split(host, "[^a-z0-9]+"), F.array(*[F.lit(w) for w in words]))


def _grams(texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Bucket of the n-gram that ends at each character, by length; text of each; text sizes.

    Digits count alike; every text is led in by a border, so its beginning is learned too.
    """
    lead = b"\x00" * (ORDER - 1)
    joined = np.frombuffer(b"".join(lead + t for t in texts), np.uint8).copy()
    joined[(joined >= 48) & (joined <= 57)] = 48
    sizes = np.array([len(t) for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(owner)) + (owner + 1) * (ORDER - 1)
    value, buckets = np.zeros(len(owner), np.uint64), []
    for back in range(ORDER):
        value = (value + joined[place - back] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(29)
        buckets.append((value % np.uint64(BUCKETS)).astype(np.int64))
    return buckets, owner, sizes


@dataclass(frozen=True)
class Model:
    """Counts of n-grams by class (accepted, rejected) and length, and the calibrated threshold."""

    counts: np.ndarray  # 2 x ORDER x BUCKETS
    threshold: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Log-likelihood of rejected less that of accepted, per character; 0 without text."""
        out = np.zeros(len(texts))
        buckets, owner, sizes = _grams(texts)
        if len(owner):
            logs = [self._logs(kind, buckets, owner) for kind in (0, 1)]
            sums = np.bincount(owner, logs[1] - logs[0], len(texts))
            out = sums / np.maximum(sizes, 1)
        return out

    def _logs(self, kind: int, buckets, owner) -> np.ndarray:
        """Each character given those before it, every order smoothed with the next shorter one."""
        counts = self.counts[kind]
        total = counts[0].sum()
        # In proportion to the class, else what neither class has seen favours the smaller one.
        weight = max(BACKOFF * 2 * total / max(1.0, self.counts[:, 0].sum()), 1e-6)
        chance = np.full(len(owner), 1 / 256)
        context = np.full(len(owner), total)
        begins = np.append(True, owner[1:] != owner[:-1])
        for length in range(ORDER):
            seen = counts[length][buckets[length]]
            chance = (seen + weight * chance) / (np.maximum(context, seen) + weight)
            # The context of the next order is the n-gram of this length one character back.
            context = np.append(0, seen[:-1])
            context[begins] = counts[length][buckets[length][begins]]
        return np.log(chance)


def _texts(url_host: Column, path: Column) -> Column:
    return F.encode(F.concat(url_host, path), "utf-8")


def _examples(pages: DataFrame, url: Column, rules, words) -> DataFrame:
    """(text, kind): URLs to learn from, 0 accepted and 1 rejected.

    Rejected are URLs with one of `words` in their host. Accepted are the others, but for those
    that a rule blocks, which may be blocked for where they are and not for what they are.
    """
    host, path = host_and_path(url)
    rows = pages.select(host.alias("host"), path.alias("path")).where("host <> ''")
    _, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    kind = F.when(has_word(F.col("host"), words), 1).when(F.coalesce(verdict, F.lit("")) != "block", 0)
    return rows.select(_texts(F.col("host"), F.col("path")).alias("text"), kind.cast("long").alias("kind")).where(
        "kind IS NOT NULL"
    )


def train(pages: DataFrame, url_column: str = "url", rules=RULES, words=REJECTED_WORDS) -> Model:
    """Counts n-grams over all URLs and sets the threshold that parts both classes best.

    Tasks add up in tables of fixed size, so what reaches the driver is bounded by ORDER and
    BUCKETS (and BINS), however many URLs there are.
    """
    examples = _examples(pages, F.col(url_column).cast("string"), rules, words)
    counted = _counted(examples).groupBy("kind", "cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((2, ORDER * BUCKETS))
    counts[counted.kind.to_numpy(np.int64), counted.cell.to_numpy(np.int64)] = counted.n.to_numpy(np.float64)
    model = Model(counts.reshape(2, ORDER, BUCKETS), 0.0)
    return Model(model.counts, _calibrated(examples, model))


def _counted(examples: DataFrame) -> DataFrame:
    def run(batches):
        counts = np.zeros((2, ORDER * BUCKETS), np.int64)
        for batch in batches:
            texts, kinds = byte_values(batch.column(0)), batch.column(1).to_numpy()
            buckets, owner, _ = _grams(texts)
            for length, places in enumerate(buckets):
                cells = kinds[owner] * ORDER * BUCKETS + length * BUCKETS + places
                counts += np.bincount(cells, minlength=counts.size).reshape(counts.shape)
        kinds, cells = np.nonzero(counts)
        yield pa.record_batch(
            [pa.array(kinds), pa.array(cells), pa.array(counts[kinds, cells])], ["kind", "cell", "n"]
        )

    return examples.mapInArrow(run, "kind long, cell long, n long")


def _calibrated(examples: DataFrame, model: Model) -> float:
    """The score at which the shares of rejected and accepted URLs above it differ most."""
    shared = examples.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = shared.value.scores(byte_values(batch.column(0)))
        bins = np.clip((scores + WIDTH) / (2 * WIDTH) * BINS, 0, BINS - 1).astype(np.int64)
        return pa.record_batch([batch.column(1), pa.array(bins)], ["kind", "bin"])

    rows = arrow_map(examples, run, "kind long, bin long").groupBy("kind", "bin").count().collect()
    seen = np.zeros((2, BINS))
    for r in rows:
        seen[r.kind, r.bin] = r["count"]
    if not seen[1].any() or not seen[0].any():
        return WIDTH
    above = 1 - np.cumsum(seen, axis=1) / seen.sum(axis=1, keepdims=True)
    gain = above[1] - above[0]
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    # In the middle of the gap, a little nearer to neither class.
    edge = (best[0] + best[-1]) / 2 + 1
    return float(edge / BINS * 2 * WIDTH - WIDTH)


def judge(
    pages: DataFrame,
    model: Model | None = None,
    rules=RULES,
    words=REJECTED_WORDS,
    id_column: str = "page_id",
    url_column: str = "url",
) -> DataFrame:
    """(page_id, host, path, rule, verdict, score): one row per page.

    The longest rule that fits decides; else a URL is blocked if its length-normalised
    log-likelihood ratio is above the calibrated threshold. A URL that is null or has no "://"
    has an empty host and path, fits no rule and, saying nothing, is allowed. If no URL is
    rejected to learn from, the models block none. Repeated rows and null ids are judged like
    any others.
    """
    model = model or train(pages, url_column, rules, words)
    shared = pages.sparkSession.sparkContext.broadcast(model)
    host, path = host_and_path(F.col(url_column).cast("string"))
    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    ruled = rows.select("*", rule.alias("rule"), verdict.alias("ruled"), _texts(F.col("host"), F.col("path")).alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = shared.value.scores(byte_values(batch.column(5)))
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:5], pa.array(scores)], ["page_id", "host", "path", "rule", "ruled", "score"]
        )

    schema = "page_id long, host string, path string, rule string, ruled string, score double"
    scored = arrow_map(ruled, run, schema)
    own = F.when(F.col("score") > F.lit(model.threshold), "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "score")
