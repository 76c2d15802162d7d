"""Periodic runs against plain comparison at every lag."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from quarryline.llm import periodic_runs, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def plain_runs(words, least=24, copies=3):
    """Runs by comparing every word with that at every lag."""
    found = {}
    for q in range(1, len(words) // copies + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if length >= max(least, copies * q):
                found.setdefault((start, length), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_text(doc_id, text):
    words = (text or "").encode().split()
    if doc_id is None:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    return words


def plain_row(doc_id, text):
    words = plain_text(doc_id, text)
    runs = plain_runs(words)
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return (
        doc_id,
        len(runs),
        *(best or (None, None, None)),
        1000 * best[1] // best[2] if best else None,
        hashlib.sha256(lines.encode()).hexdigest(),
        hashlib.sha256(kept).hexdigest(),
    )


def made_texts(seed, count):
    draw = random.Random(seed)
    for _ in range(count):
        kinds = draw.choice([1, 2, 3, 8, 60])
        words = [str(draw.randrange(kinds)) for _ in range(draw.choice([0, 1, 5, 30, 80, 200]))]
        for _ in range(draw.randint(0, 3)):
            part = [str(draw.randrange(draw.choice([2, 60]))) for _ in range(draw.randint(1, 20))]
            at = draw.randint(0, len(words))
            words[at:at] = (part * 12)[: draw.randint(0, 12 * len(part))]
        yield words


@pytest.mark.parametrize("least,copies", [(24, 3), (6, 3), (1, 3), (12, 4)])
def test_runs_are_those_of_all_lags(least, copies):
    texts = list(made_texts(least, 250))
    counts, found, left = periodic_runs.runs_of([" ".join(t).encode() for t in texts], least, copies)
    assert sum(map(len, found)) > 100
    for words, n, runs, kept in zip(texts, counts, found, left):
        plain = plain_runs(words, least, copies)
        assert n == len(words) and [tuple(r) for r in runs.tolist()] == plain
        dropped = {i for s, m, q in plain for i in range(s + q, s + m)}
        assert kept.decode() == " ".join(w for i, w in enumerate(words) if i not in dropped)


def test_rare_words_split_until_nothing_is_left():
    words = [w for i in range(400) for w in (f"w{i}", f"w{i + 1}", f"w{i + 2}")]
    number, before, _, _ = periodic_runs.words_of([" ".join(words).encode()])
    low, high = periodic_runs.frequent_segments(number, before)
    for a, b in zip(low, high):
        assert b - a >= 24 and all(words[a:b].count(w) >= 3 for w in words[a:b])
    rare = " ".join(["x y"] * 20 + [f"only{i}" for i in range(50)] + ["z"] * 30).encode()
    number, before, _, _ = periodic_runs.words_of([rare])
    low, high = periodic_runs.frequent_segments(number, before)
    assert sorted(zip(low.tolist(), high.tolist())) == [(0, 40), (90, 120)]


def test_wrong_hashes_are_found_out(monkeypatch):
    monkeypatch.setattr(periodic_runs, "_mixed", lambda values: values % 3)
    texts = list(made_texts(3, 40))
    _, found, _ = periodic_runs.runs_of([" ".join(t).encode() for t in texts])
    for words, runs in zip(texts, found):
        assert set(map(tuple, runs.tolist())) <= set(plain_runs(words, 1))


def test_long_and_degenerate_texts():
    draw = random.Random(1)
    long = [str(draw.randrange(30)) for _ in range(200_000)] + ["a", "b", "c"] * 40_000
    signs = [str(bin(i).count("1") & 1) for i in range(100_000)]
    for words, runs in ((long, [(200_000, 120_000, 3)]), (["a"] * 100_000, [(0, 100_000, 1)]), (signs, [])):
        _, found, _ = periodic_runs.runs_of([" ".join(words).encode()])
        assert [tuple(r) for r in found[0].tolist()] == runs
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(None, copies=2)


def test_query_on_odd_rows(spark, tmp_path):
    draw = random.Random(7)
    texts = [
        None, "", " \t\n\x0b\x0c\r", "one", "a b " * 30, "é\x1cü " * 40, "x " * 23, "x " * 24, "x y " * 12,
        "the cat sat " * 30 + "on " * 25, *(" ".join(t) for t in made_texts(11, 60)),
        "\n".join(str(draw.randrange(900)) for _ in range(3000)),
    ]
    rows = [(i, t, None, "s", 0) for i, t in enumerate(texts)] + [(None, "x " * 30, "en", "s", 0)] * 2 + [(3, "x " * 30, "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.QUERIES["op11_periodic_runs"](spark, str(tmp_path))
    assert found.columns == [
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"
    ]
    assert {t for _, t in found.dtypes} == {"bigint", "string"}
    mine = sorted(map(tuple, found.collect()), key=repr)
    assert mine == sorted((plain_row(r[0], r[1]) for r in rows), key=repr)
    assert sum(r[1] > 0 for r in mine) > 20


def test_query_on_the_smallest_documents(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    short = [(i, t) for i, t in rows if len(t or "") < 20_000]
    mine = {r[0]: tuple(r) for r in queries.QUERIES["op11_periodic_runs"](spark, folder).collect()}
    assert len(mine) == len(rows)
    for i, t in short:
        assert mine[i] == plain_row(i, t)


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "x " * 30, 5, 6)], "doc_id long, text string, runs long, id long")
    row = periodic_runs.periodic_runs(docs).first()
    assert (row.id, row.n_words, [tuple(r) for r in row.runs], row.collapsed) == (1, 30, [(0, 30, 1)], "x")
    assert periodic_runs.periodic_runs(docs.limit(0)).collect() == []
