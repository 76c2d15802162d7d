"""Exact, SimHash, suffix and passage deduplication against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quarryline.llm import components, exact_dedup, simhash, substring_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, id string, mark string, fingerprint int, n_bytes string, body string"


def frame(spark, rows):
    """Rows of (doc_id, text) with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "x", "y", 1, "z", "b") for r in rows], SCHEMA)


def key(values):
    return sorted(values, key=repr)


# --- exact ---------------------------------------------------------------------------------


@given(st.binary(max_size=300), st.integers(0, 300), st.integers(1, 50), st.integers(1, 50))
@settings(max_examples=60, deadline=None)
def test_fingerprints_combine_however_a_text_is_cut(data, cut, one, two):
    left, right = data[:cut], data[cut:]
    whole = exact_dedup.fingerprint(data)
    assert exact_dedup.combine(exact_dedup.fingerprint(left, one), exact_dedup.fingerprint(right, two)) == whole


def test_fingerprint_is_the_polynomial():
    data = random.Random(1).randbytes(20_000)
    for place, (p, r) in enumerate(zip(exact_dedup.PRIMES, exact_dedup.BASES), start=1):
        value = 0
        for byte in data:
            value = (value * r + byte + 1) % p
        assert exact_dedup.fingerprint(data, 7001)[place] == value


ROWS = [
    (1, "Same Text"), (2, "same text"), (3, "SAME TEXT"), (4, "É"), (5, "é"), (6, ""), (7, None),
    (None, "same text"), (None, None), (8, "x" * 300_000), (9, "X" * 300_000), (10, "alone"),
    (11, "again"), (11, "again"), (12, "Again "), (None, "only nulls"), (None, "only nulls"),
]


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_exact_duplicates(spark):
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[lowered(t)].append(i)
    want = []
    for i, t in ROWS:
        ids = [x for x in groups[lowered(t)] if x is not None]
        keep = max(ids) if ids else None
        digest = hashlib.sha256(lowered(t).encode()).hexdigest()
        want.append((i, keep, len(groups[lowered(t)]), i == keep, digest))
    found = exact_dedup.exact_duplicates(frame(spark, ROWS)).collect()
    assert key((r.id, r.keep_id, r.group_size, r.kept, r.sha256) for r in found) == key(want)


def test_texts_under_one_fingerprint_are_parted(spark, monkeypatch):
    docs = frame(spark, [(1, "aa"), (2, "ab"), (3, "aa"), (4, "cc")])
    groups = spark.createDataFrame([(0, 2, 3)], "fingerprint long, n_bytes long, keep_id long")
    bodies = spark.createDataFrame(
        [(1, 0, 2, b"aa"), (2, 0, 2, b"ab"), (3, 0, 2, b"aa"), (4, 5, 2, b"cc")],
        "id long, fingerprint long, n_bytes long, body binary",
    )
    monkeypatch.setattr(exact_dedup, "_bodies", lambda *_: bodies)
    assert [tuple(r) for r in exact_dedup.clashes(docs, groups, "doc_id", "text").collect()] == [(0, 2)]


def test_rows_that_stay_keep_their_columns(spark):
    docs = frame(spark, ROWS)
    stay = exact_dedup.without_duplicates(docs)
    assert stay.columns == docs.columns and stay.schema == docs.schema
    texts = [lowered(r.text) for r in stay.collect()]
    assert len(texts) == len(set(texts)) == len({lowered(t) for _, t in ROWS})
    assert {(r.doc_id, lowered(r.text)) for r in stay.collect()} >= {(3, "same text"), (7, ""), (11, "again")}


@pytest.mark.parametrize(
    "operator",
    [
        exact_dedup.exact_duplicates, exact_dedup.without_duplicates, simhash.near_duplicates,
        simhash.one_of_each, suffix_dedup.without_repeats, substring_dedup.repeated_passages,
    ],
)
def test_empty_tables(spark, operator):
    assert operator(frame(spark, [])).collect() == []


# --- SimHash -------------------------------------------------------------------------------


def slow_simhash(text):
    words = lowered(text).encode().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@given(st.text(alphabet="aB é\t\n ", max_size=60))
@settings(max_examples=80, deadline=None)
def test_simhash(text):
    assert simhash.simhash(text.encode()) == slow_simhash(text)


def test_long_texts_are_hashed_in_parts(monkeypatch):
    text = " ".join(str(i % 977) for i in range(5000))
    whole = simhash.simhash(text.encode())
    monkeypatch.setattr(simhash, "SHINGLES_AT_ONCE", 7)
    assert simhash.simhash(text.encode()) == whole


def scattered(count, seed):
    rng, out = random.Random(seed), []
    for _ in range(count):
        value = rng.getrandbits(64)
        out.append(value)
        for distance in range(1, 7):
            near = value
            for bit in rng.sample(range(64), distance):
                near ^= 1 << bit
            out.append(near)
    return np.unique(np.array(out, np.uint64))


def slow_classes(values, distance):
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= distance) + i + 1:
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_golay_code_corrects_three_errors():
    rng = np.random.default_rng(4)
    words = rng.integers(0, 1 << 23, 500)
    index = simhash.decode(words)
    clean = words ^ simhash._corrections()[simhash._syndromes(words)]
    assert (simhash._syndromes(clean) == 0).all() and (clean >> 11 == index).all()
    assert (np.bitwise_count(clean ^ words) <= 3).all()
    sizes = Counter(Counter(simhash.nearby(words, 23)[0].tolist()).values())
    assert set(sizes) == {1, 6}


def test_pairs_within_four_bits_share_a_key():
    values = scattered(80, 7)
    rows, keys = simhash.fuzzy_keys(values)
    held = defaultdict(set)
    for r, k in zip(rows.tolist(), keys.tolist()):
        held[r].add(k >> 1)
    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= 4) + i + 1:
            assert held[i] & held[int(j)]


@pytest.mark.parametrize("block", [3, 4096])
def test_links_join_what_near_pairs_join(spark, block):
    # A dense cloud beside scattered pairs, so that keys overflow the small block.
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    cloud = [centre ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for _ in range(60)]
    values = np.unique(np.concatenate([scattered(40, 9), np.array(cloud, np.uint64)]))
    rows = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fingerprint long")
    labels = {r.node: r.component for r in components.components(simhash.links(rows, block=block)).collect()}
    mine, classes = defaultdict(set), defaultdict(set)
    for v, c in zip(values.view(np.int64).tolist(), slow_classes(values, 4)):
        classes[c].add(v)
        mine[labels.get(v, v)].add(v)
    assert key(map(sorted, mine.values())) == key(map(sorted, classes.values()))


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    found = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}
    assert {r.node: r.component for r in found} == want and len(found) == len(want)


def test_near_duplicates(spark):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [
        (5, base), (3, base.upper()), (9, base.replace("word200", "other")), (None, base), (20, "something else"),
        (21, None), (22, ""), (23, " \n"), (30, base + " tail"), (30, base + " tail"), (None, "lonely null text here"),
    ]
    found = simhash.near_duplicates(frame(spark, rows)).collect()
    values = {r: slow_simhash(r[1]) for r in rows}
    distinct = np.array(sorted(set(values.values())), np.uint64)
    classes = dict(zip(distinct.tolist(), slow_classes(distinct, 4)))
    ids = defaultdict(list)
    for i, t in rows:
        ids[classes[values[i, t]]].append(i)
    want = []
    for i, t in rows:
        known = [x for x in ids[classes[values[i, t]]] if x is not None]
        want.append((i, values[i, t], min(known) if known else None))
    assert key((r.id, r.fingerprint % (1 << 64), r.component) for r in found) == key(want)
    stay = simhash.one_of_each(frame(spark, rows)).collect()
    assert len(stay) == len(ids) and {r.doc_id for r in stay} == {w[2] for w in want}


# --- repeated bytes ------------------------------------------------------------------------


def slow_repeats(rows, length):
    seen = Counter()
    for _, t in rows:
        data = (t or "").encode()
        seen.update(data[s : s + length] for s in range(len(data) - length + 1))
    out = []
    for i, t in rows:
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - length + 1):
            if seen[data[s : s + length]] > 1:
                gone[s : s + length] = True
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((i, len(data), int(gone.sum()), runs, bytes(np.frombuffer(data, np.uint8)[~gone])))
    return out


def prose(rng, size):
    return "".join(rng.choice("abcdefgé \n") for _ in range(size))


def copied(seed):
    rng = random.Random(seed)
    passages = [prose(rng, n) for n in (350, 400, 401, 450, 700, 1500)]
    rows = []
    for i in range(40):
        text = prose(rng, rng.randint(0, 900))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            text += p[rng.randint(0, len(p) // 3) : len(p) - rng.randint(0, len(p) // 3)] + prose(rng, rng.randint(0, 200))
        rows.append((i, text))
    rows += [(100, None), (101, ""), (None, rows[3][1]), (None, None), (102, rows[5][1]), (103, "ab" * 500)]
    rows += [(104, "z" * 399), (105, "z" * 900), (106, rows[7][1]), (106, rows[7][1]), (107, prose(rng, 3000))]
    return rows


@pytest.mark.parametrize("length,gram,segment", [(400, 64, 1 << 20), (60, 16, 1 << 20), (60, 16, 256)])
def test_repeated_bytes_go(spark, monkeypatch, length, gram, segment):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", segment)
    rows = copied(length + segment)
    docs = frame(spark, rows)
    # Small segments only take effect in this process, so its functions run here.
    if segment < 1 << 20:
        assert_anchors_cover(rows, length, gram, segment)
        return
    found = suffix_dedup.without_repeats(docs, length, gram).collect()
    mine = [(r.id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found]
    assert key(mine) == key(slow_repeats(rows, length))


def assert_anchors_cover(rows, length, gram, segment):
    """Every window start belongs to one row, in order, also across segments."""
    for _, text in rows:
        data = np.frombuffer((text or "").encode(), np.uint8)
        starts = []
        for base in range(0, len(data) - length + 1, segment):
            part = data[base : base + segment + length - 1]
            if len(part) >= length:
                _, _, at, lo, hi = suffix_dedup.anchors(part, length, gram)
                assert ((at >= hi) & (at + gram <= lo + length)).all()
                for a, b in zip(lo, hi):
                    starts += range(base + a, base + b + 1)
        assert starts == list(range(max(0, len(data) - length + 1)))


def test_sliding_least():
    values = np.random.default_rng(1).integers(0, 50, 100)
    for width in (1, 2, 3, 7, 16, 100):
        want = [values[i : i + width].min() for i in range(100 - width + 1)]
        assert suffix_dedup.sliding_least(values, width).tolist() == want


# --- passages ------------------------------------------------------------------------------


def test_compact_windows_are_the_tree_nodes():
    rng = np.random.default_rng(1)
    for size, least in ((200, 10), (50, 50), (500, 7), (9, 1), (5, 6)):
        values = rng.integers(1 << 24, 1 << 63, size).astype(np.uint64)
        values[rng.integers(0, size, 2)] = 0
        want = set()
        for i in np.flatnonzero(values):
            a = b = int(i)
            while a > 0 and values[a - 1] >= values[i]:
                a -= 1
            while b < size - 1 and values[b + 1] >= values[i]:
                b += 1
            if b - a + 1 >= least:
                want.add((int(i), a, b))
        found = substring_dedup.compact_windows(values, least)
        assert {tuple(map(int, w)) for w in zip(*found)} == want


def passages(rng, rate):
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shared, rows, holders = [words(n) for n in (51, 60, 80, 120, 300)], [], set()
    for i in range(120):
        text = words(rng.randint(0, 300))
        if i % 3 == 0:
            p = list(rng.choice(shared))
            for at in rng.sample(range(len(p)), int(rate * len(p))):
                p[at] = rng.choice(["", "changed", p[at] + " more"])
            text += p + words(rng.randint(0, 100))
            holders.add(i)
        rows.append((i, " ".join(text)))
    return rows, holders


def similar(a, b, passage, similarity):
    """Whether windows of `passage` words of two texts are alike enough, by trying all."""
    parts = [[tuple(w[i : i + 5]) for i in range(len(w) - 4)] for w in (a.split(), b.split())]
    least = passage - 4
    sets = [[set(p[i : i + least]) for i in range(len(p) - least + 1)] for p in parts]
    return any(len(x & y) >= similarity * len(x | y) for x in sets[0] for y in sets[1])


@pytest.mark.parametrize("rate,recall", [(0, 1.0), (0.015, 0.9)])
def test_passages_that_texts_share(spark, rate, recall):
    rows, holders = passages(random.Random(8), rate)
    texts = dict(rows)
    docs = frame(spark, [*rows, (300, None), (301, "short"), (None, rows[0][1]), (302, rows[3][1]), (302, rows[3][1])])
    found = [r for r in substring_dedup.repeated_passages(docs).collect()]
    ids = {r.id for r in found}
    assert ids - {None, 302} <= holders and {None, 302} <= ids
    assert sum(r.id == 302 for r in found) == 2
    truth = {
        i for i in holders if any(j != i and similar(texts[i], texts[j], 50, 0.8) for j in holders)
    } if rate else holders
    assert len(truth & ids) >= recall * len(truth)
    for r in found:
        assert r.n_words == sum(p.n_words for p in r.passages) and r.class_id is not None
        if r.id in texts:
            assert all(p.first_word + p.n_words <= len(texts[r.id].split()) for p in r.passages)


def test_run_digests_and_cores():
    rng = np.random.default_rng(5)
    tokens = rng.integers(1, 4, 300).astype(np.uint64)
    for size in (1, 2, 5, 8, 41):
        found = substring_dedup.run_digests(tokens, size)
        runs = [tuple(tokens[i : i + size]) for i in range(300 - size + 1)]
        assert len(found) == len(runs) and len(set(found.tolist())) == len(set(runs))
        assert len(set(zip(found.tolist(), runs))) == len(set(runs))
    # Wherever a run of 46 stands, both texts name a core that lies in it.
    shared = rng.integers(1, 1 << 60, 46).astype(np.uint64)
    named = []
    for before in range(0, 90, 7):
        text = np.concatenate([rng.integers(1, 1 << 60, before), shared, rng.integers(1, 1 << 60, 95 - before)]).astype(np.uint64)
        values = substring_dedup.mixed(text) | np.uint64(1 << 24)
        _, place = substring_dedup.cores(*substring_dedup.compact_windows(values, 46), 46, 41)
        named.append({p - before for p in place.tolist() if 0 <= p - before <= 5})
    assert set.intersection(*named)


@pytest.mark.parametrize("size", [56, 60, 80])
def test_partial_holders_do_not_part_copies(spark, size):
    rng = random.Random(size)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows, pairs = [], []
    for trial in range(40):
        lines = words(size)
        # Some of the many partial holders have smaller marks than both copies of the whole.
        for i, part in enumerate([lines[: size * 2 // 3], lines[size // 3 :]] * 6):
            rows.append((trial * 100 + i, " ".join(words(40) + part + words(40))))
        pairs.append((trial * 100 + 50, trial * 100 + 51))
        rows += [(i, " ".join(words(40) + lines + words(40))) for i in pairs[-1]]
    found = {r.id: r for r in substring_dedup.repeated_passages(frame(spark, rows)).collect()}
    for a, b in pairs:
        assert a in found and b in found and found[a].class_id == found[b].class_id
        for i in (a, b):
            assert any(p.first_word <= 40 and p.first_word + p.n_words >= 40 + size for p in found[i].passages)


def test_near_copies_do_not_depend_on_the_first_text_of_their_group(spark):
    rng = random.Random(3)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows, pairs = [], []
    for trial in range(40):
        left, right = words(29), words(29)
        # Texts that hold one half each; most groups have one of them as their first.
        for i in range(12):
            rows.append((trial * 100 + i, " ".join(words(40) + (left if i % 2 else right) + words(40))))
        # Two that are alike with one edited word: neither half is a passage, nor holds 41 equal tokens.
        pairs.append((trial * 100 + 50, trial * 100 + 51))
        rows += [(i, " ".join(words(20) + left + [f"edit{i}"] + right + words(20))) for i in pairs[-1]]
    found = {r.id: r for r in substring_dedup.repeated_passages(frame(spark, rows)).collect()}
    assert set(found) <= {i for pair in pairs for i in pair}
    linked = [a in found and b in found and found[a].class_id == found[b].class_id == a for a, b in pairs]
    assert sum(linked) >= 0.9 * len(pairs)
    for r in found.values():
        assert any(p.first_word < 49 < p.first_word + p.n_words for p in r.passages)
    # A third text with an edit of its own is like one of a pair alone, which has its passage already.
    left, right = words(29), words(29)
    middle = words(12)
    chain = [left + ["a"] + middle + right, left + ["b"] + middle + right, left + ["b"] + middle + ["c"] + right]
    holders = [(10 + i, " ".join(words(40) + (left if i % 2 else right) + words(40))) for i in range(12)]
    rows = [(i, " ".join(words(20) + t + words(20))) for i, t in enumerate(chain)] + holders
    found = {r.id: r for r in substring_dedup.repeated_passages(frame(spark, rows)).collect()}
    assert set(found) == {0, 1, 2} and {r.class_id for r in found.values()} == {0}


def test_packed_cores_make_the_groups_of_their_places():
    rng = np.random.default_rng(2)
    own = rng.integers(1, 1 << 60, 500).astype(np.uint64)
    text = substring_dedup.shingles(own)
    schema = pa.schema([("mark", pa.int64()), ("text", pa.string())])
    batch = pa.record_batch([pa.array([7]), pa.array([" ".join(f"w{i % 170}" for i in range(500))])], schema=schema)
    (windows,) = substring_dedup._window_rows(4, 46, 5, 41)([batch])
    (groups,) = substring_dedup._grouped(46, 41)([windows])
    by_cores = [r for r in groups.to_pylist() if r["reach"] >= substring_dedup.SHARED]
    # The text repeats every 170 words, and so do its cores at their places.
    places = {}
    for r in by_cores:
        places.setdefault(r["group"], set()).add(r["centre"] % 170)
    assert len(text) == 496 and len(by_cores) > 60 and all(len(p) == 1 for p in places.values())
    inside = sum(len(x.as_py()) // substring_dedup.TOKEN_BYTES for x in windows.column(5) if x.is_valid)
    assert len(by_cores) == inside and min(r["centre"] for r in by_cores) >= 0
    near = substring_dedup._grouped(46, 41, by_cores=False)([windows])
    assert sum(b.num_rows for b in near) == groups.num_rows - inside


def test_contents_tell_runs_and_centres_apart():
    rng = np.random.default_rng(4)
    tokens = np.tile(rng.integers(1, 1 << 60, 50).astype(np.uint64), 3)
    at = lambda *x: [np.array(v) for v in zip(*x)]
    found = substring_dedup.run_contents(tokens, *at((3, 9, 20), (53, 59, 70), (103, 109, 120), (3, 10, 20), (3, 9, 21), (4, 9, 20)))
    assert found[0] == found[1] == found[2] and len(set(found.tolist())) == 4


def test_pairs_verified_together_are_those_of_each_alone(monkeypatch):
    rng = np.random.default_rng(9)
    least, want, rows = 10, set(), []
    for i in range(200):
        own, other = (rng.integers(1, 40, rng.integers(0, 60)).astype(np.uint64) << np.uint64(40) for _ in range(2))
        if i % 2:
            other = np.concatenate([other[:5], own[: rng.integers(0, 60)], other[5:]])
        rows.append((i, 1000 * i, i + 500, 7, own, other))
        spans = []
        for a, b in ((own, other), (other, own)):
            hit = [t in b.tolist() for t in a.tolist()]
            held = [at for at in range(len(a) - least + 1) if sum(hit[at : at + least]) >= 9]
            runs = []
            for at in held:
                if runs and at <= runs[-1][1] + 1:
                    runs[-1][1] = at + least - 1
                else:
                    runs.append([at, at + least - 1])
            spans.append(runs)
        if all(spans):
            want |= {(i, i + 500, 1000 * i + a, 1000 * i + b) for a, b in spans[0]}
            want |= {(i + 500, i, 7 + a, 7 + b) for a, b in spans[1]}
    packed = [substring_dedup.packed_tokens(t) for row in rows for t in row[4:]]
    assert sum(map(len, packed)) == 6 * sum(len(t) for row in rows for t in row[4:])
    columns = [pa.array(c, pa.int64()) for c in list(zip(*rows))[:4]]
    batch = pa.record_batch([*columns, pa.array(packed[0::2]), pa.array(packed[1::2])], list("abcdef"))
    for together, pairs in ((200_000, 1 << 15), (300, 1 << 15), (1, 3)):
        monkeypatch.setattr(substring_dedup, "VERIFIED_AT_ONCE", together)
        monkeypatch.setattr(substring_dedup, "PAIRS_AT_ONCE", pairs)
        found = [r for part in substring_dedup._verified(least, 0.8)([batch]) for r in zip(*map(pa.Array.to_pylist, part.columns))]
        assert len(found) == len(set(found)) and set(found) == want and want
