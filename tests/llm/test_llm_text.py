"""WARC round trip, URL and language models, leaks, HTML, packing and the pipeline."""

from __future__ import annotations

import hashlib
import html
import math
import random
import re
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from quarryline.llm import decontaminate, html_text, langid, packing, queries, url_filter, warc

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def key(values):
    return sorted(values, key=repr)


def docs_of(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    schema = "doc_id long, text string, lang string, score string, id string, ids int, bin int"
    return spark.createDataFrame([(*r, None, "s", "i", 1, 2) if len(r) == 2 else (*r, "s", "i", 1, 2) for r in rows], schema)


# --- WARC ----------------------------------------------------------------------------------


def test_archive_round_trip(spark):
    long, other = "<p>" + "x" * 1200, "é" * 600
    rows = [
        (1, "http://a/", long), (2, "http://b/\r\nEvil: 1", long), (9, None, long), (None, "http://n/", long),
        (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "v", other), (7, "v", other),
        (None, "w", "z" * 1000), (None, "w", "z" * 1000), (8, "one", "line\r\n\r\nbreaks" * 100),
    ]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, sha1 string, payload string")
    archive = warc.write(pages)
    found = warc.read(spark, archive).collect()
    want = []
    for i, _, page in rows:
        body = (page or "").encode()
        ids = [x for x, _, p in rows if x is not None and (p or "") == (page or "")]
        first = max(ids) if ids and len(body) >= 1000 else None
        revisit = first is not None and i != first
        want.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert key((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found) == key(want)
    for r in found:
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        block = rest[: int(fields["Content-Length"])]
        assert rest[len(block) :] == b"\r\n\r\n" and "Evil" not in fields
        assert block == (bytes(r.payload) if r.record_type == "response" else b"")
    assert key(bytes(r.payload).decode() for r in found) == key(p or "" for _, _, p in rows)
    stored = spark.read.parquet(archive.payloads)
    assert stored.count() == len({p or "" for _, _, p in rows})


def test_damaged_payloads_are_not_read(spark):
    pages = spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string")
    archive = warc.write(pages)
    broken = spark.read.parquet(archive.payloads).withColumn("body", damaged())
    path = archive.payloads + "-broken"
    broken.write.parquet(path)
    with pytest.raises(Exception, match="damaged payload"):
        warc.read(spark, warc.Archive(archive.headers, path)).collect()


def damaged():
    import zstandard
    from pyspark.sql import functions as F

    return F.lit(zstandard.compress(b"tExt"))


# --- URLs ----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def url_model(spark):
    return url_filter.train(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def test_url_rules_and_models(spark, url_model):
    rows = [
        (1, "http://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"),
        (2, "http://example.net/de/", "example.net", "/de/", "net/", "block"),
        (3, "http://myexample.com/de/1", "myexample.com", "/de/1", None, None),
        (4, "https://w.example.com/de/1#/", "w.example.com", "/de/1", "example.com/de/", "block"),
        (5, "x://org/fr/", "org", "/fr/", "org/fr/", "allow"),
        (6, None, "", "", None, "allow"), (7, "no host", "", "", None, "allow"), (8, "", "", "", None, "allow"),
        (9, "http://b.net?x", "b.net", "", None, None), (None, "http://b.net/?x://y", "b.net", "/", "net/", "block"),
        (10, "http://big-casino-win.example.com/en/5", "big-casino-win.example.com", "/en/5", None, "block"),
        (11, "http://m.spam-farm.example.org/en/51.html", "m.spam-farm.example.org", "/en/51.html", None, "block"),
        (12, "http://ththat.example.com/en/4318#top", "ththat.example.com", "/en/4318", None, "allow"),
        (12, "http://ththat.example.com/en/4318#top", "ththat.example.com", "/en/4318", None, "allow"),
        (13, "http://x.org/" + "fr/" * 20_000, "x.org", "/" + "fr/" * 20_000, "org/fr/", "allow"),
    ]
    pages = spark.createDataFrame([(r[0], r[1], "h", "p") for r in rows], "page_id long, url string, host string, path string")
    found = url_filter.judge(pages, url_model).collect()
    assert key((r.page_id, r.host, r.path, r.rule) for r in found) == key((r[0], *r[2:5]) for r in rows)
    verdicts = defaultdict(set)
    for r in found:
        verdicts[r.page_id].add(r.verdict)
    assert all(verdicts[r[0]] == {r[5]} for r in rows if r[5])
    assert url_filter.judge(pages.limit(0)).collect() == []


def slow_score(model, text):
    """The smoothed likelihood ratio, character by character."""
    buckets, _, _ = url_filter._grams([text])
    total = 0.0
    for i in range(len(text)):
        logs = []
        for counts in model.counts:
            weight = max(url_filter.BACKOFF * 2 * counts[0].sum() / max(1.0, model.counts[:, 0].sum()), 1e-6)
            chance, context = 1 / 256, counts[0].sum()
            for length in range(url_filter.ORDER):
                seen = counts[length][buckets[length][i]]
                chance = (seen + weight * chance) / (max(context, seen) + weight)
                context = counts[length][buckets[length][i - 1 if i else 0]]
            logs.append(np.log(chance))
        total += logs[1] - logs[0]
    return total / len(text)


def test_scores_of_a_batch_are_those_of_each_text(url_model):
    texts = [b"www.casino.example.com/en/12", b"", b"a", b"ththat.example.org/fr/1.html"]
    found = url_model.scores(texts)
    assert found[1] == 0
    for i in (0, 2, 3):
        assert found[i] == pytest.approx(slow_score(url_model, texts[i]))


# --- Language ------------------------------------------------------------------------------


def test_presence_does_not_depend_on_parts(monkeypatch):
    text = "Öl und Straße: the quick brown fox. " * 30
    whole = langid.presence(text)
    monkeypatch.setattr(langid, "CHARACTERS", 17)
    assert (langid.presence(text) == whole).all()
    assert langid.presence("12 ?! \n") is None and langid.presence("") is None


def test_scores_are_those_of_the_kernel():
    rng = np.random.default_rng(2)
    present = [rng.random(langid.BUCKETS) < 0.01 for _ in range(30)]
    labels = ["x" if i % 2 else "y" for i in range(30)]
    model = langid.train(present, labels, count=30, ridge=1e-3)
    rows = np.array(present, float)
    unit = rows / np.sqrt(rows.sum(axis=1, keepdims=True))
    kernel = unit @ unit.T
    targets = np.array([[v == name for name in model.languages] for v in labels], float)
    share = 1 / (targets.sum(axis=0) @ targets.T)
    # With all rows as landmarks the Nyström solution is that of kernel ridge regression.
    solution = np.linalg.solve(kernel + 1e-3 * np.diag(1 / share), targets)
    scores = rows @ model.weights / np.sqrt(rows.sum(axis=1, keepdims=True))
    assert np.allclose(scores, kernel @ solution, atol=1e-3)


def test_learning_holds_the_sample_as_numbers_once():
    rng = np.random.default_rng(4)
    packed = [np.packbits(rng.random(langid.BUCKETS) < 0.05).tobytes() for _ in range(400)]
    labels = [f"l{i % 4}" for i in range(400)]
    tracemalloc.start()
    model = langid.train(packed, labels)
    floors = langid.floors(packed, labels, [packed[:1]] * 400)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400 * langid.BUCKETS * 4 + (32 << 20)
    rows = [np.unpackbits(np.frombuffer(p, np.uint8)).astype(bool) for p in packed]
    assert (langid.train(rows, labels).weights == model.weights).all()
    assert langid.floors(rows, labels, [packed[:1]] * 400) == floors


def test_every_size_of_text_has_a_floor_however_few_were_scored():
    rng = np.random.default_rng(5)

    def text(language, grams):
        row = np.zeros(langid.BUCKETS, bool)
        row[rng.choice(4000, grams, replace=False) + 4000 * language] = True
        return np.packbits(row).tobytes()

    labels = [str(i % 2) for i in range(20)]
    few = langid.floors([text(i % 2, 700) for i in range(20)], labels, [[]] * 20)
    assert min(few[1:]) > langid.REJECTED_BELOW and len(set(few[1:])) == 1
    # The few texts of a size of their own count there, and no floor lies above them.
    sizes = [700] * 120 + [40] * 4
    labels = [str(i % 2) for i in range(124)]
    many = langid.floors([text(i % 2, n) for i, n in enumerate(sizes)], labels, [[]] * 124)
    assert 0 < many[6] < many[10] and many[1] == many[6]
    assert langid.floors([], [], []) == (0.0,) * len(many)


def test_held_out_accuracy_and_edge_cases(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs, ~langid.held_out())
    found = {r.doc_id: r for r in queries.op8_language_id(spark, "/root/testdata/sf0.01").collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(found[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in truth)
    assert np.mean([found[i].lang_pred == truth[i] for i in held]) > 0.97
    rows = [(1, None), (2, ""), (3, "123 ..."), (4, "the and of that with " * 50_000), (None, "les des une"), (5, "\U0001f600")]
    odd = docs_of(spark, [*rows, rows[3]])
    judged = langid.predict(odd, model)
    assert judged.columns[-2:] == ["lang_pred", "score"] and judged.count() == 7
    got = {r.doc_id: (r.lang_pred, r.score) for r in judged.collect()}
    assert [got[i] for i in (1, 2, 3, 5)] == [("und", 0.0)] * 4 and got[4][0] == "en" and got[None][0] == "fr"
    assert all(0 <= s <= 1 for _, s in got.values())
    kept = langid.in_known_language(odd, model)
    assert kept.schema == odd.schema and key(r.doc_id for r in kept.collect()) == key([4, 4, None])
    empty = langid.fit(odd.limit(0))
    assert langid.predict(odd, empty).where("lang_pred <> 'und'").count() == 0
    assert langid.predict(odd.limit(0), model).collect() == []


UNLEARNED = [
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem "
    "i powinni postępować wobec innych w duchu braterstwa.",
    "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e "
    "devono agire gli uni verso gli altri in spirito di fratellanza.",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, "
    "ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı "
    "kardeşlik zihniyeti ile hareket etmelidirler.",
    "Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền lợi. Mọi con người đều được tạo hoá ban "
    "cho lý trí và lương tâm và cần phải đối xử với nhau trong tình bằng hữu.",
]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_unlearned_languages_go_and_short_texts_stay(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    model = langid.fit(docs, ~langid.held_out())
    short = ["the and of that", "les des une", "the of and that with these words"]
    rows = [(i, t) for i, t in enumerate(UNLEARNED + short)]
    stay = langid.in_known_language(docs_of(spark, rows), model)
    assert key(r.doc_id for r in stay.collect()) == list(range(len(UNLEARNED), len(rows)))
    clean = docs.where(langid.held_out() & docs.lang.isNotNull()).where("text rlike '[a-z]'")
    assert langid.in_known_language(clean, model).count() >= 0.97 * clean.count()


# --- Leaks ---------------------------------------------------------------------------------


def slow_distance(item, text):
    previous = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        current = [i]
        for j, b in enumerate(text, 1):
            current.append(min(previous[j] + 1, current[-1] + 1, previous[j - 1] + (a != b)))
        previous = current
    return min(previous)


@given(st.lists(st.integers(0, 3), min_size=1, max_size=20), st.lists(st.integers(0, 3), max_size=30))
@settings(max_examples=150, deadline=None)
def test_edit_distance(item, text):
    assert decontaminate.edit_distance_within(item, text) == slow_distance(item, text)


def edited(rng, words, rate):
    words = list(words)
    for at in rng.sample(range(len(words)), int(rate * len(words))):
        words[at] = rng.choice(["", "changed" + str(rng.random())[2:], words[at].upper() + "x"])
    return " ".join(words)


def test_leaks_against_brute_force(spark):
    rng = random.Random(6)
    prose = lambda n: [rng.choice("the of and a to".split()) if rng.random() < 0.4 else f"w{rng.randrange(3000)}" for _ in range(n)]
    items = [(i, " ".join(prose(n))) for i, n in enumerate((5, 9, 14, 20, 40, 60))]
    items += [(90, None), (91, ""), (92, "two words"), (93, " ".join(prose(900))), (0, items[0][1])]
    rows = []
    for i in range(60):
        text = " ".join(prose(rng.randint(0, 200)))
        if i % 2:
            text += ". " + edited(rng, items[i % 6][1].split(), (0, 0.08, 0.1)[i % 3]) + " " + " ".join(prose(30))
        rows.append((i, text))
    rows += [(100, None), (101, ""), (None, rows[1][1]), (1, rows[1][1]), (102, "x " * 3000 + items[4][1] + " y" * 3000)]
    table = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, id string")
    docs = docs_of(spark, rows)
    found = decontaminate.leaks(docs, table, item_chars_at_once=200)
    got = key((r.id, r.item_id, r.distance) for r in found.collect())
    words = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    want = []
    for i, t in rows:
        for j, item in dict(items).items():
            parts = words(item)
            if 5 <= len(parts) <= 400:
                d = slow_distance(parts, words(t))
                if d <= int(0.2 * len(parts)):
                    want.append((i, j, d))
    assert set(got) <= {(i, j, d) for i, j, d in want} | {(i, j, d + 1) for i, j, d in want}
    near = {(i, j) for i, j, d in want}
    assert len({g[:2] for g in got} & near) >= 0.95 * len(near)
    assert all((i, j) in {g[:2] for g in got} for i, j, d in want if d == 0)
    stay = decontaminate.without_leaks(docs, table, item_chars_at_once=200)
    assert stay.schema == docs.schema
    assert key(r.doc_id for r in stay.collect()) == key(i for i, _ in rows if i not in {g[0] for g in got})
    assert decontaminate.leaks(docs, table.limit(0)).collect() == []
    assert decontaminate.leaks(docs.limit(0), table).collect() == []


def test_long_texts_are_searched_in_stretches(monkeypatch):
    rng = random.Random(1)
    item = [f"i{n}" for n in range(30)]
    text = " ".join([f"w{rng.randrange(10**6)}" for _ in range(150)] + item + ["z"] * 50)
    index = decontaminate.Index.build([(1, " ".join(item))], 4)
    monkeypatch.setattr(decontaminate, "STRETCH", 16)
    assert [x[:3] for x in decontaminate.leaks_in([text], index, 0.2)] == [(0, 0, 0)]


def test_leaks_at_the_full_distance_are_all_found():
    rng = random.Random(3)
    texts, items = [], []
    for n in [5, 7, 10, 12, 15, 20, 29, 40, 60] * 20:
        item = [f"i{rng.randrange(10**6)}" for _ in range(n)]
        passage = list(item)
        for at in rng.sample(range(n), n // 5):
            passage[at] = rng.choice(["", f"other{rng.randrange(99)}", passage[at] + " more"])
        items.append((len(items), " ".join(item)))
        texts.append(" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(50))) + " " + " ".join(passage) + " end" * 9)
    found = decontaminate.leaks_in(texts, decontaminate.Index.build(items, 6), 0.2)
    assert [x[:2] for x in found] == [(i, i) for i in range(len(items))]
    for t, i, d, _ in found:
        assert d == slow_distance(items[i][1].split(), texts[t].split()) <= len(items[i][1].split()) // 5


@pytest.mark.parametrize("size", [403, 405, 411, 900, 1700])
def test_long_items_count_whole(size):
    rng = random.Random(size)
    item = [f"i{rng.randrange(10**6)}" for _ in range(size)]
    around = lambda words: " ".join(["x"] * 50 + words + ["y"] * 50)
    passage = list(item)
    for at in rng.sample(range(size), size // 6):
        passage[at] = rng.choice(["", "other", passage[at] + " more"])
    tail = size % 400
    texts = [around(item[-tail:]), around(item[:400]), around(item[: size // 2]), around(passage), around(item)]
    index = decontaminate.Index.build([(1, " ".join(item))], 6)
    found = {t: d for t, _, d, _ in decontaminate.leaks_in(texts, index, 0.2)}
    assert set(found) == {3, 4} | ({1} if size < 500 else set()) and found[4] == 0
    assert found[3] == slow_distance(item, texts[3].split()) if size < 500 else found[3] <= size // 5


# --- HTML ----------------------------------------------------------------------------------


PAGES = {
    "": "", "plain  text\nonly": "plain text only", "<p>a<p>b &amp; c&nbsp;d": "a\n\nb & c d",
    "<body>1 < 2 and 3 > 2 <b>bold</body>": "1 < 2 and 3 > 2 bold",
    "<script>if(a<b)</script><style>p{}</style><p>x<!-- no --></p>": "x",
    "<div class=ad>only ads</div>": "",
    "<table><tr><td>a<td>b<tr><td>c</table>": "a\n\nb\n\nc",
    "<nav>menu</nav><article><h1>T</h1><p>one<br>two</p></article><footer>f</footer>": "T\n\none two",
    "<article><header><h1>T</h1></header><p>one</p><form>f</form><div id='comments'><p>no</p></div></article>": "T\n\none",
    "<header>site</header><div><h2>Head</h2><p>" + "word " * 30 + "</p><p>" + "more " * 30 + "</p></div>"
    "<div class='side-bar sidebar'>links</div>": "Head\n\n" + ("word " * 30).strip() + "\n\n" + ("more " * 30).strip(),
    "<article><p>a <a href=x>link</a> b<ul><li>1<li>2</ul></article>": "a link b\n\n1\n\n2",
    "<article><p><b>open<p>next</article><div role=banner>no</div>": "open\n\nnext",
    "<p hidden>no</p><p style='display: none'>no</p><p aria-hidden=true>no</p><p>yes": "yes",
}


@pytest.mark.parametrize("page", PAGES)
def test_main_text(page):
    assert html_text.main_text(page) == PAGES[page]


@given(st.text(alphabet="<>/a bp\"'=!-&;x\n", max_size=80))
@settings(max_examples=200, deadline=None)
def test_any_markup_is_read(page):
    text = html_text.main_text(page)
    assert text == text.strip() and "\n\n\n" not in text


BODY = "<p>" + "one two three " * 20 + "</p><p>" + "four five six " * 20 + "</p>"
BODY_TEXT = "\n\n".join((w * 20).strip() for w in ("one two three ", "four five six "))
WRAPPERS = ["content no-sidebar", "has-sidebar", "with-nav", "social-enabled", "post related", "page-header-wide", "widget"]


@pytest.mark.parametrize("name", [*WRAPPERS, None])
@pytest.mark.parametrize("inner", ["<article>{}</article>", "<div><main>{}</main></div>", "<div>{}</div>"])
def test_wrappers_keep_their_article(name, inner):
    tag = f'<div class="{name}">' if name else '<form action="x.aspx"><fieldset>'
    close = "</div>" if name else "</fieldset></form>"
    page = f"<body><nav>menu</nav>{tag}{inner.format(BODY)}<div class=sidebar>links</div>{close}<footer>f</footer>"
    assert html_text.main_text(page) == BODY_TEXT


def test_what_is_no_wrapper_still_goes():
    others = "<div id=comments><article>" + "<p>comment text</p>" * 200 + "</article></div>"
    for inner in (f"<article>{BODY}</article>", f"<div>{BODY}</div>"):
        for extra in ("<form><p>" + "field " * 9 + "</form>", "<div class='related'><article>teaser</article></div>", "<div class=cookie-consent>" + "we ask " * 500 + "</div>"):
            if "<article>" in inner or "<article>" not in extra:
                assert html_text.main_text(f"<body>{inner}{extra}") == BODY_TEXT
    assert html_text.main_text(f"<body><article>{BODY}</article>{others}") == BODY_TEXT
    assert html_text.main_text("<form><div class=ad>only ads</div></form>") == ""


def test_articles_of_the_pages(spark):
    found = queries.op9_html_text(spark, "/root/testdata/sf0.01").collect()
    texts = {r.page_id: (r.text, r.n_chars) for r in found}
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    for r in pages:
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        want = "\n\n".join(b for b in blocks if b)
        assert texts[r.page_id] == (want, len(want))


RENAMED = {
    "article": lambda page: re.sub(r"<(/?)article\b", r"<\1div", page),
    "all names": lambda page: re.sub(
        r"(<\w+)\s(?:class|id|role)=(?:\"[^\"]*\"|[^\s>]+)", r"\1", re.sub(r"<(/?)(?:article|nav|footer)\b", r"<\1div", page)
    ),
}


@pytest.mark.parametrize("names", RENAMED)
def test_articles_are_found_without_names(spark, names):
    from collections import Counter

    kept = found = both = 0
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        want = Counter(html_text.main_text(r.html).split("\n\n"))
        got = Counter(html_text.main_text(RENAMED[names](r.html)).split("\n\n"))
        kept, found, both = kept + want.total(), found + got.total(), both + (want & got).total()
    assert both >= 0.98 * kept and both >= 0.98 * found


def slow_densities(tree):
    """The densities by their definition, node by node over all texts below it."""
    count = len(tree.tags)

    def above(node):
        while node >= 0:
            yield node
            node = tree.parents[node]

    def of(node):
        below = [n for n in range(1, count) if n != node and node in above(n) and not tree.dropped[n]]
        texts = [(n, len(v.strip())) for n, v in tree.texts if not tree.dropped[n] and node in above(n)]
        return (
            sum(n for _, n in texts), len(below),
            sum(n for at, n in texts if tree.linked[at]), sum(tree.tags[n] == "a" for n in below),
        )

    c, _, lc, _ = of(0)
    body = lc / max(1, c)
    own = []
    for node in range(count):
        c, t, lc, lt = of(node)
        if not c or tree.dropped[node]:
            own.append(0.0)
            continue
        share = c / max(1, lc) * max(1, t) / max(1, lt)
        base = math.log(c / max(1, c - lc) * lc + body * c + math.e)
        own.append(c / max(1, t) * max(0.0, math.log(share) / base))
    sums = [sum(own[n] for n in range(1, count) if tree.parents[n] == node) for node in range(count)]
    return own, sums


def test_densities_and_choice_against_the_definition():
    rng = random.Random(11)

    def markup(depth):
        if depth == 0 or rng.random() < 0.3:
            return "word " * rng.randrange(12)
        tag = rng.choice(["div", "p", "a", "section", "b", "ul", "article", "nav", "div class=ad"])
        return f"<{tag}>" + "".join(markup(depth - 1) for _ in range(rng.randrange(4))) + f"</{tag.split()[0]}>"

    for _ in range(150):
        tree = html_text.parse("<body>" + "".join(markup(5) for _ in range(4)))
        own, sums = html_text.densities(tree)
        slow_own, slow_sums = slow_densities(tree)
        assert own == pytest.approx(slow_own) and sums == pytest.approx(slow_sums)
        held = [n for n in range(1, len(own)) if not tree.dropped[n] and tree.tags[n] in html_text.BLOCK and (own[n] or sums[n])]
        holders = {tree.parents[n] for n in held}
        if holders - {0, 1}:
            top = max(sums[n] for n in holders)
            best = [n for n in holders if sums[n] >= top * (1 - 1e-9)]
            above = set(best)
            for n in best:
                while n > 0:
                    n = tree.parents[n]
                    above.add(n)
            if not any(tree.tags[n] in html_text.PAGE for n in best):
                assert html_text._root(tree, own, sums) & above


def test_paragraphs_of_the_article_keep_their_looks():
    for name in ("warning", "share", "related", "notice", "search"):
        assert html_text.main_text(f"<article><p>one<p class={name}>two</article>") == "one\n\ntwo"
        assert html_text.main_text(f"<article><p>one<ul class={name}><li><a href=x>two</a></ul></article>") == "one"


def test_a_slash_that_ends_an_unquoted_value_does_not_close():
    tree = html_text.parse("<p>a <a href=/x/>link</a> <span class='x'/>b <i/>c")
    assert [v.strip() for n, v in tree.texts if tree.linked[n] and v.strip()] == ["link"]


def test_a_main_around_the_whole_page_is_no_article():
    links = "<ul>" + "".join(f"<li><a href=/{i}>menu {i}</a></li>" for i in range(30)) + "</ul>"
    page = f"<body><main><div>{links}</div><div>{BODY}</div><div>short note</div></main>"
    assert html_text.main_text(page) == BODY_TEXT


def test_pages_of_every_kind(spark):
    deep = "<div>" * 3000 + "text" + "</div>" * 3000
    rows = [(1, "u", None), (None, None, "<p>x"), (2, "u", deep), (2, "u", deep), (3, "u", "<p>" + "word " * 200_000)]
    pages = spark.createDataFrame([(*r, "own") for r in rows], "page_id long, url string, html string, text string")
    found = html_text.extract(pages).collect()
    assert key((r.page_id, r.n_chars) for r in found) == key([(1, 0), (None, 1), (2, 4), (2, 4), (3, 999_999)])
    assert html_text.extract(pages.limit(0)).collect() == []


# --- Packing -------------------------------------------------------------------------------


@given(st.lists(st.integers(1, 64), max_size=60))
@settings(max_examples=150, deadline=None)
def test_best_fit_takes_the_tightest_window(lengths):
    lengths.sort(reverse=True)
    windows: list[list[int]] = []
    for piece, length in enumerate(lengths):
        room = {64 - sum(lengths[p] for p in w): i for i, w in enumerate(windows)}
        fitting = [r for r in room if r >= length]
        if fitting:
            windows[room[min(fitting)]].append(piece)
        else:
            windows.append([piece])
    # Among equally full windows any may be taken, so what counts is the fill.
    fills = lambda found: sorted(sum(lengths[p] for p in w) for w in found)
    assert fills(packing.best_fit(lengths, 64)) == fills(windows)


@given(st.lists(st.integers(1, 64), max_size=60), st.integers(0, 8))
@settings(max_examples=150, deadline=None)
def test_filled_windows_hold_every_token_once(lengths, tolerated):
    lengths.sort(reverse=True)
    found = packing.fill(packing.best_fit(lengths, 64), lengths, 64, tolerated)
    tokens = sorted((p, t) for w in found for p, s, n in w for t in range(s, s + n))
    assert tokens == [(p, t) for p, n in enumerate(lengths) for t in range(n)]
    for w in found:
        size = sum(n for *_, n in w)
        assert size <= 64 and (size + tolerated >= 64 or size & (size - 1) == 0)


ALPHABET = list("aAbZ09.,'!? \n\t sStTré\u0301ñÑßΣİ中\u00a0\u3000\x85\x1c-_<|>½²") + ["<|endoftext|>", "'s", "'ll", "n't."]


@given(st.lists(st.sampled_from(ALPHABET), max_size=30).map("".join))
@settings(max_examples=400, deadline=None)
def test_ids_of_words_are_those_of_the_text(text):
    found = np.frombuffer(packing.word_ids(VOCABULARY)(text), "<u4").tolist()
    assert found == tokenizer().encode(text, add_special_tokens=False).ids


def tokenizer(held=[]):  # noqa: B006
    if not held:
        held.append(Tokenizer.from_file(VOCABULARY))
    return held[0]


def test_words_are_forgotten_when_there_are_too_many(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 5)
    encode = packing.WordIds(VOCABULARY)
    for text in ("one two three", "four five six seven", "one, two. Three! x1 y-2"):
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer().encode(text, add_special_tokens=False).ids


def check_packing(rows, texts, window=4096):
    """Every id of every text (with id 2) lies in one piece; sequences are gapless."""
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length > 0
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.id, r.doc_tokens].append((r.start, ids.tolist()))
    want = defaultdict(list)
    for i, t in texts:
        ids = [*tokenizer().encode(t or "", add_special_tokens=False).ids, 2]
        want[i, len(ids)].append(ids)
    assert set(want) == set(pieces)
    for k, copies in want.items():
        assert sum(len(ids) for _, ids in pieces[k]) == sum(map(len, copies))
        for start, ids in pieces[k]:
            assert any(c[start : start + len(ids)] == ids for c in copies)
    padding = total = 0
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= window
        total += end
        padding += 0 if end & (end - 1) == 0 else window - end
    return padding / max(1, total)


def test_documents_are_packed_whole(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(900, None), (901, ""), (None, "null id"), (902, "again"), (902, "again"), (903, "long word " * 20_000)]
    docs = docs_of(spark, rows)
    found = packing.pack(docs, VOCABULARY, group_chars=100_000).collect()
    assert check_packing(found, rows) < 0.01
    assert {r.sequence_id for r in packing.pack(docs, VOCABULARY, group_chars=100_000).collect()} == {r.sequence_id for r in found}
    assert packing.pack(docs.limit(0), VOCABULARY).collect() == []


# --- Pipeline ------------------------------------------------------------------------------


def test_pipeline_stages_and_result(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF)
        assert docs.schema == before.schema
        docs = spark.createDataFrame(docs.collect(), before.schema)
    kept = {r.doc_id for r in docs.collect()}
    texts = [(i, rows[i]) for i in kept]
    lowered = [t.lower() for _, t in texts]
    assert len(lowered) == len(set(lowered))
    found = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in found} == kept
    tokens = {i: len(tokenizer().encode(t, add_special_tokens=False).ids) + 1 for i, t in texts}
    sums = defaultdict(int)
    for r in found:
        sums[r.doc_id] += r.length
    assert sums == tokens


def test_pipeline_on_empty_and_odd_documents(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [
        (1, None, None, None, None), (None, "the of and that with these words", "en", "s", 3), (2, "", "en", "s", 0),
        (3, "the of and that with these words", None, "s", 3), (3, "the of and that with these words", None, "s", 3),
    ]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        assert {r.doc_id for r in docs.collect()} <= {3}
