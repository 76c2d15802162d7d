"""Main text of HTML pages by composite text density."""

from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import arrow_map

# Names that the markup language and common page designs use; plain word lists.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol "
    "optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCK - {"body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "legend"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ITEMS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",),
    "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th"),
    "thead": ("tbody", "thead", "tfoot", "tr", "td", "th"),
    "tfoot": ("tbody", "thead", "tfoot", "tr", "td", "th"),
}
# An item only closes another one of the same list or table.
FENCES = frozenset("ul ol dl menu table select html body".split())
DROPPED = frozenset(
    "aside audio button canvas datalist dialog embed footer frameset head iframe input "
    "map math menu nav noframes noscript object option script select style svg template textarea title video".split()
)
HEADERS = frozenset(["header", "hgroup"])
DROPPED_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog menu menubar navigation search toolbar".split()
)
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense aside banner breadcrumb breadcrumbs byline "
    "comment comments commentlist consent cookie cookies disqus footer gdpr hidden login masthead menu "
    "modal nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination "
    "popup promo promoted promotion recommended related reply respond search share sharing sidebar signup "
    "skip social sponsor sponsored subscribe subscription taboola toolbar topbar warning widget widgets".split()
)
# Words for text of others, which never make an element a wrapper of the page by its size.
FOREIGN_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense comment comments commentlist consent cookie "
    "cookies disqus gdpr hidden modal outbrain overlay popup reply respond taboola".split()
)
FORMS = frozenset(["form", "fieldset"])
# Names such as no-sidebar say what the page around has, not what the element is.
SAYS_OF_PAGE = re.compile(
    r"(?<![a-z0-9])(?:(?:no|not|has|have|with|without)[-_]+[a-z0-9_-]+|[a-z0-9_-]+[-_]+(?:enabled|disabled))(?![a-z0-9_-])"
)
CONTENT = frozenset(["article", "main"])
PAGE = frozenset(["html", "body"])
PARAGRAPHS = HEADINGS | frozenset("blockquote dl figure ol p pre table ul".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>", re.S
)
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
WORD = re.compile(r"[a-z0-9]+")
# A slash that ends a tag; one that ends an unquoted value belongs to the value.
CLOSED = re.compile(r"(?<![^\s\"'])/\Z|\A/\Z|\A[^=]*/\Z")


@dataclass
class Tree:
    """Nodes in document order, and the order in which text and block borders come."""

    tags: list[str] = field(default_factory=lambda: ["html"])
    parents: list[int] = field(default_factory=lambda: [-1])
    dropped: list[bool] = field(default_factory=lambda: [False])
    # 1: left out unless it wraps the article; 2: unless it holds the only article there is.
    doubted: list[int] = field(default_factory=lambda: [0])
    linked: list[bool] = field(default_factory=lambda: [False])
    inside: list[bool] = field(default_factory=lambda: [False])
    texts: list[tuple[int, str]] = field(default_factory=list)


BORDER = "\n"


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


def _left_out(tag: str, attributes: dict[str, str]) -> bool:
    """Whether an element is none of the article, whatever it holds."""
    if tag in DROPPED or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return True
    if attributes.get("role", "").lower() in DROPPED_ROLES:
        return True
    if "style" in attributes and re.search(r"display\s*:\s*none", attributes["style"], re.I):
        return True
    return False


def _doubted(tag: str, attributes: dict[str, str], inside: bool) -> int:
    """Whether an element is none of the article by its class or id, or as a form: 0, 1 or 2."""
    if tag in CONTENT or tag in ("html", "body"):
        return 0
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}".lower()
    words = set(WORD.findall(SAYS_OF_PAGE.sub(" ", names)))
    if words & FOREIGN_WORDS:
        return 2
    if inside and (tag in HEADINGS or tag in ("p", "pre")):
        return 0  # a paragraph of the article, whatever its class says of its looks
    if words & DROPPED_WORDS or tag in FORMS or attributes.get("role", "").lower() == "form":
        return 1
    # A header in the article holds its heading; any other one belongs to the site.
    return int(not inside and (tag in HEADERS or "header" in words))


def parse(page: str) -> Tree:
    """Builds the tree, closing what the page leaves open the way browsers do."""
    tree, stack, at = Tree(), [0], 0
    open_tags: dict[str, int] = {"html": 1}

    def close(count: int) -> None:
        while len(stack) > count:
            tag = tree.tags[stack.pop()]
            open_tags[tag] -= 1
            if tag in BLOCK:
                tree.texts.append((stack[-1], BORDER))

    def text(value: str) -> None:
        if value:
            tree.texts.append((stack[-1], html.unescape(value)))

    size = len(page)
    while at < size:
        begin = page.find("<", at)
        if begin < 0:
            text(page[at:])
            break
        m = TOKEN.match(page, begin) or PLAIN_TAG.match(page, begin)
        if m is None:
            # A lone "<" is text.
            text(page[at : begin + 1])
            at = begin + 1
            continue
        text(page[at:begin])
        at = m.end()
        tag = m[2].lower() if m.lastindex and m[2] else None
        if tag is None:
            continue
        if m[1]:
            if tag == "br":
                text(" ")
            elif tag == "p" and not open_tags.get("p"):
                tree.texts.append((stack[-1], BORDER))
            elif open_tags.get(tag) and tag not in ("html", "body"):
                depth = len(stack) - 1
                while tree.tags[stack[depth]] != tag:
                    depth -= 1
                close(max(depth, 1))
            continue
        if tag in ("html", "body") and open_tags.get(tag):
            continue
        if tag in CLOSES_P and open_tags.get("p"):
            _close_to(tree, stack, ("p",), close)
        if tag in ITEMS:
            _close_to(tree, stack, ITEMS[tag], close)
        parent = stack[-1]
        attributes = _attributes(m[3])
        node = len(tree.tags)
        inside = tree.inside[parent] or tag in CONTENT
        tree.tags.append(tag)
        tree.parents.append(parent)
        tree.inside.append(inside)
        tree.dropped.append(tree.dropped[parent] or _left_out(tag, attributes))
        tree.doubted.append(_doubted(tag, attributes, tree.inside[parent]))
        tree.linked.append(tree.linked[parent] or tag == "a")
        if tag in BLOCK:
            tree.texts.append((parent, BORDER))
        if tag == "br":
            text(" ")
        if tag in VOID or (CLOSED.search(m[3]) and tag not in BLOCK and tag not in RAW):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        stack.append(node)
        open_tags[tag] = open_tags.get(tag, 0) + 1
    close(1)
    _settle(tree)
    return tree


def _settle(tree: Tree) -> None:
    """Leaves out doubted elements with all they hold, but for those that wrap the article.

    A wrapper holds more text of articles or main parts than is kept elsewhere or, where no such
    part is, more text outside of links than is kept elsewhere.
    """
    if not any(tree.doubted):
        return
    count = len(tree.tags)
    own = [0] * count
    for node, value in tree.texts:
        if not tree.dropped[node] and not tree.linked[node]:
            own[node] += len(value.strip())
    # Of each subtree, by text and by text in articles: all of it, and what lies in no doubted part.
    sizes = [own, [n if tree.inside[i] else 0 for i, n in enumerate(own)]]
    held, free = [list(s) for s in sizes], [list(s) for s in sizes]
    for node in range(count - 1, 0, -1):
        parent = tree.parents[node]
        for whole, open_ in zip(held, free):
            whole[parent] += whole[node]
            if not tree.doubted[node]:
                open_[parent] += open_[node]
    kept = [free[0][0], free[1][0]]
    for node in range(1, count):
        if tree.dropped[node] or tree.dropped[tree.parents[node]]:
            tree.dropped[node] = True
        elif doubt := tree.doubted[node]:
            if doubt == 2:
                wraps = held[1][node] > 0 and not tree.inside[node] and not kept[1]
            else:
                wraps = held[1][node] > kept[1] or (not kept[1] and held[0][node] > kept[0])
            tree.dropped[node] = not wraps
            if wraps:
                kept = [kept[0] + free[0][node], kept[1] + free[1][node]]


def _close_to(tree: Tree, stack: list[int], tags: tuple[str, ...], close) -> None:
    """Closes the outermost open element of `tags` above the nearest fence."""
    found = None
    for depth in range(len(stack) - 1, 0, -1):
        tag = tree.tags[stack[depth]]
        if tag in tags:
            found = depth
        elif tag in FENCES or (tags == ("p",) and tag in ("td", "th", "caption", "button")):
            break
    if found is not None:
        close(found)


def densities(tree: Tree) -> tuple[list[float], list[float]]:
    """Composite density of every node that is not left out, and the sum of its children's."""
    count = len(tree.tags)
    chars, tags, link_chars, link_tags = ([0] * count for _ in range(4))
    for node, value in tree.texts:
        if not tree.dropped[node]:
            n = len(value.strip())
            chars[node] += n
            if tree.linked[node]:
                link_chars[node] += n
    for node in range(count - 1, 0, -1):
        parent = tree.parents[node]
        if not tree.dropped[node]:
            chars[parent] += chars[node]
            tags[parent] += tags[node] + 1
            link_chars[parent] += link_chars[node]
            link_tags[parent] += link_tags[node] + (tree.tags[node] == "a")
    body = link_chars[0] / max(1, chars[0])
    own, sums = [0.0] * count, [0.0] * count
    for node in range(count - 1, -1, -1):
        if chars[node] and not tree.dropped[node]:
            c, t, lc, lt = chars[node], max(1, tags[node]), link_chars[node], link_tags[node]
            base = math.log(c / max(1, c - lc) * lc + body * c + math.e)
            share = c / max(1, lc) * t / max(1, lt)
            own[node] = c / t * max(0.0, math.log(share) / base) if share > 0 else 0.0
        if node:
            sums[tree.parents[node]] += own[node]
    return own, sums


def _root(tree: Tree, own: list[float], sums: list[float]) -> set[int]:
    """The nodes whose text is the article, by density.

    Of the nodes that hold blocks, the one with the greatest sum of its children's densities is the
    article. The body can be it by its many children only: if the best node that holds blocks in
    it has at least half the sum of its bare blocks, that one is taken. The threshold is the
    least density on the path from there up to the body; other branches of the path belong to
    the article if they reach it and are paragraphs or hold blocks, headings on the path in any
    case. An `article` or `main` on the path is taken whole if it has half the density of the best
    node or is nearer to that than to the body's; one that wraps menus and all is neither.
    """
    nodes = [n for n in range(len(tree.tags)) if not tree.dropped[n] and (own[n] or sums[n])]
    if not nodes:
        return {0}
    holders = {tree.parents[n] for n in nodes if n and tree.tags[n] in BLOCK}
    rank = lambda n: (sums[n], own[n], tree.tags[n] in CONTENT, -n)
    best = max((n for n in nodes if n in holders), key=rank, default=None)
    if best is None:
        best = max(nodes, key=rank)
    while tree.tags[best] in PAGE:
        inside = [n for n in nodes if n and tree.parents[n] == best]
        first = max((n for n in inside if n in holders), key=rank, default=None)
        bare = sum(own[n] for n in inside if n not in holders)
        if first is None or (tree.tags[first] not in PAGE and sums[first] < bare / 2):
            break
        best = first
    path, node = [best], best
    while node:
        node = tree.parents[node]
        path.append(node)
    body = next((n for n in path if tree.tags[n] == "body"), 0)
    like_best = lambda n: 2 * own[n] >= own[best] or own[n] ** 2 >= own[best] * own[body]
    content = next((n for n in path if tree.tags[n] in CONTENT and like_best(n)), None)
    if content is not None:
        return {content}
    ways = [n for n in path if tree.tags[n] not in PAGE]
    least = min(own[n] for n in ways or path)
    chosen = {best}
    for n in range(1, len(tree.tags)):
        on_path = tree.parents[n] in path and n not in path and not tree.dropped[n]
        dense = own[n] >= least and (tree.tags[n] in PARAGRAPHS or n in holders)
        if on_path and (dense or tree.tags[n] in HEADINGS and tree.parents[n] in ways):
            chosen.add(n)
    for n in ways:
        if n != best:
            chosen.add(-n - 1)  # text that stands in the node itself
    return chosen


def main_text(page: str | None) -> str:
    """The article of a page, blocks parted by an empty line; empty if there is none."""
    tree = parse(page or "")
    own, sums = densities(tree)
    chosen = _root(tree, own, sums)
    kept = [False] * len(tree.tags)
    for node in range(len(tree.tags)):
        parent = tree.parents[node]
        kept[node] = node in chosen or (parent >= 0 and kept[parent])
    blocks, current = [], []
    for node, value in tree.texts:
        if value is BORDER:
            if current:
                blocks.append("".join(current))
                current = []
        elif not tree.dropped[node] and (kept[node] or -node - 1 in chosen):
            current.append(value)
    blocks.append("".join(current))
    return "\n\n".join(b for b in (" ".join(x.split()) for x in blocks) if b)


def extract(
    pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html"
) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every page, from its whole html.

    Null html is empty and has an empty text. Pages are judged one by one, so repeated rows,
    null ids and null urls pass through as they are, an empty table gives an empty one, and a page
    of any length is read whole in one task. Other columns of the input are left out.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(t) for t in batch.column(2).to_pylist()]
        sizes = pa.array([len(t) for t in texts], pa.int64())
        return pa.record_batch(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes],
            ["page_id", "url", "text", "n_chars"],
        )

    rows = pages.select(
        F.col(id_column).cast("long").alias("page_id"),
        F.col(url_column).cast("string").alias("url"),
        F.col(html_column).cast("string").alias("html"),
    )
    return arrow_map(rows, run, "page_id long, url string, text string, n_chars long")
