"""Main text of web pages by consensus host paths.

1. Each page's containers are scored: a block of running text counts for the container it
   stands in, half for the one around that, less its share of link text.
2. Containers vote with their part of the page's score for their path, written as tags
   with classes whose digits are generalised. Votes are summed per host and path (map-side
   combined), and each host keeps its best paths.
3. Pages are joined to their host's paths and extracted again: the first path that a page
   has decides which subtrees are the article; a page with none keeps its own best container.
   A path inside an article or main element stands for all of that element, so a body
   container or one of several sections doesn't cut off its siblings.

Within the article, navigation, asides, forms, notices, adverts, comments and hidden parts
are left out. They are known by tags and roles, by class names and ids made of such words
only, and, where a name merely holds such a word, by links that make up most of the text; a
form around most of the page isn't one. Character references are decoded, white space inside a block becomes one
space, blocks are joined by two line feeds. Whole pages are read.

A host with a large share of the pages is one key of the join in step 3; that is a
sort-merge join, whose over-large partitions adaptive execution splits.

Defined results: null or empty html gives an empty text; a null or odd url is host "" and
votes like any other; broken markup is read as far as it goes (an unclosed tag is closed by
its parent, a stray end tag is skipped, an attribute's missing quote ends with the tag, an
unclosed script or style reaches to the end, any other unclosed element that has no text
counts as empty); deep and very long pages take memory in proportion to their length; repeated rows get a row each; an empty table gives
an empty result. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, materialize
from .tokenization import slices

# Names from the HTML standard and common class names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg select".split())
#: Of these, the ones whose content isn't markup: without an end tag they reach to the end of the page.
RAW_TEXT = frozenset("script style textarea title iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = frozenset("article body center div main section td".split())
LISTS = frozenset("dl form header ol table ul".split())
BOILER_TAGS = frozenset("nav footer aside button dialog".split())
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs consent cookie cookies footer gdpr login masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo promoted related share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
COMMENT_WORDS = frozenset("comment comments disqus replies respond".split())
#: Words that a boilerplate word may stand with in a class name without changing its meaning.
NEUTRAL_WORDS = frozenset(
    "area bar block bottom box button buttons center column container content fixed group holder icon icons inner item items left link links list main media outer page panel posts primary region right row secondary section site slot sticky thread top unit wrap wrapper".split()
)
BOILER_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
#: A start tag of the key ends open elements of the named kinds, up to the nearest list or table.
ENDS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
FENCE = {"li": {"ul", "ol"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}

#: A tag whose quotes don't end where an attribute can end is cut at its first ">".
_TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"(?=[\s/>])|'[^']*'(?=[\s/>]))*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_DIGITS = re.compile(r"[0-9]+")
_PARTS = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in RAW}


def class_says(name: str, words: frozenset[str]) -> int:
    """2 if a class or id consists of ``words`` and neutral ones, 1 if it holds one of ``words``, else 0."""
    parts = [x for x in _PARTS.split(name) if x and not x.isdigit()]
    if not any(x in words for x in parts):
        return 0
    return 2 if all(x in words or x in NEUTRAL_WORDS for x in parts) else 1


class Paths:
    """The paths of one page as numbers: a path is its parent's number and a last step."""

    def __init__(self) -> None:
        self.number: dict[tuple[int, str], int] = {}
        self.parent: list[int] = []
        self.step: list[str] = []

    def child(self, parent: int, step: str) -> int:
        found = self.number.get((parent, step))
        if found is None:
            found = self.number[parent, step] = len(self.parent)
            self.parent.append(parent)
            self.step.append(step)
        return found

    def text(self, path: int) -> str:
        steps = []
        while path >= 0:
            steps.append(self.step[path])
            path = self.parent[path]
        return ">".join(reversed(steps))

    def find(self, text: str) -> int | None:
        path = -1
        for step in text.split(">"):
            found = self.number.get((path, step))
            if found is None:
                return None
            path = found
        return path

    def under(self, path: int) -> list[bool]:
        """For each path, whether it is ``path`` or below it."""
        out: list[bool] = []
        for i, p in enumerate(self.parent):  # parents come first
            out.append(i == path or (p >= 0 and out[p]))
        return out


class Node:
    """An open element.

    ``hard`` boilerplate (by tag, role, or reader comments) holds for all inside. ``soft``, what
    only a class name says, ends at an article. ``doubt`` is the nearest element around (up to an
    article) for which that isn't clear: a form, or a class name that merely holds such a word;
    what its text looks like decides.
    """

    __slots__ = ("chars", "doubt", "hard", "in_article", "link", "links", "outer", "parent", "path", "soft", "tag")

    def __init__(self, tag: str, parent: Node | None, attributes: str, paths: Paths):
        self.tag, self.parent = tag, parent
        hard, soft, within, self.outer = (parent.hard, parent.soft, parent.in_article, parent.doubt) if parent else (False, False, False, None)
        self.link = tag == "a" or bool(parent and parent.link)
        self.chars = self.links = 0
        main, classes = tag in ("article", "main"), ""
        if main:
            soft, self.outer = False, None
        doubt = tag == "form"
        if attributes and not attributes.isspace():
            held = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)}
            names = held.get("class", "").lower().replace(">", "")
            classes = "".join(f".{_DIGITS.sub('#', c)}" for c in sorted(names.split()))
            hidden = "hidden" in held or held.get("aria-hidden") == "true" or "display:none" in held.get("style", "").replace(" ", "").lower()
            hard = hard or hidden or held.get("role", "").lower() in BOILER_ROLES
            if tag not in ("body", "html", "main"):
                named = [*names.split(), held.get("id", "").lower()]
                says = max(class_says(n, BOILER_WORDS) for n in named)
                # Of headings, paragraphs and the like only a name that is such a word outright tells anything.
                if says == 2 and tag not in CONTAINER and tag not in LISTS:
                    says = 2 if any(n in BOILER_WORDS for n in named) else 0
                hard = hard or any(class_says(n, COMMENT_WORDS) == 2 for n in named)
                soft = soft or (not main and says == 2)
                doubt = doubt or (not main and (says == 1 or any(class_says(n, COMMENT_WORDS) == 1 for n in named)) and (tag in CONTAINER or tag in LISTS))
        self.hard = hard or tag in BOILER_TAGS or (tag == "header" and not within)
        self.soft = soft
        self.doubt: Node | None = self if doubt else self.outer
        self.in_article = within or main
        self.path = paths.child(parent.path if parent else -1, tag.replace(">", "") + classes)

    def boiler(self, page_chars: int) -> bool:
        if self.hard or self.soft:
            return True
        at = self.doubt
        while at is not None:
            # A form around most of the page is no form of the page's; a doubtful name needs links to prove it.
            if at.chars <= page_chars / 2 if at.tag == "form" else at.links > at.chars / 2:
                return True
            at = at.outer
        return False


@dataclass
class Page:
    """(text, element, characters of link text) of a page's blocks, in page order."""

    found: list[tuple[str, Node, int]]
    paths: Paths

    def kept(self) -> list[tuple[str, Node, int]]:
        """The blocks that aren't boilerplate."""
        total = sum(len(t) for t, _, _ in self.found)
        known: dict[int, bool] = {}
        for _, node, _ in self.found:
            if id(node) not in known:
                known[id(node)] = node.boiler(total)
        return [x for x in self.found if not known[id(x[1])]]


def blocks(html: str) -> Page:
    paths = Paths()
    root = Node("#page", None, "", paths)
    stack, out = [root], []
    text: list[str] = []
    links = 0

    def flush() -> None:
        nonlocal links
        joined = " ".join("".join(text).split())
        if joined:
            at = stack[-1]
            while at.tag not in BLOCK and at.parent is not None:
                at = at.parent
            out.append((joined, at, links))
            doubt = at.doubt
            while doubt is not None:
                doubt.chars += len(joined)
                doubt.links += min(links, len(joined))
                doubt = doubt.outer
        text.clear()
        links = 0

    def add(raw: str) -> None:
        nonlocal links
        raw = unescape(raw) if "&" in raw else raw
        text.append(raw)
        if stack[-1].link:
            links += len(raw)

    at = 0
    while m := _TOKEN.search(html, at):
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        closing, tag, attributes = (m[4], m[5], m[6]) if m[5] else (m[1], m[2], m[3])
        tag = (tag or "").lower()
        if not tag:
            continue
        if closing:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if depth and not (tag not in BLOCK and any(n.tag in CONTAINER for n in stack[depth + 1 :])):
                if any(n.tag in BLOCK for n in stack[depth:]):
                    flush()
                del stack[depth:]
            continue
        if tag in RAW:
            # An element that is closed at once is empty, and one that is never closed is its start tag alone.
            end = None if tag == "svg" and attributes.endswith("/") else _RAW_END[tag].search(html, at)
            at = end.end() if end else len(html) if tag in RAW_TEXT else at
            continue
        if tag == "br":
            text.append("\n")
            continue
        if tag in VOID and tag != "hr":
            continue
        if tag in BLOCK:
            flush()
            if tag in CLOSES_P:
                depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == "p" or stack[i].tag in CONTAINER), 0)
                if depth and stack[depth].tag == "p":
                    del stack[depth:]
            if tag in ENDS:
                depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag in ENDS[tag] or stack[i].tag in FENCE[tag]), 0)
                if depth and stack[depth].tag in ENDS[tag]:
                    del stack[depth:]
            if tag == "hr":
                continue
        if not attributes.endswith("/") or tag in BLOCK:
            stack.append(Node(tag, stack[-1], attributes, paths))
    if at < len(html):
        add(html[at:])
    flush()
    return Page(out, paths)


def score_containers(page: Page) -> dict[int, float]:
    """path -> score of the page's containers."""
    scores: dict[int, float] = {}
    for text, node, links in page.kept():
        worth = len(text) * max(0.0, 1 - links / max(1, len(text)))
        share, at = 1.0, node
        while at is not None and share >= 0.25:
            if at.tag in CONTAINER or at.parent is None:
                scores[at.path] = scores.get(at.path, 0.0) + worth * share
                share /= 2
            at = at.parent
    return {p: s for p, s in scores.items() if s > 0}


def best_paths(page: Page, k: int) -> list[tuple[str, float]]:
    """The ``k`` best containers' paths and their shares of the page's score; of equal ones the path that comes first on the page."""
    scores = score_containers(page)
    total = sum(scores.values())
    return [(page.paths.text(p), scores[p] / total) for p in heapq.nsmallest(k, scores, key=lambda p: (-scores[p], p))]


def extract(page: Page, paths: list[str]) -> str:
    """The blocks under the first of ``paths`` that the page has, without boilerplate."""
    kept = page.kept()
    for text in [*paths, *(p for p, _ in best_paths(page, 1))]:
        path = page.paths.find(text)
        if path is None:
            continue
        under = page.paths.under(path)
        inside = next((node for _, node, _ in kept if under[node.path]), None)
        if inside is not None:
            under = page.paths.under(article_around(inside, path))
            return "\n\n".join(t for t, node, _ in kept if under[node.path])
    return ""


def article_around(node: Node, path: int) -> int:
    """The path of the nearest article or main that ``path``, an element at or around ``node``, is or stands in; else ``path``."""
    at: Node | None = node
    while at is not None and at.path != path:
        at = at.parent
    while at is not None and at.tag not in ("article", "main"):
        at = at.parent
    return at.path if at is not None else path


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", paths_kept: int = 3) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    pages = columns(pages, page_id=(id_col, "long"), url=(url_col, "string"), html=(html_col, "string"))
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    pages = pages.withColumn("host", host)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            hosts, paths, votes = [], [], []
            for h, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for path, share in best_paths(blocks(html.as_py() or ""), paths_kept):
                    hosts.append(h)
                    paths.append(path)
                    votes.append(round(1_000_000 * share))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(votes, pa.int64())], names=["host", "path", "votes"])

    tally = pages.select("host", "html").mapInArrow(vote, "host string, path string, votes long").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    ranked = tally.withColumn("place", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), "path"))).filter(F.col("place") <= paths_kept)
    winners = ranked.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("place", "path"))).alias("w")).select("host", F.transform("w", lambda x: x["path"]).alias("paths"))
    # A table of its own: both sides of the join are then dealt by it, and a hot host can be split.
    winners = materialize(winners, "paths")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            texts = [extract(blocks(html.as_py() or ""), paths or []) for html, paths in zip(batch.column(2), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    joined = pages.join(winners.hint("merge"), "host", "left").select("page_id", "url", "html", "paths")
    return joined.mapInArrow(read, "page_id long, url string, text string, n_chars long")
