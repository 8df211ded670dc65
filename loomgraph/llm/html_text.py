"""Main text of web pages: boosted trees over the nodes of a page's tree, decoded from the root down.

A page's block elements are nodes. Boosted trees give each the odds that it belongs to the article, from its
tag, the words in its class, id and role, depth, place among its siblings, and the density of text, links and
tags below it. Decoding takes the choice for the whole tree that is likeliest while nothing below a dropped
node is kept, so no contradiction between an ancestor and a descendant is left. The trees are trained on
pages that are made here in a fixed random order and know their article.

Scripts, styles, templates, frames, text areas, titles and comments of the markup never count as text. Character
references are decoded, white space inside a block becomes one space, blocks are joined by an empty line.
Null and empty pages give an empty text; pages may break off anywhere; repeated pages are each extracted.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import trees
from loomgraph.llm.common import annotate

NAME = re.compile(r"[a-zA-Z][^\s>/]*")
ATTRIBUTE = r"""(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
#: Element names of the HTML standard.
RAW = frozenset("script style template textarea title iframe noembed noframes noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "tbody", "thead"), "tfoot": ("tr", "td", "th", "tbody", "thead")}
HOLDS = frozenset("table ul ol dl html body article section div main td".split())
STOPS = ("td", "th", "table", "button")  # a paragraph outside of these stays open
FOREIGN = ("svg", "math")  # in these an element may close itself

TAGS = ("nav", "header", "footer", "aside", "form", "article", "main", "section", "div", "p", "h1", "h2", "li", "ul", "table", "body", "blockquote", "pre")
GOOD = ("article", "content", "main", "post", "body", "entry", "story", "text", "prose", "page")
POOR = ("nav", "menu", "header", "head", "foot", "footer", "side", "sidebar", "ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "banner", "cookie", "consent", "notice", "alert", "comment", "comments", "reply", "disqus", "share", "social", "related", "promo", "login", "signup", "subscribe", "newsletter", "breadcrumb", "breadcrumbs", "toolbar", "widget", "popup", "modal", "pagination", "copyright", "legal")


@dataclass
class Node:
    tag: str
    up: int
    depth: int
    words: tuple[str, ...] = ()
    down: list[int] = field(default_factory=list)
    pieces: list[tuple[int, str]] = field(default_factory=list)  # own texts with their block's number
    own: int = 0
    links: int = 0
    tags: int = 0
    place: int = 0  # among its siblings


class Tags:
    """The tags of a page in order, in one pass: no character is looked at again for each ``<`` before it."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.dead: set[int] = set()  # places after a quoted value from which no ``>`` outside of quotes follows
        self.seen: dict[str, tuple[int, int]] = {}  # where it was looked for last, and what was found

    def find(self, what: str, at: int) -> int:
        """The next ``what`` from ``at`` on, or -1; a stretch is looked through once."""
        since, found = self.seen.get(what, (0, -2))
        if found != -2 and since <= at and (found < 0 or at <= found):
            return found
        found = self.page.find(what, at)
        self.seen[what] = at, found
        return found

    def after(self, at: int) -> int:
        """The place after the ``>`` of a tag whose attributes start at ``at``, or -1. A ``>`` in a quoted value does not end it, unless there is no other."""
        page, first, path = self.page, self.find(">", at), []
        while first >= 0 and at not in self.dead and (end := self.find(">", at)) >= 0:
            quote = min((q for q in (self.find('"', at), self.find("'", at)) if q >= 0), default=end)
            close = self.find(page[quote], quote + 1) if quote < end else -1
            if close < 0:  # a quote that stays open is no quote
                return end + 1
            path.append(at)
            at = close + 1
        self.dead.update(path)
        return first + 1 if first >= 0 else -1

    def closing(self, tag: str, at: int) -> int:
        """Where the next end tag of ``tag`` starts, or -1."""
        key = "</" + tag
        if self.seen.get(key):
            return -1
        m = re.compile(rf"</{re.escape(tag)}(?![\w-])", re.I).search(self.page, at)
        if not m:
            self.seen[key] = at, -1
        return m.start() if m else -1

    def next(self, at: int) -> tuple[int, int, str, str] | None:
        """(start, end, name with a slash before it if it closes, attributes) of the next tag from ``at`` on; comments and declarations have no name."""
        page = self.page
        while (start := self.find("<", at)) >= 0:
            what = page[start + 1 : start + 2]
            if what in ("!", "?") and what:
                if page.startswith("<!--", start):
                    end = self.find("-->", start + 4)
                    return start, len(page) if end < 0 else end + 3, "", ""
                end = self.find(">", start)
                if end >= 0:
                    return start, end + 1, "", ""
            slash = what == "/"
            if m := NAME.match(page, start + 1 + slash):
                end = self.find(">", m.end()) + 1 if slash else self.after(m.end())
                if end > 0:
                    return start, end, ("/" if slash else "") + m[0].lower(), page[m.end() : end - 1]
            at = start + 1
        return None


def parse(page: str) -> list[Node]:
    """The page's block nodes, each after its parent; the first stands for the page."""
    nodes = [Node("#page", 0, 0)]
    stack: list[tuple[str, int]] = [("#page", 0)]  # open elements and the block node they are in
    places: dict[str, list[int]] = {}  # where in the stack a tag is open; so that no tag has to look through the stack
    block, in_link, at = 0, 0, 0
    tags = Tags(page)

    def text(s: str) -> None:
        nonlocal block
        if s:
            s = html.unescape(s)
            n = nodes[stack[-1][1]]
            n.pieces.append((block, s))
            size = len(s.strip())
            n.own += size
            n.links += size if in_link else 0

    def pop() -> None:
        nonlocal block, in_link
        tag, node = stack.pop()
        places[tag].pop()
        if tag == "a":
            in_link -= 1
        if node != stack[-1][1]:
            block += 1

    def last(names: Iterable[str]) -> int:
        """The place of the last open element of these, or 0."""
        return max((places[t][-1] for t in names if places.get(t)), default=0)

    while found := tags.next(at):
        start, end, tag, attributes = found
        text(page[at:start])
        at = end
        if tag[:1] == "/":
            tag = tag[1:]
            if places.get(tag):
                while stack[-1][0] != tag:
                    pop()
                pop()
        elif tag:
            nodes[stack[-1][1]].tags += 1
            if tag in RAW:
                # outside of foreign elements a slash closes nothing: what follows is the element's own up to its end tag
                if not (attributes.rstrip().endswith("/") and last(FOREIGN)):
                    close = tags.closing(tag, at)
                    if close < 0:  # never past the end of the element it is in
                        up = tags.closing(stack[-1][0], at)
                        at = up if up >= 0 else len(page)
                    else:
                        end = tags.find(">", close)
                        at = end + 1 if end >= 0 else len(page)
                continue
            if tag in VOID:
                if tag == "hr":
                    block += 1
                elif tag == "br":
                    text("\n")
                continue
            if tag in BLOCK and places.get("p"):
                k = places["p"][-1]
                if k > last(STOPS):
                    while len(stack) > k:
                        pop()
            if tag in ENDS:
                k = max(last(ENDS[tag]), last(HOLDS))
                while k and len(stack) > k and stack[k][0] in ENDS[tag]:
                    pop()
                    k = len(stack) - 1 if len(stack) > 1 and stack[-1][0] in ENDS[tag] else k
            if tag == "a":
                in_link += 1
            node = stack[-1][1]
            if tag in BLOCK:
                block += 1
                words = tuple(w for x in re.findall(ATTRIBUTE, attributes) for w in re.split(r"[^a-z]+", "".join(x).lower()) if w) if "=" in attributes else ()
                nodes[node].down.append(len(nodes))
                nodes.append(Node(tag, node, nodes[node].depth + 1, words, place=len(nodes[node].down) - 1))
                node = len(nodes) - 1
            places.setdefault(tag, []).append(len(stack))
            stack.append((tag, node))
    text(page[at:])
    return nodes


def features(nodes: list[Node]) -> np.ndarray:
    n = len(nodes)
    size, links, tags, paragraphs, words = (np.zeros(n) for _ in range(5))
    for i in range(n - 1, -1, -1):
        x = nodes[i]
        size[i] += x.own
        links[i] += x.links
        tags[i] += x.tags
        paragraphs[i] += x.tag == "p"
        words[i] += sum(len(s.split()) for _, s in x.pieces)
        if i:
            for a in (size, links, tags, paragraphs, words):
                a[x.up] += a[i]
    rows, inherited = [], []
    for i, x in enumerate(nodes):
        good, poor = sum(w in GOOD for w in x.words), sum(w in POOR for w in x.words)
        above = inherited[x.up] if i else (0, 0, 0, 0)
        mine = (max(above[0], good), max(above[1], poor), above[2] or x.tag in ("article", "main"), above[3] or x.tag in ("nav", "header", "footer", "aside", "form"))
        inherited.append(mine)
        siblings = nodes[x.up].down
        rows.append([*(x.tag == t for t in TAGS), good, poor, *above, x.depth, len(siblings), x.place / max(len(siblings), 1), np.log1p(size[i]), np.log1p(x.own), links[i] / max(size[i], 1), size[i] / max(size[0], 1), size[i] / (tags[i] + 1), paragraphs[i], size[x.up] / max(len(siblings), 1), words[i], len(x.down)])
    return np.array(rows, float)


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """Which nodes to keep: the likeliest choice in which nothing below a dropped node is kept."""
    keep, drop = np.minimum(0, odds) - np.log1p(np.exp(-np.abs(odds))), np.minimum(0, -odds) - np.log1p(np.exp(-np.abs(odds)))
    best, none = keep.copy(), drop.copy()
    for i in range(len(nodes) - 1, 0, -1):
        none[nodes[i].up] += none[i]
        best[nodes[i].up] += max(best[i], none[i])
    kept = np.zeros(len(nodes), bool)
    kept[0] = best[0] >= none[0]
    for i in range(1, len(nodes)):
        kept[i] = kept[nodes[i].up] and best[i] >= none[i]
    return kept


def blocks(nodes: list[Node], kept: np.ndarray) -> list[str]:
    texts: dict[int, list[str]] = {}
    for x, k in zip(nodes, kept, strict=True):
        if k:
            for b, s in x.pieces:
                texts.setdefault(b, []).append(s)
    joined = (" ".join("".join(texts[b]).split()) for b in sorted(texts))
    return [s for s in joined if s]


def sample_page(r: random.Random) -> tuple[str, set[str]]:
    """A made page and the words of its article; every word of it occurs once."""
    count = [0]

    def text(n: int) -> str:
        count[0] += n
        return " ".join(f"w{count[0] - k}{'.' if k % 9 == 0 else ''}" for k in range(n, 0, -1))

    tag = lambda t, body, words="": f"<{t}{f' {r.choice(['class', 'id'])}={chr(34)}{words}{chr(34)}' if words else ''}>{body}" + ("" if t == "p" and r.random() < 0.15 else f"</{t}>")
    lone = lambda a: r.choice([*a, ""])
    links = lambda k: tag("ul", "".join(f"<li><a href='/{i}'>{text(r.randint(1, 3))}</a></li>" for i in range(k)))
    para = lambda: tag("p", r.choice(["", "<b>"]) + text(r.choice([1, 4, 8, 15, 30, 60, 100])) + r.choice(["", "<br>", f" <a href='/x'>{text(2)}</a> {text(3)}"]))
    advert = lambda: tag(r.choice(["div", "div", "section", "aside"]), r.choice([text(r.randint(2, 25)), tag("p", text(r.randint(4, 20)))]), r.choice(["ad", "ads", "advert", "ad-box", "sponsored", "banner ad", "promo", "advertisement"]))
    before = [tag("nav", links(r.randint(3, 8)), lone(["menu", "main-nav"])), tag("div", links(r.randint(3, 8)), r.choice(["menu", "nav", "navbar", "breadcrumb"])), tag("header", tag("h1", text(2)) + tag("p", text(4)), lone(["site-header", "head"])), tag("div", tag("p", text(8)), r.choice(["header", "cookie-notice", "notice", "alert", "consent"])), advert()]
    after = [tag("footer", r.choice([text(r.randint(3, 25)), tag("p", text(8)) + links(3)]), lone(["footer", "site-footer"])), tag("div", text(r.randint(3, 15)), r.choice(["footer", "copyright", "legal"])), tag("aside", tag("h2", text(2)) + links(4) + tag("p", text(10)), lone(["sidebar", "related"])), tag("div", tag("h3", text(2)) + tag("p", text(12)) + links(3), r.choice(["sidebar", "side", "related", "widget", "share social"])), tag("form", tag("p", text(4)) + "<input name=q>" + f"<button>{text(1)}</button>", lone(["search", "login", "newsletter", "subscribe"])), tag(r.choice(["section", "div", "ul"]), tag("h3", text(1)) + "".join(tag(r.choice(["div", "li", "p"]), tag("p", text(r.randint(4, 30))), lone(["comment", "reply"])) for _ in range(r.randint(1, 5))), r.choice(["comments", "comment-list", "reader-comments", "disqus"])), advert()]
    r.shuffle(before)
    r.shuffle(after)
    before, after = before[: r.randint(0, 3)], after[: r.randint(0, 3)]
    inside: list[str] = []
    body = ""
    for k in range(r.choice([1, 1, 2, 3, 6, 12])):
        start = count[0]
        if k == 0 and r.random() < 0.8:
            body += tag(r.choice(["h1", "h1", "h2"]), text(r.randint(2, 10)))
        body += r.choice([para, para, para, para, lambda: tag("h2", text(4)), lambda: tag("ul", "".join(tag("li", text(r.randint(3, 15))) for _ in range(3))), lambda: tag("blockquote", para()), lambda: tag("table", tag("tr", tag("td", text(3)) + tag("td", text(3))))])()
        inside += [f"w{i}" for i in range(start, count[0])]
        if r.random() < 0.08:
            body += r.choice([advert, lambda: tag("div", links(3), "related"), lambda: tag("div", tag("p", text(5)), "share social")])()
    frame = r.choice(["article", "article", "article", "main", "div", "section", "both"])
    main = tag("main", tag("article", body)) if frame == "both" else tag(frame, body, r.choice(["content", "post", "main-content", "entry", "story", "article-body"]) if frame in ("div", "section") else lone(["content", "post"]))
    middle = tag("div", main, lone(["wrapper", "container", "page"])) if r.random() < 0.3 else main
    page = "".join(before) + middle + "".join(after)
    return f"<!DOCTYPE html><html><head><title>t</title></head><body>{page}" + r.choice(["</body></html>", ""]), set(inside)


@lru_cache(maxsize=1)
def model(pages: int = 500, seed: int = 17) -> trees.Ensemble:
    """Trained on ``pages`` made pages. A node is of the article if article text is below it and it holds little else, or holds it among others."""
    r, xs, ys = random.Random(seed), [], []
    for _ in range(pages):
        page, inside = sample_page(r)
        nodes = parse(page)
        y = np.zeros(len(nodes))
        for i in range(len(nodes) - 1, -1, -1):
            own = {w.strip(".") for _, s in nodes[i].pieces for w in s.split()}
            y[i] = max(y[i], bool(own & inside))
            y[nodes[i].up] = max(y[nodes[i].up], y[i])
        xs.append(features(nodes))
        ys.append(y)
    return trees.boost(np.concatenate(xs), np.concatenate(ys), trees=40, depth=4)


def main_text(pages: list[str | None], trained: trees.Ensemble) -> list[str]:
    parsed = [parse(p) if p else [Node("#page", 0, 0)] for p in pages]
    sizes = np.cumsum([len(p) for p in parsed])[:-1]
    odds = np.split(trained.raw(np.concatenate([features(p) for p in parsed])), sizes)
    return ["\n\n".join(blocks(p, decode(p, o))) for p, o in zip(parsed, odds, strict=True)]


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars (code points)."""
    trained = model()

    def texts(raw: list[bytes | None]) -> list[pa.Array]:
        return [pa.array(main_text([None if x is None else x.decode("utf-8", "replace") for x in raw], trained), pa.string())]

    return annotate(pages.select("page_id", "url", "html"), "html", texts, "_text string").select("page_id", "url", F.col("_text").alias("text"), F.length("_text").cast("long").alias("n_chars"))
