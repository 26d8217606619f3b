"""Main text of web pages: boosted trees over DOM-node features, and a hierarchical decoding.

A page becomes a tree of block elements whose leaves are runs of text. Trees trained on generated pages
give each node a log odds of holding main text. The decoding picks the set of nodes with the largest sum
in which a node is chosen only with its parent, and an element only with one of its children, so that no
ancestor and descendant contradict each other. The chosen leaves, in page order, are the text.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting

# A tag in three readings, tried in turn: quotes hold no "<"; quoted values hold any character; quotes mean nothing. None looks beyond
# a "<" outside quotes, or beyond the quote that ends a value, so that a page is read in one go however broken its tags are.
TAG = re.compile(r"<(/?)([a-zA-Z][\w:-]*+)((?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+)>")
QUOTED = re.compile(r"<(/?)([a-zA-Z][\w:-]*+)((?:[^<>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')(?=[\s/>])|=)*+)>")
LOOSE = re.compile(r"<(/?)([a-zA-Z][\w:-]*+)([^<>]*+)>")
ATTRIBUTE = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\b\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
MARKS = re.compile(r"[.,;:!?]")
# Element names of HTML by kind.
RAW = {"script", "style", "textarea", "title", "iframe", "template", "xmp", "noembed"}
CONTROL = {"button", "select", "datalist"}
EMBEDDED = {"svg", "object", "canvas", "audio", "video", "noscript", "map"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
#: What no control can hold: there one that was never closed ends.
APART = re.compile(r"</(button|select|datalist)\b[^<>]*>|</(?:" + "|".join(sorted(BLOCK)) + r")\b|<(?:p|h[1-6]|article|section|main|ul|ol|dl|table|blockquote|form|header|footer|nav|aside)\b", re.I)
SCOPE = {"ul", "ol", "menu", "dl", "table", "body", "html", "div", "article", "section", "main", "aside", "nav"}
KINDS = [{"nav", "menu"}, {"header", "hgroup"}, {"footer"}, {"aside", "dialog"}, {"form", "fieldset", "legend"}, {"article", "main"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"p"}, {"ul", "ol", "li", "dl", "dt", "dd", "dir"}, {"table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"div", "section", "center"}, {"html", "body"}, {"pre", "blockquote", "figure", "figcaption", "details", "summary", "address"}, EMBEDDED]
WORDS = [
    {"ad", "ads", "advert", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner"},
    {"nav", "navigation", "navbar", "menu", "breadcrumb", "breadcrumbs", "toolbar", "pagination", "pager"},
    {"comment", "comments", "reply", "replies", "discussion", "disqus", "respond"},
    {"cookie", "cookies", "consent", "notice", "alert", "gdpr", "popup", "modal", "newsletter", "subscribe", "signup", "overlay", "dialog"},
    {"sidebar", "aside", "widget", "related", "recommended", "share", "sharing", "social", "complementary", "tags", "trending"},
    {"footer", "foot", "copyright", "legal", "contentinfo"},
    {"header", "masthead", "topbar", "top", "logo", "site", "login", "search"},
    {"content", "article", "post", "main", "entry", "story", "text", "body"},
]
KIND = {tag: 1 << k for k, tags in enumerate(KINDS) for tag in tags}
WORD = {word: 1 << (len(KINDS) + k) for k, words in enumerate(WORDS) for word in words}
HIDDEN = 1 << (len(KINDS) + len(WORDS))
BITS = len(KINDS) + len(WORDS) + 1


class Page:
    """Nodes in page order: elements, and leaves that hold a run of text (``text`` is None for elements).

    Read once from start to end. Embedded elements (pictures, players, what scripts replace) are nodes as
    well, inside a run that goes on behind them. A start tag that no end tag follows, of an element that
    isn't a block, changes nothing; an end tag without an open element neither.
    """

    __slots__ = ("parent", "own", "above", "depth", "text", "chars", "linked", "end")

    def __init__(self, source: str):
        self.parent, self.own, self.above, self.depth = [-1], [0], [0], [0]
        self.text: list[str | None] = [None]
        self.chars, self.linked, self.end = [0], [0], [0]
        stack: list[tuple[str, int]] = [("", 0)]
        places: dict[str, list[int]] = {}  # of open elements in the stack, by name
        saved: list[tuple[list[str], list[str], bool]] = []
        run: list[str] = []
        links: list[str] = []
        in_link, head, lower = False, False, None
        last = {}  # places of the last end tags

        def flush() -> None:
            text = "".join(run)
            run.clear()
            if "&" in text:
                text = entities.unescape(text)
            text = " ".join(text.split())
            if text:
                linked = sum(len(x.strip()) for x in links)
                self.add(stack[-1][1], 0, text, min(linked, len(text)))
            links.clear()

        def close(to: int) -> None:
            nonlocal run, links, in_link
            while len(stack) > to:
                flush()
                name, node = stack.pop()
                places[name].pop()
                self.end[node] = len(self.parent)
                if name in EMBEDDED:
                    run, links, in_link = saved.pop()

        def open_(name: str, attributes: str) -> None:
            places.setdefault(name, []).append(len(stack))
            stack.append((name, self.add(stack[-1][1], KIND.get(name, 0) | (bits(attributes) if attributes.strip() else 0), None, 0)))

        def ended(name: str) -> bool:
            """Whether an end tag of that name follows."""
            nonlocal lower
            if name not in last:
                lower = source.lower() if lower is None else lower
                last[name] = lower.rfind(f"</{name}") if len(lower) == size else size
            return last[name] >= at

        def top(names: set[str]) -> int:
            return max((places[n][-1] for n in names if places.get(n)), default=0)

        at, size, final = 0, len(source), source.rfind(">")
        while True:
            tag = source.find("<", at, final + 1)
            if tag < 0:
                break
            if tag > at:
                run.append(source[at:tag])
                if in_link:
                    links.append(run[-1])
            at = tag
            mark = source[at + 1]
            if mark in "!?":
                if source.startswith("<!--", at):
                    stop = source.find("-->", at + 4)
                    at = stop + 3 if stop >= 0 else size
                else:
                    at = source.find(">", at) + 1
                continue
            found = (TAG.match(source, at) or QUOTED.match(source, at) or LOOSE.match(source, at)) if mark == "/" or mark.isascii() and mark.isalpha() else None
            if found is None:
                run.append("<")
                at += 1
                continue
            at = found.end()
            ends, name, attributes = found[1], found[2].lower(), found[3]
            if ends:
                if name == "a":
                    in_link = False
                elif places.get(name):
                    close(places[name][-1])
                    in_link = in_link and name in EMBEDDED
                continue
            if name in VOID:
                if name in ("br", "hr"):
                    run.append(" ")
            elif name in RAW:
                stop = closing(name).search(source, at)
                at = stop.end() if stop else size
            elif name == "head":
                stop = None if head else HEAD_ENDS.search(source, at)  # its end tag may be left out
                at, head = stop.end() if stop else at, True
            elif name in CONTROL:
                if not attributes.endswith("/") and ended(name):
                    stop = APART.search(source, at)
                    at = size if stop is None else stop.end() if stop[1] else stop.start()
            elif name in EMBEDDED:
                if not attributes.endswith("/") and ended(name):
                    saved.append((run, links, in_link))
                    run, links = [], []
                    open_(name, attributes)
            elif name == "a":
                in_link = True
            elif name in BLOCK:
                flush()
                if stack[-1][0] == "p":
                    close(len(stack) - 1)
                if name in CLOSES:
                    while (k := top(CLOSES[name])) > top(SCOPE):
                        close(k)
                open_(name, attributes)
        if at < size:
            run.append(source[at:])
        close(1)
        flush()
        self.end[0] = len(self.parent)

    def add(self, parent: int, own: int, text: str | None, linked: int) -> int:
        node = len(self.parent)
        self.parent.append(parent)
        self.own.append(own)
        self.above.append(self.above[parent] | self.own[parent])
        self.depth.append(self.depth[parent] + 1)
        self.text.append(text)
        self.chars.append(len(text) if text else 0)
        self.linked.append(linked)
        self.end.append(node + 1)
        return node


HEAD_ENDS = re.compile(r"</head\b[^<>]*>|(?=<body\b)", re.I)


@lru_cache(maxsize=None)
def closing(name: str) -> re.Pattern:
    return re.compile(rf"</{name}\b[^<>]*>", re.I)


def bits(attributes: str) -> int:
    out = 0
    for name, value in ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name in ("class", "id", "role"):
            for token in TOKEN.findall(value):
                out |= WORD.get(token.lower(), 0)
        elif name == "hidden" or name == "aria-hidden" and "true" in value.lower() or re.search(r"display\s*:\s*none", value, re.I):
            out |= HIDDEN
    return out


def features(pages: list[Page]) -> np.ndarray:
    """A row per node: kinds and attribute tokens of itself and its ancestors, density, depth, siblings, neighbours."""
    counts = np.array([len(p.parent) for p in pages])
    starts = np.concatenate(([0], np.cumsum(counts)))
    shift = np.repeat(starts[:-1], counts)
    join = lambda name, kind=np.int64: np.fromiter((x for p in pages for x in getattr(p, name)), kind, starts[-1])
    parent = np.maximum(join("parent") + shift, shift)
    own, above, depth, chars, linked, end = (join(n) for n in ("own", "above", "depth", "chars", "linked", "end"))
    end = end + shift
    texts = [t or "" for p in pages for t in p.text]
    leaf = np.fromiter((t is not None for p in pages for t in p.text), bool, starts[-1])
    words = np.fromiter((t.count(" ") + 1 if t else 0 for t in texts), np.int64, starts[-1])
    marks = np.fromiter((len(MARKS.findall(t)) for t in texts), np.int64, starts[-1])
    node = np.arange(starts[-1])

    def within(x: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(x)))
        return (total[end] - total[node]).astype(float)

    c, l, w, m, f = within(chars), within(linked), within(words), within(marks), within(leaf)
    size = (end - node).astype(float)
    page_chars = np.repeat(c[starts[:-1]], counts)
    before = np.concatenate(([0], np.cumsum(chars)))[:-1]
    before = before - np.repeat(before[starts[:-1]], counts)
    siblings = np.bincount(parent, minlength=len(node))[parent].astype(float)
    order = np.lexsort((node, parent))
    rank = np.empty(len(node))
    rank[order] = node - np.searchsorted(parent[order], parent[order])
    link = l / np.maximum(c, 1)
    per = w / np.maximum(f, 1)
    dense = m / np.maximum(w, 1)
    numbers = [np.log1p(c), link, np.log1p(w), per, dense, np.log1p(size), c / size, depth, siblings, rank, (before + c / 2) / np.maximum(page_chars, 1), c / np.maximum(page_chars, 1), link[parent], np.log1p(c[parent]), per[parent], dense[parent], leaf]
    split = lambda x: ((x[:, None] >> np.arange(BITS)) & 1).astype(float)
    return np.concatenate((np.stack(numbers, axis=1), split(np.where(leaf, own[parent], own)), split(above)), axis=1)


def decode(page: Page, logit: list[float]) -> list[str]:
    """Texts of the leaves of the best consistent set of nodes."""
    n = len(page.parent)
    gain, best, chosen = list(logit), [-np.inf] * n, [0.0] * n
    for v in range(n - 1, -1, -1):
        if page.text[v] is None:
            if best[v] == -np.inf:
                gain[v] = -np.inf  # an element without text
            else:
                gain[v] = logit[v] + (chosen[v] if chosen[v] > 0 else best[v])
        up = page.parent[v]
        if up >= 0:
            best[up] = max(best[up], gain[v])
            if gain[v] > 0:
                chosen[up] += gain[v]
    keep = [False] * n
    keep[0] = gain[0] > 0
    for v in range(1, n):
        up = page.parent[v]
        keep[v] = keep[up] and (gain[v] > 0 or chosen[up] == 0 and gain[v] == best[up])
    return [t for t, k in zip(page.text, keep) if k and t is not None]


class Generator:
    """Pages of many layouts with known main text, to train on."""

    def __init__(self, seed: int):
        self.r = np.random.default_rng(seed)

    def pick(self, *options):
        return options[int(self.r.integers(len(options)))]

    def chance(self, p: float) -> bool:
        return bool(self.r.random() < p)

    def text(self, low: int, high: int, stop: bool = True) -> str:
        n = int(self.r.integers(low, max(low, high) + 1))
        out = ["".join(self.pick("ka", "lo", "mi", "ne", "ru", "ta", "so", "vé", "an", "er", "in", "st") for _ in range(int(self.r.integers(1, 4)))) for _ in range(n)]
        for k in range(3, n, 9):
            out[k] += self.pick(".", ",", "", "")
        line = " ".join(out)
        line = line.capitalize() if self.chance(0.8) else line
        return line + ("." if stop and self.chance(0.6) else "")

    def links(self, low: int, high: int) -> str:
        items = [f'<a href="/{k}">{self.text(1, 3, False)}</a>' for k in range(int(self.r.integers(low, high)))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if self.chance(0.7) else " | ".join(items)

    def block(self, tag: str, named: str, inner: str) -> str:
        named = f' {self.pick("class", "class", "id")}="{named}"' if named else ""
        return f"<{tag}{named}>{inner}</{tag}>"

    def paragraphs(self, low: int, high: int) -> str:
        return "".join(f"<p>{self.text(*self.pick((1, 4), (5, 40), (20, 120)))}</p>" for _ in range(int(self.r.integers(low, high))))

    def clutter(self) -> str:
        text = lambda: self.pick(self.text(2, 25), self.paragraphs(1, 3))
        return self.pick(
            lambda: self.block(self.pick("nav", "div", "div"), self.pick("", "menu", "nav-main", "breadcrumb"), self.links(2, 10)) if self.chance(0.7) else self.block("nav", "", self.links(2, 9)),
            lambda: self.block(self.pick("div", "div", "aside", "section"), self.pick("ad", "ads", "advert", "ad-banner", "sponsored", "promo"), text()),
            lambda: self.block(self.pick("aside", "div"), self.pick("sidebar", "widget", "related", "share social"), self.pick(self.links(2, 8), text())),
            lambda: self.block("aside", "", self.pick(self.links(2, 8), text())),
            lambda: self.block("div", self.pick("cookie-notice", "consent", "newsletter signup", "alert notice", "popup modal"), text()),
            lambda: self.block(self.pick("section", "div", "ol"), self.pick("comments", "comment-list", "replies", "discussion"), "".join(self.block("div", "comment", f"<p>{self.text(3, 60)}</p>") for _ in range(int(self.r.integers(1, 5))))),
            lambda: self.embedded(),
            lambda: self.block("form", self.pick("", "search", "login"), f"<label>{self.text(1, 3, False)}</label><input><p>{self.text(2, 9)}</p>"),
        )()

    def embedded(self) -> str:
        tag = self.pick(*sorted(EMBEDDED))
        inner = self.text(1, 12, False) if self.chance(0.6) else f"<p>{self.text(2, 12)}</p>"
        return f"<{tag}>{'<title>' + inner + '</title>' + f'<text>{inner}</text>' if tag == 'svg' else inner}</{tag}>"

    def page(self) -> tuple[str, list[str]]:
        main: list[str] = []

        def content(wrap: str, low: int = 1, high: int = 60) -> str:
            text = self.text(*self.pick((1, 3), (low, 15), (8, high), (20, 120)))
            main.append(text)
            shown = self.pick(text, text, f"<b>{text}</b>", f"<b>{text}<br>") if wrap == "p" else text
            if self.chance(0.08):
                shown = f"{shown}{self.embedded()}" if self.chance(0.5) else f"{self.embedded()}{shown}"
            return f"<{wrap}>{shown}" + ("" if wrap == "p" and self.chance(0.2) else f"</{wrap}>")

        parts = []
        if self.chance(0.9):
            parts.append(content(self.pick("h1", "h1", "h2"), 4, 14))
        for _ in range(int(self.pick(0, 1, 2, 4, 8, 14))):
            kind = self.r.random()
            if kind < 0.75:
                parts.append(content("p"))
            elif kind < 0.83:
                parts.append(content(self.pick("h2", "h3"), 1, 8))
            elif kind < 0.9:
                parts.append("<ul>" + "".join(content("li", 1, 12) for _ in range(3)) + "</ul>")
            elif kind < 0.95:
                parts.append("<blockquote>" + content("p") + "</blockquote>")
            else:
                parts.append("<table><tr>" + content("td", 1, 4) + content("td", 1, 4) + "</tr></table>")
            if self.chance(0.06):
                parts.append(self.clutter())
        tag, named = self.pick(("article", ""), ("article", ""), ("main", ""), ("article", "post"), ("div", "content"), ("div", "article-body"), ("section", "entry story"), ("div", "main-text"))
        core = self.block(tag, named, "".join(parts))
        for _ in range(int(self.pick(0, 0, 1, 2))):
            core = self.block(self.pick("div", "main", "section"), self.pick("", "wrap", "page"), core)
        top = "".join(self.clutter() for _ in range(int(self.pick(0, 1, 2, 3))))
        if self.chance(0.5):
            top = self.block(self.pick("header", "div"), self.pick("header", "site-header", "masthead"), self.pick(self.text(1, 6, False), self.links(2, 6), f"<h1>{self.text(1, 4, False)}</h1>")) + top
        elif self.chance(0.3):
            top = f"<header>{self.pick(self.text(1, 12), self.links(2, 5))}</header>" + top
        low = "".join(self.clutter() for _ in range(int(self.pick(0, 0, 1, 2, 3))))
        if self.chance(0.7):
            low += self.block("footer", "", self.pick(f"&copy; {self.text(1, 4, False)} &middot; {self.text(1, 10)}", self.links(2, 8), f"<p>{self.text(3, 40)}</p>"))
        elif self.chance(0.5):
            low += self.block("div", self.pick("footer", "copyright", "site-footer legal"), self.pick(self.text(2, 20), self.links(2, 8)))
        return f"<!DOCTYPE html><html><head><title>{self.text(2, 6, False)}</title></head><body>{top}{core}{low}</body></html>", main


@lru_cache(maxsize=2)
def model(pages: int = 1200, seed: int = 5) -> boosting.Trees:
    """Trees trained on generated pages; takes a few seconds, the same each time."""
    make = Generator(seed)
    made = [make.page() for _ in range(pages)]
    trees = [Page(source) for source, _ in made]
    y = []
    for page, (_, main) in zip(trees, made):
        main = set(main)
        label = [t in main if t is not None else False for t in page.text]
        for v in range(len(label) - 1, 0, -1):
            label[page.parent[v]] |= label[v]
        y += label
    return boosting.train(features(trees), np.array(y, float), trees=80)


def extract_all(sources: list[str], trees: boosting.Trees) -> list[str]:
    """Main texts of some pages: blocks joined by empty lines."""
    out, at = [], 0
    while at < len(sources):
        pages, nodes = [], 0
        while at < len(sources) and nodes < 40_000:  # what is held at once
            pages.append(Page(sources[at]))
            nodes += len(pages[-1].parent)
            at += 1
        logit = trees.logit(features(pages)).tolist()
        for page in pages:
            n = len(page.parent)
            out.append("\n\n".join(decode(page, logit[:n])))
            del logit[:n]
    return out


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page: the main text of the whole html.

    A null html counts as empty; a page without main text gives the empty string. Character references
    are decoded, white space in a block becomes one space, blocks are joined by an empty line. Null and
    repeated ids keep their rows; other columns are not read; an empty table gives no rows. A narrow map;
    the trees have a fixed size.
    """
    kind, link = df.schema[id_col].dataType.simpleString(), df.schema[url_col].dataType.simpleString()
    sent = df.sparkSession.sparkContext.broadcast(model())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = extract_all([x or "" for x in part.column(2).to_pylist()], trees)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    return df.select(F.col(id_col), F.col(url_col), F.col(html_col).cast("string").alias("__html")).mapInArrow(work, f"`{id_col}` {kind}, `{url_col}` {link}, text string, n_chars long")
