"""Main text of web pages: gradient-boosted trees over DOM-node features, decoded hierarchically."""

from __future__ import annotations

import functools
import html
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weftlight.llm import boosting
from weftlight.llm.common import blocks, columns, texts_of

#: Elements that are never text of a page (scripts, styles, forms' controls, embedded objects, page metadata).
DROPPED = frozenset("script style head title noscript template iframe object svg canvas button select option textarea input datalist audio video map meta link".split())
#: Elements whose content is characters up to their own end tag.
RAW = frozenset("script style textarea title noscript iframe xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a block of text.
BLOCK = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
#: Start tags that end an open element of the second set, unless one of the third is met first.
_CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tbody": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th"]), frozenset(["table"])),
    "tfoot": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th"]), frozenset(["table"])),
}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>?|[^<]+|<", re.S)
#: The end tag of each element of RAW, letters of either case; nothing else ends it.
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I | re.A) for name in RAW}
_ATTR = re.compile(r"(class|id|role|hidden|style|itemprop)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: Words in class, id and role attributes, by what they say about an element (fixed word lists).
HINTS = {
    "main": "article content main post entry story body text page articlebody post-body",
    "menu": "nav navbar menu navigation breadcrumb breadcrumbs toolbar tabs pagination pager toc",
    "header": "header masthead topbar branding logo hero",
    "footer": "footer foot copyright legal colophon imprint",
    "side": "sidebar side aside rail widget widgets related recommended recommend more popular trending tags",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner adsbygoogle",
    "notice": "cookie cookies consent notice notices alert gdpr popup modal overlay newsletter subscribe subscription paywall disclaimer",
    "comment": "comment comments reply replies discussion disqus respond reader feedback review reviews",
    "share": "share sharing social follow like buttons byline meta author",
    "form": "form search login signup signin register contact",
    "hidden": "hidden none invisible sr offscreen",
}
_HINT_OF = {w: i for i, ws in enumerate(HINTS.values()) for w in ws.split()}
_TAGS = ["p", "div", "section", "article", "main", "aside", "nav", "header", "footer", "form", "ul", "ol", "li", "table", "td", "blockquote", "pre", "figure", "body", "h"]
_TAG_OF = {t: i for i, t in enumerate(_TAGS)} | {f"h{i}": len(_TAGS) - 1 for i in range(1, 7)}


class Page:
    """Block elements of a page in order: parent, tag, hints, and their own text runs with their places in the page."""

    __slots__ = ("parent", "tag", "hints", "own", "chars", "links", "marks", "depth", "runs", "last")

    def __init__(self, source: str):
        self.parent, self.tag, self.hints, self.own = [], [], [], []
        self.chars, self.links, self.marks, self.depth, self.last = [], [], [], [], []
        self.runs: list[tuple[int, str]] = []
        self._parse(source)

    def _open(self, parent: int, tag: str, hints: int) -> int:
        k = len(self.tag)
        self.parent.append(parent)
        self.tag.append(tag)
        self.hints.append(hints)
        self.own.append(0)
        for x in (self.chars, self.links, self.marks):
            x.append(0)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        return k

    def _parse(self, source: str) -> None:
        node = self._open(-1, "body", 0)
        stack: list[tuple[str, int]] = []  # element, and the block to go back to when it ends
        dead = anchors = 0  # open elements of DROPPED, open links
        raw, at, size = "", 0, len(source)
        find = _TOKEN.match
        while at < size:
            if raw:
                m = _RAW_END[raw].search(source, at)
                at, raw = m.start() if m else size, ""
                continue
            m = find(source, at)
            at = m.end()
            name = m[2] or m[5]
            if name is None:
                text = m[0]
                if text[0] != "<" or text == "<":
                    if not dead:
                        self._text(node, text, anchors)
                continue
            name, closing, attrs = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
            if closing:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        for tag, back in stack[i:]:
                            dead -= tag in DROPPED
                            anchors -= tag == "a"
                        node = stack[i][1]
                        del stack[i:]
                        break
                    if stack[i][0] in ("table", "body", "html") and name not in ("body", "html"):
                        break
                if name in BLOCK or name == "br":
                    self.runs.append((node, " " if name == "br" else "\n"))
                continue
            if name in ("html", "body"):
                self._hint(0, attrs)
                continue
            closes, until = _CLOSES.get(name, (frozenset(["p"]), frozenset(["table", "td", "th"])) if name in BLOCK else (frozenset(), frozenset()))
            if name in BLOCK and name != "p" and "p" not in closes:
                closes = closes | {"p"}
            if closes:
                i = len(stack) - 1
                low = None
                while i >= 0 and stack[i][0] not in until and (stack[i][0] in closes or stack[i][0] not in BLOCK):
                    if stack[i][0] in closes:
                        low = i
                    i -= 1
                if low is not None:
                    for tag, _ in stack[low:]:
                        dead -= tag in DROPPED
                        anchors -= tag == "a"
                    node = stack[low][1]
                    del stack[low:]
            if name in VOID:
                if name in ("br", "wbr", "img", "hr"):
                    self.runs.append((node, "\n" if name == "hr" else " " if name == "br" else ""))
                continue
            back = node
            if name in BLOCK and not dead:
                node = self._open(node, name, 0)
                self._hint(node, attrs)
                self.runs.append((node, "\n"))
            elif name in DROPPED:
                dead += 1
            if name == "a":
                anchors += 1
            if attrs.rstrip().endswith("/") and name in DROPPED:
                dead -= 1
                continue
            stack.append((name, back))
            if name in RAW:
                raw = name

    def _hint(self, node: int, attrs: str) -> None:
        if not attrs:
            return
        bits = self.hints[node]
        for m in _ATTR.finditer(attrs):
            kind, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if kind == "hidden" or kind == "style" and re.search(r"display\s*:\s*none", value):
                bits |= 1 << _HINT_OF["hidden"]
            elif kind != "style":
                for w in _WORDS.findall(_CAMEL.sub(" ", value).lower()):
                    k = _HINT_OF.get(w)
                    if k is not None:
                        bits |= 1 << k
        self.hints[node] = bits

    def _text(self, node: int, text: str, anchors: int) -> None:
        if "&" in text:
            text = html.unescape(text)
        self.runs.append((node, text))
        n = len(text.strip())
        if n:
            self.own[node] += n
            self.chars[node] += n
            self.marks[node] += text.count(".") + text.count(",") + text.count("。") + text.count("，")
            if anchors:
                self.links[node] += n

    def text(self, keep: np.ndarray) -> str:
        """Text of the kept elements: a line per block, white space inside it one space."""
        out: list[str] = []
        cur: list[str] = []
        where = -1
        for node, run in self.runs:
            if node != where or run == "\n":
                if cur:
                    out.append("".join(cur))
                    cur = []
                where = node
            if keep[node] and run != "\n":
                cur.append(run)
        if cur:
            out.append("".join(cur))
        return "\n".join(x for x in (" ".join(t.split()) for t in out) if x)


FEATURES = len(_TAGS) * 2 + len(HINTS) * 3 + 17


def features(page: Page) -> np.ndarray:
    """A row for each block element: its tag and hints, its parent's and all its ancestors', density, depth, siblings."""
    n = len(page.tag)
    parent = np.array(page.parent)
    own, chars, links, marks = (np.array(x, float) for x in (page.own, page.chars, page.links, page.marks))
    nodes, paras, kids = np.ones(n), np.array([t == "p" for t in page.tag], float), np.zeros(n)
    above = list(page.hints)
    for i in range(n - 1, 0, -1):
        p = parent[i]
        chars[p] += chars[i]
        links[p] += links[i]
        marks[p] += marks[i]
        nodes[p] += nodes[i]
        paras[p] += paras[i]
        kids[p] += 1
    for i in range(1, n):
        above[i] |= above[parent[i]]
    up = np.maximum(parent, 0)
    x = np.zeros((n, FEATURES), np.float32)
    tag = np.array([_TAG_OF.get(t, -1) for t in page.tag])
    known = tag >= 0
    k = len(_TAGS)
    x[np.flatnonzero(known), tag[known]] = 1
    ptag = np.where(parent >= 0, tag[up], -1)
    x[np.flatnonzero(ptag >= 0), k + ptag[ptag >= 0]] = 1
    h = len(HINTS)
    bits = np.arange(h)
    hints = np.array(page.hints)
    x[:, 2 * k : 2 * k + h] = hints[:, None] >> bits & 1
    x[:, 2 * k + h : 2 * k + 2 * h] = (np.array(above)[up] * (parent >= 0))[:, None] >> bits & 1
    # how many of an element's siblings share its tag, and what they hold
    key = parent * 1000 + tag
    _, place, count = np.unique(key, return_inverse=True, return_counts=True)
    mean = np.bincount(place, chars) / count
    inside = np.zeros(n, np.int64)
    for i in range(n - 1, 0, -1):
        inside[parent[i]] |= inside[i] | hints[i]
    x[:, 2 * k + 2 * h : 2 * k + 3 * h] = inside[:, None] >> bits & 1
    total = max(chars[0], 1)
    order = np.cumsum(own) - own
    rest = [
        np.log1p(own), np.log1p(chars), chars / total, links / np.maximum(chars, 1), marks / np.maximum(chars, 1), np.log1p(nodes), chars / nodes,
        np.array(page.depth), paras, kids, count[place], np.log1p(mean[place]), np.arange(n) / n, order / total, np.log1p(chars[up]), links[up] / np.maximum(chars[up], 1), (chars / nodes) / max(total / n, 1e-9),
    ]
    x[:, 2 * k + 3 * h :] = np.stack(rest, axis=1)
    return x


def decode(parent: list[int], logit: np.ndarray) -> np.ndarray:
    """The likeliest labels in which an element is kept only if its parent is.

    From the leaves up: keeping an element gains its log-odds and the best of its children, dropping it drops them all.
    The root always stays open.
    """
    gain = logit.astype(float)
    for i in range(len(parent) - 1, 0, -1):
        if gain[i] > 0:
            gain[parent[i]] += gain[i]
    keep = np.zeros(len(parent), bool)
    keep[0] = True
    for i in range(1, len(parent)):
        keep[i] = keep[parent[i]] and gain[i] > 0
    return keep


#: Share of the made-up pages that have few blocks and little around them.
BARE_PAGES = 0.15


# ---- made-up training pages ------------------------------------------------------------------------------------------


class _Maker:
    """Writes pages of many layouts; elements that hold or are main text carry the attribute data-m."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, n: int, stops: bool = True) -> str:
        r = self.r
        out = ["".join(r.choice("abcdeghilmnoprstuväéñß") for _ in range(r.randint(2, 9))) + (r.choice([",", ".", ".", ""]) if stops and r.random() < 0.18 else "") for _ in range(n)]
        return " ".join(out).capitalize() + ("." if stops else "")

    def link(self) -> str:
        return f'<a href="/{self.words(1, False)}">{self.words(self.r.randint(1, 3), False)}</a>'

    def attr(self, *names: str, chance: float = 0.75) -> str:
        if self.r.random() > chance:
            return ""
        return f' {self.r.choice(["class", "class", "id"])}="{self.r.choice(names)}{self.r.choice(["", "", "-1", " box", " clearfix", "-wrap"])}"'

    def listing(self, n: int) -> str:
        tag = self.r.choice(["ul", "ul", "ol"])
        return f"<{tag}>" + "".join(f"<li>{self.link()}</li>" for _ in range(n)) + f"</{tag}>"

    def boiler(self) -> str:
        r = self.r
        text, few = self.words(r.randint(3, 25)), self.words(r.randint(1, 8))
        return r.choice([
            lambda: f'<nav{self.attr("nav", "menu", chance=0.4)}>{self.listing(r.randint(2, 9))}</nav>',
            lambda: f'<div{self.attr("navbar", "menu", "breadcrumb", "navigation", chance=1)}>{self.listing(r.randint(2, 6)) if r.random() < 0.7 else " ".join(self.link() for _ in range(5))}</div>',
            lambda: f'<header{self.attr("header", "masthead", chance=0.4)}><h{r.choice("12")}>{few}</h1><p>{text}</p></header>',
            lambda: f'<div{self.attr("header", "topbar", "logo", chance=1)}><h1>{few}</h1>{self.link()}</div>',
            lambda: f'<div{self.attr("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", chance=1)}>{text if r.random() < 0.5 else f"<p>{text}</p>" * r.randint(1, 3)}</div>',
            lambda: f'<aside{self.attr("sidebar", "related", chance=0.5)}>{"<h3>" + few + "</h3>" if r.random() < 0.5 else ""}{self.listing(r.randint(2, 6)) if r.random() < 0.5 else f"<p>{text}</p>"}</aside>',
            lambda: f'<div{self.attr("sidebar", "widget", "related", "recommended", "popular", chance=1)}><h4>{few}</h4>{self.listing(4) if r.random() < 0.6 else f"<p>{self.words(30)}</p>"}</div>',
            lambda: f'<div{self.attr("cookie-notice", "cookie", "consent", "gdpr", "notice", "newsletter", "popup", "alert", chance=1)}><p>{text}</p>{"<button>" + few + "</button>" if r.random() < 0.5 else ""}</div>',
            lambda: f'<form{self.attr("search", "login", "subscribe", chance=0.5)}><label>{few}</label><input name="q"><p>{text}</p><button>{few}</button></form>',
            lambda: f'<{(t := r.choice(["section", "div", "div", "ul"]))}{self.attr("comments", "comment-list", "discussion", "replies", "reader-comments", chance=1)}>' + "".join(f'<{(u := "li" if t == "ul" else r.choice(["div", "article", "p"]))}{self.attr("comment", "reply", chance=0.6)}>{self.words(r.randint(4, 60))}</{u}>' for _ in range(r.randint(1, 6))) + f"</{t}>",
            lambda: f'<div{self.attr("share", "social", "tags", "meta", chance=1)}>{self.link()} {self.link()} {few}</div>',
            lambda: f'<footer{self.attr("footer", chance=0.3)}>{r.choice(["&copy; ", ""])}{text}{self.listing(3) if r.random() < 0.3 else ""}</footer>',
            lambda: f'<div{self.attr("footer", "copyright", "legal", "disclaimer", chance=1)}><p>&copy; {text}</p></div>',
        ])()

    def article(self, alone: bool = False) -> str:
        r = self.r
        out = []
        if r.random() < 0.85:
            h = f"<h1 data-m>{self.words(r.randint(3, 12), False)}</h1>"
            out.append(f"<header data-m>{h}</header>" if not alone and r.random() < 0.12 else h)
        for i in range(r.choice([1, 1, 2, 3, 4, 6, 9, 14])):
            kind, n = r.random(), r.choice([r.randint(1, 12), r.randint(10, 60), r.randint(40, 160)])
            text = self.words(n)
            if r.random() < 0.2:
                text += f" {self.link()} " + self.words(5)
            if kind < 0.72:
                out.append(f"<p data-m>{text}" + r.choice(["</p>", "</p>", "</p>", "", "<br>"]))
            elif kind < 0.78:
                out.append(f"<p data-m><b>{text}<br>")
            elif kind < 0.84:
                out.append(f"<h{r.choice('23')} data-m>{self.words(r.randint(1, 7), False)}</h2>")
            elif kind < 0.9:
                out.append("<ul data-m>" + "".join(f"<li data-m>{self.words(r.randint(2, 20))}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif kind < 0.93:
                out.append(f"<blockquote data-m>{text if r.random() < 0.5 else f'<p data-m>{text}</p>'}</blockquote>")
            elif kind < 0.95:
                out.append("<table data-m>" + "".join(f"<tr data-m><td data-m>{self.words(2)}</td><td data-m>{self.words(3)}</td></tr>" for _ in range(3)) + "</table>")
            elif kind < 0.97:
                out.append(f"<div data-m>{text}</div>")
            else:
                out.append(f"<pre data-m>{text}</pre>")
            if i and r.random() < 0.06:
                out.append(self.boiler())
        return "".join(out)

    def bare(self) -> str:
        """A page of few blocks with little or nothing around them, in plain or wrapped in elements of any name."""
        r = self.r
        n = r.choice([1, 1, 1, 2, 3])
        body = "".join(f"<p data-m>{self.words(r.choice([r.randint(4, 15), r.randint(10, 60), r.randint(40, 160)]))}</p>" for _ in range(n))
        for _ in range(r.choice([0, 1, 1, 2, 3])):
            names = ("content", "wrap", "wrapper", "entry", "text", "container", "post", "page", "inner", self.words(1, False))
            body = f"<{(t := r.choice(['div', 'div', 'div', 'section', 'main', 'article']))} data-m{self.attr(*names, chance=0.7)}>{body}</{t}>"
        before, after = (self.boiler() if r.random() < 0.2 else "" for _ in range(2))
        return f"<html><head><title>x</title></head><body>{before}{body}{after}</body></html>"

    def page(self) -> str:
        r = self.r
        if r.random() < BARE_PAGES:
            return self.bare()
        style = r.random()
        if style < 0.5:
            body = f"<article data-m{self.attr('post', 'article', 'entry', chance=0.3)}>{self.article()}</article>"
        elif style < 0.65:
            body = f"<main data-m{self.attr('content', 'main', chance=0.3)}>{self.article()}</main>"
        elif style < 0.9:
            body = f"<div data-m{self.attr('content', 'main', 'article', 'post-body', 'entry-content', 'story', 'text', chance=0.85)}>{self.article()}</div>"
        else:
            body = self.article(alone=True)
        for _ in range(r.choice([0, 0, 1, 2])):
            inner = f"{self.boiler() if r.random() < 0.4 else ''}{body}{self.boiler() if r.random() < 0.4 else ''}"
            body = f"<{(t := r.choice(['div', 'div', 'section', 'main']))} data-m{self.attr('wrapper', 'container', 'page', 'content', 'layout', chance=0.7)}>{inner}</{t}>"
        before = "".join(self.boiler() for _ in range(r.randint(0, 4)))
        if r.random() < 0.4:
            inner = r.choice(["<h1>{}</h1>", "<p>{}</p>", "<h2>{}</h2>", "{}", "<div>{}</div>", "<h1>{}</h1><p>x y z</p>"]).format(self.words(r.randint(1, 6), False))
            before = f"<header{self.attr('header', 'top', 'site', chance=0.3)}>{inner}{self.listing(3) if r.random() < 0.3 else ''}</header>" + before
        after = "".join(self.boiler() for _ in range(r.randint(0, 4)))
        if r.random() < 0.3:
            after += f"<footer>&copy; {self.words(r.randint(1, 12))}</footer>"
        return f"<html><head><title>x</title></head><body>{before}{body}{after}</body></html>"


def labelled(pages: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the elements of made-up pages (without the always open root)."""
    xs, ys = [], []
    maker = _Maker(seed)
    for _ in range(pages):
        source = maker.page()
        p = Page(source.replace(" data-m", ' itemprop="zzmain"'))
        x = features(p)
        marks = [" data-m" in t for t in re.findall(r"<[a-z][a-z0-9]*[^>]*>", source.partition("<body>")[2]) if re.match(r"<([a-z0-9]+)", t)[1] in BLOCK]
        if len(marks) != len(x) - 1:
            continue
        xs.append(x[1:])
        ys.append(np.array(marks, float))
    return np.concatenate(xs), np.concatenate(ys)


@functools.cache
def model(pages: int = 900, seed: int = 7) -> boosting.Boosted:
    """The trees, fitted on a fixed number of made-up pages: the same wherever and whenever they are made."""
    return boosting.fit(*labelled(pages, seed))


def main_text(sources: list[str], trees: boosting.Boosted) -> list[str]:
    pages = [Page(s) if s else None for s in sources]
    live = [p for p in pages if p is not None]
    if not live:
        return [""] * len(sources)
    logit = trees.logit(np.concatenate([features(p) for p in live]))
    ends = np.cumsum([len(p.tag) for p in live])
    texts = iter([p.text(decode(p.parent, z)) for p, z in zip(live, np.split(logit, ends[:-1]), strict=True)])
    return [next(texts) if p is not None else "" for p in pages]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text, n_chars) per page: the main text of the whole html, a block a line.

    Null and empty pages and pages without main text give ''. Broken markup is read as browsers do where that matters for
    blocks. Repeated rows are read alike; further columns are dropped; an empty table gives no row. One narrow pass; the
    broadcast model has a fixed size.
    """
    pages = columns(pages, id_col, url_col, html_col)
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    shared = pages.sparkSession.sparkContext.broadcast(model())

    def run(batches):
        for b in blocks(batches, 2 << 20):
            texts = main_text(texts_of(b, html_col), shared.value)
            yield pa.RecordBatch.from_arrays([b.column(id_col), b.column(url_col), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    return pages.mapInArrow(run, f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars long")
