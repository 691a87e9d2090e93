"""Main text of web pages: boosted trees over DOM nodes and a hierarchical decoding.

A tolerant parser builds the tree of block elements of a whole page. Two boosted ensembles give
each node the odds of being main content and of being boilerplate, from subtree density,
attribute tokens, depth and sibling statistics. A dynamic programme over the tree then chooses
the cheapest labelling in which content lies under neutral or content nodes and nothing below
boilerplate is content, so ancestors and descendants never contradict each other.

The ensembles are trained here, on pages composed by ``training_pages`` (``TRAIN_PAGES`` of them,
a bounded, seeded sample of page layouts with known labels), as the tables hold no labels.

Null and empty pages, and pages without main content, give the empty text. Very long pages are
parsed whole, in time that grows with their length. Repeated rows are each extracted. Extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gbdt
from ._util import strings

TRAIN_PAGES, SEED = 700, 7
#: Pages whose nodes are classified together.
CHUNK = 256

# Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose content is text up to their end tag; elements that hold no text of the page; what may stand in a head.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
HIDDEN = frozenset("button select object canvas template noscript svg".split())
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var nobr acronym".split())
CLOSED_BY_BLOCK = frozenset(["p"])
ENDS = {"li": ("li", ("ul", "ol")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
TAGS = "article main nav header footer aside form p ul ol li div section table h1 h2 h3 blockquote pre figure dl body".split()
# Attribute tokens, by what they usually stand for.
TOKENS = {
    "content": "article content post entry story body text main prose page read hentry".split(),
    "menu": "nav navbar menu breadcrumb breadcrumbs tabs toolbar pagination pager toc".split(),
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner dfp adsense".split(),
    "reader": "comment comments reply replies respond disqus discussion thread reader".split(),
    "side": "sidebar side aside widget related recommended recommend more popular trending teaser links".split(),
    "foot": "footer foot copyright legal colophon bottom".split(),
    "notice": "cookie cookies notice consent gdpr alert modal popup overlay newsletter subscribe subscription signup paywall".split(),
    "share": "share sharing social follow tags meta byline author".split(),
    "head": "header head masthead logo top brand search hero".split(),
}
GROUPS = list(TOKENS)
TOKEN_GROUP = {t: i for i, g in enumerate(GROUPS) for t in TOKENS[g]}

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: One attribute, or the end of the tag: a value in quotes counts as such only after '='.
PART = re.compile(r"[\s/]*(?:(>)|[^\s/>][^\s/>=]*(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|[^\s>]*))?)")
#: The rest of a usual tag at once: quotes stand around whole values only.
USUAL = re.compile(r"(?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'=]))*+>")
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPLIT = re.compile(r"[^a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Tokens:
    """Cuts a page into text, start tags and end tags, in time that grows with its length.

    Items are (kind, name, value): ("text", "", text), ("start", name, attributes), ("end", name, "").
    Comments, declarations and the content of ``RAW`` elements are left out; a raw element without an
    end tag is only a tag. A quote that is never closed is part of an unquoted value; a tag that is
    never closed ends the page.
    """

    def __init__(self, source: str):
        self.source = source
        self.lower = source.lower() if len(source.lower()) == len(source) else re.sub("[A-Z]+", lambda m: m[0].lower(), source)
        self.none_after: dict[str, int] = {}  # from where on there is no end tag of a name
        self.at = 0  # where the last tag ended

    def end_tag(self, name: str, at: int) -> int:
        """Where the next end tag of ``name`` begins, or -1."""
        if self.none_after.get(name, len(self.source)) <= at:
            return -1
        pattern, k = "</" + name, at
        while (k := self.lower.find(pattern, k)) >= 0:
            after = self.lower[k + len(pattern) : k + len(pattern) + 1]
            if not after or after in "\t\n\f\r />":
                return k
            k += len(pattern)
        self.none_after[name] = at
        return -1

    def tag_stop(self, at: int) -> int:
        """Where the tag whose attributes begin at ``at`` ends, after its '>'; -1 if nowhere."""
        source, n = self.source, len(self.source)
        if m := USUAL.match(source, at):
            return m.end()
        while at < n:
            m = PART.match(source, at)
            if not m or m.end() == at:
                return -1
            at = m.end()
            if m[1]:
                return at
        return -1

    def __iter__(self):
        source, n, at = self.source, len(self.source), 0
        while at < n:
            k = source.find("<", at)
            if k < 0:
                yield "text", "", source[at:]
                return
            m = TAG.match(source, k)
            if m:
                if k > at:
                    yield "text", "", source[at:k]
                name, stop = m[2].lower(), self.tag_stop(m.end())
                if stop < 0:
                    return
                at = self.at = stop
                if m[1]:
                    yield "end", name, ""
                    continue
                yield "start", name, source[m.end() : stop - 1]
                if name in RAW and (close := self.end_tag(name, at)) >= 0:
                    at = close
            elif source.startswith(("<!", "<?", "</"), k):
                if k > at:
                    yield "text", "", source[at:k]
                if source.startswith("<!--", k):
                    close = source.find("-->", k + 2)
                    at = close + 3 if close >= 0 else n
                else:
                    close = source.find(">", k)
                    at = close + 1 if close >= 0 else n
            else:
                k = source.find("<", k + 1)
                k = n if k < 0 else k
                yield "text", "", source[at:k]
                at = k


class Page:
    """Block nodes in page order (parents first) and the runs of text that they own.

    What a ``HIDDEN`` element holds is left out up to its end tag; one that is not closed before the
    block around it, or not at all before a block begins, ends there.
    """

    def __init__(self, source: str):
        self.tag, self.parent, self.attrs = ["#root"], [-1], [""]
        self.runs: list[tuple[int, list[str]]] = []  # owner, parts of one block of text
        self.links: list[int] = [0]
        self.inline: list[int] = [0]
        self._parse(source)

    def _parse(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("#root", 0)]  # blocks only
        tag, parent, attrs, runs, links, inline = self.tag, self.parent, self.attrs, self.runs, self.links, self.inline
        open_run: list[str] | None = None
        in_link = 0
        head = False
        hidden, inner, closed = "", [], False  # the hidden element, the elements open in it, whether its end tag follows
        tokens = Tokens(source)

        def text(raw: str) -> None:
            nonlocal open_run
            if not raw:
                return
            if open_run is None:
                if raw.isspace():
                    return
                open_run = []
                runs.append((stack[-1][1], open_run))
            open_run.append(raw)
            if in_link:
                links[stack[-1][1]] += len(raw)

        for kind, name, value in tokens:
            if hidden:
                if kind == "start" and name not in VOID and not (hidden == "svg" and value.endswith("/")):
                    if closed or name in INLINE or name in HIDDEN:
                        inner.append(name)
                        continue
                    hidden = ""  # a block begins in an element that is never closed
                elif kind == "end":
                    if name in inner:
                        del inner[len(inner) - 1 - inner[::-1].index(name) :]
                        continue
                    if name == hidden:
                        hidden = ""
                        continue
                    if not any(name == t for t, _ in stack):
                        continue
                    hidden = ""  # the block around it ends
                else:
                    continue
            if kind == "text":
                if head and not value.isspace():
                    head = False
                if not head:
                    text(value)
                continue
            if kind == "end":
                if name == "head":
                    head = False
                elif name == "a":
                    in_link = 0
                elif name not in INLINE and name not in VOID and name not in HIDDEN and name not in RAW:
                    open_run = None
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i][0] == name:
                            del stack[i:]
                            break
                continue
            if head and name not in IN_HEAD and name != "head":
                head = False
            if name in HIDDEN:
                if not (name == "svg" and value.endswith("/")):
                    hidden, inner, closed = name, [], tokens.end_tag(name, tokens.at) >= 0
                continue
            if name in RAW:
                continue
            if name in INLINE:
                inline[stack[-1][1]] += 1
                in_link = in_link or name == "a"
                continue
            if name == "br" or name == "wbr":
                if open_run is not None and name == "br":
                    open_run.append(" ")
                continue
            if name in VOID:
                if name == "hr":
                    open_run = None
                continue
            if name == "head":
                head = True
                continue
            if head:
                continue
            open_run, in_link = None, 0
            if stack[-1][0] in CLOSED_BY_BLOCK:
                stack.pop()
            if name in ENDS:
                closes, limit = ENDS[name]
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in limit:
                        break
                    if stack[i][0] in closes.split():
                        del stack[i:]
                        break
            parent.append(stack[-1][1])
            stack.append((name, len(tag)))
            tag.append(name)
            attrs.append(value)
            links.append(0)
            inline.append(0)
            if value.endswith("/") and name not in TAGS and name != "html":
                stack.pop()
        self.blocks = [(owner, t) for owner, parts in runs if (t := " ".join(html.unescape("".join(parts)).split()))]


def _groups(attr: str) -> list[int]:
    if not attr or "=" not in attr:
        return []
    out = []
    for m in ATTRIBUTE.finditer(attr):
        value = m[1] or m[2] or m[3] or ""
        out += [g for w in SPLIT.split(CAMEL.sub(" ", value).lower()) if (g := TOKEN_GROUP.get(w)) is not None]
    return out


WIDTH = len(TAGS) + 3 * len(GROUPS) + 28
TAG_AT = {t: i for i, t in enumerate(TAGS)}


def node_features(page: Page) -> np.ndarray:
    """One row of features for each node."""
    n = len(page.tag)
    x = np.zeros((n, WIDTH), np.float32)
    parent = page.parent
    own = np.zeros(n)
    count = np.zeros(n)
    stops = np.zeros(n)
    longest = np.zeros(n)
    for owner, t in page.blocks:
        own[owner] += len(t)
        count[owner] += 1
        stops[owner] += t.count(". ") + t.count(",") + (t[-1] in ".!?")
        longest[owner] = max(longest[owner], len(t))
    sums = np.stack([own, np.array(page.links, float), np.ones(n), count, stops, np.array([t == "p" for t in page.tag], float), np.array(page.inline, float), np.array([t == "li" for t in page.tag], float)], axis=1)
    own_link = sums[:, 1].copy()
    first_group = len(TAGS)
    depth = np.zeros(n)
    place = np.zeros(n)
    kids = np.zeros(n)
    path = np.zeros((n, len(TAGS)), np.float32)
    k = len(GROUPS)
    for i in range(n):
        t = TAG_AT.get(page.tag[i])
        if t is not None:
            x[i, t] = 1
        for g in _groups(page.attrs[i]):
            x[i, first_group + g] += 1
        if i:
            p = parent[i]
            depth[i] = depth[p] + 1
            place[i] = kids[p]
            kids[p] += 1
            x[i, first_group + k : first_group + 2 * k] = np.maximum(x[p, first_group + k : first_group + 2 * k] * 0.5, 0) + x[p, first_group : first_group + k]
            path[i] = np.maximum(path[p], x[p, : len(TAGS)])
    for i in range(n - 1, 0, -1):
        sums[parent[i]] += sums[i]
        longest[parent[i]] = max(longest[parent[i]], longest[i])
        # attribute tokens below, so that wrappers of mixed parts differ from parts
        x[parent[i], first_group + 2 * k : first_group + 3 * k] += x[i, first_group + 2 * k : first_group + 3 * k] + x[i, first_group : first_group + k]
    up = np.maximum(np.array(parent), 0)
    text, link, size, runs, marks, paras, inl, items = sums.T
    base = first_group + 3 * k
    siblings = kids[up]
    cols = [
        np.log1p(text), np.log1p(own), link / np.maximum(text, 1), own_link / np.maximum(own, 1), text / size, np.log1p(size), text / max(1.0, text[0]), text / np.maximum(text[up], 1),
        depth, place, np.minimum(siblings - place, 50), np.log1p(siblings), np.log1p(kids), np.log1p(runs), marks / np.maximum(text, 1) * 100, np.log1p(paras), paras / size, inl / size, items / size,
        np.log1p(longest), text / np.maximum(runs, 1), np.log1p(text[up]), (text - own) / np.maximum(text, 1), marks / np.maximum(runs, 1), link[up] / np.maximum(text[up], 1),
        path[:, [TAG_AT["article"], TAG_AT["main"]]].max(1), path[:, [TAG_AT["nav"], TAG_AT["footer"], TAG_AT["aside"], TAG_AT["header"]]].max(1), path[:, [TAG_AT["ul"], TAG_AT["form"], TAG_AT["table"]]].max(1),
    ]
    x[:, base:] = np.stack(cols, axis=1)
    return x


NEUTRAL, CONTENT, BOILER = 0, 1, 2


def decode(page: Page, content: np.ndarray, boiler: np.ndarray) -> np.ndarray:
    """The cheapest consistent labelling of the nodes."""
    n = len(page.tag)
    eps = 1e-4
    cost = np.stack([-np.log(np.clip(1 - content - boiler, eps, 1)), -np.log(np.clip(content, eps, 1)), -np.log(np.clip(boiler, eps, 1))], axis=1)
    cost[0] = (0.0, 50.0, 50.0)
    best = cost.tolist()
    parent = page.parent
    for i in range(n - 1, 0, -1):
        m, c, b = best[i]
        up = best[parent[i]]
        up[0] += min(m, c, b)
        up[1] += min(c, b)
        up[2] += b
    label = np.zeros(n, np.int8)
    for i in range(1, n):
        above = label[parent[i]]
        m, c, b = best[i]
        if above == BOILER:
            label[i] = BOILER
        elif above == CONTENT:
            label[i] = CONTENT if c <= b else BOILER
        else:
            label[i] = CONTENT if c <= min(m, b) else NEUTRAL if m <= b else BOILER
    return label


class Extractor:
    """The two ensembles; picklable and of fixed size."""

    def __init__(self, content: gbdt.Boosted, boiler: gbdt.Boosted):
        self.content, self.boiler = content, boiler

    def extract(self, sources: list[str]) -> list[str]:
        out = []
        for i in range(0, len(sources), CHUNK):
            pages = [Page(s) for s in sources[i : i + CHUNK]]
            x = np.concatenate([node_features(p) for p in pages]) if pages else np.zeros((0, WIDTH))
            c, b = self.content.proba(x), self.boiler.proba(x)
            scale = np.maximum(1.0, c + b)
            c, b, at = c / scale, b / scale, 0
            for p in pages:
                n = len(p.tag)
                label = decode(p, c[at : at + n], b[at : at + n])
                out.append("\n".join(t for owner, t in p.blocks if label[owner] == CONTENT))
                at += n
        return out


# --- training pages -----------------------------------------------------------------------------


def training_pages(count: int = TRAIN_PAGES, seed: int = SEED):
    """Composed pages (source, and a function of a node's attributes giving its label).

    Every element carries a ``data-y`` attribute (c, b or n) that only the labels are read from.
    """
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyzéüñ"

    def word() -> str:
        return "".join(rng.choice(letters) for _ in range(rng.choice((1, 2, 2, 3, 4, 5, 6, 8, 11))))

    def sentence(least: int = 1, most: int = 22) -> str:
        words = [word() + ("," if rng.random() < 0.08 else "") for _ in range(rng.randint(least, most))]
        return " ".join(words).capitalize() + rng.choice("......!?")

    def prose(y: str, tag: str = "p") -> str:
        body = " ".join(sentence() for _ in range(rng.choice((1, 1, 2, 3, 5, 9))))
        if rng.random() < 0.15:
            body = f"<b>{body}<br>" if rng.random() < 0.5 else body.replace(" ", " <a href='/x'>", 1) + "</a>"
        close = "" if rng.random() < 0.12 else f"</{tag}>"
        return f"<{tag} data-y={y}>{body}{close}"

    def attr(*groups: str, p: float = 0.75) -> str:
        if rng.random() > p:
            return ""
        token = rng.choice(TOKENS[rng.choice(groups)])
        return f' {rng.choice(("class", "class", "id"))}="{token}{rng.choice(("", "", "-wrap", " clearfix", "_1", "-box"))}"'

    def items(y: str, least: int = 2, most: int = 12, tag: str = "ul") -> str:
        return f"<{tag} data-y={y}>" + "".join(f'<li data-y={y}><a href="/{word()}">{word() if rng.random() < 0.7 else sentence(1, 6)}</a></li>' for _ in range(rng.randint(least, most))) + f"</{tag}>"

    def menu() -> str:
        tag = rng.choice(("nav", "nav", "div"))
        return f'<{tag} data-y=b{attr("menu", p=0.5 if tag == "nav" else 1)}>{items("b")}</{tag}>'

    def advert() -> str:
        return f'<{rng.choice(("div", "div", "aside", "section"))} data-y=b{attr("advert", p=1)}>{rng.choice((sentence(), prose("b"), sentence() + " " + sentence(), "<a href=x>" + sentence(1, 5) + "</a>"))}</div>'

    def side() -> str:
        tag = rng.choice(("aside", "aside", "div", "section"))
        inner = "".join(rng.choice((prose("b"), items("b"), prose("b", "h3"), prose("b", "div"))) for _ in range(rng.randint(1, 5)))
        return f'<{tag} data-y=b{attr("side", p=0.6 if tag == "aside" else 1)}>{inner}</{tag}>'

    def notice() -> str:
        return f'<div data-y=b{attr("notice", p=1)}>{rng.choice((prose("b"), sentence(), prose("b") + prose("b")))}<button>{word()}</button></div>'

    def form() -> str:
        return f'<form data-y=b{attr("notice", "head", p=0.5)}><label>{sentence(1, 4)}</label><input name=q>{rng.choice(("", prose("b"), "<button>" + word() + "</button>"))}</form>'

    def comments() -> str:
        tag = rng.choice(("section", "div", "ol", "ul"))
        part = "li" if tag in ("ol", "ul") else rng.choice(("div", "article", "div"))
        inner = "".join(f'<{part} data-y=b{attr("reader", p=0.8)}>{rng.choice(("", prose("b", "h4")))}{prose("b")}{rng.choice(("", prose("b")))}</{part}>' for _ in range(rng.randint(1, 6)))
        return f'<{tag} data-y=b{attr("reader", p=1)}>{rng.choice(("", prose("b", "h3")))}{inner}</{tag}>'

    def share() -> str:
        return f'<div data-y=b{attr("share", p=1)}>{rng.choice((items("b", 2, 5), "<a href=x>" + word() + "</a> <a href=y>" + word() + "</a>"))}</div>'

    def head() -> str:
        tag = rng.choice(("header", "header", "div"))
        return f'<{tag} data-y=b{attr("head", p=0.4 if tag == "header" else 1)}>{rng.choice((prose("b", "h1"), sentence(1, 4), prose("b", "div")))}{rng.choice(("", menu(), form()))}</{tag}>'

    def foot() -> str:
        tag = rng.choice(("footer", "footer", "footer", "div"))
        inner = rng.choice((f"&copy; {word()} &middot; {sentence()}", prose("b"), items("b") + prose("b"), sentence() + " " + sentence()))
        return f'<{tag} data-y=b{attr("foot", p=0.3 if tag == "footer" else 1)}>{inner}</{tag}>'

    def heading(tag: str) -> str:
        return f"<{tag} data-y=c>{' '.join(word() for _ in range(rng.randint(1, 9))).capitalize()}</{tag}>" if rng.random() < 0.6 else prose("c", tag)

    def article() -> str:
        tag = rng.choice(("article", "article", "article", "main", "div", "section"))
        parts = [heading(rng.choice(("h1", "h1", "h2")))] if rng.random() < 0.85 else []
        for _ in range(rng.choice((1, 1, 2, 4, 7, 12, 20))):
            parts.append(rng.choices((prose("c"), heading("h2"), f'<ul data-y=c>{"".join(prose("c", "li") for _ in range(rng.randint(1, 5)))}</ul>', f"<blockquote data-y=c>{prose('c')}</blockquote>", prose("c", "div"), f"<table data-y=c><tr data-y=c>{prose('c', 'td')}{prose('c', 'td')}</tr></table>"), (14, 1.5, 1, 0.7, 0.7, 0.4))[0])
            if rng.random() < 0.06:
                parts.append(rng.choice((advert, side, share, notice, form))())
        if rng.random() < 0.12:
            parts.append(rng.choice((share, comments, side))())
        if len(parts) > 2 and rng.random() < 0.12:
            parts.insert(0, f"<header data-y=b>{prose('b', 'div')}</header>")
        end = "" if rng.random() < 0.03 else f"</{tag}>"
        layout = rng.random()
        if layout < 0.12:  # no container: the parts stand in the body
            return "".join(parts)
        if layout < 0.34:  # a container that no attribute tells
            return f"<div data-y=c>{''.join(parts)}{end and '</div>'}"
        if layout < 0.42:  # a cell of a layout table
            return f"<table data-y=c><tr data-y=c><td data-y=c>{''.join(parts)}</td></tr></table>"
        return f'<{tag} data-y=c{attr("content", p=0.25 if tag in ("article", "main") else 1)}>{"".join(parts)}{end}'

    for _ in range(count):
        before = [f() for f in (head, menu, notice, advert, side, form) if rng.random() < (0.75 if f is menu else 0.3)]
        after = [f() for f in (share, comments, side, advert, notice, foot) if rng.random() < (0.8 if f is foot else 0.25)]
        rng.shuffle(before)
        if rng.random() < 0.2:  # nothing but the article
            before, after = [], []
        main = article()
        if rng.random() < 0.3:
            inside = after.pop(0) if after and rng.random() < 0.5 else ""
            main = f'<{rng.choice(("div", "main"))} data-y=n{attr("content", p=0.3)}>{main}{inside}</div>'
        if rng.random() < 0.3:
            body = f'<div data-y=n{attr("content", "head", p=0.2)}>{"".join(before)}{main}{"".join(after)}</div>'
        else:
            body = f'{"".join(before)}{main}{"".join(after)}'
        if rng.random() < 0.25:  # a page may leave out what HTML lets it
            yield body if rng.random() < 0.5 else f"<title>{word()}</title><body data-y=n>{body}"
            continue
        yield f"<!DOCTYPE html><html data-y=n><head><title>{word()}</title><style>p{{}}</style></head><body data-y=n>{body}</body></html>"


LABEL = re.compile(r"data-y=([cbn])")


def fit_extractor(count: int = TRAIN_PAGES, seed: int = SEED) -> Extractor:
    """Train both ensembles on ``count`` composed pages."""
    xs, ys = [], []
    for source in training_pages(count, seed):
        page = Page(source)
        labels = ["n" if not (m := LABEL.search(a)) else m[1] for a in page.attrs]
        for i in range(1, len(labels)):  # what lies in boilerplate is boilerplate
            if labels[page.parent[i]] == "b":
                labels[i] = "b"
        xs.append(node_features(page))
        ys += labels
    x, y = np.concatenate(xs), np.array(ys)
    return Extractor(gbdt.fit(x, (y == "c").astype(float), trees=60, depth=5), gbdt.fit(x, (y == "b").astype(float), trees=60, depth=5))


def extract_main_text(pages: DataFrame, extractor: Extractor) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html)."""
    shared = pages.sparkSession.sparkContext.broadcast(extractor)  # two ensembles of fixed size

    def rows(batches):
        model = shared.value
        for b in batches:
            texts = model.extract(strings(b.column("html")))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    given = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return given.mapInArrow(rows, "page_id long, url string, text string, n_chars long")
