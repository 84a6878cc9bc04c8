"""Main text of web pages from a tree-structured graphical model over the DOM.

Every element is a node with a hidden state: part of the main text or not.  Its
potential follows from what can be seen of it: tag, names in class, id and role, the
amount of text, the share of it in links, its share of the page's running text, and
whether a named part of the page holds it.  Each parent and child share a potential
that depends on both states and on what the child is.  As the graph is a tree,
sum-product messages, once from the leaves to the root and once back, give the exact
marginal of every node.  All nodes of equal depth of many pages are handled at once.

The weights of both potentials maximise the likelihood of labelled pages (made by
``html_labelled``, a bounded number): the gradient is what the labels show less what
the marginals expect.  Training takes some seconds on the driver.

A text belongs to the main text if the marginal of its element is at least a half.
Elements that never show text (script, style, template, ...) are dropped, and a
block's white space becomes single spaces.  The content of ``math`` and ``object`` is
text like any other.

Defined cases.  A null or empty html gives an empty text and 0 characters.  A page
without tags is all main text or none, like one block.  Unclosed elements end with
their parents; unmatched end tags are ignored; text after a comment, a tag or an
element of ``RAW`` that never ends belongs to it, as in HTML.  An element of
``PAIRED`` is left out with all in it if it has an end tag of its own; else it is a
hidden element, which ends with its parent, an svg also where HTML lets markup break
out of it.  Null ids and urls pass through.  Repeated rows get equal results, ties
cannot arise.  An empty table gives an empty one.  Of the input's columns only
page_id, url and html are read, so others may have any name.  A page of any length
is parsed whole, in time linear in its length; depth has no bound.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textops as tx
from .html_labelled import labelled_pages

SLICE_BYTES = 2 << 20
_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|</(?![a-zA-Z])[^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)" + tx.TAG_REST, re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>]++)(?:\s*+=\s*+(\"[^\"]*+\"?|'[^']*+'?|[^\s>]++)?+)?+")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# What HTML says about its elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe".split())
PAIRED = frozenset("noscript template svg select".split())
HIDDEN = frozenset("script style noscript template iframe svg head title select textarea option button annotation annotation-xml".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mspace semantics".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: Elements that end an open one of the first kinds, up to one of the second.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
}
FOREIGN = ("svg", "math")
#: What ends an unclosed svg or math, and the elements in these that hold HTML.
BREAKS_OUT = frozenset("b big blockquote br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
HOLDS_HTML = ("foreignobject", "desc", "annotation-xml", "mi", "mn", "mo", "ms", "mtext")
_PAIR = re.compile(rf"<!--|<(/?)({'|'.join(sorted(RAW | PAIRED))})(?=[\s/>])" + tx.TAG_REST, re.I)
#: Stems in class, id and role that layouts use beside and for main text.
BESIDE = ("nav", "menu", "head", "foot", "side", "bar", "ad", "ads", "advert", "sponsor", "promo", "banner", "cookie", "consent", "notice", "popup", "modal", "newsletter", "subscribe", "signup", "search", "login", "form", "share", "social", "comment", "comments", "reply", "respond", "related", "widget", "breadcrumb", "breadcrumbs", "tags", "meta", "copyright", "pagination", "pager", "toolbar", "teaser", "recommended", "disclaimer", "legal", "sidebar", "footer", "header", "navigation", "masthead", "sponsored", "site")
WITHIN = ("article", "content", "main", "post", "entry", "story", "text", "body", "prose", "article-body")
TAGS = ("html", "body", "div", "section", "article", "main", "header", "footer", "nav", "aside", "form", "p", "h1", "h2", "h3", "h4", "ul", "ol", "li", "a", "b", "span", "em", "strong", "blockquote", "pre", "table", "tr", "td", "figure", "figcaption", "label", "button", "input", "dialog", "menu", "img", "dl", "dt", "dd")
_TAG_NUMBER = {t: i for i, t in enumerate(TAGS)}
_KINDS = len(TAGS) + 1
_NAME_NUMBER = {w: i for i, w in enumerate(BESIDE)} | {w: len(BESIDE) + i for i, w in enumerate(WITHIN)}
_NAMES = len(BESIDE) + len(WITHIN)
_NUMBERS = 18
#: Where a node's weights are: tags, names, numbers.
_TAG_AT, _NAME_AT, _NUMBER_AT = 0, _KINDS, _KINDS + _NAMES
FEATURES = _KINDS + _NAMES + _NUMBERS
#: Children are told apart for their edge by tag and by marks of main text (2) or of what stands beside (1).
_EDGES = 4 * _KINDS
_MARKS = {"nav": 1, "footer": 1, "aside": 1, "form": 1, "dialog": 1, "menu": 1, "article": 2, "main": 2}


@dataclass
class Tree:
    """The elements of a page in page order, and its texts."""

    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    names: list[list[int]] = field(default_factory=list)
    main: list[bool] = field(default_factory=list)  # of labelled pages
    texts: list[tuple[int, str, int]] = field(default_factory=list)  # element, text, block


def _end(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*+>?" if name else "-->", re.I)


def _pair_ends(source: str) -> dict[int, int]:
    """Where an element of ``PAIRED`` that starts at a place and has its own end tag ends."""
    ends: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    endless: set[str] = set()
    at = 0
    while m := _PAIR.search(source, at):
        at, name = m.end(), (m[2] or "").lower()
        if name in PAIRED:
            if not m[1]:
                if name not in FOREIGN or not m[3].endswith("/"):
                    opened.setdefault(name, []).append(m.start())
            elif opened.get(name):
                ends[opened[name].pop()] = at
        elif not m[1] and name not in endless:
            if last := _end(name).search(source, at):
                at = last.end()
            else:
                endless.add(name)
    return ends


def parse(source: str) -> Tree:
    """The tree of a page, however broken."""
    tree = Tree()
    stack: list[int] = []
    ends: dict[int, int] | None = None
    opened: dict[str, list[int]] = {}  # where in the stack a tag's open elements are
    block = 0

    def push(name: str, attributes: str) -> None:
        names: list[int] = []
        main = bool(stack) and tree.main[stack[-1]]
        if attributes:
            for key, value in _ATTRIBUTE.findall(attributes):
                key = key.lower()
                if key in ("class", "id", "role"):
                    for w in _WORD.findall(value):
                        i = _NAME_NUMBER.get(w.lower())
                        if i is not None:
                            names.append(i)
                elif key == "data-main":
                    main = "1" in value
        tree.tag.append(name)
        tree.parent.append(stack[-1] if stack else -1)
        tree.depth.append(len(stack))
        tree.names.append(names)
        tree.main.append(main)
        if name not in VOID:
            opened.setdefault(name, []).append(len(stack))
            stack.append(len(tree.tag) - 1)

    def innermost(kinds: tuple[str, ...]) -> int:
        return max((opened[k][-1] for k in kinds if opened.get(k)), default=-1)

    def close(kinds: tuple[str, ...], until: tuple[str, ...] = ()) -> bool:
        i = innermost(kinds)
        if i <= innermost(until):
            return False
        for j in stack[i:]:
            opened[tree.tag[j]].pop()
        del stack[i:]
        return True

    push("html", "")
    push("body", "")
    at, end = 0, len(source)
    while at < end:
        m = _TOKEN.search(source, at)
        stop = m.start() if m else end
        if stop > at:
            text = source[at:stop]
            if not text.isspace():
                tree.texts.append((stack[-1], tx.unescape(text), block))
            elif tree.texts:
                tree.texts.append((stack[-1], " ", block))
        if m is None:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if name == "body" and 'data-main="1"' in m[3]:
            tree.main[1] = True
        if not name or name in ("html", "body"):
            continue
        if name not in INLINE:
            block += 1
        if m[1]:
            close((name,))
            continue
        if name in BREAKS_OUT:
            while close(FOREIGN, HOLDS_HTML):
                pass
        if name in ENDS_P:
            close(("p",), ("td", "th", "li", "div", "section", "article", "main", "aside", "blockquote", "form", "table", "button"))
        if name in ENDS:
            close(*ENDS[name])
        push(name, m[3])
        if name in RAW and not m[3].endswith("/"):
            last = _end(name).search(source, at)
            at = last.end() if last else end
            close((name,))
        elif name in PAIRED:
            if ends is None:
                ends = _pair_ends(source)
            if m.start() in ends or m[3].endswith("/"):
                at = ends.get(m.start(), at)
                close((name,))
    return tree


def _arrays(trees: list[Tree]) -> dict[str, np.ndarray]:
    """All nodes of several pages, with what is seen of them."""
    count = np.array([len(t.tag) for t in trees])
    first = np.cumsum(count) - count
    n = int(count.sum())
    page = np.repeat(np.arange(len(trees)), count)
    parent = np.concatenate([np.array(t.parent) + np.where(np.array(t.parent) >= 0, f, 0) for t, f in zip(trees, first.tolist(), strict=True)])
    depth = np.concatenate([t.depth for t in trees])
    kind = np.fromiter((_TAG_NUMBER.get(tag, _KINDS - 1) for t in trees for tag in t.tag), np.int64, n)
    inline = np.fromiter((tag in INLINE for t in trees for tag in t.tag), bool, n)
    shown = np.fromiter((tag not in HIDDEN for t in trees for tag in t.tag), bool, n)
    mark = np.fromiter((_MARKS.get(tag, 0) for t in trees for tag in t.tag), np.int64, n)
    at = [(f + i, w) for t, f in zip(trees, first.tolist(), strict=True) for i, names in enumerate(t.names) for w in names]
    named = np.unique(np.array(at, np.int64).reshape(-1, 2), axis=0)
    np.bitwise_or.at(mark, named[:, 0], np.where(named[:, 1] < len(BESIDE), 1, 2))
    own, sign = np.zeros(n), np.zeros(n)
    for t, f in zip(trees, first.tolist(), strict=True):
        for i, text, _ in t.texts:
            own[f + i] += len(text)
            if "\xa9" in text:
                sign[f + i] = 1
    own *= shown
    # all nodes by depth, and the place of a node's parent in the level above
    order, width = np.argsort(depth, kind="stable"), np.bincount(depth)
    starts = np.cumsum(width) - width
    levels = np.split(order, starts[1:])
    place = np.empty(n, np.int64)
    place[order] = np.arange(n) - np.repeat(starts, width)
    above = place[parent]
    # from the leaves: text, text in links, and the running text of a block with what is inline in it
    link = kind == _TAG_NUMBER["a"]
    total, linked, flow, flow_linked = own.copy(), np.zeros(n), own.copy(), np.zeros(n)
    prose, direct = np.zeros(n), np.zeros(n)
    for rows, over in zip([*levels[:0:-1], levels[0]], [*levels[-2::-1], None], strict=True):
        linked[rows] = np.where(link[rows], total[rows], linked[rows])
        flow_linked[rows] = np.where(link[rows], flow[rows], flow_linked[rows])
        block = ~inline[rows]
        running = np.where(block, (flow[rows] - flow_linked[rows]) * np.minimum(flow[rows] / 80, 1), 0)
        prose[rows] += running
        direct[rows] += running
        if over is None:
            break
        for sums, values in ((total, total[rows]), (linked, linked[rows]), (flow, flow[rows] * ~block), (flow_linked, flow_linked[rows] * ~block), (prose, prose[rows]), (direct, running)):
            sums[over] += np.bincount(above[rows], values, len(over))
    whole, running = np.maximum(total[first], 1)[page], np.maximum(prose[first], 1)[page]
    # from the root: what holds a node. What holds nearly all running text isn't beside it.
    share = prose / running
    beside, within = (mark & 1 > 0) & (share < 0.9), mark & 2 > 0
    inner = within & ~beside
    for rows in levels[1:]:
        beside[rows] |= beside[parent[rows]]
        within[rows] |= within[parent[rows]]
    marked = np.bincount(page[inner], minlength=len(trees))[page] > 0
    link_share = linked / np.maximum(total, 1)
    children = np.bincount(parent[parent >= 0], minlength=n).astype(float)
    numbers = [
        np.ones(n), np.log1p(np.minimum(own, 500)) / 5, np.log1p(np.minimum(total, 3000)) / 8, link_share, link_share > 0.6, total / whole, np.log1p(children) / 4, (np.arange(n) - first[page]) / count[page], total < 25,
        share, prose / np.maximum(total, 1), direct / running, beside, within, marked & ~within, beside & within, sign, np.log1p(np.minimum(direct, 3000)) / 8,
    ]
    edge = kind * 4 + mark
    return {"kind": kind, "named": named, "numbers": np.stack(numbers, 1), "parent": parent, "above": above, "edge": edge, "first": first, "levels": levels, "main": np.concatenate([t.main for t in trees])}


def _unary(a: dict, weights: np.ndarray) -> np.ndarray:
    """Each node's potential of state 1."""
    out = weights[a["kind"]] + a["numbers"] @ weights[_NUMBER_AT:]
    return out + np.bincount(a["named"][:, 0], weights[_NAME_AT + a["named"][:, 1]], len(out))


def _seen(a: dict, p: np.ndarray) -> np.ndarray:
    """The sum of all nodes' features, each counted ``p`` times."""
    tags = np.bincount(a["kind"], p, _KINDS)
    names = np.bincount(a["named"][:, 1], p[a["named"][:, 0]], _NAMES)
    return np.concatenate([tags, names, p @ a["numbers"]])


@dataclass
class TreeModel:
    """Weights of a node's features for state 1, and of (kind of child, parent state, child state)."""

    node: np.ndarray
    edge: np.ndarray


def marginals(model: TreeModel, a: dict) -> tuple[np.ndarray, np.ndarray]:
    """For each node the probability of state 1, and of each (parent state, state)."""
    n = len(a["parent"])
    up = np.zeros((n, 2))
    up[:, 1] = _unary(a, model.node)
    edge = model.edge[a["edge"]]
    message = np.zeros((n, 2))
    for rows, over in zip(a["levels"][:0:-1], a["levels"][-2::-1], strict=True):  # leaves first
        both = edge[rows] + up[rows][:, None, :]
        message[rows] = np.logaddexp(both[:, :, 0], both[:, :, 1])
        for state in (0, 1):
            up[over, state] += np.bincount(a["above"][rows], message[rows, state], len(over))
    down = up.copy()  # beliefs, from the root
    pair = np.zeros((n, 2, 2))
    for rows in a["levels"][1:]:
        rest = down[a["parent"][rows]] - message[rows]
        both = rest[:, :, None] + edge[rows] + up[rows][:, None, :]
        both -= both.max((1, 2), keepdims=True)
        pair[rows] = np.exp(both)
        pair[rows] /= pair[rows].sum((1, 2), keepdims=True)
        belief = np.logaddexp(rest[:, 0, None] + edge[rows][:, 0], rest[:, 1, None] + edge[rows][:, 1])
        down[rows] = up[rows] + belief
    odds = down[:, 1] - down[:, 0]
    return 1 / (1 + np.exp(-np.clip(odds, -500, 500))), pair


@functools.cache
def train(pages: int = 1800, epochs: int = 25, seed: int = 11, batch: int = 100, without: tuple[str, ...] = ()) -> TreeModel:
    """Maximum likelihood by Adam over the labelled pages, ``batch`` of them a step."""
    made = labelled_pages(pages, seed, without)
    parts = []
    for at in range(0, pages, batch):
        a = _arrays([parse(p) for p in made[at : at + batch]])
        y, inner = a["main"].astype(float), np.flatnonzero(a["parent"] >= 0)
        seen = np.zeros((_EDGES, 2, 2))
        np.add.at(seen, (a["edge"][inner], y[a["parent"][inner]].astype(int), y[inner].astype(int)), 1)
        parts.append((a, inner, _seen(a, y), seen))
    model = TreeModel(np.zeros(FEATURES), np.zeros((_EDGES, 2, 2)))
    moments = [np.zeros_like(w) for w in (model.node, model.node, model.edge, model.edge)]
    steps = epochs * len(parts)
    for step in range(1, steps + 1):
        a, inner, seen_node, seen_edge = parts[step % len(parts)]
        p, pair = marginals(model, a)
        expected = np.zeros_like(seen_edge)
        for i, j in ((0, 0), (0, 1), (1, 0), (1, 1)):
            expected[:, i, j] = np.bincount(a["edge"][inner], pair[inner, i, j], _EDGES)
        grads = (seen_node - _seen(a, p)) / batch - 0.001 * model.node, (seen_edge - expected) / batch - 0.001 * model.edge
        for i, (g, w) in enumerate(zip(grads, (model.node, model.edge), strict=True)):
            m, v = moments[2 * i], moments[2 * i + 1]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w += 0.15 * (1 - (step - 1) / steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def extract(model: TreeModel, sources: list[str | None]) -> list[str]:
    """The main text of every page."""
    out = [""] * len(sources)
    at = [i for i, s in enumerate(sources) if s]
    if not at:
        return out
    trees = [parse(sources[i]) for i in at]
    a = _arrays(trees)
    p, _ = marginals(model, a)
    for i, tree, first in zip(at, trees, a["first"].tolist(), strict=True):
        hidden = [False] * len(tree.tag)
        for j, (tag, parent) in enumerate(zip(tree.tag, tree.parent, strict=True)):
            hidden[j] = tag in HIDDEN or (parent >= 0 and hidden[parent])
        blocks: dict[int, list[str]] = {}
        for j, text, block in tree.texts:
            if not hidden[j] and p[first + j] >= 0.5:
                blocks.setdefault(block, []).append(text)
        out[i] = " ".join(filter(None, (" ".join("".join(parts).split()) for parts in blocks.values())))
    return out


def _extract(batches: Iterator[pa.RecordBatch], model: TreeModel) -> Iterator[pa.RecordBatch]:
    for batch in tx.text_slices(batches, "html", SLICE_BYTES):
        texts = extract(model, batch.column("html").to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame, model: TreeModel | None = None) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every page."""
    model = model or train()
    return pages.select("page_id", "url", "html").mapInArrow(lambda it: tx.lean(_extract(it, model)), "page_id long, url string, text string, n_chars long")
