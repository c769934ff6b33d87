"""Main text of HTML pages by gradient-boosted trees over DOM nodes and a decoding that keeps the tree consistent.

Each block of a page is a node with features: its tag and the words of its class, id and role; those of the blocks
around it; its depth; how dense text, links and blocks are in its subtree; its place among its siblings and its share
of their text. Trees boosted on labelled pages give the odds that a node's subtree holds main text. A node that is
dropped takes its subtree along, so the labels are decoded together: the set of kept nodes is the likeliest of those in
which everything above a kept node is kept.

The pages to train on are made here, by rule and with a fixed seed, as no table has labels for blocks.
"""

from __future__ import annotations

import random
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frame, strings

VOID = set("area base br col embed hr img input link meta source track wbr".split())
INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
UNSEEN = set("script style noscript template head svg math iframe object canvas audio video select option textarea button title".split())
CLOSES_P = set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Blocks that hold a page or an article whatever words their class has.
LAYOUT = {"html", "body", "main", "article"}
#: Groups of tags and of words in attributes, one feature each.
TAGS = [["article", "main"], ["section", "div"], ["p"], ["h1", "h2", "h3", "h4", "h5", "h6"], ["ul", "ol", "dl", "li", "dt", "dd"], ["nav", "menu"], ["header"], ["footer"], ["aside"], ["form", "fieldset", "dialog"], ["table", "tr", "td", "th", "tbody"], ["figure", "blockquote", "pre"], ["body", "html"]]
WORDS = [
    "article content main post entry story text body page".split(),
    "nav menu breadcrumb breadcrumbs pagination pager toc tabs navigation navbar".split(),
    "header masthead top banner logo hero".split(),
    "footer foot bottom copyright legal colophon".split(),
    "sidebar side aside widget rail related recommended popular trending more".split(),
    "ad ads advert advertisement adverts sponsor sponsored promo promotion".split(),
    "cookie cookies notice alert popup modal overlay consent gdpr message warning announcement".split(),
    "comment comments reply replies discussion respond disqus reader".split(),
    "form login search subscribe signup newsletter register share social".split(),
]


class Node:
    __slots__ = ("tag", "words", "parent", "children", "text", "links", "texts", "blocks")

    def __init__(self, tag: str, words: list[str], parent: Node | None):
        self.tag, self.words, self.parent = tag, words, parent
        self.children: list[Node] = []
        self.text: list[str] = []
        self.links = self.texts = self.blocks = 0


class Builder(HTMLParser):
    """The blocks of a page. A block's own text between its inner blocks is a block without a tag."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", [], None)
        self.open: list[tuple[str, Node]] = []  # tags that are open, with the block they are in
        self.places: dict[str, list[int]] = defaultdict(list)  # where in it each tag is
        self.unseen = self.link = 0

    def leaf(self) -> Node:
        children = self.at.children
        if not children or children[-1].tag:
            children.append(Node("", [], self.at))
        return children[-1]

    def pop(self) -> None:
        tag, node = self.open.pop()
        self.places[tag].pop()
        self.at = node
        if tag in UNSEEN:
            self.unseen -= 1
        if tag == "a":
            self.link -= 1

    def end(self, tags: set[str], within: set[str]) -> None:
        """Ends the innermost open one of ``tags``, unless one of ``within`` is open inside it. In time as tags are named and ended."""
        innermost = lambda names: max((self.places[t][-1] for t in names if self.places.get(t)), default=-1)
        last = innermost(tags)
        if last >= max(innermost(within), 0):
            while len(self.open) > last:
                self.pop()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("br", "hr"):
            self.at.children.append(Node("br", [], self.at))
            return
        if tag in VOID:
            return
        if tag in CLOSES_P:
            self.end({"p"}, {"body", "td", "th", "button", "div", "article", "section"})
        if tag in SELF_CLOSING:
            self.end(SELF_CLOSING[tag], {"ul", "ol", "dl", "table", "select"})
        self.places[tag].append(len(self.open))
        self.open.append((tag, self.at))
        if tag in UNSEEN:
            self.unseen += 1
        elif tag == "a":
            self.link += 1
        elif tag == "body":
            # Not everything without an end tag before it belongs to the head.
            self.unseen = 0
        if tag not in INLINE and tag not in UNSEEN:
            words = [w for name, value in attrs if value and name in ("class", "id", "role", "itemprop", "aria-label") for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower()) if w]
            if tag in LAYOUT:  # what such a block's class says besides is about the page: that it has a sidebar, comments, a banner
                words = [w for w in words if w in WORDS[0]]
            node = Node(tag, words, self.at)
            self.at.children.append(node)
            self.at = node

    def handle_endtag(self, tag: str) -> None:
        if tag not in VOID:
            self.end({tag}, set())

    def handle_data(self, data: str) -> None:
        if self.unseen <= 0 and data:
            leaf = self.leaf()
            leaf.text.append(data)
            if self.link > 0:
                leaf.links += len(data)


def parsed(html: str) -> list[Node]:
    """The nodes of a page, parents before children, in page order. Text that no parser gets through counts as text."""
    builder = Builder()
    try:
        builder.feed(html)
        if re.match(r"<[A-Za-z/!?]", builder.rawdata):  # a tag that never ends is no text
            builder.rawdata = ""
        HTMLParser.close(builder)
    except (AssertionError, ValueError):
        builder.handle_data(re.sub(r"<[^>]*>?", " ", html))
    out, stack = [], [builder.root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += reversed(node.children)
    for node in reversed(out):
        node.texts += len(" ".join("".join(node.text).split()))
        node.blocks += 1
        if node.parent is not None:
            node.parent.texts += node.texts
            node.parent.links += node.links
            node.parent.blocks += node.blocks
    return out


WORD_OF = {w: k for k, words in enumerate(WORDS) for w in words}
TAG_OF = {t: k for k, tags in enumerate(TAGS) for t in tags}
#: Pages that go through the trees together.
AT_ONCE = 64
N_FEATURES = 2 * (len(TAGS) + len(WORDS)) + 11


def features(nodes: list[Node]) -> np.ndarray:
    """A row per node."""
    out = np.zeros((len(nodes), N_FEATURES), np.float32)
    number = {id(n): i for i, n in enumerate(nodes)}
    own = len(TAGS) + len(WORDS)
    whole = max(nodes[0].texts, 1)
    depth: list[int] = []
    place: dict[int, tuple[int, int]] = {}
    for i, node in enumerate(nodes):
        row = out[i]
        if node.tag in TAG_OF:
            row[TAG_OF[node.tag]] = 1
        for word in node.words:
            if word in WORD_OF:
                row[len(TAGS) + WORD_OF[word]] = 1
        parent = node.parent
        if parent is None:
            depth.append(0)
            index, count, held = 0, 1, whole
        else:
            p = number[id(parent)]
            depth.append(depth[p] + 1)
            # What the blocks around are; a leaf without a tag is what its parent is.
            row[own : 2 * own] = np.maximum(out[p, own : 2 * own], out[p, :own])
            index, count = place[i] if i in place else (0, 1)
            held = max(parent.texts, 1)
        for k, child in enumerate(node.children):
            place[number[id(child)]] = (k, len(node.children))
        text = "".join(node.text)
        row[2 * own :] = (
            depth[i], np.log1p(node.texts), node.texts / whole, node.links / max(node.texts, 1), np.log1p(node.blocks), node.texts / node.blocks,
            index, index / max(count, 1), count, node.texts / held, sum(map(text.count, ".,;")) / max(len(text), 1),
        )
    return out


class Tree(NamedTuple):
    """Depth-first arrays: the feature (-1: a leaf), the value up to which a row goes left, where left and right are, the leaf's step."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    right: np.ndarray
    step: np.ndarray


def grown(x: np.ndarray, gradient: np.ndarray, weight: np.ndarray, depth: int, rate: float, least: float = 5.0) -> Tree:
    """One regression tree for Newton steps, with splits among quantiles of each feature."""
    nodes: list[list] = []

    def grow(rows: np.ndarray, left: int) -> int:
        at = len(nodes)
        g, h = gradient[rows].sum(), weight[rows].sum()
        nodes.append([-1, 0.0, 0, 0, rate * g / (h + 1.0)])
        best = (1e-6, -1, 0.0)
        if left and len(rows) > 2 * least:
            for f in range(x.shape[1]):
                column = x[rows, f]
                for value in np.unique(np.quantile(column, (0.05, 0.15, 0.3, 0.5, 0.7, 0.85, 0.95), method="lower")):
                    side = column <= value
                    n = side.sum()
                    if n < least or len(rows) - n < least:
                        continue
                    gl, hl = gradient[rows][side].sum(), weight[rows][side].sum()
                    gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                    if gain > best[0]:
                        best = (gain, f, float(value))
        if best[1] >= 0:
            side = x[rows, best[1]] <= best[2]
            nodes[at][:2] = best[1:]
            nodes[at][2] = grow(rows[side], left - 1)
            nodes[at][3] = grow(rows[~side], left - 1)
        return at

    grow(np.arange(len(x)), depth)
    columns = list(zip(*nodes, strict=True))
    return Tree(*(np.array(c, t) for c, t in zip(columns, (np.int32, np.float32, np.int32, np.int32, np.float64), strict=True)))


def applied(tree: Tree, x: np.ndarray) -> np.ndarray:
    at = np.zeros(len(x), np.int32)
    rows = np.arange(len(x))
    while True:
        feature = tree.feature[at]
        inner = feature >= 0
        if not inner.any():
            return tree.step[at]
        goes = x[rows, np.maximum(feature, 0)] <= tree.split[at]
        at = np.where(inner, np.where(goes, tree.left[at], tree.right[at]), at)


def log_odds(model: tuple[Tree, ...], x: np.ndarray) -> np.ndarray:
    return sum((applied(tree, x) for tree in model), np.zeros(len(x)))


def boosted(x: np.ndarray, y: np.ndarray, rounds: int = 30, depth: int = 4, rate: float = 0.4) -> tuple[Tree, ...]:
    model, odds = [], np.zeros(len(x))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-odds))
        model.append(grown(x, y - p, p * (1 - p), depth, rate))
        odds += applied(model[-1], x)
    return tuple(model)


def kept(nodes: list[Node], odds: np.ndarray) -> list[bool]:
    """The likeliest labels in which all above a kept node are kept. The page itself is kept."""
    odds = np.clip(odds, -30, 30)
    keep = np.logaddexp(0, -odds)  # costs
    drop = np.logaddexp(0, odds)
    number = {id(n): i for i, n in enumerate(nodes)}
    up = [number[id(n.parent)] if n.parent is not None else -1 for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        keep[up[i]] += min(keep[i], drop[i])
        drop[up[i]] += drop[i]
    out = [True] * len(nodes)
    for i in range(1, len(nodes)):
        out[i] = out[up[i]] and bool(keep[i] < drop[i])
    return out


def joined(nodes: list[Node], good: list[bool]) -> str:
    blocks = (" ".join("".join(n.text).split()) for n, g in zip(nodes, good, strict=True) if g and n.text)
    return " ".join(b for b in blocks if b)


def main_texts(html: list[str], model: tuple[Tree, ...]) -> list[str]:
    """The main texts of a few pages, whose nodes go through the trees together."""
    pages = [parsed(h) for h in html]
    odds = log_odds(model, np.concatenate([features(nodes) for nodes in pages]))
    ends = np.cumsum([len(nodes) for nodes in pages])
    return [joined(nodes, kept(nodes, own)) for nodes, own in zip(pages, np.split(odds, ends[:-1]), strict=True)]


def main_text(html: str, model: tuple[Tree, ...]) -> str:
    return main_texts([html], model)[0]


def example(draw: random.Random) -> tuple[str, set[str]]:
    """A page made by rule, and the words of its main text."""
    serial = [0]
    main: set[str] = set()

    def words(n: int, good: bool) -> str:
        out = []
        for _ in range(n):
            serial[0] += 1
            out.append(f"{'m' if good else 'x'}{serial[0]}" + draw.choice(["", "", "", ",", "."]))
        if good:
            main.update(w.strip(",.") for w in out)
        return " ".join(out)

    def named(group: int) -> str:
        word = draw.choice(WORDS[group])
        return draw.choice([f' class="{word}"', f' id="{word}"', f' class="{word}-box wide"', f' class="c{serial[0]} {word}"', f' class="{word}-{draw.choice(WORDS[group])}"', f' class="{draw.choice(["inline", "slot", "x"])}-{word}"'])

    def layout() -> str:
        """What a block around a whole page or article is called by what else the page has."""
        if draw.random() < 0.75:
            return ""
        word = draw.choice(WORDS[draw.choice([1, 2, 4, 5, 7, 7, 4])])
        return f' class="{draw.choice(["page", "wrap", "single", "layout", "outer"])} {draw.choice(["has-{}", "with-{}", "no-{}", "{}-left", "right-{}", "{}-on"]).format(word)}"'

    def links(n: int) -> str:
        return "<ul>" + "".join(f"<li><a href='/{i}'>{words(draw.randint(1, 3), False)}</a></li>" for i in range(n)) + "</ul>"

    def side(kind: int) -> str:
        short = lambda: words(draw.randint(2, 25), False)
        if kind == 0:
            tag = draw.choice(["nav", "div", "ul"])
            return f"<{tag}{'' if tag == 'nav' and draw.random() < 0.6 else named(1)}>{links(draw.randint(2, 9))}</{tag}>"
        if kind == 1:
            return f"<header{named(2) if draw.random() < 0.5 else ''}><h1>{short()}</h1>{links(3)}</header>"
        if kind == 2:
            tag = draw.choice(["footer", "footer", "div"])
            return f"<{tag}{'' if tag == 'footer' and draw.random() < 0.6 else named(3)}>&copy; {short()}{draw.choice(['', links(3)])}</{tag}>"
        if kind == 3:
            tag = draw.choice(["aside", "div", "section"])
            inner = "".join(f"<p>{short()}</p>" for _ in range(draw.randint(1, 3))) + draw.choice(["", links(4)])
            return f"<{tag}{'' if tag == 'aside' and draw.random() < 0.5 else named(4)}><h3>{words(2, False)}</h3>{inner}</{tag}>"
        if kind in (4, 5):
            return f"<{draw.choice(['div', 'section', 'p'])}{named(kind + 1)}>{short()}</div>"
        if kind == 6:
            items = "".join(f"<div{draw.choice([' class=comment', ''])}><p>{short()}</p></div>" for _ in range(draw.randint(1, 4)))
            return f"<{draw.choice(['section', 'div', 'ol'])}{named(7)}><h2>{words(1, False)}</h2>{items}</div></section>"
        if kind == 8:
            return f"<{draw.choice(['div', 'section', 'aside'])}{named(8)}><{draw.choice(['p', 'h3', 'h4'])}>{short()}</p><input name=q>{draw.choice(['', '<button>x</button>', f'<p>{words(3, False)}</p>'])}</div></section></aside>"
        return f"<form{named(8) if draw.random() < 0.5 else ''}><label>{words(3, False)}</label><input name=q><p>{short()}</p></form>"

    def body(n: int) -> str:
        out = [f"<h1>{words(draw.randint(2, 9), True)}</h1>"] if draw.random() < 0.8 else []
        if draw.random() < 0.2:
            out.append(f"<header{draw.choice(['', named(2)])}><p>{words(draw.randint(2, 6), False)}</p></header>")
        for _ in range(n):
            kind = draw.random()
            if kind < 0.7:
                out.append(f"<p>{words(draw.randint(1, 90), True)}{draw.choice(['', '<b>' + words(2, True) + '</b>', '<br><p>' + words(9, True)])}</p>")
            elif kind < 0.76:
                out.append(f"<h2>{words(draw.randint(1, 6), True)}</h2>")
            elif kind < 0.81:
                out.append("<ul>" + "".join(f"<li>{words(draw.randint(2, 12), True)}</li>" for _ in range(3)) + "</ul>")
            elif kind < 0.85:
                out.append(f"<blockquote>{words(12, True)}</blockquote>")
            elif kind < 0.88:
                out.append(f"<table><tr><td>{words(2, True)}</td><td>{words(2, True)}</td></tr></table>")
            else:
                out.append(side(draw.choice([3, 4, 4, 5, 7, 8])))
        if draw.random() < 0.2:
            out.append(f"<footer{draw.choice(['', named(3)])}>{words(draw.randint(1, 5), False)}</footer>")
        return "".join(out)

    def bare(n: int) -> str:
        """Text without blocks of its own, or only lists."""
        line = lambda: words(draw.randint(3, 40), True)
        if draw.random() < 0.3:
            return "<ul>" + "".join(f"<li>{words(draw.randint(2, 12), True)}</li>" for _ in range(draw.choice([3, 20, 150]))) + "</ul>"
        return draw.choice(["<br>", "<br><br>", " ", "<p>"]).join(line() for _ in range(n))

    size = draw.choice([1, 1, 2, 3, 5, 8, 15])
    inner = bare(size) if draw.random() < 0.12 else body(size)
    if draw.random() < 0.15:  # a page without any wrapper, or with wrappers that say nothing; often nothing but the text
        wrapped = draw.choice(["{}", "<body>{}</body>", "<html><body>{}</body></html>", "<body><div>{}</div></body>", "<div><div><div>{}</div></div></div>", "<body><table><tr><td>{}</td></tr></table></body>"])
        ends = draw.random() < 0.4
        return wrapped.format((side(0) if ends else "") + inner + (side(2) if ends else "")), main
    around = draw.choice([f"<article{layout()}>{{}}</article>", f"<main{layout()}>{{}}</main>", f"<div{layout()}><div{named(0)}>{{}}</div></div>", "<main><article>{}</article></main>", f"<div{named(0)}>{{}}</div>", f"<div id=wrap><div{named(0)}>{{}}</div></div>", "{}", "<div>{}</div>", "<article class=post><div class=entry-content>{}</div></article>", f"<section{named(0)}>{{}}</section>"])
    before = "".join(side(k) for k in range(8) if draw.random() < (0.7, 0.5, 0, 0.2, 0.35, 0.25, 0, 0.2)[k])
    after = "".join(side(k) for k in range(8) if draw.random() < (0.1, 0, 0.8, 0.4, 0.2, 0.15, 0.35, 0.2)[k])
    head = f"<head><title>{words(3, False)}</title><style>p{{x:y}}</style><script>var a='<p>';</script></head>" if draw.random() < 0.9 else ""
    inside = before + around.format(inner) + after
    if draw.random() < 0.25:
        inside = f"<div{layout()}>{inside}</div>"
    return f"<!DOCTYPE html><html>{head}<body{layout()}>{inside}</body></html>", main


@lru_cache(maxsize=1)
def trained(pages: int = 400, seed: int = 7) -> tuple[Tree, ...]:
    """The model, from pages made by rule."""
    draw = random.Random(seed)
    rows, labels = [], []
    for _ in range(pages):
        html, main = example(draw)
        nodes = parsed(html)
        number = {id(n): i for i, n in enumerate(nodes)}
        good = np.zeros(len(nodes))
        for i in range(len(nodes) - 1, -1, -1):
            if main.intersection(w.strip(",.") for w in "".join(nodes[i].text).split()):
                good[i] = 1
            if good[i] and nodes[i].parent is not None:
                good[number[id(nodes[i].parent)]] = 1
        use = [i for i, n in enumerate(nodes) if n.texts]
        rows.append(features(nodes)[use])
        labels.append(good[use])
    return boosted(np.concatenate(rows), np.concatenate(labels))


TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extracted(pages: DataFrame, model: tuple[Tree, ...] | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``, by the trees of ``model``. No shuffle.

    Null html counts as empty, which has no text; nor has a page in which nothing but menus and the like stands. Repeated
    rows have equal texts, an empty table gives none, other columns don't matter, and pages of any length are read whole.
    """
    model = model or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                texts = main_texts(list(strings(part.column(2))), model)
                yield frame(TEXTS, [part.column(0), part.column(1), texts, list(map(len, texts))])

    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
