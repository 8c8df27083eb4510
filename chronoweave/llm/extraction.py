"""Main text of web pages: gradient-boosted trees over DOM nodes, and a decoding that keeps ancestors and descendants consistent.

A page becomes a tree of block elements with runs of text as leaves. Features of a node are its tag, the tokens of its class, id
and role (by how they were labelled in training, for itself and the worst of its ancestors), the density of text, links, tags
and punctuation in its subtree, its depth, and how it stands among its siblings. Boosted trees give the probability that the
subtree holds main text. Decoding then takes the labelling of the whole tree with the highest likelihood among those where
nothing below a node without main text holds any: scores of both states are added up from the leaves, and choices made from
the root.

The trees are trained here, on pages that ``sample_pages`` composes from usual layouts (``PAGES`` of them, fixed seed): there are
no labelled pages, and so the model does not depend on the table it is used on.

Defined results: null or empty html, and a page without main text, give an empty text; null ids and urls are kept; repeated
rows get the same result; an empty table gives an empty result; other columns are left alone; nothing is cut from long pages.
"""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from functools import cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm.text import blobs, table

PAGES, ROUNDS, DEPTH, RATE, BINS = 400, 40, 4, 0.3, 32

#: Elements without content, and those whose content is no text of the page: code, the head, form controls, and frames.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CONTROLS = set("select option textarea button datalist".split())
HIDDEN = CONTROLS | set("head script style template iframe title".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup svg time tt u var wbr "
             "math mfrac mi mn mo mover mroot mrow ms mspace msqrt msub msubsup msup mtext munder munderover semantics annotation".split())
#: A paragraph ends where one of these begins.
ENDS_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav "
             "ol p pre section table ul li dd dt".split())
#: A form control that was not closed ends where one of these begins.
ENDS_CONTROL = set("article aside blockquote figure footer form h1 h2 h3 h4 h5 h6 header main nav ol p pre section table ul".split())
#: Elements that no paragraph reaches out of.
HOLDS_P = ("div", "article", "section", "td", "th", "li", "main", "aside", "blockquote", "form", "header", "footer", "nav")
#: An open element of the key's kind ends where such an element begins, up to the nearest of the list that holds them.
ENDS_LIKE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
TAGS = {tag: i for i, tag in enumerate(
    "#text article main section div p h1 h2 h3 h4 ul ol li nav header footer aside form table tr td blockquote pre figure figcaption dl dt dd body html".split(), 1)}
LABEL = "data-main"
_TOKEN = re.compile(r"[a-z]+")


class Tree(HTMLParser):
    """Block nodes in page order: parent, tag, attribute tokens, depth; for text nodes the text and its share of links.

    Every tag costs a bounded number of steps, however deep the page: open blocks are found by the places of their names, and
    open inline elements are counted per block. Hidden elements end with their end tag, or with the block that they stand in.
    """

    RCDATA_CONTENT_ELEMENTS = ()  # an unclosed text field or title must not swallow the page

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.tokens, self.depth, self.label = [-1], ["html"], [()], [0], [None]
        self.text: dict[int, str] = {}
        self.link_chars: dict[int, int] = {}
        self.tags_below = [0]
        self.open: list[tuple[str, int, Counter]] = [("html", 0, Counter())]  # name, node and open inline elements of a block
        self.places: defaultdict[str, list[int]] = defaultdict(list)
        self.hidden: list[str] = []
        self.in_hidden: Counter = Counter()
        self.parts: list[str] = []
        self.linked = self.in_link = 0

    def _node(self, tag: str, tokens: tuple[str, ...], label: str | None) -> int:
        at = self.open[-1][1]
        self.parent.append(at)
        self.tag.append(tag)
        self.tokens.append(tokens)
        self.depth.append(self.depth[at] + 1)
        self.label.append(label if label is not None else self.label[at])
        self.tags_below.append(0)
        return len(self.parent) - 1

    def _flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                node = self._node("#text", (), None)
                self.text[node], self.link_chars[node] = text, self.linked
            self.parts, self.linked = [], 0

    def _close_to(self, at: int) -> None:
        self._flush()
        while len(self.open) > at:
            tag, _, inline = self.open.pop()
            self.places[tag].pop()
            self.in_link -= inline["a"]

    def _place(self, tag: str) -> int:
        places = self.places.get(tag)
        return places[-1] if places else 0

    def _last(self, tag: str, stop: tuple[str, ...]) -> int:
        """Place of the innermost open ``tag``, 0 if there is none within the innermost of ``stop``."""
        at = self._place(tag)
        return at if at and at >= max(map(self._place, stop)) else 0

    def _show(self) -> None:
        self.hidden.clear()
        self.in_hidden.clear()

    def handle_starttag(self, tag, attrs):
        if self.hidden and tag in ENDS_CONTROL and CONTROLS.issuperset(self.hidden[:1]):
            self._show()
        if self.hidden or tag in HIDDEN:
            if tag in HIDDEN:
                if tag not in CONTROLS or self.hidden[-1:] != [tag]:  # a control ends an open one of its kind
                    self.hidden.append(tag)
            elif tag not in VOID:
                self.in_hidden[tag] += 1
            return
        self.tags_below[self.open[-1][1]] += 1
        if tag in ("html", "body"):
            return
        if tag in INLINE:
            if tag == "br":
                self.parts.append(" ")
            elif tag not in VOID:
                self.open[-1][2][tag] += 1
                self.in_link += tag == "a"
            return
        if tag in ENDS_P and (at := self._last("p", HOLDS_P)):
            self._close_to(at)
        if tag in ENDS_LIKE and (at := self._last(tag, ENDS_LIKE[tag])):
            self._close_to(at)
        self._flush()
        if tag in VOID:
            return
        held = dict(attrs)
        named = " ".join(held.get(name) or "" for name in ("class", "id", "role", "itemprop", "aria-label"))
        tokens = tuple(_TOKEN.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", named).lower()))
        if "hidden" in held or "display:none" in (held.get("style") or "").replace(" ", ""):
            tokens += ("hidden",)
        self.places[tag].append(len(self.open))
        self.open.append((tag, self._node(tag, tokens, held.get(LABEL)), Counter()))

    def handle_startendtag(self, tag, attrs):
        if tag in VOID or tag not in HIDDEN:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.hidden:
            if tag in HIDDEN:
                if tag in self.hidden[-8:] or tag == self.hidden[0]:  # deeper ones end with the outermost
                    while self.hidden.pop() != tag:
                        pass
            elif self.in_hidden[tag]:
                self.in_hidden[tag] -= 1
            elif tag in ("html", "body") or self._place(tag):
                self._show()
            if not self.hidden:
                self.in_hidden.clear()
        if not self.hidden:
            inline = self.open[-1][2]
            if tag in INLINE and inline[tag]:
                inline[tag] -= 1
                self.in_link -= tag == "a"
            elif at := self._place(tag):
                self._close_to(at)

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)
            if self.in_link > 0:
                self.linked += len(data.strip())


def parse(html: str) -> Tree:
    tree = Tree()
    tree.feed(html)
    if tree.rawdata.startswith("<!--"):  # a comment that is not closed reaches to the end of the page
        tree.rawdata = ""
    tree.close()
    tree._flush()
    return tree


def features(tree: Tree, odds: dict[str, float]) -> np.ndarray:
    """A row per node."""
    n = len(tree.parent)
    parent, depth = np.array(tree.parent), np.array(tree.depth, float)
    chars, links, stops, blocks, long = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    for node, text in tree.text.items():
        chars[node], links[node], blocks[node], long[node] = len(text), tree.link_chars[node], 1, len(text) > 80
        stops[node] = sum(map(text.count, ".,;!?"))
    tags = np.array(tree.tags_below, float)
    children, position = np.zeros(n), np.zeros(n)
    for node in range(1, n):
        position[node] = children[parent[node]]
        children[parent[node]] += 1
    for node in range(n - 1, 0, -1):  # children stand after their parents
        at = tree.parent[node]
        chars[at] += chars[node]
        links[at] += links[node]
        stops[at] += stops[node]
        blocks[at] += blocks[node]
        long[at] += long[node]
        tags[at] += tags[node]
    own_low, own_high, worst, best = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    for node in range(n):
        values = [odds.get(token, 0.0) for token in tree.tokens[node]] + [odds.get(f"<{tree.tag[node]}>", 0.0)]
        own_low[node], own_high[node] = min(values), max(values)
        above = tree.parent[node]
        worst[node] = min(own_low[node], worst[above] if above >= 0 else 0.0)
        best[node] = max(own_high[node], best[above] if above >= 0 else 0.0)
    up = np.maximum(parent, 0)
    size = np.maximum(chars, 1)
    return np.column_stack([
        [TAGS.get(tag, 0) for tag in tree.tag], depth, np.log1p(chars), links / size, tags / size, stops / size, np.log1p(blocks), long / np.maximum(blocks, 1),
        own_low, own_high, worst, best, chars / np.maximum(chars[up], 1), (links[up] - links) / np.maximum(chars[up] - chars, 1), np.log1p(children[up]),
        position / np.maximum(children[up] - 1, 1), chars / max(chars[0], 1), [TAGS.get(tree.tag[p], 0) for p in up], own_low[up], own_high[up],
    ])


class Boosted:
    """Gradient boosting of depth-limited trees on the logistic loss, with feature values in quantile bins."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE):
        self.edges = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]
        self.depth = depth
        binned, score = self._binned(x), np.zeros(len(y))
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(binned, p - y, p * (1 - p), rate)
            self.trees.append(tree)
            score += self._apply(tree, binned)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(edges, column, "left") for edges, column in zip(self.edges, x.T)])

    def _grow(self, binned, gradient, curvature, rate):
        inner = 2**self.depth - 1
        feature, cut, value = np.zeros(inner, int), np.full(inner, BINS), np.zeros(2**self.depth)
        node = np.zeros(len(binned), int)
        for level in range(self.depth):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = np.flatnonzero(node == k)
                best = 1e-6
                if len(rows):
                    total, weight = gradient[rows].sum(), curvature[rows].sum()
                    for f in range(binned.shape[1]):
                        g = np.cumsum(np.bincount(binned[rows, f], gradient[rows], BINS))
                        h = np.cumsum(np.bincount(binned[rows, f], curvature[rows], BINS))
                        gain = g**2 / (h + 1) + (total - g) ** 2 / (weight - h + 1) - total**2 / (weight + 1)
                        gain[(h < 1) | (weight - h < 1)] = 0
                        at = int(gain.argmax())
                        if gain[at] > best:
                            best, feature[k], cut[k] = gain[at], f, at
            node = 2 * node + 1 + (binned[np.arange(len(binned)), feature[node]] > cut[node])
        for leaf in range(2**self.depth):
            rows = node == leaf + inner
            value[leaf] = -rate * gradient[rows].sum() / (curvature[rows].sum() + 1)
        return feature, cut, value

    def _apply(self, tree, binned):
        feature, cut, value = tree
        node, rows = np.zeros(len(binned), int), np.arange(len(binned))
        for _ in range(self.depth):
            node = 2 * node + 1 + (binned[rows, feature[node]] > cut[node])
        return value[node - len(feature)]

    def score(self, x: np.ndarray) -> np.ndarray:
        binned = self._binned(x)
        return sum((self._apply(tree, binned) for tree in self.trees), np.zeros(len(x)))


def decode(parent: list[int], score: np.ndarray) -> np.ndarray:
    """The most likely consistent labelling: true for nodes with main text, whose ancestors all have it, too."""
    yes, no = -np.logaddexp(0, -score), -np.logaddexp(0, score)
    with_, without = yes.copy(), no.copy()
    for node in range(len(parent) - 1, 0, -1):
        with_[parent[node]] += max(with_[node], without[node])
        without[parent[node]] += without[node]
    holds = np.zeros(len(parent), bool)
    holds[0] = True
    for node in range(1, len(parent)):
        holds[node] = holds[parent[node]] and with_[node] > without[node]
    return holds


#: Words of usual layouts: class and id names of main text and of what is not.
MAIN_NAMES = ("content article article-body post post-content entry entry-content story story-body main main-content text page-content blog-post post-body "
              "articleBody news-text single hentry").split()
OTHER_NAMES = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topnav main-menu tabs toc pagination pager links".split(),
    "header": "header site-header masthead logo branding top topbar page-header hero tagline".split(),
    "footer": "footer site-footer copyright legal bottom credits colophon imprint".split(),
    "aside": "sidebar side widget related recommended popular tags social share sharing teaser trending more-news author-box read-more".split(),
    "ad": "ad ads advert advertisement banner sponsor sponsored promo promotion adsense ad-slot commercial".split(),
    "notice": "cookie cookies consent notice alert popup modal overlay newsletter subscribe paywall gdpr disclaimer message".split(),
    "comments": "comments comment comment-list respond replies discussion reply reader-comments disqus feedback user-comments".split(),
    "form": "form search login signup register contact-form searchbox".split(),
}
SEMANTIC = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "ad": "aside", "comments": "section", "notice": "div"}
WRAPPERS = "wrapper container page layout row col inner outer grid site app body-inner".split()


def sample_pages(count: int = PAGES, seed: int = 7) -> list[str]:
    """Pages in varied layouts; what is main text stands in elements with ``LABEL`` 1, the rest in such with 0."""
    rng = random.Random(seed)

    def words(least: int, most: int) -> str:
        run = ["".join(rng.choices("etaoinshrdlucm", k=rng.randint(1, 9))) for _ in range(rng.randint(least, most))]
        return " ".join(w + (rng.choice(".,.;!?") if rng.random() < 0.12 else "") for w in run).capitalize() + rng.choice([".", "", ".", "!"])

    def link(least: int = 1, most: int = 4) -> str:
        return f'<a href="/{rng.randint(1, 99)}">{words(least, most)}</a>'

    def named(names: list[str], chance: float) -> str:
        if rng.random() > chance:
            return ""
        return f' {rng.choice(["class", "class", "id"])}="{" ".join(rng.sample(names, min(len(names), rng.choice([1, 1, 2]))))}"'

    def other(kind: str) -> str:
        semantic = rng.random() < 0.6
        tag = SEMANTIC[kind] if semantic else rng.choice(["div", "div", "section", "ul" if kind == "nav" else "div"])
        name = named(OTHER_NAMES[kind], 0.45 if semantic and kind in ("nav", "header", "footer", "aside", "form") else 1.0)
        if kind == "nav":
            items = [link() for _ in range(rng.randint(2, 12))]
            inner = "".join(f"<li>{i}</li>" for i in items) if rng.random() < 0.7 else " | ".join(items)
            inner = f"<ul>{inner}</ul>" if tag != "ul" and inner.startswith("<li") else inner
        elif kind == "header":
            inner = rng.choice([f"<h1>{words(1, 4)}</h1>", f"<p>{words(1, 6)}</p>", words(1, 4), f"<div>{link()}</div>"]) + rng.choice(["", f"<p>{words(2, 9)}</p>", other("nav")])
        elif kind == "footer":
            inner = rng.choice(["", "<p>"]) + "&copy; " + words(1, 12) + rng.choice(["", f"<p>{words(3, 40)}</p>", "".join(f"<div>{link()}</div>" for _ in range(3))])
        elif kind == "comments":
            one = lambda: f"<{rng.choice(['div', 'li', 'p'])}{named(['comment', 'comment-body', 'reply'], 0.5)}>{words(3, 70)}</div>"
            inner = rng.choice(["", f"<h3>{words(1, 3)}</h3>"]) + "".join(one() for _ in range(rng.randint(1, 6)))
        elif kind == "form":
            inner = f"<label>{words(1, 4)}</label><input type=text>" + rng.choice([f"<p>{words(2, 12)}</p>", "<button>Go</button>", "<select><option>a<option>b</select>"])
        elif kind == "aside":
            inner = rng.choice(["", f"<h3>{words(1, 4)}</h3>"]) + rng.choice(
                ["".join(f"<p>{link(3, 10)}</p>" for _ in range(rng.randint(1, 7))), f"<p>{words(4, 45)}</p>", f"<ul>{''.join(f'<li>{link(2, 8)}</li>' for _ in range(5))}</ul>"])
        else:
            inner = rng.choice([words(2, 40), f"<p>{words(2, 45)}</p>", f"<p>{words(1, 8)} {link()}</p>", f"<b>{words(2, 9)}</b>"])
        return f'<{tag}{name} {LABEL}="0">{inner}</{tag}>'

    def main_block() -> str:
        kind = rng.random()
        if kind < 0.62:
            return f"<p>{words(1, 110)}{rng.choice(['', '', ' ' + link() + ' ' + words(1, 20)])}</p>"
        if kind < 0.70:
            return f"<p><b>{words(1, 30)}<br>"
        if kind < 0.78:
            return f"<h{rng.choice('234')}>{words(1, 8)}</h2>"
        if kind < 0.84:
            return f"<ul>{''.join(f'<li>{words(2, 20)}</li>' for _ in range(rng.randint(2, 6)))}</ul>"
        if kind < 0.89:
            return f"<blockquote>{words(5, 50)}</blockquote>"
        if kind < 0.93:
            return f"<div>{words(5, 80)}</div>"
        if kind < 0.96:
            return f"<table><tr><td>{words(1, 4)}<td>{words(1, 4)}</tr><tr><td>{words(1, 4)}<td>{words(1, 3)}</table>"
        return f"<figure><img src=x><figcaption>{words(3, 20)}</figcaption></figure>"

    def main() -> str:
        blocks = [rng.choice([f"<h1>{words(2, 14)}</h1>", f"<h1>{words(2, 14)}</h1>", f"<header><h1>{words(2, 14)}</h1></header>", f"<h2>{words(2, 10)}</h2>", ""])]
        for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 13])):
            blocks.append(main_block())
            if rng.random() < 0.12:
                blocks.append(other(rng.choice(["ad", "aside", "ad", "form", "nav", "notice"])))
        tag = rng.choice(["article", "article", "main", "div", "div", "section"])
        name = named(MAIN_NAMES, 0.35 if tag in ("article", "main") else 0.85)
        text = f'<{tag}{name} {LABEL}="1">{"".join(blocks)}</{tag}>'
        return f"<main>{text}</main>" if tag == "article" and rng.random() < 0.2 else text

    def page() -> str:
        before = [other(k) for k in rng.sample(["header", "nav", "nav", "ad", "notice", "form", "aside"], rng.randint(0, 4))]
        after = [other(k) for k in rng.sample(["aside", "comments", "ad", "nav", "notice", "form", "comments"], rng.randint(0, 4))]
        body = "".join([*before, main(), *after]) + (other("footer") if rng.random() < 0.8 else "")
        for _ in range(rng.choice([0, 0, 1, 2])):
            body = f"<div{named(WRAPPERS, 0.6)}>{body}</div>"
        return f"<html><head><title>{words(1, 5)}</title></head><body {LABEL}=\"0\">{body}</body></html>"

    return [page() for _ in range(count)]


@cache
def trained(count: int = PAGES, seed: int = 7) -> tuple[dict[str, float], Boosted]:
    """Token odds and trees. Odds are those of a node with the token holding main text, shrunk to none; each half of the
    pages is described with the odds of the other half, so that the trees do not trust odds of tokens seen once."""
    trees = [parse(page) for page in sample_pages(count, seed)]
    holds = []
    for tree in trees:
        y = np.array([tree.label[node] == "1" and node in tree.text for node in range(len(tree.parent))])
        for node in range(len(y) - 1, 0, -1):
            y[tree.parent[node]] |= y[node]
        holds.append(y)

    def odds_of(chosen) -> dict[str, float]:
        seen: dict[str, list[int]] = {}
        for i in chosen:
            for node in range(1, len(holds[i])):
                for token in {*trees[i].tokens[node], f"<{trees[i].tag[node]}>"}:
                    seen.setdefault(token, [1, 1])[int(holds[i][node])] += 1
        return {token: float(np.log(yes / no)) for token, (no, yes) in seen.items()}

    halves = [range(0, count, 2), range(1, count, 2)]
    by_half = [odds_of(half) for half in halves]
    x = np.vstack([features(trees[i], by_half[1 - i % 2]) for i in range(count)])
    return odds_of(range(count)), Boosted(x, np.concatenate(holds).astype(float))


def extract(pages: list[str], model: tuple[dict[str, float], Boosted]) -> list[list[str]]:
    """The blocks of main text of each page, in page order."""
    odds, boosted = model
    trees = [parse(page) for page in pages]
    rows = [features(tree, odds) for tree in trees]
    scores = np.split(boosted.score(np.vstack(rows)), np.cumsum([len(r) for r in rows])[:-1]) if rows else []
    out = []
    for tree, score in zip(trees, scores):
        holds = decode(tree.parent, score)
        out.append([text for node, text in tree.text.items() if holds[node]])
    return out


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page id, url, blocks): the blocks of main text, white space within each made single spaces."""
    shared = pages.sparkSession.sparkContext.broadcast(trained())  # ROUNDS small trees and the tokens of the sample pages

    def run(batches):
        for batch in batches:
            texts = [blob.decode() for blob in blobs(batch, "_html")]
            blocks = [found for i in range(0, len(texts), 200) for found in extract(texts[i:i + 200], shared.value)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blocks, pa.list_(pa.string()))], [page_id, url, "blocks"])

    kinds = [pages.schema[name].dataType.simpleString() for name in (page_id, url)]
    return pages.select(page_id, url, F.col(html).alias("_html")).mapInArrow(run, f"`{page_id}` {kinds[0]}, `{url}` {kinds[1]}, blocks array<string>")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    text = F.array_join("blocks", "\n")
    return main_text(table(spark, sf_dir, "pages")).select("page_id", "url", text.alias("text"), F.char_length(text).cast("long").alias("n_chars"))


#: For pages as the given tables have them, whose main text is what stands in <article>: headings, and paragraphs with bold runs.
OP7_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's') AS x FROM pages),
b AS (SELECT page_id, url, [trim(regexp_replace(regexp_replace(replace(replace(replace(replace(
        y, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&#39;', ''''), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))
        FOR y IN string_split(regexp_replace(regexp_replace(regexp_replace(x, '\s+', ' ', 'g'), '</?b>|<br>', ' ', 'g'), '</?(p|h1)>', chr(10), 'g'), chr(10))] AS l FROM a)
SELECT page_id, url, array_to_string([y FOR y IN l IF y <> ''], chr(10)) AS text, length(array_to_string([y FOR y IN l IF y <> ''], chr(10))) AS n_chars FROM b
"""
