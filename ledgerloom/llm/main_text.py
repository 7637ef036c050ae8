"""Main text of web pages: a tree-structured graphical model over the DOM.

Nodes are a page's block elements and their blocks of text; each is content or not. A node has a potential by what it
is (element, names, links, lengths); each parent and child share one by the kinds of the two. Sum-product messages go
up the tree and down again, which gives the exact marginal of every node; blocks of text that are likelier content
than not make the text. Weights maximise the likelihood of labelled pages, whose gradient needs the same marginals.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import extended
from .dom import HEADINGS, Node, parse
from .labelled_pages import write_pages


@dataclass(frozen=True)
class MainTextParams:
    pages: int = 700  # labelled pages to train on
    rounds: int = 100
    rate: float = 0.2
    ridge: float = 1e-4
    threshold: float = 0.5
    seed: int = 13
    batch: int = 64  # pages whose trees are settled together


# Elements and name parts that count as one.
ELEMENTS = [
    {"p"}, {"li"}, HEADINGS, {"td", "th", "tr", "table", "tbody", "thead", "tfoot", "caption"}, {"blockquote", "pre", "figure", "figcaption"}, {"dl", "dt", "dd"},
    {"article"}, {"main"}, {"section"}, {"div", "center"}, {"nav", "menu", "dir"}, {"header", "hgroup"}, {"footer"}, {"aside"}, {"form", "fieldset", "legend"},
    {"ul", "ol"}, {"body", "html", "#root"}, {"dialog", "details", "summary"}, {"address"},
]
NAME_PARTS = [
    "nav navbar navigation menu breadcrumb breadcrumbs tabs pagination pager toc".split(),
    "header masthead topbar branding banner logo head".split(),
    "footer bottom copyright colophon foot legal contentinfo".split(),
    "sidebar side aside widget related recommended recommendations trending popular stories rail teaser teasers complementary".split(),
    "ad ads adv advert adverts advertisement advertising adbox sponsored sponsor promo promotion commercial dfp adsbygoogle".split(),
    "cookie cookies notice alert consent gdpr popup modal overlay newsletter subscribe subscription paywall disclaimer".split(),
    "comment comments discussion reply replies response responses disqus respond".split(),
    "search login signin signup form feedback".split(),
    "share sharing social tags tag toolbar print".split(),
    "content article post story entry main text hentry body blog page".split(),
    "wrap wrapper container layout row inner outer".split(),
]
PART_OF = {word: i for i, words in enumerate(NAME_PARTS) for word in words}
ELEMENT_OF = {tag: i for i, tags in enumerate(ELEMENTS) for tag in tags}
WORD_BINS, SHARE_BINS, PLACE_BINS = (1, 2, 4, 8, 16, 40, 120), (0.0, 0.25, 0.6, 0.9), (0.05, 0.2, 0.8, 0.95)
NAME_SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
RIGHTS = re.compile(r"©|\(c\)|copyright|all rights reserved", re.I)
SENTENCE_END = re.compile(r"[.!?…。！？:;][\"'”’»)\]]*$")

AT_NAMES = len(ELEMENTS) + 1
AT_WORDS = AT_NAMES + len(NAME_PARTS)
AT_LINKS = AT_WORDS + 2 * (len(WORD_BINS) + 1)
AT_PLACE = AT_LINKS + 2 * (len(SHARE_BINS) + 1)
AT_REST = AT_PLACE + len(PLACE_BINS) + 1
WIDTH = AT_REST + 6
#: Kinds of the parent in a potential of two nodes: telling elements or names of content, of other parts, none.
KINDS = 3 * 2


def named_parts(node: Node) -> set[int]:
    names = " ".join(node.attributes[a] for a in ("class", "id", "role", "aria-label") if a in node.attributes)
    return {PART_OF[w] for x in NAME_SPLIT.split(names) if (w := x.lower()) in PART_OF} if names else set()


def active(nodes: list[Node]) -> tuple[list[list[int]], list[int]]:
    """Of each node the places of the features it has; of each the kind of its potential with the parent."""
    total, before, features, tells = max(1, nodes[0].words), 0, [], []
    for node in nodes:
        leaf = node.text is not None
        parts = set() if leaf else named_parts(node)
        element = len(ELEMENTS) if leaf else ELEMENT_OF.get(node.tag, len(ELEMENTS))
        has = [element, *(AT_NAMES + p for p in parts)]
        has.append(AT_WORDS + (len(WORD_BINS) + 1) * leaf + bisect_right(WORD_BINS, node.words if leaf else node.words / max(1, node.leaves)))
        has.append(AT_LINKS + (len(SHARE_BINS) + 1) * leaf + bisect_left(SHARE_BINS, node.linked / max(1, node.words)))
        has.append(AT_PLACE + bisect_right(PLACE_BINS, before / total))
        if leaf:
            before += node.words
            has += [AT_REST + 0] * bool(SENTENCE_END.search(node.text[-8:])) + [AT_REST + 1] * bool(RIGHTS.search(node.text[:200])) + [AT_REST + 2] * ("," in node.text)
        else:
            has += [AT_REST + 3] * (node.words * 2 > total) + [AT_REST + 4] * (node.leaves > 4) + [AT_REST + 5] * (node.leaves == 0)
        features.append(has)
        content = node.tag in ("article", "main") or bool(parts & {9})
        other = node.tag in ("nav", "header", "footer", "aside", "form", "dialog") or bool(parts & set(range(9)))
        tells.append(2 if other else 1 if content else 0)
    return features, [tells[node.parent] * 2 + (node.text is not None) if node.parent >= 0 else 0 for node in nodes]


class Forest:
    """The trees of several pages, by depth, with their features."""

    def __init__(self, pages: list[list[Node]]):
        self.starts = np.cumsum([0, *map(len, pages)])
        self.parent = np.concatenate([np.array([n.parent for n in p]) + s * (np.array([n.parent for n in p]) >= 0) for p, s in zip(pages, self.starts)])
        depth = np.array([n.depth for p in pages for n in p])
        found = [active(p) for p in pages]
        lists = [f for features, _ in found for f in features]
        self.row = np.repeat(np.arange(len(lists)), [len(f) for f in lists])
        self.column = np.array([c for f in lists for c in f], int)
        self.kind = np.array([k for _, kinds in found for k in kinds], int)
        order = np.argsort(depth, kind="stable")
        self.by_depth = [part for part in np.split(order, np.searchsorted(depth[order], np.arange(1, depth.max() + 1)))]

    def marginals(self, weights: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(P(state) by node, P(parent's state, state) by node), by messages to the parents and back to the children."""
        n = len(self.parent)
        own = np.zeros((n, 2))
        own[:, 1] = np.bincount(self.row, weights[self.column], n)
        below, to_parent = own.copy(), np.zeros((n, 2))
        for nodes in self.by_depth[:0:-1]:
            message = logsum(pairs[self.kind[nodes]] + below[nodes][:, None, :], 2)
            to_parent[nodes] = message - message.max(1, keepdims=True)
            for state in (0, 1):
                below[:, state] += np.bincount(self.parent[nodes], to_parent[nodes, state], n)
        above = np.zeros((n, 2))  # what the rest of the tree says of a node
        joint = np.zeros((n, 2, 2))
        for nodes in self.by_depth[1:]:
            up = self.parent[nodes]
            rest = above[up] + below[up] - to_parent[nodes]
            both = rest[:, :, None] + pairs[self.kind[nodes]]
            message = logsum(both, 1)
            above[nodes] = message - message.max(1, keepdims=True)
            joint[nodes] = normalised((both + below[nodes][:, None, :]).reshape(-1, 4)).reshape(-1, 2, 2)
        return normalised(above + below), joint


def logsum(x: np.ndarray, axis: int) -> np.ndarray:
    return np.logaddexp(x[:, 0], x[:, 1]) if axis == 1 else np.logaddexp(x[..., 0], x[..., 1])


def normalised(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def labels_of(nodes: list[Node]) -> np.ndarray:
    """1 for what data-main marks as main text, and for elements most of whose words are main text."""
    mark, main = [0] * len(nodes), [0] * len(nodes)
    for i, node in enumerate(nodes):
        mark[i] = int(node.attributes["data-main"]) if "data-main" in node.attributes else mark[node.parent] if i else 0
    for i in range(len(nodes) - 1, 0, -1):
        main[i] += mark[i] * nodes[i].words * (nodes[i].text is not None)
        main[nodes[i].parent] += main[i]
    return np.array([2 * main[i] > node.words if node.words else mark[i] for i, node in enumerate(nodes)], int)


@dataclass
class MainTextModel:
    weights: np.ndarray
    pairs: np.ndarray
    params: MainTextParams

    def content(self, pages: list[list[Node]]) -> list[np.ndarray]:
        """Of each page the probability of each node to be content."""
        forest = Forest(pages)
        p = forest.marginals(self.weights, self.pairs)[0][:, 1]
        return [p[a:b] for a, b in zip(forest.starts, forest.starts[1:])]

    def text(self, nodes: list[Node], content: np.ndarray) -> str:
        return "\n\n".join(n.text for n, p in zip(nodes, content.tolist()) if n.text is not None and p >= self.params.threshold)


def train(params: MainTextParams = MainTextParams(), labelled: list[str] | None = None) -> MainTextModel:
    """Weights of greatest likelihood on labelled pages, by gradient ascent with momentum and scaled steps; those of the grammar unless others are given."""
    trees = [parse(page) for page in (write_pages(params.pages, params.seed) if labelled is None else labelled)]
    forest, truth = Forest(trees), np.concatenate([labels_of(t) for t in trees])
    inner = forest.parent >= 0
    up = np.where(inner, forest.parent, 0)
    shape, size = (KINDS, 2, 2), KINDS * 4
    cell = forest.kind * 4 + truth[up] * 2 + truth
    seen = np.concatenate([np.bincount(forest.column, truth[forest.row], WIDTH), np.bincount(cell[inner], minlength=size)])
    x = np.zeros(WIDTH + size)
    mean, square = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, params.rounds + 1):
        single, joint = forest.marginals(x[:WIDTH], x[WIDTH:].reshape(shape))
        pairs = np.zeros((KINDS, 4))
        for i in range(4):
            pairs[:, i] = np.bincount(forest.kind[inner], joint[inner].reshape(-1, 4)[:, i], KINDS)
        expected = np.concatenate([np.bincount(forest.column, single[forest.row, 1], WIDTH), pairs.ravel()])
        slope = (seen - expected) / len(trees) - params.ridge * x
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        x = x + params.rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-6)
    return MainTextModel(x[:WIDTH], x[WIDTH:].reshape(shape), params)


@lru_cache(maxsize=4)
def standard_model(params: MainTextParams = MainTextParams()) -> MainTextModel:
    """The model of the grammar's pages, the same for the same parameters."""
    return train(params)


def extract(pages: DataFrame, model: MainTextModel, html: str = "html", text: str = "text", blocks: str = "blocks") -> DataFrame:
    """pages with the main text of each whole page, and how many blocks of text the page had.

    Blocks are joined in page order by an empty line; each is decoded and has single spaces. Null and empty pages, and
    those without a block that is likelier content than not, get an empty text. Text without markup is a page of one
    block. Rows are taken one by one: equal pages get equal texts, null and repeated ids change nothing, no rows give
    no rows. A very long page is parsed whole, in one task, as it is one value. Columns of pages with the new names are
    replaced.
    """
    kept = pages.drop(text, blocks)
    schema = extended(kept, f"`{text}` string, `{blocks}` long")
    names, at = [*kept.columns, text, blocks], kept.columns.index(html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, model.params.batch):
                part = batch.slice(low, model.params.batch)
                trees = [parse(x or "") for x in part.column(at).to_pylist()]
                texts = [model.text(t, p) for t, p in zip(trees, model.content(trees))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string()), pa.array([t[0].leaves for t in trees], pa.int64())], names=names)

    return kept.mapInArrow(run, schema)
