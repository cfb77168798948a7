"""HTML extraction by a tree-structured graphical model.

Every block element of a page's DOM is content or not. A log-linear model gives each element a
potential by its features (tag; words of its class, id and role, their beginnings and ends; length and density of
text, share of link text and of the page; place; words of boilerplate) and each parent-child edge one by the two labels and the
child's kind. Sum-product messages
go up and down the tree and give each element's exact marginal; blocks of elements whose marginal
reaches THRESHOLD are the text. Potentials are fitted by the likelihood of labelled pages (its
gradient is observed less expected counts, both from the same messages). The labelled pages are
made from a fixed seed, so every executor and every run has the same model.

Messages run over all trees of a batch at once, one depth at a time.

Defined results: a null or empty html gives an empty text; unclosed tags and stray ends are parsed
as a browser would, near enough; a page without block elements is its root's text; rows that repeat
are extracted one by one; an empty table gives no rows.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table
from .html_tree import BOILERPLATE, Tree, labelled_page, parse

THRESHOLD = 0.5
PAGES, SEED, ROUNDS, RATE, DECAY = 1200, 20, 150, 0.15, 3e-4
#: Kinds of child that an edge potential tells apart, each with and without a name of its own.
EDGE_GROUPS = ("", "p blockquote pre td", "li tr", "ul ol table", "div", "section article main", "aside nav footer form", "header", "h1 h2 h3 h4")
EDGE_KINDS = {t: i for i, tags in enumerate(EDGE_GROUPS) for t in tags.split()}
N_EDGES = 2 * len(EDGE_GROUPS)

#: Characters of a block that is looked at for words of boilerplate, and one in how many of its words must be such.
SHORT, SAYING = 400, 6
WORD = re.compile(r"[^\W\d_]{4,}")

PAGE = "page_id long, url string, text string, n_chars long"


class Vocabulary(dict):
    """Feature -> number; grows while training, then fixed."""

    def __init__(self):
        super().__init__()
        self.open = True

    def number(self, feature: tuple) -> int | None:
        if self.open:
            return self.setdefault(feature, len(self))
        return self.get(feature)


def scale(values: np.ndarray, steps: np.ndarray | list) -> list[int]:
    return np.searchsorted(steps, values, "right").tolist()


def features_of(tree: Tree) -> list[list[tuple]]:
    """Of each element: tag, names and their beginnings and ends, words that boilerplate says, and by its whole subtree length of text,
    share of link text, characters a block, share of the page's text, share of it that stands before, share of blocks that say boilerplate
    (its parent's too), likeness of the siblings."""
    n = len(tree.tags)
    parents = tree.parents
    chars, links = list(tree.chars), list(tree.link_chars)
    own_blocks, said = [0] * n, [set() for _ in range(n)]
    for element, text in tree.blocks:
        own_blocks[element] += 1
        if len(text) <= SHORT:
            words = WORD.findall(text.lower())
            known = {w for w in words if w in BOILERPLATE}
            said[element].update(known if SAYING * len(known) >= len(words) else ())
    own, saying = np.array(chars), [int(bool(x)) for x in said]
    before = np.cumsum(own) - own  # by document order of elements, near enough
    blocks = list(own_blocks)
    children: list[dict[str, int]] = [{} for _ in range(n)]
    for i in range(n - 1, 0, -1):
        p = parents[i]
        chars[p] += chars[i]
        links[p] += links[i]
        blocks[p] += blocks[i]
        saying[p] += saying[i]
        children[p][tree.tags[i]] = children[p].get(tree.tags[i], 0) + 1
    chars_, links_, blocks_ = np.array(chars), np.array(links), np.array(blocks)
    whole = max(1, chars[0])
    length = np.minimum(np.log2(chars_ + 1).astype(int), 14) // 2
    rows = zip(
        length.tolist(), (4 * links_ // np.maximum(chars_, 1)).tolist(), scale(chars_ / np.maximum(blocks_, 1), [1, 12, 30, 60, 120, 240]),
        scale(chars_ / whole, [0.02, 0.1, 0.3, 0.6, 0.9]), scale(before / whole, [0.02, 0.3, 0.6, 0.9, 0.99]),
        scale(np.array(saying) / np.maximum(blocks_, 1), [0.01, 0.2, 0.5, 0.9]), strict=True,
    )
    out, tells = [], []
    for i, (size, share, density, part, place, told) in enumerate(rows):
        tag, names = tree.tags[i], tree.names[i]
        found = [("tag", tag), ("length", size), ("links", share), ("density", density), ("part", part), ("place", place), ("part of", tag, part, density)]
        tells.append(told)
        found += [("told", told), ("told around", tells[parents[i]] if i else 0), ("told of", told, part)]
        found.append(("alike", min(children[parents[i]].get(tag, 0), 6) if i else 0))
        found += [("name", x) for x in names]
        found += {("begins", x[:k]) for x in names for k in (4, 6) if len(x) >= k} | {("ends", x[-6:]) for x in names if len(x) > 6}
        found += [("says", w) for w in said[i]] + ([("says",)] if said[i] else [])
        out.append(found)
    return out


class Forest:
    """Trees of a batch in one numbering, with the features of their elements."""

    def __init__(self, trees: list[Tree], vocabulary: Vocabulary):
        sizes = np.array([len(t.tags) for t in trees])
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        n = int(self.first[-1])
        self.parent, self.depth, self.kind = np.full(n, -1), np.zeros(n, int), np.zeros(n, int)
        element, feature = [], []
        for tree, at in zip(trees, self.first[:-1].tolist(), strict=True):
            here = slice(at, at + len(tree.tags))
            parents = np.array(tree.parents)
            self.parent[here] = np.where(parents >= 0, parents + at, -1)
            self.depth[here] = tree.depths
            self.kind[here] = [2 * EDGE_KINDS.get(t, 0) + bool(names) for t, names in zip(tree.tags, tree.names, strict=True)]
            for i, found in enumerate(features_of(tree)):
                for key in found:
                    if (number := vocabulary.number(key)) is not None:
                        element.append(at + i)
                        feature.append(number)
        self.element, self.feature = np.array(element, int), np.array(feature, int)
        order = np.argsort(self.depth, kind="stable")
        cuts = np.searchsorted(self.depth[order], np.arange(int(self.depth.max(initial=0)) + 2))
        self.levels = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def unary(self, weights: np.ndarray) -> np.ndarray:
        """Log potential of being content, of each element (that of not being is 0)."""
        return np.bincount(self.element, weights=weights[self.feature], minlength=len(self.parent))

    def beliefs(self, unary: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of elements (n, 2), and of edges by child (n, parent label, child label)."""
        n = len(self.parent)
        own = np.stack([np.zeros(n), unary], axis=1)
        up = np.zeros((n, 2))  # message of each element to its parent
        for level in self.levels[:0:-1]:
            joint = own[level][:, None, :] + edge[self.kind[level]]  # parent label, child label
            up[level] = np.logaddexp(joint[:, :, 0], joint[:, :, 1])
            for label in (0, 1):
                np.add.at(own[:, label], self.parent[level], up[level, label])
        down = np.zeros((n, 2))
        both = np.zeros((n, 2, 2))
        for level in self.levels[1:]:
            parent = self.parent[level]
            rest = own[parent] + down[parent] - up[level]
            joint = rest[:, :, None] + edge[self.kind[level]]
            down[level] = np.logaddexp(joint[:, 0, :], joint[:, 1, :])
            both[level] = joint + own[level][:, None, :]
        marginal = normalised(own + down)
        both = normalised(both.reshape(n, 4)).reshape(n, 2, 2)
        return marginal, both


def normalised(log: np.ndarray) -> np.ndarray:
    out = np.exp(log - log.max(axis=1, keepdims=True))
    return out / out.sum(axis=1, keepdims=True)


class Model:
    def __init__(self, vocabulary: Vocabulary, weights: np.ndarray, edge: np.ndarray):
        self.vocabulary, self.weights, self.edge = vocabulary, weights, edge

    def content(self, trees: list[Tree]) -> list[np.ndarray]:
        """The marginal of being content of every element of every tree."""
        forest = Forest(trees, self.vocabulary)
        marginal, _ = forest.beliefs(forest.unary(self.weights), self.edge)
        return [marginal[a:b, 1] for a, b in zip(forest.first[:-1], forest.first[1:], strict=True)]


def trained(pages: list[str], rounds: int = ROUNDS) -> Model:
    """Fit the potentials to pages whose elements carry data-mark labels, by Adam on the likelihood."""
    vocabulary = Vocabulary()
    trees = [parse(p) for p in pages]
    forest = Forest(trees, vocabulary)
    vocabulary.open = False
    label = np.array([int(m or 1) for t in trees for m in t.marks])
    child = np.flatnonzero(forest.parent >= 0)
    seen = np.zeros((N_EDGES, 2, 2))
    np.add.at(seen, (forest.kind[child], label[forest.parent[child]], label[child]), 1)
    n = len(vocabulary)
    x = np.zeros(n + N_EDGES * 4)
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, rounds + 1):
        weights, edge = x[:n], x[n:].reshape(N_EDGES, 2, 2)
        marginal, both = forest.beliefs(forest.unary(weights), edge)
        grad_w = np.bincount(forest.feature, weights=(label - marginal[:, 1])[forest.element], minlength=n)
        wanted = np.zeros_like(seen)
        np.add.at(wanted, forest.kind[child], both[child])
        grad = np.concatenate([grad_w, (seen - wanted).ravel()]) / len(pages) - DECAY * x
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        x = x + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(vocabulary, x[:n], x[n:].reshape(N_EDGES, 2, 2))


@lru_cache(maxsize=1)
def standard_model() -> Model:
    rng = random.Random(SEED)
    return trained([labelled_page(rng) for _ in range(PAGES)])


def extract(pages: list[str], model: Model) -> list[str]:
    """The main text of each page."""
    trees = [parse(p) for p in pages]
    out = []
    for tree, content in zip(trees, model.content(trees) if trees else [], strict=True):
        keep = (content >= THRESHOLD).tolist()
        out.append(" ".join(text for element, text in tree.blocks if keep[element]))
    return out


def extracted(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = extract([x or "" for x in part.column(2).to_pylist()], model)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )


def html_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages."""
    spark = pages.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model or standard_model())
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(lambda it: extracted(it, shared.value), PAGE)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text(table(spark, sf_dir, "pages"))
