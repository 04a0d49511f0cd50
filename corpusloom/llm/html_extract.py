"""Main text of web pages by a tree-structured graphical model.

The block elements of a page are the nodes of a tree; each is article text or
not. A node's potential comes from its tag, its names, its text and its links;
an edge's potential from the labels of parent and child and the kind of child.
Sum-product messages, once upward and once downward, give each node's exact
marginal. The weights maximise the likelihood of labelled pages, whose gradient
uses the same messages.

Training is a fit on a bounded sample (``html_samples.PAGES`` pages), made on
the driver in a second or two; extraction is a map over the table, without a
shuffle. All pages of a block are one forest, worked on level by level.

Text of a page is what its article nodes own, in page order: white space inside
a block is one space, ends are trimmed, blocks are joined by one ``\\n``.
Headings of the article belong to it. ``<br>`` is white space inside its block.

Defined results: a null or empty page, and one without article text, has the
text ``''``; markup that is not closed or not opened is read as browsers do, an
unclosed comment to the end of the page; text outside any block element belongs
to the body, and a page without any block element is text as a whole. Formulas
and what stands in for pictures, sound or scripts are offered to the model as
text of their block, words on a button inside a paragraph too. Elements deeper
than 512 stand beside their parent. The time for a page grows with its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_samples import labelled_pages
from .html_tree import Page, parse_page

# Characters of pages that are parsed before their forest is worked on.
BLOCK_CHARS = 1 << 20

TAGS = "p div li ul ol h1 h2 h3 h4 section article main nav aside header footer form table td tr blockquote pre figure figcaption dl dd body html dialog".split()
# Words of class, id and role, by what they stand for.
NAMES = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs tabs tab topnav pagination pager toolbar sitemap skip",
    "top": "header masthead topbar branding logo banner hero",
    "foot": "footer foot copyright legal colophon contentinfo imprint",
    "side": "sidebar side aside rail widget widgets secondary related recommended recommendations complementary popular trending more stories tags tagcloud archive author",
    "advert": "ad ads advert adverts advertisement advertising adsense adbox adslot adsbygoogle sponsor sponsored promo promoted promotion dfp doubleclick",
    "talk": "comment comments commentlist disqus thread respond reply replies discussion reaction reactions feedback",
    "notice": "cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup paywall disclaimer privacy dialog",
    "share": "share sharing social follow follows facebook twitter",
    "form": "search form login signin register contact",
    "main": "content article articlebody main post entry story body text blog prose single",
}
_WORD = re.compile(r"[A-Z]?[a-z]+")
_KEYS = {word: key for key, words in NAMES.items() for word in words.split()}
GROUPS = list(NAMES)
OFF_TAGS = frozenset("nav aside header footer form dialog".split())
SENTENCE_ENDS = re.compile(r"[.!?…。！？]")
N_FEATURES = 1 + len(TAGS) + 1 + len(GROUPS) + 1 + 12
N_KINDS = 3  # of children: plain, named as article, named as something else


def _features(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """A row for each node, and the kind of its edge to the parent."""
    n = len(page.nodes)
    own, linked, ends = np.zeros(n), np.zeros(n), np.zeros(n)
    for node, text, in_links in page.runs:
        own[node] += len(text)
        linked[node] += in_links
        ends[node] += len(SENTENCE_ENDS.findall(text))
    below, below_linked, below_ends = own.copy(), linked.copy(), ends.copy()
    for i in range(n - 1, 0, -1):
        parent = page.nodes[i].parent
        below[parent] += below[i]
        below_linked[parent] += below_linked[i]
        below_ends[parent] += below_ends[i]
    out, kinds = np.zeros((n, N_FEATURES)), np.zeros(n, dtype=np.int64)
    out[:, 0] = 1
    base = 1 + len(TAGS) + 1
    for i, node in enumerate(page.nodes):
        out[i, 1 + (TAGS.index(node.tag) if node.tag in TAGS else len(TAGS))] = 1
        groups = {_KEYS[w] for w in map(str.lower, _WORD.findall(node.names)) if w in _KEYS}
        for g in groups:
            out[i, base + GROUPS.index(g)] = 1
        out[i, base + len(GROUPS)] = node.hidden
        if node.tag in OFF_TAGS or node.hidden or groups - {"main"}:
            kinds[i] = 2
        elif node.tag in ("article", "main") or "main" in groups:
            kinds[i] = 1
    # Whether an element above is named as something else or as the article, and whether any on the page is.
    above = np.zeros((n, 2), dtype=bool)
    for i, node in enumerate(page.nodes):
        if node.parent >= 0:
            above[i] = above[node.parent] | (kinds[node.parent] == [2, 1])
    at = base + len(GROUPS) + 1
    out[:, at] = own > 0
    out[:, at + 1] = np.log1p(own) / 5
    out[:, at + 2] = np.log1p(below) / 8
    out[:, at + 3] = linked / np.maximum(own, 1)
    out[:, at + 4] = below_linked / np.maximum(below, 1)
    out[:, at + 5] = np.minimum(1, 50 * ends / np.maximum(own, 1))
    out[:, at + 6] = np.minimum(1, 50 * below_ends / np.maximum(below, 1))
    out[:, at + 7] = below / max(1.0, below[0])
    out[:, at + 8] = below == 0
    out[:, at + 9 : at + 11] = above
    out[:, at + 11] = bool((kinds == 1).any()) & ~above[:, 1] & (kinds != 1)
    return out, kinds


@dataclass
class Forest:
    features: np.ndarray
    kinds: np.ndarray
    parents: np.ndarray
    levels: list[np.ndarray]  # nodes by depth, roots first
    starts: list[int]  # first node of each page


def forest_of(pages: list[Page]) -> Forest:
    features, kinds, parents, depths, starts = [], [], [], [], []
    first = 0
    for page in pages:
        f, k = _features(page)
        features.append(f)
        kinds.append(k)
        parents.append(np.array([n.parent + first if n.parent >= 0 else -1 for n in page.nodes]))
        depths.append(np.array([n.depth for n in page.nodes]))
        starts.append(first)
        first += len(page.nodes)
    depth = np.concatenate(depths)
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.cumsum(np.bincount(depth))[:-1])
    return Forest(np.concatenate(features), np.concatenate(kinds), np.concatenate(parents), levels, starts)


def sum_product(forest: Forest, node: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of nodes (n, 2) and of edges to the parent (n, 2, 2: parent's label, own label), from log potentials.

    Upward, each node tells its parent the weight of its subtree for either
    label of the parent; downward, each parent tells the weight of the rest.
    """
    n = len(node)
    gathered, told = node.copy(), np.zeros((n, 2))
    for level in reversed(forest.levels[1:]):
        told[level] = np.logaddexp(edge[level, :, 0] + gathered[level, None, 0], edge[level, :, 1] + gathered[level, None, 1])
        np.add.at(gathered, forest.parents[level], told[level])
    belief, joint = gathered.copy(), np.full((n, 2, 2), -np.inf)
    for level in forest.levels[1:]:
        rest = belief[forest.parents[level]] - told[level]
        joint[level] = rest[:, :, None] + edge[level] + gathered[level][:, None, :]
        belief[level] = gathered[level] + np.logaddexp(edge[level, 0, :] + rest[:, None, 0], edge[level, 1, :] + rest[:, None, 1])
    marginal = np.exp(belief - np.logaddexp(belief[:, 0], belief[:, 1])[:, None])
    highest = joint.reshape(n, 4).max(axis=1, initial=-1e300)
    pairs = np.exp(joint - highest[:, None, None])
    return marginal, pairs / np.maximum(pairs.sum(axis=(1, 2)), 1e-300)[:, None, None]


@dataclass
class Model:
    node: np.ndarray  # (N_FEATURES,): of label 1 against label 0
    edge: np.ndarray  # (N_KINDS, 2, 2)

    def marginals(self, forest: Forest) -> np.ndarray:
        """The probability of each node to be article text."""
        return self._run(forest)[0][:, 1]

    def _run(self, forest: Forest) -> tuple[np.ndarray, np.ndarray]:
        score = forest.features @ self.node
        return sum_product(forest, np.stack([-score / 2, score / 2], axis=1), self.edge[forest.kinds])


def labels_of(page: Page) -> np.ndarray:
    """A node is article text if it is marked so and nothing below it is marked otherwise and has text."""
    labels = np.zeros(len(page.nodes), dtype=np.int64)
    for i, node in enumerate(page.nodes):
        labels[i] = int(node.label) if node.label is not None else labels[node.parent] if node.parent >= 0 else 0
    return labels


def train(pages: list[str] | None = None, steps: int = 200, rate: float = 0.1, decay: float = 1e-3) -> Model:
    """Weights of the greatest likelihood of labelled pages (see ``html_samples``), by gradient steps."""
    parsed = [parse_page(p, "data-label") for p in (labelled_pages() if pages is None else pages)]
    forest = forest_of(parsed)
    labels = np.concatenate([labels_of(p) for p in parsed])
    inner = np.flatnonzero(forest.parents >= 0)
    seen = np.zeros((N_KINDS, 2, 2))
    np.add.at(seen, (forest.kinds[inner], labels[forest.parents[inner]], labels[inner]), 1)
    model = Model(np.zeros(N_FEATURES), np.zeros((N_KINDS, 2, 2)))
    moments = [np.zeros_like(model.node), np.zeros_like(model.edge), np.zeros_like(model.node), np.zeros_like(model.edge)]
    count = len(labels)
    for step in range(1, steps + 1):
        marginal, pairs = model._run(forest)
        expected = np.zeros((N_KINDS, 2, 2))
        np.add.at(expected, forest.kinds[inner], pairs[inner])
        slopes = [
            forest.features.T @ (labels - marginal[:, 1]) / count - decay * model.node,
            (seen - expected) / count - decay * model.edge,
        ]
        for k, weights in enumerate((model.node, model.edge)):
            moments[k] = 0.9 * moments[k] + 0.1 * slopes[k]
            moments[k + 2] = 0.99 * moments[k + 2] + 0.01 * slopes[k] ** 2
            weights += rate * (moments[k] / (1 - 0.9**step)) / (np.sqrt(moments[k + 2] / (1 - 0.99**step)) + 1e-8)
    return model


def text_of(page: Page, chosen: np.ndarray) -> str:
    return "\n".join(text for node, text, _ in page.runs if chosen[node])


def extract_all(pages: list[str | None], model: Model) -> list[str]:
    parsed = [parse_page(p) for p in pages]
    forest = forest_of(parsed)
    chosen = model.marginals(forest) > 0.5
    for page, start in zip(parsed, forest.starts):
        if len(page.nodes) == 1:  # no tree to tell parts of the page by
            chosen[start] = True
    return [text_of(p, chosen[s : s + len(p.nodes)]) for p, s in zip(parsed, forest.starts)]


def extract_text(pages: DataFrame, html_col: str = "html", out_col: str = "text", model: Model | None = None) -> DataFrame:
    """The rows of ``pages`` with ``out_col`` in place of, or after, their columns."""
    model = model or train()
    kept = [c for c in pages.columns if c != out_col]
    packed = pages.select(F.struct(*kept).alias("row"), F.col(html_col).alias("html"))

    @F.arrow_udf("string")
    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch), 0).to_numpy(zero_copy_only=False)
            group = np.cumsum(sizes) // BLOCK_CHARS
            texts: list[str] = []
            for part in np.split(np.arange(len(batch)), np.flatnonzero(np.diff(group)) + 1):
                if len(part):
                    texts += extract_all(batch.slice(part[0], len(part)).to_pylist(), model)
            yield pa.array(texts, pa.string())

    out = packed.select("row", extract("html").alias("text"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in kept], F.col("text").alias(out_col))
