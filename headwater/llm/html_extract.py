"""Operator 2, HTML extraction: flat text blocks classified by a decision tree.

``html_blocks`` cuts a page into a flat list of text blocks. A block is described by its word count and link density, by
those of the block before and the block after it, and by what encloses it: the tags and the class, id and role names
of its containers are plain features beside the others, and no rule outside the tree looks at them. The tree is
trained on the driver, on the labelled blocks of ``TRAINING_PAGES`` pages that ``html_labels`` writes in many layouts,
with telling, neutral and misleading class names; workers get its nodes.

Cases: null html counts as empty and gives an empty text; pages of any length are read whole, in time and memory in
proportion to their length whatever the markup; repeated rows are extracted one by one; null page_ids and urls stay
null; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import batch
from .html_blocks import HEADINGS, Block, Page, read
from .html_labels import labelled_pages

#: Labelled pages that the tree is trained on.
TRAINING_PAGES = 1500
#: Share of a page's words from which an article element says where the article is.
MAIN_SHARE = 0.1
#: Words of a block at most in which the phrases below mean anything.
CUE_WORDS = 60

# Phrases of the lines around articles: a mark of copyright, an invitation to log in, subscribe, share or reply.
_CUES = re.compile(
    r"©|\(c\)\s*\d{4}|copyright|all rights reserved|cookie|privacy|terms of (?:use|service)|\b(?:sign|log) ?(?:in|up|out)\b|subscribe|newsletter|advertis|sponsor"
    r"|\bshare (?:this|on)\b|follow us|read more|read next|related (?:articles|posts|stories)|most read|leave a (?:reply|comment)|\d+ (?:comments|replies|responses)\b|^comments\b|\breply\b|skip to|back to top|powered by",
    re.I,
)
_COMMENTS = re.compile(r"^(?:\d+ )?(?:comments|replies|responses|reader comments|join the discussion|leave a (?:reply|comment))\b", re.I)
_STOPS = (".", "!", "?", ":", "…", '"', "”", ")")

FEATURES = (
    "words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after",
    "heading", "item", "in_article", "nested_articles", "article_share", "frame_tag", "named_frame", "named_share", "named_inside", "named_body", "named_comment",
    "cue", "stops", "group_link_density", "after_comments", "longest_before", "longest_after",
)


def features(page: Page) -> np.ndarray:
    """A row for each block: itself, its neighbours, its containers."""
    found = page.blocks
    n = len(found)
    x = np.zeros((n, len(FEATURES)))
    if not n:
        return x
    words = np.array([b.words for b in found], float)
    density = np.array([b.link_density for b in found])
    own = words * (1 - density)  # words outside links
    total = max(1.0, own.sum())
    inside = page.words_inside(own)
    x[:, 0], x[:, 1] = words, density
    x[1:, 2], x[1:, 3] = words[:-1], density[:-1]
    x[:-1, 4], x[:-1, 5] = words[1:], density[1:]
    # article and main elements count where one holds a good part of the page and most of all of them: comments and
    # teasers are marked up as articles, too
    mains = page.holds_main()
    tops = [inside[k] for k in page.top_articles]
    bounded = bool(tops) and max(tops) >= MAIN_SHARE * total and 2 * max(tops) >= sum(tops)
    group_words, group_own = page.group_sums(words), page.group_sums(own)
    comments = False
    for i, b in enumerate(found):
        c = page.contexts[b.node]
        comments = comments or bool(b.words < 8 and _COMMENTS.match(b.text))
        x[i, 6:] = (
            b.tag in HEADINGS,
            b.tag in ("li", "dt", "dd", "td", "th"),
            (1 if c.articles else -1) if bounded else 0,
            c.articles,
            inside[c.article] / total if c.article >= 0 else 0,
            c.frame_tag,
            0 if c.named_frame < 0 else 1 if mains[c.named_frame] else 2,
            inside[c.named_frame] / total if c.named_frame >= 0 else 0,
            c.named_inside,
            c.named_body,
            c.named_comment,
            len(_CUES.findall(b.text)) / max(4, b.words) ** 0.5 if b.words <= CUE_WORDS else 0,
            b.text.endswith(_STOPS),
            1 - group_own[i] / max(1, group_words[i]),
            comments,
            0,
            0,
        )
    most = np.maximum.accumulate(own)
    x[1:, FEATURES.index("longest_before")] = most[:-1]
    x[:-1, FEATURES.index("longest_after")] = np.maximum.accumulate(own[::-1])[::-1][1:]
    return x


class Tree:
    """A binary decision tree grown by Gini impurity; ties go to the first feature and the least cut."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 14, least: int = 12):
        self.nodes: list[tuple[int, float, int, int]] = []  # feature or -1, cut or share, left, right
        self._grow(x, y.astype(float), depth, least)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, least: int) -> int:
        me, n = len(self.nodes), len(y)
        self.nodes.append((-1, float(y.mean()), 0, 0))
        if depth == 0 or y.min() == y.max() or n < 2 * least:
            return me
        best = (y.mean() * (1 - y.mean()) * n - 1e-9, -1, 0.0)
        for j in range(x.shape[1]):
            order = np.argsort(x[:, j], kind="stable")
            v, hits = x[order, j], np.cumsum(y[order])
            at = np.flatnonzero(v[1:] > v[:-1]) + 1  # sizes of the left side
            at = at[(at >= least) & (n - at >= least)]
            if not len(at):
                continue
            a, b = hits[at - 1], hits[-1] - hits[at - 1]
            g = a * (1 - a / at) + b * (1 - b / (n - at))
            k = int(np.argmin(g))
            if g[k] < best[0] - 1e-9:
                best = (float(g[k]), j, float((v[at[k]] + v[at[k] - 1]) / 2))
        _, j, c = best
        if j >= 0:
            left = x[:, j] <= c
            self.nodes[me] = (j, c, self._grow(x[left], y[left], depth - 1, least), self._grow(x[~left], y[~left], depth - 1, least))
        return me

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Share of article blocks in the leaf of each row."""
        at = np.zeros(len(x), int)
        nodes = self.nodes
        feature = np.array([n[0] for n in nodes])
        value = np.array([n[1] for n in nodes])
        left, right = (np.array([n[i] for n in nodes]) for i in (2, 3))
        while len(x) and (feature[at] >= 0).any():
            f = np.maximum(feature[at], 0)
            low = x[np.arange(len(x)), f] <= value[at]
            at = np.where(feature[at] < 0, at, np.where(low, left[at], right[at]))
        return value[at]

    def asked(self) -> set[str]:
        """Names of the features that the tree splits on."""
        return {FEATURES[j] for j, *_ in self.nodes if j >= 0}


def table(pages: Sequence[tuple[str, dict[str, int]]]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of labelled pages; a block's label is that of the mark word in its text."""
    xs, ys = [], []
    for html, labels in pages:
        page = read(html)
        marks = [re.search(r"\bq\d+z", b.text) for b in page.blocks]
        told = np.array([m is not None for m in marks], bool)
        xs.append(features(page)[told])
        ys.append(np.array([labels[m[0]] for m in marks if m], int))
    return np.concatenate(xs), np.concatenate(ys)


@lru_cache(maxsize=1)
def trained() -> Tree:
    return Tree(*table(labelled_pages(TRAINING_PAGES)))


def main_blocks(html: str | None, tree: Tree | None = None) -> list[Block]:
    page = read(html or "")
    if not page.blocks:
        return []
    keep = (tree or trained()).predict(features(page)) >= 0.5
    return [b for b, k in zip(page.blocks, keep) if k]


def main_text(html: str | None, tree: Tree | None = None) -> str:
    """The article's blocks, one a line."""
    return "\n".join(b.text for b in main_blocks(html, tree))


_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""
    tree = trained()

    def run(batches):
        for b in batches:
            # a page at a time: of the batch, only its Arrow buffers and the texts so far are held
            texts = [main_text(p.as_py(), tree) for p in b.column(2)]
            yield batch(_OUT, b.column(0), b.column(1), texts, [len(t) for t in texts])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
