"""Operator 1: main text of pages by gradient-boosted trees over DOM blocks.

A page is read into its blocks (elements that aren't mere inline mark-up).
Each block is described by its tag and the words of its class, id and role
attributes, the same of the blocks above it, the density of its subtree (text,
links, words, sentence marks, mark-up), its depth and its siblings. Boosted
trees give every block the log-odds of being main text. Decoding is
hierarchical: of all choices in which a block is kept only if the block above
it is, the one with the largest sum of weighted log-odds is taken, found in
one pass up and one down the tree; so no child of a dropped part is kept, and
a part that looks wrong is kept only if what it holds outweighs that.

The trees are fitted on TRAINING_PAGES pages that are put together by rule
(``page_templates``): a bounded labelled sample, the same at every size of the
data. The model is a few thousand numbers and is broadcast; extraction is one pass over the whole pages without a shuffle, one page in
memory at a time beyond the batch.

Defined results: a null or empty page, and one without main text, has empty
text. Scripts, styles, comments and what a browser hides are never text. A
page that is not HTML is one block of text and kept. Repeated rows give equal
results. Empty tables give an empty result. Other columns are dropped.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import dom
from .boosting import Trees, fit
from .common import only
from .page_templates import Layout

#: Pages that the trees are fitted on, and the trees' number, depth and learning rate.
TRAINING_PAGES, ROUNDS, DEPTH, RATE = 900, 100, 5, 0.2
#: Characters of html whose blocks are judged at a time.
PORTION = 1_000_000
#: Bounds of one block's say in the decoding.
STRONGEST = 6.0


def _labels(page: dom.Page, main: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each block the share of its text that is main text, and its characters.

    The main pieces come in page order, so they are matched to the runs in turn."""
    n = len(page.tags)
    chars, good = np.zeros(n), np.zeros(n)
    wanted = iter(main)
    piece = next(wanted, None)
    for b, run, _, _ in page.runs:
        size = len(run.strip())
        chars[b] += size
        if piece is not None and run.strip() == piece.strip():
            good[b] += size
            piece = next(wanted, None)
    for b in range(n - 1, 0, -1):
        chars[page.parents[b]] += chars[b]
        good[page.parents[b]] += good[b]
    return good / np.maximum(chars, 1), chars


@functools.cache
def model() -> Trees:
    """The trees, fitted on pages by rule."""
    x, y, w = [], [], []
    for seed in range(TRAINING_PAGES):
        layout = Layout(seed)
        page = dom.read(layout.html)
        share, chars = _labels(page, layout.main)
        own = chars > 0
        x.append(dom.features(page)[own])
        y.append((share[own] > 0.5).astype(float))
        w.append(np.abs(2 * share[own] - 1).clip(0.1))
    return fit(np.concatenate(x), np.concatenate(y), np.concatenate(w), ROUNDS, DEPTH, RATE)


def decode(page: dom.Page, logits: np.ndarray) -> np.ndarray:
    """Which blocks to keep: the best choice that keeps a block only under a kept one."""
    n = len(page.tags)
    own = np.zeros(n)
    for b, run, _, _ in page.runs:
        own[b] += len(run.strip())
    value = np.clip(logits, -STRONGEST, STRONGEST) * (0.5 + np.log1p(own))
    value[0] = 0.0
    for b in range(n - 1, 0, -1):
        if value[b] > 0:
            value[page.parents[b]] += value[b]
    keep = value > 0
    keep[0] = True
    for b in range(1, n):
        keep[b] &= keep[page.parents[b]]
    return keep


def extract_pages(pages: list[str | None], trees: Trees) -> list[str]:
    """The main text of each page."""
    read = [dom.read(p) if p else None for p in pages]
    rows = [dom.features(p) for p in read if p]
    logits = trees.logits(np.concatenate(rows)) if rows else np.empty(0)
    out, at = [], 0
    for page in read:
        if page is None:
            out.append("")
            continue
        n = len(page.tags)
        own, at = logits[at:at + n], at + n
        out.append(dom.kept_text(page, decode(page, own)))
    return out


def _portions(pages: pd.Series) -> Iterator[slice]:
    start = size = end = 0
    for end, p in enumerate(pages, 1):
        size += len(p) if p else 0
        if size >= PORTION:
            yield slice(start, end)
            start, size = end, 0
    if end > start:
        yield slice(start, end)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    sent = pages.sparkSession.sparkContext.broadcast(model())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in _portions(pdf["html"]):
                one = pdf[part]
                text = extract_pages(list(one["html"]), sent.value)
                yield pd.DataFrame({"page_id": one["page_id"].to_numpy(), "url": one["url"].to_numpy(),
                                    "text": text, "n_chars": [len(t) for t in text]})

    return only(pages, "page_id", "url", "html").mapInPandas(run, "page_id long, url string, text string, n_chars long")
