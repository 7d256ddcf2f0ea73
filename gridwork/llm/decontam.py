"""Operator 8: benchmark decontamination by size-partitioned MinHash containment search.

A test item is contained in a document if LEAST of its different five-word
shingles stand there. Items are partitioned by size (powers of two of their
number of shingles); an item's signature holds, for each of SIGNATURE hash
functions, the shingle with the smallest value. As a long document's own
minima say nothing of a short item inside it, the item's minima are looked up
among all shingles of the document: each is there with a probability equal to
the containment. A document probes only partitions whose smallest items could
reach LEAST within its own number of shingles, and an item becomes a candidate
with PROBES of its minima, which an item with LEAST containment misses with a
probability below 1e-8 (items of few shingles: their minima are all they have,
and one is enough). Candidates are verified on the words themselves.

The items are a stated query set. They go to the tasks in blocks of at most
BLOCK_ITEMS items and about BLOCK_CHARS characters, each block against all
documents, so what is broadcast is bounded however many items there are. One
pass over the documents without a shuffle serves a block; a document is looked
at by itself, so hot passages cost one match each.

Defined results: null or wordless items and documents match nothing. An item
with fewer than five words is one shingle of all its words. Every row is
matched by itself: repeated documents and items give repeated matches. Empty
tables give an empty result. Other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SHINGLE, SIMILARITY, hashed_words, only, shingle_hashes, words_of

LEAST = SIMILARITY
#: Hash functions of a signature, and hits that make a candidate.
SIGNATURE, PROBES = 32, 12
#: Items and characters that are broadcast at a time.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 8_000_000

_FACTORS = np.random.default_rng(8).integers(0, 2 ** 63, SIGNATURE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(words: list[str], k: int) -> set[tuple[str, ...]]:
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)}


class ItemIndex:
    """The signatures of a block of items, by shingle length and size partition."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        self.words = [words_of(t) for _, t in items]
        self.sizes = np.zeros(len(items), np.int64)
        parts: dict[tuple[int, int], list[tuple[np.ndarray, int]]] = {}
        for i, (_, text) in enumerate(items):
            if not self.words[i]:
                continue
            k = min(SHINGLE, len(self.words[i]))
            h = np.unique(shingle_hashes(hashed_words(text), k))
            self.sizes[i] = len(h)
            minima = np.array([h[np.argmin(h * f)] for f in _FACTORS])
            parts.setdefault((k, int(len(h)).bit_length()), []).append((minima, i))
        self.parts = {}
        for (k, size), found in sorted(parts.items()):
            minima = np.concatenate([m for m, _ in found])
            item = np.repeat([i for _, i in found], SIGNATURE)
            order = np.argsort(minima, kind="stable")
            self.parts[k, size] = minima[order], item[order]

    def candidates(self, words: np.ndarray) -> list[int]:
        """The items that a document with these hashed words may contain."""
        out: list[int] = []
        own: dict[int, np.ndarray] = {}
        for (k, size), (minima, item) in self.parts.items():
            if len(words) < k:
                continue
            if k not in own:
                own[k] = shingle_hashes(words, k)
            if len(own[k]) < LEAST * 2 ** (size - 1):
                continue
            at = np.minimum(np.searchsorted(minima, own[k]), len(minima) - 1)
            met = np.unique(minima[at[minima[at] == own[k]]])
            if not len(met):
                continue
            ends = np.searchsorted(minima, met, "right")
            hits = np.concatenate([item[a:b] for a, b in zip(np.searchsorted(minima, met), ends, strict=True)])
            which, n = np.unique(hits, return_counts=True)
            out += which[n >= np.where(self.sizes[which] <= SIGNATURE, 1, PROBES)].tolist()
        return out

    def matches(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item, its shingles, those of them in the text) of every contained item."""
        found = self.candidates(hashed_words(text))
        if not found:
            return []
        words, own, out = words_of(text), {}, []
        for i in found:
            k = min(SHINGLE, len(self.words[i]))
            if k not in own:
                own[k] = shingles(words, k)
            wanted = shingles(self.words[i], k)
            shared = len(wanted & own[k])
            if shared >= LEAST * len(wanted):
                out.append((i, len(wanted), shared))
        return out


def blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items (item_id, text) in blocks of bounded size."""
    items = only(items, "item_id", "text").filter("text is not null")
    n, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    parts = max(-(-n // BLOCK_ITEMS), -(-chars // BLOCK_CHARS))
    for i in range(parts):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == i) if parts > 1 else items
        yield [tuple(r) for r in own.orderBy("item_id", "text").collect()]


def contained_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, n_shingles, n_shared, containment of every contained item."""
    docs = only(docs, "doc_id", "text").filter("text is not null")
    schema = "doc_id long, item_id long, n_shingles long, n_shared long, containment double"
    context = docs.sparkSession.sparkContext

    def probe(sent) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = sent.value
            for pdf in batches:
                rows = [(d, index.ids[i], n, m, m / n) for d, t in zip(pdf["doc_id"], pdf["text"], strict=True)
                        for i, n, m in index.matches(t)]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "n_shingles", "n_shared", "containment"])

        return docs.mapInPandas(run, schema)

    found = [probe(context.broadcast(ItemIndex(block))) for block in blocks(items)]
    return reduce(DataFrame.union, found) if found else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text contains an item. Each row is judged by its text
    alone: null and repeated ids make no difference, a null text stays."""
    def without(docs: DataFrame, sent) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = [not sent.value.matches(t.as_py()) for t in batch.column("text")]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return docs.mapInArrow(run, docs.schema)

    context = docs.sparkSession.sparkContext
    return reduce(without, (context.broadcast(ItemIndex(block)) for block in blocks(items)), docs)
