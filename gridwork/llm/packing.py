"""Operator 5: best-fit packing of tokenised documents by length patterns.

Documents become token ids, each closed by one end id; longer ones are cut
into pieces of SEQUENCE tokens. From the histogram of the pieces' lengths (at
most SEQUENCE numbers, whatever the corpus) patterns are enumerated: one, two,
three or four lengths that fill a sequence as well as the lengths at hand
allow. Non-negative least squares fits how often to repeat each, so that
together they use up the histogram; the counts are rounded down, and what is
left is packed longest first, each sequence completed by the best-fitting
lengths that are left. The plan says for each length which run of its pieces,
numbered through the corpus, fills which place of which run of sequences.

Tokenising is one pass whose pieces are written with their number among the
task's pieces of that length; a task's first number follows from the counts of
the tasks before it. So no length, however common, is gathered in one task,
and the driver sees only the histogram. The plan (bounded by the patterns
used, about SEQUENCE of them, and their places) is broadcast.

Words are tokenised once and remembered (about MEMORY of them in a worker, in two
generations: when the younger one is full it becomes the older one, whose words
are forgotten unless they come again): the
tokenizer drops white space and never joins what it separates, so that a text's ids are those
of its words in turn.

Defined results: a null text is empty; an empty document is the end id alone.
Repeated rows are packed each; equal lengths are interchangeable. Empty tables
give an empty result. Other columns are dropped.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import only, stage

SEQUENCE = 2048
END = (0).to_bytes(4, "little")
#: Words that a worker remembers the ids of.
MEMORY = 500_000
#: Characters of texts that are tokenised at a time.
PORTION = 2_000_000
#: Triples and quadruples take their two largest lengths from about so many of the lengths there are.
PICKED = 64
#: Steps of the least-squares fit.
STEPS = 200

#: A word that gets exactly one id, which marks the ends of others when many are tokenised at once.
MARK = "\u0001"


class Words(dict):
    """word -> the bytes of its ids, from a tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        super().__init__()
        self.older: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self._ids([MARK])[0]
        if len(self.mark) != 1:
            raise ValueError("the tokenizer has no single id for the mark")

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: set[str]) -> None:
        """Tokenise the words that aren't known yet."""
        if len(self) > MEMORY // 2:
            self.older = dict(self)
            self.clear()
        new = words - self.keys()
        known = new & self.older.keys()
        self.update((w, self.older[w]) for w in known)
        new -= known
        plain = [w for w in new if MARK not in w]
        for i in range(0, len(plain), 400):
            some = plain[i:i + 400]
            ids = np.array(self._ids([f" {MARK} ".join([*some, ""])])[0], np.uint32)
            ends = np.flatnonzero(ids == self.mark[0])
            data, start = ids.astype("<u4").tobytes(), 0
            for w, end in zip(some, ends.tolist(), strict=True):
                self[w] = data[4 * start:4 * end]
                start = end + 1
        marked = [w for w in new if MARK in w]
        for w, ids in zip(marked, self._ids(marked), strict=True):
            self[w] = np.array(ids, "<u4").tobytes()

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """The ids of whole texts as little-endian unsigned 32-bit numbers."""
        split = [(t or "").replace("\n", " ").split(" ") for t in texts]
        self.learn(set().union(*split))
        return [b"".join(map(self.__getitem__, ws)) for ws in split]


@functools.lru_cache(1)
def tokenizer_words(path: str) -> Words:
    return Words(path)


def _portions(texts: pd.Series) -> Iterator[slice]:
    start = size = end = 0
    for end, t in enumerate(texts, 1):
        size += len(t) if t else 0
        if size >= PORTION:
            yield slice(start, end)
            start, size = end, 0
    if end > start:
        yield slice(start, end)


def pieces(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, with its task and its
    number among the task's pieces of this length."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, task, seen = tokenizer_words(path), TaskContext.get().partitionId(), defaultdict(int)
        for pdf in batches:
            rows = []
            for part in _portions(pdf["text"]):
                for doc, ids in zip(pdf["doc_id"][part], words.ids(list(pdf["text"][part])), strict=True):
                    ids += END
                    for piece, at in enumerate(range(0, len(ids), 4 * SEQUENCE)):
                        own = ids[at:at + 4 * SEQUENCE]
                        n = len(own) // 4
                        rows.append((doc, piece, at // 4, n, zlib.crc32(own), task, seen[n]))
                        seen[n] += 1
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "task", "number"])

    return stage(only(docs, "doc_id", "text").mapInPandas(
        cut, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, number long"))


def enumerate_patterns(lengths: np.ndarray) -> np.ndarray:
    """Patterns as rows of four lengths in falling order, 0 for none, that fill a sequence
    as well as these lengths (sorted) can: the last of a pattern is the longest that still fits."""
    below = np.zeros(SEQUENCE + 1, np.int64)  # the longest length up to each number
    below[lengths] = lengths
    below = np.maximum.accumulate(below)
    picked = lengths[np.unique(np.linspace(0, len(lengths) - 1, PICKED).astype(int))] if len(lengths) else lengths
    none = np.zeros((len(lengths), 1), np.int64)
    single = np.hstack([lengths[:, None], none, none, none])
    rest = below[SEQUENCE - lengths]
    pair = np.hstack([lengths[:, None], rest[:, None], none, none])
    found = [single, pair]
    a, b = (x.ravel() for x in np.meshgrid(lengths, picked, indexing="ij"))
    fits = a + b < SEQUENCE
    a, b = a[fits], b[fits]
    c = below[SEQUENCE - a - b]
    found.append(np.stack([a, b, c, np.zeros_like(a)], axis=1))
    left = SEQUENCE - a - b
    c = below[left // 2]
    d = below[np.maximum(left - c, 0)]
    found.append(np.stack([a, b, c, d], axis=1)[c > 0])
    every = -np.sort(-np.concatenate(found), axis=1)
    return np.unique(every, axis=0)


def fit_counts(patterns: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - counts|**2, where A has how often a pattern has
    each length. Multiplicative steps keep x from going below zero; fuller patterns start higher."""
    used = patterns.T.astype(np.int64)
    weight = (used > 0).astype(float)
    fill = patterns.sum(axis=1) / SEQUENCE
    x = fill ** 64 * counts[used].sum(axis=0) / (1 + len(patterns))

    def times(v: np.ndarray) -> np.ndarray:  # A v
        return np.bincount(used.ravel(), (weight * v).ravel(), SEQUENCE + 1)

    def back(u: np.ndarray) -> np.ndarray:  # A' u
        return (u[used] * weight).sum(axis=0)

    wanted = back(counts.astype(float))
    for _ in range(STEPS):
        x *= wanted / np.maximum(back(times(x)), 1e-9)
    return x


def plan(histogram: dict[int, int]) -> tuple[np.ndarray, int]:
    """How the pieces go into sequences: rows (length, first number, first sequence, offset), sorted;
    pieces of a length from the first number on go to the offset in one sequence after the other.
    And the number of sequences."""
    left = np.zeros(SEQUENCE + 1, np.int64)
    for n, c in histogram.items():
        left[n] = c
    taken = np.zeros(SEQUENCE + 1, np.int64)
    rows: list[tuple[int, int, int, int]] = []
    sequences = 0

    def use(pattern: list[int], times: int) -> None:
        nonlocal sequences
        offset = 0
        for n in pattern:
            rows.append((n, int(taken[n]), sequences, offset))
            taken[n] += times
            left[n] -= times
            offset += n
        sequences += times

    if left[SEQUENCE]:
        use([SEQUENCE], int(left[SEQUENCE]))
    lengths = np.flatnonzero(left)
    if len(lengths):
        patterns = enumerate_patterns(lengths)
        x = fit_counts(patterns, left)
        full = patterns.sum(axis=1) == SEQUENCE  # what isn't full is better left to the best fit
        order = np.lexsort((-x, -patterns.sum(axis=1)))
        for p in order[(full & (x >= 1))[order]].tolist():
            own = [n for n in patterns[p].tolist() if n]
            times = min([int(x[p]), *(int(left[n]) // own.count(n) for n in own)])
            if times > 0:
                use(own, times)
        while (n := int(np.flatnonzero(left)[-1]) if left.any() else 0):
            own = complete(n, left)
            use(own, min(int(left[m]) // own.count(m) for m in own))
    return np.array(sorted(rows), np.int64).reshape(-1, 4), sequences


def complete(first: int, left: np.ndarray) -> list[int]:
    """A sequence with the length ``first`` and the lengths left that fill it best: one, or the two
    that fill it better, and so on until none fits."""
    left, own, room = left.copy(), [first], SEQUENCE - first
    left[first] -= 1
    while room:
        there = np.flatnonzero(left[:room + 1])
        if not len(there):
            break
        one = int(there[-1])
        if one < room:
            # the best second for each as first of two; the same length twice needs two of it
            below = np.zeros(room + 1, np.int64)
            below[there] = there
            below = np.maximum.accumulate(below)
            second = below[room - there]
            twice = (second == there) & (left[there] < 2)
            second[twice] = below[np.maximum(there[twice] - 1, 0)]
            best = int(np.argmax(there + second + there / (4 * SEQUENCE)))
            if second[best] and there[best] + second[best] > one:
                one = int(max(there[best], second[best]))
        own.append(one)
        left[one] -= 1
        room -= one
    return own


def pack(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    cut = pieces(docs, path)
    per_task = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = per_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    sent = docs.sparkSession.sparkContext.broadcast(plan(histogram)[0])
    numbered = cut.join(firsts, ["task", "length"]).withColumn("number", F.col("number") + F.col("first")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "number")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lengths, firsts, sequences, offsets = sent.value.T
        keys = lengths * 2 ** 48 + firsts
        for pdf in batches:
            number = pdf["number"].to_numpy()
            at = np.searchsorted(keys, pdf["length"].to_numpy() * 2 ** 48 + number, "right") - 1
            yield pdf.drop(columns="number").assign(sequence_id=sequences[at] + number - firsts[at], offset=offsets[at])

    return numbered.mapInPandas(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
