"""Operator 13: toxicity by non-negative positive-unlabelled learning.

A text's features are the words it holds (runs of letters and digits, in lower
case, LONGEST at most). Which words, is decided by counting over all texts
that may teach: CANDIDATES words that most confirmed toxic texts hold, and of
them the FEATURES whose share of the confirmed texts differs most from their
share of all texts (in standard errors). Spark counts per task before it
shuffles; what reaches the driver is bounded by CANDIDATES.

The classifier is linear and fitted in numpy from two sets of rows: confirmed
toxic texts (positive) and texts taken as they come (unlabelled, toxic ones
among them). With the class prior p the risk on negative texts is estimated by
what the unlabelled ones lose beyond the share of the positive ones,

    p E+[l(z)] + max(0, Eu[l(-z)] - p E+[l(-z)]),

with the logistic loss l. Where the second term falls below 0, which no real
risk does, the step goes back up along it, so the fit can't win by calling the
confirmed texts' like all positive. The prior is the toxic share of the labels
that may teach. Labels of 0 are used for nothing else.

Bounds, documented parameters of the fit alone: MAX_LABELS confirmed documents
(those with the smallest hash of their id, broadcast), MAX_ROWS rows of either
set (drawn by a hash of the row's place). Counts cover all texts, and every
whole text is scored, in one pass without a shuffle.

Defined results: documents whose id has crc32 modulo FOLDS = 0 teach nothing
(a null id's is 0). A null or empty text has no words and is scored as such.
An id with several labels is toxic if one says so; null ids and null marks
label nothing. Without a confirmed text every score is the prior (0 without
labels). Repeated rows get equal scores. Empty tables give an empty result.
Other columns are dropped.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, only

FOLDS = 5
#: Letters of a word at most: a longer run says nothing.
LONGEST = 64
CANDIDATES, FEATURES = 8192, 1024
#: Confirmed texts that hold a word, at least.
LEAST_TEXTS = 2
#: Standard errors that a word's shares must be apart.
APART = 6.0
#: Bounds of the fit.
MAX_LABELS, MAX_ROWS = 100_000, 50_000
STEPS, RATE, RIDGE = 400, 0.1, 3e-5


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is kept from training."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def words_in(text: str | None) -> set[str]:
    """The different words of a whole text."""
    return set(WORD.findall(text.lower())) if text else set()


@dataclass
class Model:
    """Weights of words, and what a text without any of them gets."""
    weights: dict[str, float]
    base: float

    def score(self, text: str | None) -> float:
        known = self.weights.keys() & words_in(text)
        z = self.base + sum(self.weights[w] for w in sorted(known))
        return float(1 / (1 + np.exp(-np.clip(z, -700, 700))))


def _counted(vocabulary: frozenset[str] | None):
    """A mapInArrow function: in how many texts of a task each word is (of the vocabulary, if one is given);
    under the empty word, how many texts there are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column("text"):
                own = words_in(text.as_py())
                found.update(own & vocabulary if vocabulary is not None else (w for w in own if len(w) <= LONGEST))
            found[""] += len(batch)
            if len(found) > 1_000_000:  # a task may meet any number of words
                yield _table(found)
                found = Counter()
        yield _table(found)
    return run


def _table(found: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "texts"])


def _texts_with(texts: DataFrame, vocabulary: frozenset[str] | None) -> DataFrame:
    """word, texts: in how many of the texts each word is."""
    return texts.mapInArrow(_counted(vocabulary), "word string, texts bigint").groupBy("word").agg(F.sum("texts").alias("texts"))


def choose(positive: dict[str, int], every: dict[str, int]) -> list[str]:
    """The words whose share of the confirmed texts is farthest from their share of all, in standard errors."""
    n, m = positive[""], every[""]
    found = []
    for word, hits in positive.items():
        if word:
            share = (every.get(word, 0) + 1) / (m + 2)
            apart = (hits / n - share) / (share * (1 - share) / n) ** 0.5
            if abs(apart) >= APART:
                found.append((-abs(apart), word))
    return [w for _, w in sorted(found)[:FEATURES]]


def _rows_of(features: dict[str, int]):
    """A mapInArrow function: the numbers of the features that a text has, as bytes."""
    known = features.keys()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            has = [np.array(sorted(features[w] for w in known & words_in(t.as_py())), "<i4").tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("positive"), batch.column("unlabelled"), pa.array(has, pa.binary())],
                                             ["positive", "unlabelled", "has"])
    return run


@dataclass
class Rows:
    """Distinct rows of features, as row and column numbers, and how often each is positive and unlabelled."""
    row: np.ndarray
    column: np.ndarray
    positive: np.ndarray
    unlabelled: np.ndarray


def fit(rows: Rows, width: int, prior: float) -> tuple[np.ndarray, float]:
    """Weights and base of the linear classifier with the least non-negative risk."""
    p, u = rows.positive / rows.positive.sum(), rows.unlabelled / rows.unlabelled.sum()
    # the base starts at the prior's log-odds; the last weight is the base
    weights = np.append(np.zeros(width), np.log(prior / (1 - prior)))
    mean, square = np.zeros(width + 1), np.zeros(width + 1)
    n = len(p)
    for step in range(1, STEPS + 1):
        z = weights[-1] + np.bincount(rows.row, weights[rows.column], n)
        s = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
        loss = np.logaddexp(0, z)  # of calling a row negative
        negative = u @ loss - prior * (p @ loss)
        down = u * s - prior * p * s
        slope = down - prior * p * (1 - s) if negative >= 0 else -down
        slope = np.append(np.bincount(rows.column, slope[rows.row], width), slope.sum()) + np.append(RIDGE * weights[:-1], 0)
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope ** 2
        weights = weights - RATE * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.999 ** step)) + 1e-8)
    return weights[:-1], float(weights[-1])


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """The classifier from docs(doc_id, text) and labels(doc_id, toxic) that are not held out."""
    marks = (only(labels, "doc_id", "toxic").filter("doc_id is not null and toxic is not null")
             .groupBy("doc_id").agg(F.max(F.expr("int(toxic = 1)")).alias("toxic")).filter(~held_out(F.col("doc_id"))))
    prior = marks.agg(F.avg("toxic")).first()[0] or 0.0
    teaching = only(docs, "doc_id", "text").withColumn("place", F.xxhash64(F.monotonically_increasing_id()))
    teaching = teaching.filter(~held_out(F.col("doc_id")))
    if not 0 < prior < 1:
        return Model({}, float(np.log((prior + 1e-12) / (1 - prior + 1e-12))))
    confirmed = (marks.filter("toxic = 1").select(F.col("doc_id").alias("marked"), F.xxhash64("doc_id").alias("h"))
                 .orderBy("h", "marked").limit(MAX_LABELS).select("marked"))  # so few ids may be broadcast
    positive = teaching.join(F.broadcast(confirmed), teaching["doc_id"] == confirmed["marked"], "left_semi")
    counted = _texts_with(positive.select("text"), None).filter(f"texts >= {LEAST_TEXTS} or word = ''")
    top = {r["word"]: r["texts"] for r in counted.orderBy(F.expr("word <> ''"), F.desc("texts"), "word").limit(CANDIDATES + 1).collect()}
    if not top.get(""):
        return Model({}, float(np.log(prior / (1 - prior))))
    every = {r["word"]: r["texts"] for r in _texts_with(teaching.select("text"), frozenset(top)).collect()}
    chosen = choose(top, every)
    features = {w: i for i, w in enumerate(chosen)}

    def drawn(total: int) -> Column:
        return F.pmod(F.col("place"), F.lit(1 << 30)) < int(min(1.0, MAX_ROWS / total) * (1 << 30))

    marked = teaching.join(F.broadcast(confirmed), teaching["doc_id"] == confirmed["marked"], "left").select(
        (F.col("marked").isNotNull() & drawn(top[""])).alias("positive"), drawn(every[""]).alias("unlabelled"), "text")
    rows = (marked.filter("positive or unlabelled")
            .mapInArrow(_rows_of(features), "positive boolean, unlabelled boolean, has binary")
            .groupBy("has").agg(F.sum(F.expr("int(positive)")).alias("p"), F.sum(F.expr("int(unlabelled)")).alias("u"))
            .orderBy("has").collect())  # at most 2 x MAX_ROWS, or so: drawn one by one
    has = [np.frombuffer(bytes(r["has"]), "<i4") for r in rows]
    found = Rows(np.repeat(np.arange(len(has)), list(map(len, has))), np.concatenate(has).astype(np.int64),
                 np.array([r["p"] for r in rows], float), np.array([r["u"] for r in rows], float))
    weights, base = fit(found, len(chosen), prior)
    return Model(dict(zip(chosen, weights.tolist(), strict=True)), base)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))
    given = only(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([sent.value.score(t.as_py()) for t in batch.column("text")], pa.float64())],
                ["doc_id", "score"])

    out = given.mapInArrow(run, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))
