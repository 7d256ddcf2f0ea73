"""Operator 3: language identification by hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1; the vector of an n-gram
binds (multiplies) its letters' vectors, each permuted (rotated) by its place;
a text's vector bundles (adds) those of all its n-grams, and a language's
prototype those of all its training texts. A text gets the language whose
prototype has the largest cosine with it, both taken from the mean prototype
(what all languages share says nothing).

Training adds up one vector per task and language before anything is
shuffled; the model is languages x DIMENSIONS numbers, checked against
MAX_LANGUAGES before it goes to the tasks. Predicting is one pass over the
whole texts without a shuffle. Texts are taken in portions of PORTION
characters and n-grams in blocks, so memory depends neither on the batch nor
on how many different n-grams its texts have, but on the longest text.

Whether a text is in a learnt language at all is another question, since the
best of several centred cosines is never low. It is asked of the largest
cosine with a prototype that nothing was taken from (``Fits``): the text is in
none of them if that stays NOISE and more below SHARE of the lower quartile of
what that language's training texts reach with the prototype of the others.
Texts are compared with those of the same number of different n-grams (as a
power of two, repeats counting less): short and repetitive texts have low
cosines in any language, and very short ones can't be told from noise and stay.

Defined results: a null text, or one without a letter, is ``und`` with score
0; so is every text if nothing was learnt. Equal cosines: the smaller language
name. Repeated rows get equal predictions. Rows with null language, or null
or letterless text, teach nothing. Empty tables give an empty result. Other
columns are dropped.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only

N = 3
DIMENSIONS = 512
#: Different letter vectors; code points share them by remainder. 0 is the gap between words.
LETTERS = 4096
#: The most languages of a model: it is sent to every task.
MAX_LANGUAGES = 1000
#: Characters of texts that are counted at a time.
PORTION = 500_000
#: N-grams, and numbers of a table texts x n-grams, that are worked on at a time; an n-gram that one of so many texts has is in the table.
BLOCK, TABLE, MANY = 4096, 8_000_000, 200
UNKNOWN = "und"
#: A text is in no learnt language if its cosine is NOISE and more below SHARE of this quantile of the training texts'.
QUANTILE, SHARE = 0.25, 0.5
#: Two standard deviations of the cosine of unrelated vectors.
NOISE = 2 / DIMENSIONS ** 0.5


@functools.cache
def _letter_table() -> np.ndarray:
    """code point -> letter number; 0 for what is no letter."""
    points = np.arange(0x110000)
    is_letter = np.fromiter((chr(p).isalpha() for p in points), bool, len(points))
    return np.where(is_letter, points % (LETTERS - 1) + 1, 0).astype(np.int64)


@functools.cache
def _placed_letters() -> list[np.ndarray]:
    """For each place in an n-gram, the letters' vectors permuted for it."""
    signs = np.random.default_rng(20_240_607).integers(0, 2, (LETTERS, DIMENSIONS), dtype=np.int8) * 2 - 1
    return [np.roll(signs, N - 1 - i, axis=1) for i in range(N)]


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The different n-grams of a text, as numbers, and how often each occurs.

    Runs of other characters than letters count as one gap, also before the
    first letter and after the last.
    """
    letters = _letter_table()[np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)]
    letters = np.concatenate([[0], letters, [0]])
    letters = letters[(letters > 0) | np.concatenate([[True], letters[:-1] > 0])]
    if len(letters) < N:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    n = len(letters) - N + 1
    grams = np.zeros(n, np.int64)
    for i in range(N):
        grams = grams * LETTERS + letters[i:i + n]
    return np.unique(grams, return_counts=True)


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    """The bound vector of each n-gram number."""
    placed, out = _placed_letters(), 1
    for i in reversed(range(N)):
        out = out * placed[i][grams % LETTERS]
        grams = grams // LETTERS
    return out


def text_vectors(texts: list[str | None]) -> np.ndarray:
    """One row for each text: the sum of its n-grams' vectors (exact: whole numbers below 2**24)."""
    return _summed([gram_counts(t) for t in texts])


def _summed(counted: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Blocks of n-grams at a time: those that many of the texts have as a product of
    matrices, the others text by text, so nothing grows with texts times n-grams."""
    out = np.zeros((len(counted), DIMENSIONS), np.float32)
    if not any(len(g) for g, _ in counted):
        return out
    if len(counted) == 1:  # maybe a very long text: its n-grams are different ones already
        grams, counts = counted[0]
        for start in range(0, len(grams), BLOCK):
            out[0] += counts[start:start + BLOCK].astype(np.float32) @ gram_vectors(grams[start:start + BLOCK]).astype(np.float32)
        return out
    grams, at = np.unique(np.concatenate([g for g, _ in counted]), return_inverse=True)
    row = np.repeat(np.arange(len(counted)), [len(g) for g, _ in counted])
    counts = np.concatenate([c for _, c in counted]).astype(np.float32)
    many = np.bincount(at) * MANY >= len(counted)
    rare = np.flatnonzero(~many[at])
    for start in range(0, len(rare), BLOCK):
        some = rare[start:start + BLOCK]
        vectors = gram_vectors(grams[at[some]]).astype(np.float32) * counts[some, None]
        first = np.flatnonzero(np.diff(row[some], prepend=-1))
        out[row[some[first]]] += np.add.reduceat(vectors, first, axis=0)
    place = np.cumsum(many) - 1
    often = np.flatnonzero(many[at])
    often = often[np.argsort(place[at[often]], kind="stable")]
    column, grams = place[at[often]], grams[many]
    step = max(min(BLOCK, TABLE // len(counted)), 1)
    for start in range(0, len(grams), step):
        own = grams[start:start + step]
        some = slice(*np.searchsorted(column, [start, start + step]))
        table = np.zeros((len(counted), len(own)), np.float32)
        table[row[often[some]], column[some] - start] = counts[often[some]]
        out += table @ gram_vectors(own).astype(np.float32)
    return out


def portions(lengths: Iterator[int], most: int = PORTION) -> Iterator[slice]:
    """Slices of consecutive texts with about ``most`` characters together."""
    start = size = end = 0
    for end, n in enumerate(lengths, 1):
        size += n
        if size >= most:
            yield slice(start, end)
            start, size = end, 0
    if end > start:
        yield slice(start, end)


def _lengths(texts: pd.Series | list[str | None]) -> Iterator[int]:
    return (len(t) if t else 0 for t in texts)


def _bundled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sums of the vectors of each language in a task."""
    sums: dict[str, np.ndarray] = {}
    for pdf in batches:
        for part in portions(_lengths(pdf["text"])):
            vectors = text_vectors(list(pdf["text"][part])).astype(np.int64)
            langs = pdf["lang"][part].to_numpy()
            for lang in set(langs):
                sums[lang] = sums.get(lang, 0) + vectors[langs == lang].sum(axis=0)
    if sums:
        yield pd.DataFrame({"lang": list(sums), "sums": [v.tolist() for v in sums.values()]})


def language_sums(docs: DataFrame) -> dict[str, np.ndarray]:
    """The sum of the text vectors of each language of docs(text, lang) that has any, by name."""
    docs = only(docs, "text", "lang").filter("text is not null and lang is not null")
    parts = docs.mapInPandas(_bundled, "lang string, sums array<bigint>")
    rows = (parts.select("lang", F.posexplode("sums").alias("d", "s")).groupBy("lang", "d").agg(F.sum("s").alias("s"))
            .groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "s"))), lambda x: x["s"]).alias("sums"))
            .orderBy("lang").limit(MAX_LANGUAGES + 1).collect())
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: is lang a language?")
    found = {r["lang"]: np.array(r["sums"], float) for r in rows}
    return {k: v for k, v in found.items() if v.any()}


def learn(docs: DataFrame) -> dict[str, np.ndarray]:
    """The prototype of each language from docs(text, lang): a unit vector each, and
    under the empty name the mean that all vectors are taken from."""
    found = {k: v / np.linalg.norm(v) for k, v in language_sums(docs).items()}
    mean = np.mean(list(found.values()), axis=0) if len(found) > 1 else np.zeros(DIMENSIONS)
    return {"": mean} | {k: (v - mean) / np.linalg.norm(v - mean) for k, v in found.items()}


def judge_texts(texts: list[str | None], model: dict[str, np.ndarray]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    names = sorted(k for k in model if k)
    vectors = text_vectors(texts).astype(float)
    size = np.linalg.norm(vectors, axis=1)
    if not names:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    vectors = vectors / np.maximum(size, 1)[:, None] - model[""]
    cosines = vectors @ np.stack([model[k] for k in names]).T / np.maximum(np.linalg.norm(vectors, axis=1), 1e-12)[:, None]
    best = cosines.argmax(axis=1)
    lettered = np.array([any(map(str.isalpha, t or "")) for t in texts], bool)
    score = np.where(lettered, np.clip(cosines[np.arange(len(texts)), best], 0, 1), 0)
    return [names[b] if known else UNKNOWN for b, known in zip(best, lettered, strict=True)], score


def predict(docs: DataFrame, model: dict[str, np.ndarray], carry: tuple[str, ...]) -> DataFrame:
    """The ``carry`` columns of docs with lang_pred and score from its text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    given = only(docs, *carry, "text") if "text" not in carry else only(docs, *carry)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in only(docs, *carry).schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in portions(_lengths(pdf["text"])):
                one = pdf[part]
                langs, score = judge_texts(list(one["text"]), sent.value)
                yield one[list(carry)].assign(lang_pred=langs, score=score)

    return given.mapInPandas(run, f"{schema}, lang_pred string, score double")


def held_out(doc_id):
    """Whether a document is kept from training: crc32 of its id as text, modulo 3, is 1."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, learnt from those not held out."""
    model = learn(docs.filter(~held_out(docs["doc_id"])))
    out = predict(docs, model, ("doc_id",))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def size_class(counts: np.ndarray) -> int:
    """The power of two of a text's number of n-grams, as many as would be if all were as frequent; -1 if it has none."""
    return int(np.log2(counts.sum() ** 2 / (counts ** 2).sum())) if len(counts) else -1


def _sized(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    counted = [gram_counts(t) for t in texts]
    return np.array([size_class(c) for _, c in counted], int), _summed(counted).astype(float)


def own_cosines(vectors: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """The cosine of each training text with the sum of its language's others; 0 if there are none."""
    others = sums - vectors
    size = np.linalg.norm(vectors, axis=1) * np.linalg.norm(others, axis=1)
    return np.clip((vectors * others).sum(axis=1) / np.maximum(size, 1e-12), 0, 1)


@dataclass
class Fits:
    """What a text must reach to be in one of the languages."""
    prototypes: np.ndarray  # one row per language
    least: np.ndarray       # the least cosine by language and size class

    def known(self, texts: list[str | None]) -> np.ndarray:
        """Whether each text is in one of the languages."""
        sizes, vectors = _sized(texts)
        if not len(self.prototypes) or not len(texts):
            return np.zeros(len(texts), bool)
        cosines = vectors @ self.prototypes.T / np.maximum(np.linalg.norm(vectors, axis=1), 1)[:, None]
        best = cosines.argmax(axis=1)
        reached = cosines[np.arange(len(texts)), best]
        return (sizes >= 0) & (reached >= self.least[best, np.clip(sizes, 0, self.least.shape[1] - 1)])


def _least(quantiles: dict[int, float], classes: int) -> np.ndarray:
    """The least cosine of each size class. Larger texts reach more: no class asks for more than a
    larger one, and one without training texts takes the next smaller's (or what its size makes of the next larger's)."""
    own = {c: min(q for d, q in quantiles.items() if d >= c) for c in quantiles}
    first = min(own)
    wanted = [own[max(d for d in own if d <= c)] if c >= first else own[first] * 2 ** ((c - first) / 2) for c in range(classes)]
    # below 0 any text does: too few n-grams to tell
    return np.where(np.array(wanted) * SHARE > NOISE, np.array(wanted) * SHARE - NOISE, -1.0)


def learn_fits(docs: DataFrame) -> Fits:
    """Prototypes and least cosines from docs(text, lang)."""
    sums = language_sums(docs)
    if not sums:
        return Fits(np.zeros((0, DIMENSIONS)), np.zeros((0, 1)))
    sent = docs.sparkSession.sparkContext.broadcast(sums)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in portions(_lengths(pdf["text"])):
                one = pdf[part]
                sizes, vectors = _sized(list(one["text"]))
                some = sizes >= 0
                langs = one["lang"].to_numpy()[some]
                if len(langs):
                    reached = own_cosines(vectors[some], np.stack([sent.value[k] for k in langs]))
                    yield pd.DataFrame({"lang": langs, "size": sizes[some], "reached": np.round(reached * 1000).astype(int)})

    given = only(docs, "text", "lang").filter("text is not null and lang is not null")
    # thousandths are counted first: at most 1001 rows of a language and size
    counts = given.mapInPandas(run, "lang string, size int, reached int").groupBy("lang", "size", "reached").count()
    rows = counts.groupBy("lang", "size").agg((F.percentile("reached", QUANTILE, F.col("count")) / 1000).alias("q")).collect()
    found: dict[str, dict[int, float]] = {}
    for r in rows:
        found.setdefault(r["lang"], {})[r["size"]] = r["q"]
    names, classes = sorted(sums), 1 + max(r["size"] for r in rows)
    return Fits(np.stack([sums[k] / np.linalg.norm(sums[k]) for k in names]),
                np.stack([_least(found[k], classes) for k in names]))


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text is in no learnt language: without a letter, or too far from every
    prototype (see above). Each row is judged by itself."""
    fits = docs.sparkSession.sparkContext.broadcast(learn_fits(docs.filter(~held_out(docs["doc_id"]))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            known = [fits.value.known(texts[part]) for part in portions(_lengths(texts))]
            yield batch.filter(pa.array(np.concatenate([np.zeros(0, bool), *known])))

    return docs.mapInArrow(run, docs.schema)
