"""Operator 6: near-duplicate classes by order MinHash.

A text is the sequence of its five-word shingles, each labelled with its
occurrence (the second time a shingle comes it is another one). A sketch takes
the KEPT smallest labelled shingles under one hash function and keeps them in
text order, so that texts share a sketch only if they have the same shingles
in the same order. BANDS sketches are each a key; texts that share a key are
candidates. A candidate pair is a link if a banded alignment of the two
shingle sequences matches as many in order as make matched / (all less
matched) reach SIMILARITY: five-word shingles, 0.8. Texts with the same words
are one node from the start. A class is a connected component of links.

A pair of long texts at similarity 0.8 shares no key with probability
(1 - 0.8**6)**40, about 5e-6. The fewer shingles, the likelier that is, as the
smallest are drawn without replacement (at 60 shingles 1.2e-5, at 10 of them
3e-3), and texts of fewer than KEPT have keys of their own length. So texts of
up to SHORT shingles don't depend on keys: step 3 finds all their pairs. Of
the texts of one key not all pairs are formed:

1. each text is aligned with the first of those it shares keys with: the text with the most
   exact copies, then the smallest;
2. then with the first text of every key, unless they are in one class by now: one pair
   of texts for two classes at a time, so that texts that got into one class
   meet no more, and what is left after ROUNDS at once;
3. the texts of keys that still hold several classes, and all short texts with
   those long enough to be like one, are joined exactly: two
   texts that reach the similarity share one of their rarest shingles (prefix
   and position filter), and match no more than the counts of their shingles in
   PARTS parts have in common, so only texts of different classes that pass both
   are aligned, in rounds as in step 2. No partner or candidate is capped.

Hot groups: equal texts are one row per node before keys are counted; minima
are partly taken before the shuffle; joins on a hot key are ones that Spark
splits; pairs are at most one per text and key, plus those of step 3. Word
sequences are only moved for texts of candidate pairs.

Defined results: a text that is null or has no word is a class by itself, and
so is a null doc_id (its class is null). A text of fewer than five words is
one shingle of all of them. Each row has the class of its text: rows that repeat
a doc_id with another text may be in another class. A class is named by its
smallest doc_id, which is the document to keep (all its rows in that class).
Empty tables give an empty result. Other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import CHAIN, SHINGLE, SIMILARITY, mixed, only, shingle_hashes, stage, word_hashes, words_of
from .components import components

KEPT, BANDS = 6, 40
#: Texts of up to so many shingles are also compared without keys, with all that could reach SIMILARITY.
SHORT = 60
#: Rounds in which two classes meet by one pair of texts.
ROUNDS = 2
#: Node numbers up to so many are broadcast (8 bytes each); more are joined.
BROADCAST_NODES = 1_000_000
#: Elements of a diagonal that an alignment compares at a time.
RUN = 32

_FACTORS = np.random.default_rng(6).integers(0, 2 ** 63, (BANDS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = mixed(np.arange(1, BANDS + 1, dtype=np.uint64) * CHAIN)


def labelled(shingles: np.ndarray) -> np.ndarray:
    """Each shingle with its occurrence: equal ones become different by their number in the text."""
    order = np.argsort(shingles, kind="stable")
    sorted_ = shingles[order]
    first = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
    if first.all():
        return shingles
    at = np.arange(len(shingles))
    occurrence = np.empty(len(shingles), np.uint64)
    occurrence[order] = at - np.maximum.accumulate(np.where(first, at, 0))
    return np.where(occurrence > 0, mixed(shingles + occurrence * CHAIN), shingles)


def sketches(words: np.ndarray) -> np.ndarray:
    """The BANDS keys of a text of hashed words: in each, the KEPT smallest labelled shingles in text order."""
    own = labelled(shingle_hashes(words))
    n, kept = len(own), min(KEPT, len(own))
    if not n:
        return np.empty(0, np.uint64)
    values = own * _FACTORS
    # most of the values can't be among the smallest; where too few are left, all are looked at
    low = values <= np.uint64(min(2 ** 64 - 1, 4 * KEPT * 2 ** 64 // n))
    if (low.sum(axis=1) < kept).any():
        low[:] = True
    band, at = np.nonzero(low)
    order = np.lexsort((values[band, at], band))
    start = np.searchsorted(band, np.arange(BANDS))
    smallest = order[np.arange(len(band)) - start[band] < kept]
    smallest.sort()  # (band, place in the text)
    chosen = own[at[smallest]].reshape(BANDS, kept)
    keys = _BAND.copy()
    for i in range(kept):
        keys = (keys + chosen[:, i]) * CHAIN
    return mixed(keys)


#: Texts whose sketches a task holds at a time.
PIECE = 500


def _sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sketches and words of texts, with the ``id`` where there is one beside doc_id."""
    hashes = word_hashes()
    for pdf in batches:
        for at in range(0, len(pdf), PIECE):
            rows = []
            for doc, text in pdf[["doc_id", "text"]].iloc[at:at + PIECE].itertuples(index=False):
                words = words_of(text)
                own = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
                whole = xxhash.xxh3_128_digest(" ".join(words))
                rows.append((doc, *np.frombuffer(whole, np.int64).tolist(), len(words),
                             sketches(own).view(np.int64), own.astype(np.uint32).tobytes()))
            out = pd.DataFrame(rows, columns=["doc_id", "h1", "h2", "n", "keys", "words"])
            yield out.assign(id=pdf["id"].iloc[at:at + PIECE].to_numpy()) if "id" in pdf else out


def indel_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Insertions and deletions that turn a into b, or ``most`` + 1 if they are more.

    Alignment in a band of ``most`` diagonals on either side: after d steps each
    diagonal is known by the furthest place reached on it.
    """
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    a = np.concatenate([a.astype(np.int64), np.full(RUN, -1)])  # words have 32 bits: neither end matches
    b = np.concatenate([b.astype(np.int64), np.full(RUN, -2)])
    reached = np.full(2 * most + 5, -1, np.int64)  # by diagonal, from -most - 2
    middle = most + 2
    reached[middle + 1] = 0
    run = np.arange(RUN)
    for d in range(most + 1):
        diagonals = np.arange(max(-d, -m), min(d, n) + 1)
        diagonals = diagonals[(diagonals - d) % 2 == 0]
        at = middle + diagonals
        x = np.maximum(reached[at + 1], reached[at - 1] + 1)
        x = np.minimum(np.minimum(x, n), m + diagonals)
        active = np.arange(len(x))
        while len(active):
            i = x[active][:, None] + run
            equal = a[np.minimum(i, n + RUN - 1)] == b[np.minimum(i - diagonals[active][:, None], m + RUN - 1)]
            same = equal.all(axis=1)
            x[active] += np.where(same, RUN, equal.argmin(axis=1))
            active = active[same]
        reached[at] = x
        if d >= abs(n - m) and (d - (n - m)) % 2 == 0 and reached[middle + n - m] >= n:
            return d
    return most + 1


def least_matched(n: int, m: int) -> int:
    """The fewest matched shingles of texts with n and m of them that reach SIMILARITY."""
    return int(np.ceil(SIMILARITY / (1 + SIMILARITY) * (n + m) - 1e-9))


def similar(a: bytes, b: bytes) -> bool:
    """Whether two texts, given by their hashed words, reach SIMILARITY."""
    x, y = (shingle_hashes(np.frombuffer(w, np.uint32).astype(np.uint64)) for w in (a, b))
    least = least_matched(len(x), len(y))
    if min(len(x), len(y)) < least:
        return False
    p, q = labelled(x), labelled(y)
    if len(np.intersect1d(p, q, assume_unique=True)) < least:  # the most that any order could match
        return False
    _, numbers = np.unique(np.concatenate([p, q]), return_inverse=True)
    most = len(x) + len(y) - 2 * least
    return indel_distance(numbers[:len(x)], numbers[len(x):], most) <= most


def _aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.loc[[similar(a, b) for a, b in zip(pdf["words_a"], pdf["words_b"], strict=True)], ["a", "b"]]


def _with_words(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, words) of the given nodes (doc_id) only."""
    nodes = stage(nodes.distinct())
    small = nodes.count() <= BROADCAST_NODES
    return texts.select("doc_id", "words").join(F.broadcast(nodes) if small else nodes, "doc_id", "left_semi")


def align(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The links among ``pairs``(a, b), a written table."""
    some = stage(_with_words(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), texts))
    a = some.select(F.col("doc_id").alias("a"), F.col("words").alias("words_a"))
    b = some.select(F.col("doc_id").alias("b"), F.col("words").alias("words_b"))
    # which side has the hot node doesn't matter: both joins can be split
    return stage(pairs.join(a, "a").join(b, "b").select("a", "b", "words_a", "words_b")
                 .mapInPandas(_aligned, "a long, b long"))


def _joined(classes: DataFrame, links: DataFrame) -> DataFrame:
    """classes(node, class) after links(a, b) among nodes. Only the different pairs of
    classes that are linked go into the search for components, and each class once."""
    a, b = (classes.select(F.col("node").alias(x), F.col("class").alias(f"class_{x}")) for x in "ab")
    pairs = stage(links.join(a, "a").join(b, "b").select(F.least("class_a", "class_b").alias("a"), F.greatest("class_a", "class_b").alias("b"))
                  .filter("a <> b").distinct())
    found = components(pairs).withColumnRenamed("node", "class")
    return stage(classes.join(found, "class", "left").select("node", F.coalesce("component", "class").alias("class")))


def _met(classes: DataFrame, pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """classes(node, class) after all links among pairs(a, b) that matter: in a round two classes
    meet by one pair of texts; pairs whose texts are in one class by then drop out."""
    side = lambda x: classes.select(F.col("node").alias(x), F.col("class").alias(f"class_{x}"))
    left = stage(pairs)
    for last in [False] * ROUNDS + [True]:
        left = stage(left.join(side("a"), "a").join(side("b"), "b").filter("class_a <> class_b"))
        if left.isEmpty():
            break
        one = left.groupBy(F.least("class_a", "class_b"), F.greatest("class_a", "class_b")).agg(F.min(F.struct("a", "b")).alias("p"))
        some = stage((left if last else one.select("p.a", "p.b")).select("a", "b"))
        classes = _joined(classes, align(some, texts))
        left = left.select("a", "b").join(some, ["a", "b"], "left_anti")
    return classes


#: Shingles that a task gathers before it passes them on, beyond those of one text.
GATHERED = 50_000


def _all_shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def rows() -> pd.DataFrame:
        sizes = [len(x) for x in found]
        return pd.DataFrame({"node": np.repeat(np.array(nodes, np.int64), sizes), "n": np.repeat(np.array(sizes, np.int32), sizes),
                             "shingle": np.concatenate(found)})

    for pdf in batches:
        nodes, found, held = [], [], 0
        for node, words in zip(pdf["doc_id"], pdf["words"], strict=True):
            nodes.append(node)
            found.append(labelled(shingle_hashes(np.frombuffer(words, np.uint32).astype(np.uint64))).view(np.int64))
            held += len(found[-1])
            if held >= GATHERED:
                yield rows()
                nodes, found, held = [], [], 0
        if found:
            yield rows()


#: Parts that a text's shingles are counted in: two texts match no more in a part than either has there.
PARTS = 128


def _part_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How many shingles each text has in each part; repeats of a shingle are in one part."""
    for pdf in batches:
        for at in range(0, len(pdf), PIECE):
            some = pdf.iloc[at:at + PIECE]
            counts = [np.bincount((shingle_hashes(np.frombuffer(w, np.uint32).astype(np.uint64)) % np.uint64(PARTS)).astype(np.int64),
                                  minlength=PARTS).astype(np.int32) for w in some["words"]]
            yield pd.DataFrame({"node": some["doc_id"].to_numpy(), "counts": counts})


def _prefix(n: Column, least: Column) -> Column:
    return n - F.ceil(least - 1e-9) + 1


def rare_partners(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes(node, class) of different classes that could reach SIMILARITY
    by prefix and position filter and by the counts of their shingles' parts: all that do are among them."""
    rows = stage(_with_words(nodes.select(F.col("node").alias("doc_id")), texts)
                 .mapInPandas(_all_shingles, "node long, n int, shingle long"))
    counts = rows.groupBy("shingle").agg(F.count("*").alias("df"))
    by_rarity = Window.partitionBy("node").orderBy("df", "shingle")
    n, t = F.col("n"), SIMILARITY
    ranked = (rows.join(counts, "shingle").withColumn("at", F.row_number().over(by_rarity) - 1)
              .filter((F.col("df") > 1) & (F.col("at") < _prefix(n, t * n))).drop("df"))
    ranked = stage(ranked.join(nodes, "node"))

    def fits(n: Column, at: Column, m: Column, other: Column) -> Column:
        """Whether texts of n and m shingles, the first they share at these ranks, can still match enough."""
        return 1 + F.least(n - at - 1, m - other - 1) >= F.ceil(t / (1 + t) * (n + m) - 1e-9)

    # first by the sizes there are: a shingle too far back for every size that has it makes no pair
    sizes = ranked.groupBy("shingle", F.col("n").alias("m")).agg(F.min("at").alias("first"))
    ranked = stage(ranked.join(sizes, (ranked["shingle"] == sizes["shingle"]) & fits(n, F.col("at"), F.col("m"), F.col("first")),
                               "left_semi"))
    # then by classes, so that the texts of one class never meet each other; the smaller side comes first
    groups = ranked.groupBy("shingle", "class", "n").agg(F.min("at").alias("first"), F.count("*").alias("texts"))
    side = lambda df, s: df.select("shingle", *[F.col(c).alias(f"{c}_{s}") for c in df.columns if c != "shingle"])
    met = (side(groups, "a").join(side(groups, "b"), "shingle")
           .filter((F.col("class_a") != F.col("class_b")) & fits(F.col("n_a"), F.col("first_a"), F.col("n_b"), F.col("first_b")))
           .filter("texts_a < texts_b or (texts_a = texts_b and class_a < class_b)")
           .select("shingle", "class_a", "n_a", "class_b", "n_b", "first_b"))
    met = stage(met)
    some = stage(met.join(side(ranked, "a"), ["shingle", "class_a", "n_a"])
                 .filter(fits(F.col("n_a"), F.col("at_a"), F.col("n_b"), F.col("first_b"))))
    others = stage(side(ranked, "b").join(met.select("shingle", "class_b", "n_b").distinct(), ["shingle", "class_b", "n_b"], "left_semi"))
    # a frequent line makes many texts alike in a shingle or two: what they have in common at most is known before they meet
    counts = stage(_with_words(some.select(F.col("node_a").alias("doc_id")).union(others.select("node_b")), texts)
                   .mapInPandas(_part_counts, "node long, counts array<int>"))
    counted = lambda df, s: df.join(counts.select(F.col("node").alias(f"node_{s}"), F.col("counts").alias(f"counts_{s}")), f"node_{s}")
    common = F.aggregate(F.zip_with("counts_a", "counts_b", lambda x, y: F.least(x, y)), F.lit(0), lambda total, x: total + x)
    return (counted(some, "a").join(counted(others, "b"), ["shingle", "class_b", "n_b"])
            .filter(fits(F.col("n_a"), F.col("at_a"), F.col("n_b"), F.col("at_b")))
            .filter(common >= F.ceil(t / (1 + t) * (F.col("n_a") + F.col("n_b")) - 1e-9))
            .select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct())


def _classed(rows: DataFrame) -> DataFrame:
    """doc_id, id, n, first of every row of rows(doc_id, id, text), where doc_id numbers the rows: ``first``
    is the smallest id of the row's class, null where the row is a class by itself."""
    texts = stage(rows.select("doc_id", "id", "text").mapInPandas(
        _sketched, "doc_id long, h1 long, h2 long, n long, keys array<long>, words binary, id long"))
    worded = texts.filter("n > 0 and id is not null")
    same = stage(worded.groupBy("h1", "h2").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"),
                                                F.max("n").alias("n"), F.min("id").alias("first")))
    keyed = (worded.select("h1", "h2", "doc_id", "keys")
             .join(same.drop("n", "first").withColumnRenamed("node", "doc_id"), ["h1", "h2", "doc_id"])
             .select(F.col("doc_id").alias("node"), "copies", F.explode("keys").alias("key")))
    several = (keyed.groupBy("key").agg(F.min("node").alias("_low"), F.max("node").alias("_high"))
               .filter("_low < _high").select("key"))
    shared = stage(keyed.join(several, "key", "left_semi"))
    # what many texts were copied from is likely there as it was, most often: it goes first
    centers = (shared.groupBy("key").agg(F.min(F.struct((-F.col("copies")).alias("rank"), F.col("node").alias("center"))).alias("c")))
    shared = stage(shared.drop("copies").join(centers, "key").select("key", "node", "c.center", "c.rank"))
    # whatever can reach SIMILARITY with a short text has at most SHORT / SIMILARITY shingles
    short = same.filter(F.col("n") - (SHINGLE - 1) <= SHORT / SIMILARITY).select("node")
    classes = stage(shared.select("node").union(short).distinct().withColumn("class", F.col("node")))

    first = (shared.filter("node <> center").groupBy("node").agg(F.min(F.struct("rank", "center")).alias("c"))
             .select("node", "c.center"))
    classes = _joined(classes, align(stage(first.select(F.col("center").alias("a"), F.col("node").alias("b"))), texts))

    rest = (shared.filter("node <> center").select("node", "center").distinct()
            .join(first.withColumn("_done", F.lit(1)), ["node", "center"], "left_anti"))
    classes = _met(classes, rest.select(F.col("center").alias("a"), F.col("node").alias("b")), texts)

    open_keys = (shared.join(classes, "node").groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high"))
                 .filter("low < high").select("key"))
    open_nodes = stage(shared.join(open_keys, "key", "left_semi").select("node").union(short).distinct().join(classes, "node"))
    classes = _met(classes, rare_partners(open_nodes, texts), texts)

    of_text = same.join(classes, "node", "left").select("h1", "h2", "first", F.coalesce("class", "node").alias("class"))
    named = of_text.groupBy("class").agg(F.min("first").alias("first"))
    by_text = of_text.drop("first").join(named, "class").select("h1", "h2", "first")
    out = texts.select("doc_id", "id", "h1", "h2", "n").join(by_text, ["h1", "h2"], "left")
    return out.select("doc_id", "id", "n", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("first")).alias("first"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id and n_words of every document."""
    rows = only(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("doc_id"), F.col("doc_id").alias("id"), "text")
    return _classed(rows).select(F.col("id").alias("doc_id"), F.coalesce("first", "id").alias("class_id"), F.col("n").alias("n_words"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class: the one that names it (of rows that repeat its id in this class, all)."""
    # the rows are stored with their numbers, so that both readings mean the same ones
    number = "_row"
    while number in docs.columns:
        number += "_"
    rows = stage(docs.withColumn(number, F.monotonically_increasing_id()))
    classed = _classed(rows.select(F.col(number).alias("doc_id"), rows["doc_id"].alias("id"), rows["text"]))
    others = classed.filter("id <> first").select(F.col("doc_id").alias("_other"))
    return rows.join(others, rows[number] == others["_other"], "left_anti").drop(number)
