"""Near-duplicate classes (6), top-k search (7) and the pipeline."""

from collections import Counter, defaultdict

import corpus_pipeline
import edge_cases
import numpy as np
import parity
import pytest
from pyspark.sql import functions as F

from gridwork.llm import decontam, langid, order_minhash, packing, topk
from gridwork.llm.common import shingle_hashes, stage, words_of
from gridwork.llm.components import components
from gridwork.llm.queries import TOKENIZER


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def _matched_share(a, b):
    x, y = ([tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))] for w in (a, b))
    m = _lcs(x, y)
    return m / (len(x) + len(y) - m)


def _classes(texts):
    """doc -> smallest doc of its class, by comparing all pairs that share a shingle."""
    words = {d: words_of(t) for d, t in texts.items()}
    where = defaultdict(set)
    for d, w in words.items():
        for i in range(max(1, len(w) - 4) if w else 0):
            where[tuple(w[i:i + 5])].add(d)
    pairs = {(a, b) for own in where.values() for a in own for b in own if a < b}
    name = {d: d for d in texts}

    def root(d):
        while name[d] != d:
            d = name[d]
        return d

    for a, b in sorted(pairs):
        if words[a] == words[b] or _matched_share(words[a], words[b]) >= 0.8:
            x, y = sorted((root(a), root(b)))
            name[y] = x
    return {d: root(d) for d in texts}


@pytest.fixture(scope="module")
def copies():
    """Texts with near copies at all similarities, moved halves, and a passage that many share."""
    rng = np.random.default_rng(9)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = rng.choice(vocabulary, 30).tolist()
    texts = {}
    for base in range(12):
        words = rng.choice(vocabulary, int(rng.integers(8, 90))).tolist()
        if base % 3 == 0:
            words = words[:20] + passage + words[20:]
        for copy in range(9):
            own = list(words)
            for _ in range(int(rng.integers(0, 5))):
                at = int(rng.integers(0, len(own)))
                own[at:at + int(rng.integers(0, 2))] = [f"new{rng.integers(0, 10 ** 6)}"]
            if copy == 8:
                own = own[len(own) // 2:] + own[:len(own) // 2]
            texts[len(texts)] = " ".join(own)
    texts[len(texts)] = "again and again " * 40
    texts[len(texts)] = "again and again " * 41
    return texts


def test_classes_with_a_passage_in_common_meet_only_if_alike(spark):
    """Many texts of two classes share a passage that is rarer than the rest of them: no pair of them is like one."""
    rng = np.random.default_rng(3)
    texts = {}
    for of in (0, 1000):
        base = [f"v{x}" for x in rng.integers(0, 10 ** 6, 100)]
        for i in range(40):
            texts[of + i] = " ".join([*base[:i], f"own{of + i}", *base[i + 1:]] + "one two three four five six".split() * (i < 15))
    texts[2000] = texts[7] + " end"
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    stored = stage(rows.withColumn("id", F.col("doc_id")).mapInPandas(
        order_minhash._sketched, "doc_id long, h1 long, h2 long, n long, keys array<long>, words binary, id long"))
    nodes = stage(rows.select(F.col("doc_id").alias("node"), (F.floor(F.col("doc_id") / 1000) * 1000).alias("class")))
    met = {(r["a"], r["b"]) for r in order_minhash.rare_partners(nodes, stored).collect()}
    words = {d: words_of(t) for d, t in texts.items()}
    alike = {(a, 2000) for a in range(40) if _matched_share(words[a], words[2000]) >= 0.8}
    assert (7, 2000) in alike and (7, 2000) in met
    assert not [p for p in met if p[1] in range(1000, 1040)]


def test_indel_distance():
    rng = np.random.default_rng(0)
    for _ in range(150):
        a = rng.integers(0, 6, rng.integers(1, 90))
        b = a.copy() if rng.random() < 0.5 else rng.integers(0, 6, rng.integers(1, 90))
        b = np.insert(np.delete(b, rng.integers(0, len(b), rng.integers(0, 4))), 0, rng.integers(0, 6, 2))
        d = len(a) + len(b) - 2 * _lcs(a.tolist(), b.tolist())
        for most in (d, d + 3, max(0, d - 1), 200):
            assert order_minhash.indel_distance(a, b, most) == min(d, most + 1)


def test_sketch_follows_order_and_occurrence():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 2 ** 63, 300).astype(np.uint64)
    own = set(order_minhash.sketches(words).tolist())
    assert own == set(order_minhash.sketches(words.copy()).tolist()) and len(own) == order_minhash.BANDS
    moved = order_minhash.sketches(np.concatenate([words[150:], words[:150]]))
    assert len(own & set(moved.tolist())) < 5  # same words, another order
    edited = words.copy()
    edited[[20, 140, 260]] = 7
    assert own & set(order_minhash.sketches(edited).tolist())
    twice = shingle_hashes(np.array([5] * 9, np.uint64))
    assert len(np.unique(order_minhash.labelled(twice))) == len(twice)


def test_classes_against_all_pairs(spark, copies):
    docs = spark.createDataFrame(list(copies.items()), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(docs).collect()}
    assert got == _classes(copies)


def test_short_texts_miss_no_partner(spark):
    rng = np.random.default_rng(4)
    texts = {}

    def add(words, partner):
        for w in (words, partner):
            texts[len(texts)] = " ".join(w)

    word = lambda: f"x{rng.integers(0, 10 ** 9)}"
    for more, fewer in ((5, 4), (6, 5), (7, 6)):  # shingles, at either end: 4/5, 5/6 and 6/7 matched
        for at in range(8):
            words = [word() for _ in range(more + 4)]
            add(words, words[1:] if at % 2 else words[:-1])
            assert _matched_share(words, words[1:]) == fewer / more
    for _ in range(300):  # 8/10: the keys of 1 in 300 or so say nothing
        words = [word() for _ in range(14)]
        add(words, words[2:])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(docs).collect()}
    assert got == {d: d - d % 2 for d in texts} == _classes(texts)


def test_rare_partners_are_all_there(spark, copies):
    some = {d: t for d, t in copies.items() if d < 60}
    docs = spark.createDataFrame(list(some.items()), "doc_id long, text string")
    texts = stage(docs.mapInPandas(order_minhash._sketched,
                                   "doc_id long, h1 long, h2 long, n long, keys array<long>, words binary"))
    nodes = docs.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("class"))
    got = {(r["a"], r["b"]) for r in order_minhash.rare_partners(nodes, texts).collect()}
    words = {d: words_of(t) for d, t in some.items()}
    assert {(a, b) for a in some for b in some if a < b and _matched_share(words[a], words[b]) >= 0.8} <= got
    assert len(got) < len(some) ** 2 / 6


def test_near_duplicate_edges(spark):
    docs = edge_cases.documents(spark)
    rows = order_minhash.near_duplicates(docs).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _, _ in edge_cases.TEXTS)
    assert all(r["class_id"] == r["doc_id"] for r in rows)
    kept = order_minhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_rows_that_share_an_id_have_the_class_of_their_text(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    docs = spark.createDataFrame([(5, a), (5, b), (1, a)], "doc_id long, text string")
    assert sorted(tuple(r) for r in order_minhash.keep_one(docs).collect()) == [(1, a), (5, b)]
    docs = spark.createDataFrame([(1, a), (1, b), (2, a + " more"), (3, b + " more")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["class_id"], r["n_words"]) for r in order_minhash.near_duplicates(docs).collect())
    assert got == [(1, 1, 40), (1, 1, 40), (2, 1, 41), (3, 1, 41)]
    kept = sorted(r["text"] for r in order_minhash.keep_one(docs).collect())
    assert kept == [a, b]


def test_clean_judges_rows_by_their_text(spark):
    item = "one two three four five six seven"
    rows = [(None, "x " + item), (None, "fine"), (7, "y " + item + " z"), (7, "also fine"), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_found", F.lit(1))
    items = spark.createDataFrame([(1, item), (2, None)], "item_id long, text string")
    kept = decontam.clean(docs, items)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == [(0, "fine"), (7, "also fine"), (8, "")]
    assert decontam.clean(docs, items.limit(0)).count() == 5


def test_near_duplicates_of_nothing(spark):
    docs = edge_cases.documents(spark)
    assert order_minhash.near_duplicates(edge_cases.empty(spark, docs)).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 100), (300, 300), (50, 51), (51, 52), (52, 50)]
    got = dict(components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 200: 100, 50: 50, 51: 50, 52: 50}


def test_best_vectors_query(spark):
    parity.check(spark, "op7_best_vectors")


def test_best_vectors_with_ties_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    rng = np.random.default_rng(7)
    vectors = rng.normal(0, 0.05, (700, 6))
    vectors[::3] = vectors[0]  # a third of all rows is one vector
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(vectors)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = defaultdict(list)
    for r in topk.search(table.filter("vec_id % 50 = 0"), table, 10).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    whole = np.floor(vectors.astype(np.float32).astype(float) * 1024).astype(int)
    for q in range(0, 700, 50):
        scores = whole @ whole[q]
        wanted = sorted((i for i in range(700) if i != q), key=lambda i: (-scores[i], i))[:10]
        assert got[q] == [(i, scores[i]) for i in wanted]


def test_best_vectors_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (0, [1.0, 0.5]), (1, [0.5, -0.5]), (2, None), (3, [nan, 1.0]), (4, [1.0, None]), (5, [inf, 0.0]),
            (None, [1.0, 1.0]), (6, [1.0]), (7, []), (8, [0.5, -0.5]), (100, [1.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("v", F.lit(1))
    got = [tuple(r) for r in topk.search(table.filter("vec_id % 100 = 0"), table, 10).orderBy("query_id", "rank").collect()]
    one = 1024 * 1024
    assert got == [(0, 1, 100, one * 3 // 2), (0, 2, 1, one // 4), (0, 3, 8, one // 4),
                   (100, 1, 0, one * 3 // 2), (100, 2, 1, 0), (100, 3, 8, 0)]
    assert topk.search(table, table.limit(0), 3).count() == 0 and topk.search(table.limit(0), table, 3).count() == 0


def test_pipeline_stages_against_their_definitions(spark):
    docs = spark.read.parquet(f"{parity.SMALL}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{parity.SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "decontamination", "packing"]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    scores = {r["doc_id"]: r["score"] for r in langid.identify(docs).collect()}
    after, given = [], docs
    for _, step in corpus_pipeline.STAGES:
        given = stage(step(spark, given, parity.SMALL))
        after.append(given)
        assert step is corpus_pipeline.pack or given.columns == docs.columns
    ids = [{r["doc_id"] for r in x.select("doc_id").collect()} for x in after]
    assert ids[0] == {d for d, s in scores.items() if s > 0}
    assert ids[1] == set(_classes({d: texts[d] for d in ids[0]}).values())
    wanted = [(decontam.shingles(words_of(t), 5)) for _, t in items]
    dirty = {d for d in ids[1] for own in [decontam.shingles(words_of(texts[d]), 5)]
             if any(len(w & own) >= 0.8 * len(w) for w in wanted)}
    assert dirty and ids[2] == ids[1] - dirty == ids[3]
    expected = packing.tokenizer_words(TOKENIZER).ids([texts[d] for d in sorted(ids[3])])
    got = Counter()
    for r in after[3].collect():
        got[r["doc_id"]] += r["length"]
    assert [got[d] for d in sorted(ids[3])] == [len(x) // 4 + 1 for x in expected]
