"""Toxicity (13)."""

import zlib

import edge_cases
import numpy as np
import parity
import pytest
from pyspark.sql import functions as F

from gridwork.llm import toxicity
from gridwork.llm.common import WORD
from gridwork.llm.queries import QUERIES

LARGER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def scored(spark):
    return {r["doc_id"]: r for r in QUERIES["op13_toxicity"](spark, LARGER).collect()}


def test_every_document_is_scored(spark, scored):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    assert sorted(scored) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    for i, r in scored.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        assert r["predicted"] == int(r["score"] >= 0.5)


def test_held_out_accuracy(spark, scored):
    marks = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    own = [(marks[i], r["score"], r["predicted"]) for i, r in scored.items() if r["held_out"] and i in marks]
    good, bad = ([s for t, s, _ in own if t == k] for k in (0, 1))
    assert np.mean([b > g for b in bad for g in good]) > 0.9
    assert np.mean([t == p for t, _, p in own]) > 0.95


def test_a_hidden_label_changes_nothing(spark):
    docs = spark.read.parquet(f"{parity.SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{parity.SMALL}/labels.parquet")
    hidden = toxicity.held_out(F.col("doc_id"))
    turned = labels.withColumn("toxic", F.when(hidden, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = docs.withColumn("lang", F.lit("x")).withColumn("source", F.col("doc_id").cast("string"))
    assert sorted(toxicity.score(docs, labels).collect()) == sorted(toxicity.score(other, turned).collect())


def test_counts_and_features_by_hand(spark):
    docs = spark.read.parquet(f"{parity.SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{parity.SMALL}/labels.parquet")
    model = toxicity.learn(docs, labels)
    free = {r["doc_id"] for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5}
    toxic = {r["doc_id"] for r in labels.collect() if r["toxic"] == 1} & free
    words = {r["doc_id"]: set(WORD.findall((r["text"] or "").lower())) for r in docs.collect() if r["doc_id"] in free}
    n, m = len(toxic & set(words)), len(words)
    apart = {}
    for w in set().union(*(words[i] for i in toxic)):
        p, u = (sum(w in words[i] for i in ids) for ids in (toxic, words))
        share = (u + 1) / (m + 2)
        if p >= toxicity.LEAST_TEXTS and abs(z := (p / n - share) / (share * (1 - share) / n) ** 0.5) >= toxicity.APART:
            apart[w] = -abs(z)
    assert set(model.weights) == set(sorted(apart, key=lambda w: (apart[w], w))[:toxicity.FEATURES])
    for r in docs.limit(30).collect():
        z = model.base + sum(v for w, v in model.weights.items() if w in set(WORD.findall((r["text"] or "").lower())))
        assert abs(model.score(r["text"]) - 1 / (1 + np.exp(-z))) < 1e-12


def test_risk_is_corrected_by_the_prior():
    """Unlabelled rows, a third of them positive: the fit finds the posterior, not the labels' share."""
    rng = np.random.default_rng(1)
    toxic = rng.random(20_000) < 1 / 3
    has = np.where(toxic, rng.random(20_000) < 0.9, rng.random(20_000) < 0.05)
    # rows: without and with the word; positive ones are drawn from the toxic
    u = np.array([(~has).sum(), has.sum()], float)
    p = np.array([(toxic & ~has).sum(), (toxic & has).sum()], float)
    weights, base = toxicity.fit(toxicity.Rows(np.array([1]), np.array([0]), p, u), 1, 1 / 3)
    got = 1 / (1 + np.exp(-np.array([base, base + weights[0]])))
    assert np.allclose(got, p / u, atol=0.05)


def test_edges(spark):
    edges = edge_cases.documents(spark)
    labels = spark.createDataFrame([(1, 1), (1, 0), (8, 1), (2, 0), (None, 1), (6, None), (7, 0), (10, 0)], "doc_id long, toxic int")
    labels = labels.withColumn("text", F.lit("clash"))
    rows = toxicity.score(edges, labels).collect()
    assert len(rows) == len(edge_cases.TEXTS) and all(0 <= r["score"] <= 1 for r in rows)
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], []).append(r)
    assert by_id[1][0] == by_id[1][1] and all(r["held_out"] for r in by_id[None])
    assert by_id[2][0]["score"] == by_id[3][0]["score"]  # no words in either
    none = toxicity.score(edges, labels.limit(0)).collect()
    assert {(r["predicted"], round(r["score"], 9)) for r in none} == {(0, 0.0)}
    assert toxicity.score(edge_cases.empty(spark, edges), labels).count() == 0
