"""Operator 10: license scan by diagonal voting.

Templates are word sequences: short phrases and the opening words of license
notices. All rolling word k-grams of a document are looked up; those that
templates have too are joined by Spark to the template positions with the same
k-gram, and vote for the diagonal (document position less template position)
that they lie on. A copied passage is one diagonal with many votes; words put
in or left out move it to a neighbouring one, so that diagonals at most a
SLACK of the template's length apart are merged into one span. A phrase is verified where its diagonal alone
has all its k-grams (k-grams are compared by word numbers, not by hashes that
could clash): its words then stand there consecutively. A notice is verified
if a span has LEAST of its k-grams and is no longer than STRETCH times it.

Only k-grams that some template has leave the scan of the texts; the votes of
a document are added up per diagonal before they are shuffled. The templates
are a parameter and small; their positions are broadcast.

Defined results: a null text is empty; a document without words has n_words 0,
null first_word and last_word, empty labels and score 0. Repeated rows are
judged each by itself (a row's key is its place in the scan, written before
it is used). Empty tables give an empty result. Other columns are dropped.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import only, stage

#: Words: the bytes of digits, lower-case letters and everything beyond ASCII.
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")

#: k of phrases and of notices.
PHRASE_K, NOTICE_K = 2, 4
#: Share of a notice's length that neighbouring diagonals of a span may lie apart, least share
#: of its k-grams, most length of its span.
SLACK, LEAST, STRETCH = 0.25, 0.8, 1.5

# Phrases with their labels.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

# Opening words of public license notices with their labels.
NOTICES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files the software to deal in the software without restriction", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance "
     "with the license", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general "
     "public license as published by the free software foundation", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that "
     "the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
     "granted", "isc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
]


@functools.cache
def template_grams() -> tuple[dict[bytes, int], dict[int, np.ndarray], list[tuple]]:
    """word -> number from 1; k -> sorted codes of its grams; rows (gram, template, label, k, n_grams, tpos)."""
    given = [(t.encode().split(), label, PHRASE_K) for t, label in PHRASES]
    given += [(t.encode().split(), label, NOTICE_K) for t, label in NOTICES]
    numbers = {w: i for i, w in enumerate(sorted({w for t, _, _ in given for w in t}), 1)}
    rows = []
    for template, (words, label, k) in enumerate(given):
        codes = gram_codes(np.array([numbers[w] for w in words]), k, len(numbers) + 1)
        rows += [(int(c), template, label, k, len(codes), i) for i, c in enumerate(codes)]
    known = {k: np.unique([r[0] for r in rows if r[3] == k]) for k in (PHRASE_K, NOTICE_K)}
    return numbers, known, rows


def gram_codes(numbers: np.ndarray, k: int, base: int) -> np.ndarray:
    """Every run of k word numbers as one number; different runs have different ones."""
    n = len(numbers) - k + 1
    codes = np.zeros(max(n, 0), np.int64)
    for i in range(k if n > 0 else 0):
        codes = codes * base + numbers[i:i + n]
    return codes


def words_of(text: str | None) -> list[bytes]:
    return _WORDS.findall(text.encode("utf-8", "replace").lower()) if text else []


def gram_hits(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(k, position, code) of the k-grams that templates have too."""
    numbers, known, _ = template_grams()
    ids = np.fromiter((numbers.get(w, 0) for w in words), np.int64, len(words))
    found = []
    if np.count_nonzero(ids) < PHRASE_K:
        return found
    for k, codes in known.items():
        grams = gram_codes(ids, k, len(numbers) + 1)
        at = np.minimum(np.searchsorted(codes, grams), len(codes) - 1)
        found += [(k, int(i), int(grams[i])) for i in np.flatnonzero(codes[at] == grams)]
    return found


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    task, row = TaskContext.get().partitionId() << 40, 0
    for pdf in batches:
        words = [words_of(t) for t in pdf["text"]]
        hits = [[{"k": k, "pos": p, "gram": g} for k, p, g in gram_hits(w)] for w in words]
        yield pd.DataFrame({"row": task + np.arange(row, row + len(pdf)), "doc_id": pdf["doc_id"],
                            "n_words": [len(w) for w in words], "hits": hits})
        row += len(pdf)


def template_positions(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"({g}L, {t}, '{label}', {k}, {n}, {p})" for g, t, label, k, n, p in template_grams()[2])
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(gram, template, label, k, n_grams, tpos)")


def spans(scanned: DataFrame) -> DataFrame:
    """row, template, label, k, start, end (words), coverage, verified of every merged span."""
    hits = scanned.select("row", F.explode("hits").alias("h")).select("row", "h.k", "h.pos", "h.gram")
    voted = (hits.join(F.broadcast(template_positions(scanned.sparkSession)), ["k", "gram"])
             .groupBy("row", "template", "label", "k", "n_grams", (F.col("pos") - F.col("tpos")).alias("diagonal"))
             .agg(F.collect_set("tpos").alias("at"), F.min("pos").alias("start"), F.max("pos").alias("last")))
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(order) > F.when(
        F.col("k") == PHRASE_K, 0).otherwise(F.floor((F.col("n_grams") + F.col("k") - 1) * SLACK))
    merged = (voted.withColumn("new", F.coalesce(apart, F.lit(True)).cast("int"))
              .withColumn("span", F.sum("new").over(order))
              .groupBy("row", "template", "label", "k", "n_grams", "span")
              .agg(F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("votes"),
                   F.min("start").alias("start"), (F.max("last") + F.col("k")).alias("end")))
    length = F.col("n_grams") + F.col("k") - 1
    coverage = F.col("votes") / F.col("n_grams")
    verified = F.when(F.col("k") == PHRASE_K, F.col("votes") == F.col("n_grams")).otherwise(
        (coverage >= LEAST) & (F.col("end") - F.col("start") <= STRETCH * length))
    return merged.select("row", "template", "label", "k", "start", "end",
                         coverage.alias("coverage"), verified.alias("verified"))


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    schema = "row long, doc_id long, n_words long, hits array<struct<k:int,pos:int,gram:long>>"
    scanned = stage(only(docs, "doc_id", "text").mapInPandas(_scan, schema))
    found = F.col("verified")
    base = found & (F.col("k") == PHRASE_K)
    sets = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("label"))))
    per_row = spans(scanned).groupBy("row").agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"), F.array_join(sets(base), ",").alias("base_labels"),
        F.array_join(sets(found), ",").alias("labels"),
        F.max(F.when(found, F.col("coverage")).otherwise(F.col("coverage") * LEAST)).alias("score"))
    return scanned.drop("hits").join(per_row, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("base_labels", "labels")],
        F.coalesce("score", F.lit(0.0)).alias("score"))
