"""Rows that every operator must take: nulls, empty and very long texts, ties, repeats, clashing columns."""

from pyspark.sql import functions as F

LONG = "the quick brown fox jumps over the lazy dog while seven wizards watch from afar " * 4000
TEXTS = [
    (1, "Some plain words about rivers and mountains in the north of the country.", "en"),
    (1, "Some plain words about rivers and mountains in the north of the country.", "en"),
    (2, None, "en"), (3, "", "fr"), (4, " \n\t ", None), (5, "?!... --- 123 45", "de"),
    (None, "A text without an id, about nothing at all.", "en"),
    (None, None, None), (6, LONG, "en"), (7, "日本語 のテキスト です。", "ja"), (8, "one two", "en"),
    (9, "\u0301combining \x01 mark \x1f sep <|endoftext|> x\u0001y", None),
    (10, "Released under the MIT License. Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0.", "en"),
]
#: Names that operators use for themselves.
CLASHING = ["words", "keys", "node", "n", "hits", "row", "label", "slot", "shard", "lang_pred", "score", "class",
            "component", "h1", "length", "number", "task", "text_", "_other", "_found", "_rejected", "file", "k", "v"]


def documents(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string, lang string")
    df = df.withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHING])


def empty(spark, df):
    return spark.createDataFrame([], df.schema)
