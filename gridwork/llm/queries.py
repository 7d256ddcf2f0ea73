"""The registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwork.session import read_table

from . import (
    decontam,
    html_extract,
    langid,
    license_scan,
    order_minhash,
    packing,
    sharding,
    topk,
    toxicity,
    url_reputation,
    vector_codes,
    warc_fixity,
    whitening,
)
from .common import stage

#: Parameters of the queries.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
SHARDS = [f"shard-{i:02d}" for i in range(24)]
TABLE_SIZE = 4_099
QUERY_EVERY, BEST = 100, 10
#: One page in so many is corrupt in the second replica, one in so many is lost.
CORRUPT_EVERY, LOST_EVERY = 97, 193
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read_table(spark, sf_dir, "pages"))


def _md5_number(c: Column) -> Column:
    return F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("long")


def op2_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as archive records against a second replica with damage by rule."""
    records = warc_fixity.warc_records(read_table(spark, sf_dir, "pages"))
    drawn, data = _md5_number(F.coalesce(F.col("record_id"), F.lit(-1))), F.col("bytes")
    other = F.when(drawn % CORRUPT_EVERY == 0, warc_fixity.overwritten(data)).otherwise(data)
    both = stage(warc_fixity.with_offsets(records.select(
        "file", "record_id", F.length(data).cast("long").alias("length"), warc_fixity.digest_of(data).alias("digest"),
        warc_fixity.digest_of(other).alias("other"), (drawn % LOST_EVERY == 1).alias("lost"))))
    replica = both.filter("not lost").drop("digest").withColumnRenamed("other", "digest")
    return warc_fixity.audit(both, replica).select("file", "offset", "record_id", "length", "kind")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents"))


def op4_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_reputation.judge(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "labels"), RULES)


def op5_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), TOKENIZER)


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op7_best_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return topk.search(vectors.filter(vectors["vec_id"] % QUERY_EVERY == 0), vectors, BEST)


def op8_contained_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op9_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id")
    return sharding.place(docs, "doc_id", SHARDS, TABLE_SIZE).select("doc_id", "slot", "shard")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read_table(spark, sf_dir, "documents"))


def op11_whitened_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode(read_table(spark, sf_dir, "embeddings"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_main_text, op2_fixity_audit, op3_language, op4_url_reputation, op5_pack_documents,
        op6_near_duplicates, op7_best_vectors, op8_contained_items, op9_shard_documents, op10_licenses,
        op11_whitened_vectors, op12_vector_codes, op13_toxicity)
}
