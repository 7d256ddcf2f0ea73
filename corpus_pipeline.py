"""The corpus pipeline: language identification, near-duplicate removal, decontamination, packing.

Every stage works on all that its predecessor kept. ``run`` writes each stage's
result as Parquet in the shared folder and reads it back for the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridwork.llm import decontam, langid, order_minhash, packing
from gridwork.llm.common import stage
from gridwork.llm.queries import TOKENIZER
from gridwork.session import read_table, ship_package


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learnt."""
    ship_package(spark)
    return langid.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the smallest id."""
    ship_package(spark)
    return order_minhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    ship_package(spark)
    return decontam.clean(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, in sequences."""
    ship_package(spark)
    return packing.pack(docs, TOKENIZER)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: SQL can express neither the profiles nor the packing; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, from ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, step) in enumerate(STAGES, 1):
        docs = step(spark, docs, sf_dir)
        docs = stage(docs) if i < len(STAGES) else docs
    return docs
