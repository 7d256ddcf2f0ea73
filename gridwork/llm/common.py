"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import functools
import re
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwork.session import checkpoint_dir

#: A word is a run of letters and digits.
WORD = re.compile(r"[^\W_]+")

#: Words of a shingle, and the least similarity that counts as near-duplicate.
SHINGLE = 5
SIMILARITY = 0.8

#: Words that a worker remembers the hashes of; beyond it starts anew.
MEMORY = 100_000


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns of a table, whatever else it carries."""
    return df.select(*[df[c] for c in columns])


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder that
    ``spark.checkpoint.dir`` names and read it back.

    Like ``checkpoint()`` this cuts the lineage and survives lost executors,
    but the table is columnar and compressed, and keeps its column statistics.
    The folder goes when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/gridwork-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.parquet(path)


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class WordHashes(dict):
    """word -> 64-bit hash, remembered by the worker up to MEMORY words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMORY:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


@functools.cache
def word_hashes() -> WordHashes:
    return WordHashes()


def words_of(text: str | None) -> list[str]:
    """The lower-cased words of a whole text; none if it is null."""
    return WORD.findall(text.lower()) if text else []


def hashed_words(text: str | None) -> np.ndarray:
    w = words_of(text)
    return np.fromiter(map(word_hashes().__getitem__, w), np.uint64, len(w))


#: Odd multiplier that chains word hashes into shingle hashes.
CHAIN = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over the whole range, one to one."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def shingle_hashes(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """The hashes of all runs of k words in text order; of a text with fewer
    words (but one at least) the one run that it is."""
    n = len(words)
    k = min(k, n)
    if not n:
        return np.empty(0, np.uint64)
    h = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        h = (h + words[i:n - k + 1 + i]) * CHAIN
    return mixed(h)


def spread(spark: SparkSession) -> int:
    """Tasks that a shuffle of this session has."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
