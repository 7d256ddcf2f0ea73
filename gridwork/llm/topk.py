"""Operator 7: exact top-k inner product search with block-at-a-time pruning.

Vectors are whole numbers: floor(SCALE * x) of each component. Rows are laid
into blocks of BLOCK consecutive rows; a block keeps its vectors as a forward
index and, for each component, its largest and smallest value. For a query,
the block's bound is the sum over components of the larger of query x largest
and query x smallest: no vector of the block scores higher. A query goes
through the blocks by falling bound, scoring each through its forward index,
and stops where the bound is below its k-th score (an equal bound may still
hold a tie with a smaller id).

Queries are a stated set; they go in groups of QUERY_GROUP against runs of
blocks (shards). Each pair of group and shard is one bounded unit of work with
its own k best, and the units' k best of a query are merged by a window over
at most k rows a shard. Nothing is collected on the driver but three counts.

Defined results: vectors that are null, or hold a null or non-finite
component, or an id that is null, take no part. A vector of another length
than a query's is no candidate for it. A vec_id that comes several times
counts once, with its best score, and is never a candidate for itself. Equal
scores: the smaller vec_id first. Empty tables give an empty result. Other
columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import only, spread, stage

SCALE = 1024
#: Rows of a block, blocks of a shard at most, queries of a group at most (about).
BLOCK, SHARD_BLOCKS, QUERY_GROUP = 256, 256, 2048


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<bigint>) of the vectors that take part."""
    given = only(vectors, "vec_id", "embedding").filter("vec_id is not null and embedding is not null")
    unfit = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    numbers = F.transform("embedding", lambda x: x.cast("double"))
    return given.select("vec_id", numbers.alias("e")).filter(~F.exists("e", unfit)).select(
        "vec_id", F.transform("e", lambda x: F.floor(x * SCALE)).alias("v"))


def _blocked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Consecutive rows of one length as blocks: ids, forward index, bounds."""
    for pdf in batches:
        sizes = pdf["v"].map(len).to_numpy()
        out = []
        for size in np.unique(sizes):
            own = pdf[sizes == size]
            for at in range(0, len(own), BLOCK):
                part = own.iloc[at:at + BLOCK]
                m = np.stack(part["v"].to_numpy()).astype(np.int64).reshape(len(part), size)
                out.append((int(size), part["vec_id"].to_numpy(np.int64).tobytes(), m.tobytes(),
                            m.max(axis=0).tobytes(), m.min(axis=0).tobytes()))
        yield pd.DataFrame(out, columns=["size", "ids", "forward", "high", "low"])


def best_of(blocks: pd.DataFrame, queries: pd.DataFrame, k: int) -> Iterator[tuple[int, int, int]]:
    """(query_id, vec_id, score) of the k best of each query among these blocks of its length."""
    ids = [np.frombuffer(x, np.int64) for x in blocks["ids"]]
    for size in np.unique(queries["size"]):
        own = np.flatnonzero(blocks["size"].to_numpy() == size)
        if not len(own):
            continue
        shape = (len(own), size)
        high = np.frombuffer(b"".join(blocks["high"].iloc[own]), np.int64).reshape(shape)
        low = np.frombuffer(b"".join(blocks["low"].iloc[own]), np.int64).reshape(shape)
        forward = [np.frombuffer(blocks["forward"].iloc[b], np.int64).reshape(-1, size) for b in own]
        for row in queries[queries["size"] == size].itertuples():
            q = np.frombuffer(row.v, np.int64)
            bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
            found, score = np.empty(0, np.int64), np.empty(0, np.int64)
            for b in np.argsort(-bound, kind="stable"):
                if len(found) == k and bound[b] < score[-1]:
                    break
                if len(found) == k and bound[b] == score[-1] and ids[own[b]].min() > found[-1]:
                    continue  # it could only tie, and loses ties
                new = forward[b] @ q
                fit = ids[own[b]] != row.query_id
                if len(found) == k:
                    fit &= new >= score[-1]
                if not fit.any():
                    continue
                every, scores = np.concatenate([found, ids[own[b]][fit]]), np.concatenate([score, new[fit]])
                order = np.lexsort((every, -scores))
                every, scores = every[order], scores[order]
                first = np.sort(np.unique(every, return_index=True)[1])[:k]  # an id counts once, with its best
                found, score = every[first], scores[first]
            yield from ((row.query_id, int(v), int(s)) for v, s in zip(found, score, strict=True))


def search(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of vectors(vec_id, embedding) for each of the queries."""
    blocks = stage(whole_vectors(vectors).mapInPandas(
        _blocked, "size int, ids binary, forward binary, high binary, low binary"))
    asked = stage(whole_vectors(queries).select(F.col("vec_id").alias("query_id"), F.size("v").alias("size"), "v"))
    n_blocks, n_queries = blocks.count(), asked.count()
    shards = max(-(-n_blocks // SHARD_BLOCKS), min(n_blocks, spread(vectors.sparkSession)))
    groups = -(-n_queries // QUERY_GROUP)
    schema = "query_id long, vec_id long, score long"
    if not n_blocks or not n_queries:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(v=[np.asarray(v, np.int64).tobytes() for v in pdf["v"]])

    def unit(blocks: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = best_of(blocks, pack(queries), k) if len(blocks) and len(queries) else ()
        return pd.DataFrame(list(found), columns=["query_id", "vec_id", "score"])

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = (blocks.withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int"))
            .withColumn("group", every(groups)))
    # equal rows of a query are spread over the groups by their place, not by their id
    right = (asked.withColumn("group", F.pmod(F.monotonically_increasing_id(), F.lit(groups)).cast("int"))
             .withColumn("shard", every(shards)))
    found = left.groupBy("shard", "group").cogroup(right.groupBy("shard", "group")).applyInPandas(unit, schema)
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
