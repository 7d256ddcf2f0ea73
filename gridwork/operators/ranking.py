"""Exact global ranks without a single-partition window.

``row_number() over (order by k)`` with no partition key runs in one task.
Here rows are range-partitioned on the order, sorted inside each partition,
numbered locally (``monotonically_increasing_id`` is the record index inside
its partition), and shifted by the row count of all earlier partitions. The
per-partition counts are one row per partition, so broadcasting them is
bounded by the partition count. The numbered data is checkpointed first so
both uses see the same partitions.

Rows that are equal in the order can't be dealt out by it: a third of all rows
with one key would be one task. ``ties`` stores the rows first and orders equal
ones by their place in that table, by which ranges can cut them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwork.session import cut_lineage


def global_rank(df: DataFrame, order, out: str = "rank", partitions: int | None = None, ties: bool = False) -> DataFrame:
    """Adds ``out`` = 1-based position of each row in ``order`` (give a total
    order: ties are numbered in an unspecified but fixed way; with ``ties``
    however many equal rows are spread over the tasks)."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    if ties:  # a stored table's rows have fixed places
        df = cut_lineage(df).withColumn("_tie", F.monotonically_increasing_id())
        cols = [*cols, F.col("_tie")]
    s = (df.repartitionByRange(n, *cols).sortWithinPartitions(*cols)
         .withColumn("_pid", F.spark_partition_id().cast("long"))
         .withColumn("_mid", F.monotonically_increasing_id()))
    s = cut_lineage(s)
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offs = counts.select(
        "_pid", F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                           F.lit(0)).alias("_off"))
    local = F.col("_mid") - F.shiftleft(F.col("_pid"), 33)
    return (s.join(F.broadcast(offs), "_pid")
            .withColumn(out, F.col("_off") + local + 1)
            .drop("_pid", "_mid", "_off", *["_tie"] * ties))


#: Hex digits of an md5 key that its counts are kept by.
PREFIX = 4


def first_k_per_group(df: DataFrame, group: str, key: str, sizes: DataFrame, out: str = "_keep") -> DataFrame:
    """Marks, in every ``group``, the rows with the smallest md5 ``key``: exactly
    ``k`` of them, as ``sizes(group, k)`` says (one row per group, a handful).

    The counts of the keys' first PREFIX digits (at most 65,536 a group, added
    up before they are shuffled) tell in which prefix the k-th key lies. Rows
    before it are kept and rows after it are not, without moving any; only the
    rows of that one prefix are ranked, over all tasks, equal keys among them by
    their places, so that not even a third of all rows with one key is one task's.
    """
    prefix = F.substring(F.col(key), 1, PREFIX)
    counts = df.groupBy(group, prefix.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    edge = (counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).join(F.broadcast(sizes), group)
            .filter((F.col("_before") <= F.col("k")) & (F.col("k") < F.col("_before") + F.col("_n")))
            .select(group, F.col("_p").alias("_edge"), (F.col("k") - F.col("_before")).alias("_more")))
    # a group that is kept whole has no edge: all its prefixes lie before
    placed = df.join(F.broadcast(edge), group, "left").withColumn("_p", prefix)
    sure = placed.filter(F.col("_edge").isNull() | (F.col("_p") != F.col("_edge"))).withColumn(
        out, F.coalesce(F.col("_p") < F.col("_edge"), F.lit(True)))
    ranked = global_rank(placed.filter(F.col("_p") == F.col("_edge")), [group, key], out="_rank", ties=True)
    first = ranked.groupBy(F.col(group).alias("_of")).agg(F.min("_rank").alias("_first"))  # one row a group
    edges = (ranked.join(F.broadcast(first), F.col(group) == F.col("_of"))
             .withColumn(out, F.col("_rank") - F.col("_first") < F.col("_more")).drop("_of", "_rank", "_first"))
    return sure.unionByName(edges).drop("_p", "_edge", "_more")
