"""Operator 2: Merkle fixity audit of WARC replicas.

A replica is a set of archive files, each a run of records at byte offsets. A
record's leaf is the hash of its place and its bytes. Offset ranges of RANGE
bytes hash their records' leaves in offset order; FANOUT ranges in order make
a node of the next level, up to one root per file. Two replicas are audited
from the roots down: only branches whose hashes differ are descended (a join
on the differing parents), so intact files cost one comparison each, and the
records that differ are found with their offsets.

Trees are built level by level with aggregates over bounded groups: a range of
RANGE bytes holds at most RANGE / (shortest record) records however large the
file, so no group grows with the archive, and every level is smaller by its
fan-out. The leaves are written once (hashes only), not read again from the
records.

Defined results: a record whose bytes are null hashes as empty. A record that
one replica lacks is reported as missing or extra. Records that repeat a place
in a file are told apart by their hashes; equal ones count once. Replicas with the same records have
the same roots, whatever the order of their rows. Empty replicas give an empty
result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import only, stage

#: Bytes of a leaf range; ranges (and nodes) that make a node of the next level.
RANGE, FANOUT = 1 << 16, 16
#: Pages of one archive file when pages are laid out as records.
FILE_PAGES = 512


def warc_records(pages: DataFrame) -> DataFrame:
    """file, record_id, bytes: pages(page_id, url, html) as WARC response records,
    FILE_PAGES ids a file. Null ids go to a file of their own (-1)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"),
                    F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "),
                    F.coalesce(F.regexp_replace("url", r"[\r\n]", ""), F.lit("")), F.lit("\r\nContent-Length: "),
                    F.length(payload).cast("string"), F.lit("\r\n\r\n")).cast("binary")
    record = F.concat(head, payload, F.lit("\r\n\r\n").cast("binary"))
    return only(pages, "page_id", "url", "html").select(
        F.coalesce(F.floor(F.col("page_id") / FILE_PAGES), F.lit(-1)).alias("file"),
        F.col("page_id").alias("record_id"), record.alias("bytes"))


def digest_of(data: Column) -> Column:
    return F.sha2(F.coalesce(data, F.lit("").cast("binary")), 256)


def with_offsets(digests: DataFrame) -> DataFrame:
    """Records(file, record_id, length, digest, …) with their ``offset``: one after the other by id.
    Lengths and digests go through the sort, the bytes don't."""
    before = Window.partitionBy("file").orderBy("record_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return digests.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


def digests(records: DataFrame) -> DataFrame:
    """A replica (file, offset, record_id, length, digest) from its records(file, offset, record_id, bytes)."""
    length = F.coalesce(F.length("bytes"), F.lit(0)).cast("long")
    return only(records, "file", "offset", "record_id", "bytes").select(
        "file", "offset", "record_id", length.alias("length"), digest_of(F.col("bytes")).alias("digest"))


def leaves(replica: DataFrame) -> DataFrame:
    """file, offset, record_id, length, leaf: the hash of each record's place and bytes."""
    place = F.concat_ws(" ", F.col("offset").cast("string"), F.col("length").cast("string"), "digest")
    return only(replica, "file", "offset", "record_id", "length", "digest").select(
        "file", "offset", "record_id", "length", F.sha2(place, 256).alias("leaf")).dropDuplicates(["file", "offset", "leaf"])


def _ordered_hash(at: Column, value: Column) -> Column:
    """The hash of a bounded group's values in the order of their places."""
    listed = F.array_sort(F.collect_list(F.struct(at.alias("at"), value.alias("value"))))
    return F.sha2(F.array_join(F.transform(listed, lambda x: F.concat_ws(" ", x["at"].cast("string"), x["value"])), "\n"), 256)


def tree(leaf: DataFrame) -> list[DataFrame]:
    """Levels (file, node, hash) from the offset ranges up to one root (node 0) per file."""
    level = stage(leaf.groupBy("file", F.floor(F.col("offset") / RANGE).alias("node"))
                  .agg(_ordered_hash(F.col("offset"), F.col("leaf")).alias("hash")))
    levels = [level]
    while level.filter("node > 0").head(1):
        level = stage(level.groupBy("file", F.floor(F.col("node") / FANOUT).alias("_up"))
                      .agg(_ordered_hash(F.col("node"), F.col("hash")).alias("hash"))
                      .withColumnRenamed("_up", "node"))
        levels.append(level)
    return levels


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """(file, node) whose hashes differ, or that one side lacks."""
    return (a.join(b.withColumnRenamed("hash", "other"), ["file", "node"], "full")
            .filter(~F.col("hash").eqNullSafe(F.col("other"))).select("file", "node"))


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """Replicas (file, offset, record_id, length, digest; see :func:`digests`) against each other: file, offset, record_id, length, kind of each record in which replica b differs from a:
    corrupt, missing (only in a) or extra (only in b), each with both leaves."""
    a, b = stage(leaves(a)), stage(leaves(b))
    up_a, up_b = tree(a), tree(b)
    # a file longer in one replica has more levels there; the other's top is taken up with it
    while len(up_a) != len(up_b):
        short = up_a if len(up_a) < len(up_b) else up_b
        short.append(stage(short[-1].groupBy("file", F.floor(F.col("node") / FANOUT).alias("_up"))
                           .agg(_ordered_hash(F.col("node"), F.col("hash")).alias("hash"))
                           .withColumnRenamed("_up", "node")))
    suspect = stage(_differing(up_a[-1], up_b[-1]))

    def under(parent: Callable[[], Column]) -> Callable[[DataFrame], DataFrame]:
        return lambda child: (child.withColumn("_up", parent()).join(
            suspect.select("file", F.col("node").alias("_up")), ["file", "_up"], "left_semi").drop("_up"))

    for level_a, level_b in list(zip(up_a, up_b, strict=True))[-2::-1]:
        below = under(lambda: F.floor(F.col("node") / FANOUT))
        suspect = stage(_differing(below(level_a), below(level_b)))
    below = under(lambda: F.floor(F.col("offset") / RANGE))
    keys, same = ["file", "offset"], ["file", "offset", "leaf"]
    a, b = stage(below(a)), stage(below(b))
    left = a.join(b, same, "left_anti").withColumnRenamed("leaf", "leaf_a")
    right = b.join(a, same, "left_anti").select(
        "file", "offset", F.col("record_id").alias("record_b"), F.col("length").alias("length_b"), F.col("leaf").alias("leaf_b"))
    kind = F.when(F.col("leaf_b").isNull(), "missing").when(F.col("leaf_a").isNull(), "extra").otherwise("corrupt")
    return (left.join(right, keys, "full")
            .select("file", "offset", F.coalesce("record_id", "record_b").alias("record_id"),
                    F.coalesce("length", "length_b").alias("length"), kind.alias("kind"), "leaf_a", "leaf_b"))


def overwritten(data: Column) -> Column:
    """The bytes with the one in the middle overwritten."""
    half = F.floor(F.length(data) / 2).cast("int")
    return F.concat(F.substring(data, F.lit(1), half), F.lit("\u0001").cast("binary"),
                    F.substring(data, half + 2, F.length(data)))
