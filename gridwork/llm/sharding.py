"""Operator 9: sharding by a permutation-filled lookup table (DataFrame functions only).

Each shard has its own order of preference over the slots of a table of prime
size; the shards take turns, each claiming the first slot on its list that is
still free, until the table is full. Every shard so owns an equal share of the
slots to within one, and when a shard joins or leaves few other slots move. A
row's key is hashed to a slot and the slot's owner is looked up in the table,
which is broadcast: its size is the parameter ``size``, not the data's.

The table is a parameter, filled on the driver (its size is bounded by
``MAX_SIZE``). Placing rows is one map-side lookup without a shuffle, so a key
that holds a third of all rows costs nothing more.

Defined results: a null key is placed as the empty string; repeated rows go
to the same shard; an empty table gives an empty result; other columns are
passed on, except that ``slot`` and ``shard`` replace columns of that name.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The table of a shard list is broadcast; this bounds it (about 1 MB).
MAX_SIZE = 65_537


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:12], 16)


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def fill_table(shards: list[str], size: int) -> list[int]:
    """The owner (index in ``shards``) of every slot.

    A shard's preference list is an arithmetic walk through the slots: start
    and step come from hashes of its name, and as ``size`` is prime every step
    visits every slot once.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct names, one at least")
    if not _is_prime(size) or not len(shards) <= size <= MAX_SIZE:
        raise ValueError(f"size must be a prime from the number of shards to {MAX_SIZE}")
    at = [_number(f"start {s}") % size for s in shards]
    step = [_number(f"step {s}") % (size - 1) + 1 for s in shards]
    owner: list[int | None] = [None] * size
    for turn in range(size):
        who = turn % len(shards)
        while owner[at[who]] is not None:
            at[who] = (at[who] + step[who]) % size
        owner[at[who]] = who
    return owner  # type: ignore[return-value]


def table_frame(spark: SparkSession, shards: list[str], size: int) -> DataFrame:
    """(slot, shard) for every slot, from one constant."""
    owners = ",".join(map(str, fill_table(shards, size)))
    names = F.array(*map(F.lit, shards))
    one = spark.range(1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("slot", "_o"))
    return one.select("slot", F.element_at(names, F.col("_o").cast("int") + 1).alias("shard"))


def slot_of(key: Column, size: int) -> Column:
    text = F.coalesce(key.cast("string"), F.lit(""))
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % size).cast("int")


def place(df: DataFrame, key: str, shards: list[str], size: int) -> DataFrame:
    """``df`` with ``slot`` and the name of its ``shard``."""
    table = table_frame(df.sparkSession, shards, size)
    return df.withColumn("slot", slot_of(df[key], size)).drop("shard").join(F.broadcast(table), "slot")
