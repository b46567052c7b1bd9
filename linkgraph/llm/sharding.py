"""Rendezvous (highest-random-weight) sharding of stable record keys over weighted shards.

Every (key, shard) pair has its own uniform draw u from a 64-bit hash; the shard with the least
-ln(u) / weight wins.  A key's winner depends on the key and the list of shards alone: adding a
shard can only move keys into it, removing one only moves the keys it held.  All of it is one
narrow projection.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkgraph.llm.common import materialize


def rendezvous(key: Column, shards: Mapping[int, float]) -> Column:
    """The shard id (int) that wins ``key``; equal scores go to the smaller id.

    A null key is a key of its own.  Weights must be positive.
    """
    if not shards or min(shards.values()) <= 0:
        raise ValueError("shards need positive weights")
    text = F.coalesce(key.cast("string"), F.lit(""))
    draws = []
    for shard, weight in sorted(shards.items()):
        h = F.xxhash64(F.lit(f"shard-{shard}"), key.isNull(), text)
        u = (F.shiftrightunsigned(h, 11) + F.lit(0.5)) / F.lit(float(1 << 53))
        draws.append(F.struct((-F.log(u) / F.lit(float(weight))).alias("score"), F.lit(int(shard)).alias("id")))
    return F.array_min(F.array(*draws))["id"] if len(draws) > 1 else F.lit(int(next(iter(shards))))


def assign_shards(
    df: DataFrame,
    key: str,
    text: str,
    shards: Mapping[int, float],
    grown: Mapping[int, float] | None = None,
    buckets: int = 1024,
) -> DataFrame:
    """Return ``key``, size, text_crc32, shard, slot and grown_shard for every row.

    Slots are gapless from 0 in each shard.  A shard isn't numbered by one task: its rows are cut
    into ``buckets`` by a hash of the row and of the scan task that read it (so that rows alike in
    every column spread too), counted per bucket, and a bucket's first slot is the count before it.
    Only the narrow table (no text) is written, counted and shuffled.

    Size is the UTF-8 length of the text plus 1; a null text has size 1 and crc 0, a null key is a
    key like any other, repeated rows get slots of their own, and further columns are ignored.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    k = F.col(key)
    narrow = df.select(
        k.alias("key"),
        (F.octet_length(body).cast("long") + F.lit(1)).alias("size"),
        F.crc32(body.cast("binary")).cast("long").alias("text_crc32"),
        rendezvous(k, shards).alias("shard"),
        (rendezvous(k, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        F.spark_partition_id().alias("task"),
    )
    salt = F.xxhash64("key", "text_crc32", "task")
    narrow = materialize(narrow.withColumn("bucket", F.pmod(salt, F.lit(buckets)).cast("int")).drop("task"), "shards")
    before = (
        narrow.groupBy("shard", "bucket")
        .count()
        .withColumn("first", F.sum("count").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("count"))
        .select("shard", "bucket", "first")
    )
    within = Window.partitionBy("shard", "bucket").orderBy("key", "text_crc32", "size")
    numbered = narrow.withColumn("nth", F.row_number().over(within) - 1)
    # len(shards) * buckets rows of 16 bytes at most, whatever the input
    return numbered.join(F.broadcast(before), ["shard", "bucket"]).select(
        F.col("key").alias(key),
        "size",
        "text_crc32",
        "shard",
        (F.col("first") + F.col("nth")).cast("long").alias("slot"),
        "grown_shard",
    )
