"""Values that users attach to items, merged by time: the last writer wins, a deletion is a write.

A merge of any batches in any order and split is one result: the greatest write of each key, in an order that
is total.  A value that was deleted stays as a tombstone, so that an older write which comes late doesn't
bring it back; ``forget`` takes tombstones out that no such write can be awaited for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

from linkgraph.operators.store import SnapshotStore, Version

#: A write: of the value (JSON text) of a key of an item, or its deletion; by a client, at a time.
WRITE = StructType(
    [StructField("item_type", IntegerType()), StructField("item_id", StringType()), StructField("key", StringType()), StructField("value", StringType())]
    + [StructField("deleted", BooleanType()), StructField("updated", LongType()), StructField("client", StringType())]
)
KEY = ["item_type", "item_id", "key"]


def merge_writes(*batches: DataFrame) -> DataFrame:
    """One row (WRITE) a key: its latest write.

    Of writes at one time that of the greatest client counts, then a deletion, then the greatest value; equal
    rows are one.  Writes without an item, key or time are none; a null ``deleted`` means false, and a deleted
    value is null.  Partial merges are made map side, so a key with very many writes is a row a task.
    """
    rows = reduce(DataFrame.unionByName, [b.select(*WRITE.names) for b in batches])
    rows = rows.where("item_type is not null and item_id is not null and key is not null and updated is not null")
    gone = F.coalesce("deleted", F.lit(False))
    at = F.struct("updated", F.coalesce("client", F.lit("")).alias("c"), gone.alias("deleted"), F.when(~gone, F.col("value")).alias("value"), "client")
    last = rows.groupBy(*KEY).agg(F.max(at).alias("w"))
    return last.select(*KEY, *[F.col(f"w.{n}").alias(n) for n in WRITE.names[3:]])


def values(merged: DataFrame) -> DataFrame:
    """(item_type, item_id, key, value) of what is there; a filter on them reaches a stored table."""
    return merged.where(~F.col("deleted")).select(*KEY, "value")


def forget(merged: DataFrame, before: int) -> DataFrame:
    """Without tombstones from before a time: no write older than that may come any more."""
    return merged.where(~(F.col("deleted") & (F.col("updated") < before)))


def put_writes(store: SnapshotStore, writes: DataFrame, batch: tuple[str, int] | None = None) -> Version | None:
    """Merge a batch into the table ``items`` of a snapshot store; None where the batch is known."""
    now = store.latest()
    held = [store.table("items", now)] if now else []
    return store.save({"items": merge_writes(*held, writes)}, batch)
