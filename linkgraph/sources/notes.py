"""Scans of notes and tags, bounded where a bound is asked for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

MAX_NOTES, MAX_TAGS = 5000, 1000


def _schema(strings: str, numbers: str) -> StructType:
    fields = [(n, StringType()) for n in strings.split()] + [(n, LongType()) for n in numbers.split()]
    return StructType([StructField(n, t) for n, t in fields])


NOTE = _schema("id parent_id title body", "created_time updated_time pos")
TAG = _schema("id title", "ord")
NOTE_TAG = _schema("tag_id note_id", "")


@dataclass(frozen=True)
class Bounded:
    """At most ``limit`` rows of a scan.  ``inclusive``: a full scan counts as truncated even if
    nothing more was there (so it is for tags)."""

    rows: DataFrame
    source: DataFrame
    limit: int
    inclusive: bool = False

    @property
    def truncated(self) -> bool:
        """Whether the bound cut something off; looks at one row more than the bound at most."""
        if self.inclusive:
            return self.source.limit(self.limit).count() >= self.limit
        return self.source.limit(self.limit + 1).count() > self.limit


def empty(spark: SparkSession, schema: StructType) -> DataFrame:
    """What a missing page amounts to."""
    return spark.createDataFrame([], schema)


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """The notes of a Parquet table; only the note columns are read."""
    return _shaped(spark.read.parquet(path), NOTE, "pos")


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    return _shaped(spark.read.parquet(path), TAG, "ord")


def _shaped(df: DataFrame, schema: StructType, order: str) -> DataFrame:
    """The columns of ``schema``, null where they lack.  Without an order column, rows are ordered by
    a number of their id: a hash would do as well, but must not depend on partitions."""
    columns = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema if f.name != order]
    at = F.col(order).cast("bigint") if order in df.columns else F.xxhash64("id")
    return df.select(*columns, at.alias(order))


def scan_notes(notes: DataFrame, limit: int | None = MAX_NOTES) -> Bounded:
    """The first ``limit`` notes by position; without a limit all of them."""
    slim = notes.select(*[c for c in NOTE.names if c in notes.columns])
    if limit is None:
        return Bounded(slim, slim.limit(0), 0)
    return Bounded(slim.orderBy("pos", "id").limit(limit), slim, limit)


def scan_tags(tags: DataFrame, limit: int | None = MAX_TAGS) -> Bounded:
    """The first ``limit`` tags by order; a scan that reaches the limit counts as truncated."""
    slim = tags.select(*TAG.names)
    if limit is None:
        return Bounded(slim, slim.limit(0), 1, inclusive=True)
    return Bounded(slim.orderBy("ord", "id").limit(limit), slim, limit, inclusive=True)


def open_note(notes: DataFrame, note_id: str) -> DataFrame:
    """The note of an id; the filter reaches the scan."""
    return notes.where(F.col("id") == note_id)
