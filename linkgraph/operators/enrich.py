"""Enrichment: links from the body, tags from the associations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkgraph.functions.links import linked_ids
from linkgraph.sources.shared import spread

STRINGS = "array<string>"


def tag_titles(tags: DataFrame, note_tag: DataFrame) -> DataFrame:
    """(note_id, tags): the titles of each note's tags, in tag order.

    The tag side has at most as many rows as its scan allows, which lets Spark choose a broadcast by
    its size; the associations are aggregated before they meet in a shuffle.
    """
    named = spread(note_tag, "tag_id").join(tags.withColumnRenamed("id", "tag_id"), "tag_id")
    listed = spread(named, "note_id").groupBy("note_id").agg(F.array_sort(F.collect_list(F.struct("ord", "tag_id", "title"))).alias("t"))
    return listed.select("note_id", F.transform("t", lambda x: x["title"]).alias("tags"))


def enrich(notes: DataFrame, titles: DataFrame, extract: Callable[[Column], Column] = linked_ids) -> DataFrame:
    """All note columns with ``links`` (ids in the body) and ``tags`` ([] without any)."""
    found = titles.select(F.col("note_id").alias("id"), F.col("tags").alias("_tags"))
    # links come from the body before the join, so that bodies that nothing else reads aren't shuffled
    linked = notes.drop("links", "tags").withColumn("links", extract(F.coalesce("body", F.lit(""))))
    joined = linked.join(found, "id", "left")
    return joined.withColumn("tags", F.coalesce("_tags", F.array().cast(STRINGS))).drop("_tags")
