"""Upkeep of the note graph from a feed of item changes: equal to a rebuild, without one.

The graph's tables are kept in a snapshot store together with what they come from: links as they stand in
notes, tags as they stand on notes, and the pairs of notes that each tag makes.  A batch of changes touches

- links of changed notes, and links of other notes to notes that came or went
- tags that changed notes had or have: all their pairs, since a tag that passes the group limit gains or
  loses every pair, and since its first note decides the order of names
- edges of pairs that such a tag has a part in, merged anew from the stored pairs of all their tags
- degrees and labels at the ends of what was taken out and put in

Everything else is carried over by anti-joins; no body, no link and no other tag is looked at again.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from linkgraph.functions.text import label
from linkgraph.operators.edges import MAX_GROUP, merge, occurrences, raw_links, tag_pairs
from linkgraph.operators.graph import Graph, endpoints
from linkgraph.operators.store import KEEP, SnapshotStore, Version
from linkgraph.sources.shared import delete, run_folder, written

# Kinds of change events.
CREATE, UPDATE, DELETE = 1, 2, 3

#: A change: the note as it is after it (but for DELETE), and a number that grows with each change of a note.
CHANGE = StructType(
    [StructField("id", StringType()), StructField("event", IntegerType()), StructField("seq", LongType()), StructField("title", StringType()), StructField("pos", LongType())]
    + [StructField(n, ArrayType(StringType())) for n in ("links", "tags")]
)
EDGE = ("source", "target", "type", "tagName")


def _touching(rows: DataFrame, ids: DataFrame, *columns: str, keep: bool) -> DataFrame:
    """The rows that have (``keep``) or don't have one of their ``columns`` among ``ids``, which are distinct."""
    if not keep:
        return reduce(lambda df, c: df.join(ids.withColumnRenamed("id", c), c, "left_anti"), columns, rows).select(*rows.columns)
    first, *others = columns
    found = rows.join(ids.withColumnRenamed("id", first), first, "left_semi").select(*rows.columns)
    for c in others:  # each row once
        more = rows.join(ids.withColumnRenamed("id", c), c, "left_semi").join(ids.withColumnRenamed("id", first), first, "left_anti")
        found = found.unionByName(more.select(*rows.columns))
    return found


def _as_edges(links: DataFrame) -> DataFrame:
    return links.select("source", "target", F.lit("link").alias("type"), F.lit(None).cast("string").alias("tagName"))


def _keys(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a.id", "b.id").alias("low"), F.greatest("a.id", "b.id").alias("high")).distinct()


def _nodes(notes: DataFrame, degree: DataFrame) -> DataFrame:
    joined = notes.where("alive").select("id", label(F.col("title")).alias("label")).join(degree, "id", "left")
    return joined.select("id", "label", F.col("id").alias("noteId"), F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"))


def _at(seq: Column, gone: Column, content: Column) -> Column:
    """What orders the changes of a note."""
    return F.struct(seq.alias("seq"), gone.alias("gone"), content.alias("content"))


def latest_changes(changes: DataFrame) -> DataFrame:
    """The last change of each note by ``seq``; at equal numbers a deletion, else one of them by its content
    (``at`` is what decided).

    Changes without an id or number, or of another kind, are none.  What decides is narrow and counted map
    side, so a note with very many changes is a row a task.
    """
    known = changes.select(*CHANGE.names).where(f"id is not null and seq is not null and event between {CREATE} and {DELETE}")
    known = known.withColumn("at", _at(F.col("seq"), F.col("event") == DELETE, F.xxhash64(*CHANGE.names)))
    last = known.groupBy("id").agg(F.max("at").alias("_last"))
    return known.join(last, "id").where("at = _last").drop("_last").dropDuplicates(["id"])


class GraphFeed:
    """A graph in a snapshot store that follows changes; readers use ``export.read_snapshot`` on its folder."""

    def __init__(self, spark: SparkSession, folder: str, max_group: int | None = MAX_GROUP, keep: int = KEEP):
        self.spark, self.max_group, self.store = spark, max_group, SnapshotStore(spark, folder, keep)

    def graph(self) -> Graph | None:
        version = self.store.latest()
        return Graph(self.store.table("nodes", version), self.store.table("edges", version)) if version else None

    def start(self, notes: DataFrame, batch: tuple[str, int] | None = None) -> Version | None:
        """Make the first version, or a new one regardless of the present: of enriched notes (id, title, pos,
        links, tags), which count as changes with number 0."""

        zero = F.lit(0).cast("bigint")

        def write(path: str) -> dict[str, StructType]:
            held = {}

            def put(name: str, rows: DataFrame) -> DataFrame:
                held[name] = rows.schema
                return written(rows, name, f"{path}/{name}")

            rows = put("notes", notes.select("id", "title", "pos", _at(zero, F.lit(False), zero).alias("at"), F.lit(True).alias("alive")))
            links = put("links", raw_links(notes))
            pairs = put("pairs", tag_pairs(put("tags", occurrences(notes)), self.max_group))
            found = _as_edges(links.join(rows.select(F.col("id").alias("target")), "target", "left_semi"))
            edges = put("edges", found.unionByName(merge(pairs)))
            degree = put("degree", endpoints(edges).groupBy("id").agg(F.count("*").alias("degree")))
            put("nodes", _nodes(rows, degree))
            return held

        return self.store.commit(write, batch)

    def apply(self, changes: DataFrame, batch: tuple[str, int] | None = None) -> Version | None:
        """Make the version that follows from ``changes`` (CHANGE); None where the batch is known.

        A change that isn't later (``latest_changes``) than what the store has of its note is none, so batches
        may come again or in any order.  An update of an unknown note creates it, and a deletion of one is kept.
        Where no change is one, the version that follows is of the same tables.
        """
        if self.store.known(batch):
            return None
        now = self.store.latest()
        if now is None:
            empty = self.spark.createDataFrame([], CHANGE)
            self.start(empty)
            now = self.store.latest()
        scratch = f"{run_folder(self.spark)}/feed-{now.data}-{id(changes):x}"
        own = changes.sparkSession

        def old(name: str) -> DataFrame:
            return own.read.schema(self.store.table(name, now).schema).parquet(f"{self.store.folder}/data/{now.data}/{name}")

        def write(path: str) -> dict[str, StructType] | None:
            held = {}

            def put(name: str, *parts: DataFrame) -> DataFrame:
                rows = reduce(DataFrame.unionByName, parts).select(*old(name).columns)
                held[name] = rows.schema
                return written(rows, name, f"{path}/{name}")

            def keep(name: str, rows: DataFrame) -> DataFrame:
                return written(rows, name, f"{scratch}/{name}")

            stored = old("notes").select("id", F.col("at").alias("_at"))
            late = latest_changes(changes).join(stored, "id", "left").where("_at is null or at > _at").drop("_at")
            changed = keep("changed", late)
            if changed.isEmpty():
                return None
            ids, live = changed.select("id"), changed.where(f"event <> {DELETE}")

            state = changed.select("id", "title", "pos", "at", (F.col("event") != DELETE).alias("alive"))
            notes = put("notes", _touching(old("notes"), ids, "id", keep=False), state)

            links = put("links", _touching(old("links"), ids, "source", keep=False), raw_links(live))
            alive = notes.where("alive").select(F.col("id").alias("target"))
            new_links = _as_edges(_touching(links, ids, "source", "target", keep=True).join(alive, "target", "left_semi"))

            gone = old("tags").join(ids, "id", "left_semi")
            tags = put("tags", _touching(old("tags"), ids, "id", keep=False), occurrences(live))
            touched = keep("touched", gone.select("tag").unionByName(occurrences(live).select("tag")).distinct())
            again = keep("again", tag_pairs(tags.join(touched, "tag", "left_semi"), self.max_group))
            former = old("pairs")
            pairs = put("pairs", former.join(touched, "tag", "left_anti"), again)
            keys = keep("keys", _keys(former.join(touched, "tag", "left_semi").unionByName(again)))
            placed = pairs.withColumn("low", F.least("a.id", "b.id")).withColumn("high", F.greatest("a.id", "b.id"))
            new_tags = merge(placed.join(keys, ["low", "high"], "left_semi"))

            edges = old("edges")
            old_links = _touching(edges.where("type = 'link'"), ids, "source", "target", keep=True)
            by_key = edges.where("type = 'tag'").withColumn("low", F.least("source", "target")).withColumn("high", F.greatest("source", "target"))
            old_tags = by_key.join(keys, ["low", "high"], "left_semi")
            out = keep("out", old_links.unionByName(old_tags.select(*EDGE)))
            into = keep("into", new_links.unionByName(new_tags.select(*EDGE)))
            rest = _touching(edges.where("type = 'link'"), ids, "source", "target", keep=False)
            put("edges", rest, by_key.join(keys, ["low", "high"], "left_anti").select(*EDGE), into)

            moves = endpoints(into).withColumn("d", F.lit(1)).unionByName(endpoints(out).withColumn("d", F.lit(-1)))
            moves = keep("moves", moves.groupBy("id").agg(F.sum("d").alias("d")).where("d <> 0"))
            ends = moves.select("id")
            summed = old("degree").join(ends, "id", "left_semi").unionByName(moves.withColumnRenamed("d", "degree"))
            summed = summed.groupBy("id").agg(F.sum("degree").alias("degree")).where("degree > 0")
            degree = put("degree", _touching(old("degree"), ends, "id", keep=False), summed)

            renewed = keep("renewed", ids.unionByName(ends).distinct())
            put("nodes", _touching(old("nodes"), renewed, "id", keep=False), _nodes(notes.join(renewed, "id", "left_semi"), degree.join(renewed, "id", "left_semi")))
            return held

        try:
            return self.store.commit(write, batch)
        finally:
            delete(self.spark, scratch)


def follow(changes: DataFrame, feed: GraphFeed, checkpoint: str, shape: Callable[[DataFrame], DataFrame] = lambda rows: rows, **trigger) -> StreamingQuery:
    """Apply each micro-batch of a stream to ``feed``; ``shape`` makes CHANGE rows of the stream's.  A batch that
    is handled again after a failure adds nothing."""

    def handle(batch: DataFrame, number: int) -> None:
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
        feed.apply(shape(batch), (stream, number))

    return changes.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
