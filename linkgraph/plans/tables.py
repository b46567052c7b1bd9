"""Notes, tags and associations derived from the driver's tables, in Spark and in SQL alike.

- documents -> notes whose bodies end in a link of one of twelve kinds (by doc_id), to one of the
  first 200 documents, which every scale has
- orders and lineitem -> notes tagged by the parts they hold (many tags are over the group limit)
- events -> users tagged by the hours they were active in (pairs share several tags)
- lineitem -> parts tagged by supplier (all groups over the limit)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkgraph.sources import pages as P
from linkgraph.sources.shared import hadoop_path, spread, written

TARGETS = 200
#: The long prefix of the derived links, as a literal, so that SQL and plan are checked against it.
SCHEME = "note://"
X = "0" * 31 + "x"  # no hex digit: a link to nothing

#: What follows the text, by doc_id % 12, with the ids of the target and of the note itself.
SUFFIXES = (
    "\n[inline](:/TARGET)",
    "\n[anchor](:/TARGET#part+1%20a)",
    "\n[ref]: :/TARGET\n",
    "\n[crlf]: :/TARGET\r\n",
    '\n![image](:/TARGET "a title")',
    "\n<a class='x' href=\":/TARGET#top\">there</a>",
    f"\n[scheme]({SCHEME}TARGET) <img src=':/TARGET'>",
    "\n```\n[fenced](:/TARGET)\n```\n[out](:/SELF)",
    "\n`[code](:/TARGET)` and ]`gone`(:/TARGET)",
    "\n[a \\[b\\] c](:/TARGET) \\](:/SELF)",
    "\n[self](:/SELF) [again](:/TARGET) [again](:/TARGET)",
    f"\n[dangling](:/{'f' * 32}) [bad](:/{X}) <a href=\"{SCHEME.upper()}TARGET\">no</a> [t](:/TARGET)",
)


#: Exported lines of each kind of flaw, and sound ones: kind and element.
LINES = (
    ("nodes", '{"data":{"id":"ID","label":"a","noteId":"ID","degree":3}}'),
    ("nodes", '{"data":{"label":"a","degree":3}}'),
    ("nodes", '{"data":{"id":"ID","label":"","degree":3}}'),
    ("nodes", '{"data":{"id":"ID","label":"a","noteId":"other","degree":3}}'),
    ("nodes", '{"data":{"id":"ID","label":"a","noteId":"ID","degree":-1}}'),
    ("nodes", '{"data":{"id":"ID","la'),
    ("edges", '{"source":"ID","target":"b","type":"link"}'),
    ("edges", '{"data":{"source":"ID","type":"link"}}'),
    ("edges", '{"data":{"source":"ID","target":"b","type":"friend"}}'),
    ("edges", '{"data":{"source":"ID","target":"b","type":"tag"}}'),
    ("edges", '{"data":{"source":"ID","target":"b","type":"tag","tagName":"t"}}'),
    ("notes", '{"data":{"id":"ID","label":"a"}}'),
    ("edges", "[]"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def note_id(number: Column) -> Column:
    """32 hex digits of a number."""
    return F.lpad(F.lower(F.hex(number)), 32, "0")


def document_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of the shape (id, parent_id, title, body, created_time, updated_time, pos)."""
    return notes_of(table(spark, sf_dir, "documents"))


def document_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as a stream of its files."""
    fs, path = hadoop_path(spark, f"{sf_dir}/documents.parquet")
    schema = table(spark, sf_dir, "documents").schema
    reader = spark.readStream.schema(schema)
    if fs.getFileStatus(path).isDirectory():
        return reader.parquet(f"{sf_dir}/documents.parquet")
    return reader.option("pathGlobFilter", "documents.parquet").parquet(sf_dir)


def notes_of(docs: DataFrame) -> DataFrame:
    """The notes of some documents."""
    docs = docs.select("doc_id", "text", "source", "n_chars")
    number = F.col("doc_id")
    ending = F.element_at(F.array(*[F.lit(s) for s in SUFFIXES]), (number % 12).cast("int") + 1)
    ending = F.replace(F.replace(ending, F.lit("TARGET"), note_id((number * 7 + 3) % TARGETS)), F.lit("SELF"), note_id(number))
    title = F.when(number % 17 == 0, F.lit("")).otherwise(F.split(F.col("text"), "\n", 2)[0])
    return docs.select(
        note_id(number).alias("id"),
        F.col("source").alias("parent_id"),
        title.alias("title"),
        F.concat(F.coalesce("text", F.lit("")), ending).alias("body"),
        F.col("n_chars").alias("created_time"),
        F.col("n_chars").alias("updated_time"),
        number.alias("pos"),
    )


def document_tags(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(notes, tags, note_tag): notes of documents tagged by source and hundred, and by ninth."""
    notes = document_notes(spark, sf_dir)
    names = F.array(F.concat(F.col("parent_id"), F.lit("/"), F.floor(F.col("pos") / 100)), F.concat(F.lit("low-"), F.floor(F.col("pos") / 9)))
    pairs = notes.select(F.col("id").alias("note_id"), F.explode(names).alias("title")).where("title is not null")
    bridge = pairs.select(F.concat(F.lit("id-"), F.col("title")).alias("tag_id"), "note_id")
    # tags in the order of the lengths of their names, then of the names
    tags = pairs.select(F.concat(F.lit("id-"), F.col("title")).alias("id"), "title").distinct().withColumn("ord", F.length("title").cast("bigint"))
    return notes, tags, bridge


def order_tags(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(notes, tags, note_tag): orders tagged by part."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    notes = orders.select(note_id(F.col("k")).alias("id"), F.concat(F.lit("Order "), F.col("k")).alias("title"), F.lit("").alias("body"), F.col("k").alias("pos"))
    return notes, *_tags(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("n"), F.col("l_partkey").alias("t")), "part-")


def user_tags(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(notes, tags, note_tag): users tagged by hour (of the day and date)."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("n"), F.regexp_replace(F.substring(F.col("ts").cast("string"), 1, 13), "[^0-9]", "").cast("bigint").alias("t"))
    notes = events.select(note_id(F.col("n")).alias("id"), F.concat(F.lit("User "), F.col("n")).alias("title"), F.lit("").alias("body"), F.col("n").alias("pos")).distinct()
    return notes, *_tags(events, "hour-")


def part_tags(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(notes, tags, note_tag): parts tagged by supplier."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("n"), F.col("l_suppkey").alias("t"))
    notes = lines.select(note_id(F.col("n")).alias("id"), F.concat(F.lit("Part "), F.col("n")).alias("title"), F.lit("").alias("body"), F.col("n").alias("pos")).distinct()
    return notes, *_tags(lines, "supplier-")


def _tags(pairs: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    pairs = pairs.where("n is not null and t is not null").distinct()
    name = F.concat(F.lit(prefix), F.col("t"))
    tags = pairs.select(name.alias("id"), name.alias("title"), F.col("t").alias("ord")).distinct()
    return tags, pairs.select(name.alias("tag_id"), note_id(F.col("n")).alias("note_id"))


def note_pages(spark: SparkSession, sf_dir: str, fails: bool) -> DataFrame:
    """Page envelopes of the document notes, a hundred numbers a page; with ``fails`` the page after the first half fails."""
    notes = document_notes(spark, sf_dir)
    last = notes.agg(F.floor(F.max("pos") / P.PAGE) + 1).first()[0] or 1
    page = (F.floor(F.col("pos") / P.PAGE) + 1).cast("int")
    error = F.when(page == last // 2 + 1, "HTTPError: 500") if fails else None
    return written(P.as_pages(notes, P.NOTE_ITEM, page, F.col("pos"), F.lit(int(last)), error=error), "note-pages")


def part_tag_pages(spark: SparkSession, sf_dir: str, fails: bool, size: int = 10) -> tuple[DataFrame, DataFrame]:
    """Page envelopes of the part tags, and of the orders that carry each, ``size`` a page; with ``fails`` the
    second page of the first tag in the upper half fails."""
    _, tags, bridge = order_tags(spark, sf_dir)
    top = tags.agg(F.max("ord")).first()[0] or 0
    tag_pages = P.as_pages(tags, P.TAG_ITEM, (F.floor(F.col("ord") / P.PAGE) + 1).cast("int"), F.col("ord"), F.lit(top // P.PAGE + 1))
    by_tag = Window.partitionBy("tag_id").orderBy("note_id")
    rows = spread(bridge, "tag_id").join(tags.select(F.col("id").alias("tag_id"), "ord"), "tag_id").select(
        "ord", "tag_id", F.col("note_id").alias("id"), F.floor((F.row_number().over(by_tag) - 1) / size).alias("before"), F.floor((F.count("*").over(Window.partitionBy("tag_id")) - 1) / size).alias("most")
    )
    error = F.when((F.col("ord") == top // 2) & (F.col("before") == 1), "HTTPError: 500") if fails else None
    note_pages = P.as_pages(rows, P.REFERENCE, F.col("before") + 1, F.col("id"), F.col("most") + 1, key=F.col("tag_id"), error=error)
    return written(tag_pages, "tag-pages"), written(note_pages, "tag-note-pages")
