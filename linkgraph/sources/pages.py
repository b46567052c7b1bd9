"""Paged scans of an item service: pages are read as rows, failures included, and a scan is what they amount to.

``PageSource`` is a data source whose rows are page envelopes (key, page, items, has_more, fetched, error): a
failed request is a row with an error, so a job doesn't fail with it.  ``paged_notes`` and ``paged_tags``
turn envelopes, freshly read or stored, into what a reader that asks for one page after the other would
have: the rows up to the first failure, the bound or the last page, and whether that is all.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegerType, LongType, StringType, StructField, StructType

from linkgraph.sources.notes import MAX_NOTES, MAX_TAGS, NOTE, NOTE_TAG, TAG
from linkgraph.sources.shared import spread, written

#: Items of a page, and the place of an item: that of its page times STRIDE, plus its own.
PAGE, STRIDE = 100, 1_000_000


def fields_of(schema: StructType, *order: str) -> StructType:
    """The fields that are asked of the service: those of a table but the order it will get."""
    return StructType([f for f in schema if f.name not in order])


def envelope(item: StructType) -> StructType:
    fields = [("key", StringType()), ("page", IntegerType()), ("items", ArrayType(item)), ("has_more", BooleanType()), ("fetched", LongType()), ("error", StringType())]
    return StructType([StructField(n, t) for n, t in fields])


NOTE_ITEM, TAG_ITEM, REFERENCE = fields_of(NOTE, "pos"), fields_of(TAG, "ord"), StructType([StructField("id", StringType())])


@dataclass
class Pages(InputPartition):
    """The pages ``first`` to ``last`` (None: to the end) of each of some keys."""

    keys: tuple[str, ...]
    first: int = 1
    last: int | None = None


def _value(value, kind: DataType):
    if value is None:
        return None
    if isinstance(kind, StringType):
        return value if isinstance(value, str) else json.dumps(value)
    return int(value)


class PageReader(DataSourceReader):
    """Asks url/path?fields=..&limit=..&page=.. for pages; ``fields`` are those of the schema's items."""

    def __init__(self, options: dict[str, str], schema: StructType):
        self.options = {k.lower(): v for k, v in options.items()}
        self.item = schema["items"].dataType.elementType
        self.keys = [str(k) for k in json.loads(self.options["keys"])] if "keys" in self.options else None
        self.page: int | None = None

    def partitions(self) -> Sequence[InputPartition]:
        """One for each ``keys_each`` keys; without keys one for each ``pages_each`` of about ``pages``
        pages, the last of them open, unless ``last`` is the last page to be asked for."""
        each = int(self.options.get("keys_each", 1))
        if self.page is not None:
            keys = [""] if self.keys is None else self.keys
            return [Pages(tuple(keys[i : i + each]), self.page, self.page) for i in range(0, len(keys), each)]
        if self.keys is not None:
            return [Pages(tuple(self.keys[i : i + each])) for i in range(0, len(self.keys), each)]
        step = int(self.options.get("pages_each", 50))
        starts = [*range(1, int(self.options.get("pages", 1)) + 1, step)]
        last = int(self.options["last"]) if "last" in self.options else None
        return [Pages(("",), a, a + step - 1) for a in starts[:-1]] + [Pages(("",), starts[-1], last)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        """Pages of each key until one fails, promises no more or is the partition's last."""
        for key in partition.keys:
            page, more = partition.first, True
            while more and (partition.last is None or page <= partition.last):
                items, more, error = self.ask(key, page)
                yield key, page, items, more, time.time_ns() // 1000, error
                page += 1

    def ask(self, key: str, page: int) -> tuple[list | None, bool | None, str | None]:
        """(items, has_more, error) of a page, after ``attempts`` requests at most."""
        path = self.options["path"].replace("{key}", urllib.parse.quote(key, safe=""))
        asked = {"fields": ",".join(self.item.names), "limit": self.options.get("limit", PAGE), "page": page} | json.loads(self.options.get("query", "{}"))
        url = f"{self.options['url'].rstrip('/')}/{path}?{urllib.parse.urlencode(asked)}"
        error = ""
        for _ in range(int(self.options.get("attempts", 1))):
            try:
                with urllib.request.urlopen(url, timeout=float(self.options.get("timeout", 30))) as answer:
                    told = json.load(answer)
                items = [tuple(_value(x.get(f.name), f.dataType) for f in self.item) for x in told.get("items") or []]
                return items, told.get("has_more") is True, None
            except (urllib.error.URLError, OSError, ValueError, TypeError, AttributeError) as e:
                error = f"{type(e).__name__}: {e}"
        return None, None, error


class FilteredPageReader(PageReader):
    """A PageReader for sessions that push filters (a reader that takes filters is refused by others)."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Keys and a page that a query asks for are all that is requested."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("page",) and self.page is None:
                self.page = int(f.value)
            elif isinstance(f, EqualTo | In) and f.attribute == ("key",) and self.keys is not None:
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.keys = [k for k in self.keys if k in wanted]
            else:
                yield f


class PageSource(DataSource):
    """``spark.read.format("item_pages")`` once it is registered; options url, path (with {key}), keys (a JSON
    list), keys_each, pages, pages_each, last, limit, attempts, timeout, query (a JSON
    object, such as a token) and filters (true where spark.sql.python.filterPushdown.enabled is).

    The schema is ``envelope`` of the fields that are wanted; by default those of notes.
    """

    @classmethod
    def name(cls) -> str:
        return "item_pages"

    def schema(self) -> StructType:
        return envelope(NOTE_ITEM)

    def reader(self, schema: StructType) -> DataSourceReader:
        pushes = self.options.get("filters", "false").lower() == "true"
        return (FilteredPageReader if pushes else PageReader)(dict(self.options), schema)


def read_pages(spark: SparkSession, url: str, path: str, item: StructType, **options) -> DataFrame:
    """Envelopes of a service's pages; lists and dicts among the options are passed as JSON.

    Every action asks the service anew, so scans take ``fetch_pages`` or other stored envelopes.
    """
    spark.dataSource.register(PageSource)
    options["filters"] = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    told = {k: json.dumps(v) if isinstance(v, list | dict) else str(v) for k, v in options.items()}
    return spark.read.format("item_pages").schema(envelope(item)).options(url=url, path=path, **told).load()


def fetch_pages(spark: SparkSession, url: str, path: str, item: StructType, store: str | None = None, **options) -> DataFrame:
    """``read_pages``, asked for once and stored: at ``store``, or for as long as the driver lasts."""
    return written(read_pages(spark, url, path, item, **options), "pages", store)


def _best(envelopes: DataFrame) -> DataFrame:
    """(key, page, ok, fetched, more, n) a page: its latest answer without an error, if there is one."""
    ok = F.col("error").isNull()
    narrow = envelopes.where("page >= 1").select(F.coalesce("key", F.lit("")).alias("key"), "page", ok.alias("ok"), F.when(ok, F.coalesce("fetched", F.lit(0))).alias("fetched"), F.coalesce("has_more", F.lit(False)).alias("more"), F.greatest(F.size("items"), F.lit(0)).cast("bigint").alias("n"))
    at = F.when(F.col("ok"), F.col("fetched"))
    return narrow.groupBy("key", "page").agg(F.max("ok").alias("ok"), F.max("fetched").alias("fetched"), F.max_by("more", at).alias("more"), F.max_by("n", at).alias("n"))


def page_status(envelopes: DataFrame) -> DataFrame:
    """(key, last, failed) a key: the last page that a reader gets, and the one that stopped it, or null.

    A page fails if all its envelopes have an error, or if it is missing though the one before promised more.
    A gap is found by an anti-join of each page's successor, so no task holds all pages of a key.
    """
    best = _best(envelopes)
    missing = best.select("key", (F.col("page") + 1).alias("page")).join(best.select("key", "page"), ["key", "page"], "left_anti")
    missing = missing.groupBy("key").agg(F.min("page").alias("missing"))
    ended = F.col("ok") & ~F.col("more")
    ends = best.groupBy("key").agg(F.min("page").alias("first"), F.min(F.when(ended, F.col("page"))).alias("end"), F.min(F.when(~F.col("ok"), F.col("page"))).alias("bad"))
    fails = F.least("bad", "missing", F.when(F.col("first") > 1, 1))
    stopped = F.col("end").isNull() | (fails <= F.col("end"))
    return ends.join(missing, "key").select("key", F.when(stopped, fails - 1).otherwise(F.col("end")).alias("last"), F.when(stopped, fails).alias("failed"))


def page_items(envelopes: DataFrame) -> DataFrame:
    """(key, page, place, item) of all items of answered pages: of a page that was fetched again, the answer
    with the latest ``fetched``, which tells its envelopes apart."""
    chosen = _best(envelopes).where("ok").select("key", "page", "fetched")
    told = envelopes.where("error is null and page >= 1").select(F.coalesce("key", F.lit("")).alias("key"), "page", F.coalesce("fetched", F.lit(0)).alias("fetched"), "items")
    rows = spread(told, "key", "page", "fetched").join(chosen, ["key", "page", "fetched"], "left_semi")
    return rows.select("key", "page", F.posexplode("items").alias("at", "item")).select("key", "page", (F.col("page").cast("bigint") * STRIDE + F.col("at")).alias("place"), "item")


@dataclass(frozen=True)
class PagedScan:
    """What a scan gets: its rows, whether something is lacking, and the page that failed, if one did."""

    rows: DataFrame
    truncated: bool
    failed: int | None


def _scan(envelopes: DataFrame, item: StructType, order: str, limit: int | None) -> tuple[PagedScan, int]:
    """A scan of the one key of ``envelopes`` and the number of rows on the pages it gets."""
    status = page_status(envelopes).first()
    last, failed = (status.last, status.failed) if status else (0, 1)
    got = page_items(envelopes).where(F.col("page") <= last).select(*[F.col(f"item.{n}").alias(n) for n in item.names], F.col("place").alias(order))
    counts = _best(envelopes).where(F.col("page") <= last).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("more"), F.col("n"))).alias("promised")).first()
    total, promised = counts.n or 0, counts.promised or 0
    rows = got if limit is None else got.orderBy(order).limit(limit)
    cut = limit is not None and (total > limit or promised >= limit)
    return PagedScan(rows, failed is not None or cut, failed), total


def paged_notes(envelopes: DataFrame, limit: int | None = MAX_NOTES) -> PagedScan:
    """The notes of pages with one key: all up to the last page, the first failure or the bound.

    ``pos`` follows page and place.  Truncated: a page failed, or the bound was reached while more was
    promised.  No envelope at all counts as a failed first page; a page without items as an empty one.
    """
    return _scan(envelopes, NOTE_ITEM, "pos", limit)[0]


@dataclass(frozen=True)
class PagedTags:
    """Tags, associations (NOTE_TAG) as far as they were read, and whether something is lacking."""

    tags: DataFrame
    note_tag: DataFrame
    truncated: bool


def paged_tags(tag_pages: DataFrame, note_pages: DataFrame, limit: int | None = MAX_TAGS) -> PagedTags:
    """Tags and the notes that carry them, from pages of tags and pages of notes by tag (the key is its id).

    Without all pages of tags there are no associations.  Else tags are read in their order: where a page of
    a tag's notes fails, what was read before it counts, and nothing after; a tag without any page
    fails at its first.  Reaching the bound counts as truncated, even if nothing more was there.
    """
    spark = tag_pages.sparkSession
    tags, total = _scan(tag_pages, TAG_ITEM, "ord", limit)
    full = limit is not None and total >= limit
    if tags.failed is not None:
        return PagedTags(tags.rows.limit(0), spark.createDataFrame([], NOTE_TAG), True)
    of_tag = tags.rows.select(F.col("id").alias("key"), "ord").join(page_status(note_pages), "key", "left")
    failing = of_tag.where("failed is not null or last is null").agg(F.min("ord").alias("ord")).first().ord
    read = of_tag.where("last >= 1").select("key", "ord", "last")
    if failing is not None:
        read = read.where(F.col("ord") <= failing)
    found = spread(page_items(note_pages), "key").join(read, "key").where("page <= last")
    return PagedTags(tags.rows, found.select(F.col("key").alias("tag_id"), F.col("item.id").alias("note_id")), full or failing is not None)


def as_pages(items: DataFrame, item: StructType, page: Column, order: Column, last: Column, key: Column | None = None, error: Column | None = None) -> DataFrame:
    """Envelopes of a table's rows, for a service's answers that are stored as a table: ``page`` from 1,
    ``last`` the key's last page, ``error`` what failed on a page.  A page holds a bounded number of rows."""
    told = items.select(
        (F.lit("") if key is None else key).alias("key"), page.cast("int").alias("page"), order.alias("_order"), F.struct(*item.names).alias("item"),
        last.alias("_last"), (F.lit(None).cast("string") if error is None else error).alias("error"),
    )
    pages = told.groupBy("key", "page").agg(F.array_sort(F.collect_list(F.struct("_order", "item"))).alias("items"), F.max("_last").alias("_last"), F.max("error").alias("error"))
    answered = F.col("error").isNull()
    return pages.select(
        "key", "page", F.when(answered, F.transform("items", lambda x: x["item"])).alias("items"), F.when(answered, F.col("page") < F.col("_last")).alias("has_more"), F.lit(0).cast("bigint").alias("fetched"), "error"
    )
