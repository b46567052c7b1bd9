"""Text search by stored n-grams: a query reads the lists of its rarest n-grams, then looks at what is in all of them.

``write_index`` stores, for each n-gram of a lower-cased text, the ids of the texts that hold it, parted by a
bucket of the n-gram and sorted by it, and how many texts each n-gram has.  ``find`` reads a few rows of the
counts, then only the buckets of the n-grams it chose; a text that passes is searched for the whole query.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegerType, StringType, StructField, StructType

from linkgraph.functions.links import trim
from linkgraph.sources.shared import written

#: Characters of an n-gram, buckets of the lists, and lists that a query reads at most.
GRAM, BUCKETS, LISTS = 3, 64, 4


def grams(text: Column, size: int = GRAM) -> Column:
    """The distinct n-grams of a lower-cased text; none of a null or shorter one."""
    low = F.lower(text)
    found = F.transform(F.sequence(F.lit(1), F.length(low) - size + 1), lambda i: F.substring(low, i, F.lit(size)))
    return F.when(F.length(low) >= size, F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def query_grams(query: str, size: int = GRAM) -> tuple[str, list[str]]:
    """A query as it is looked for (trimmed and lower-cased by the caller's session) and its distinct n-grams."""
    return query, list(dict.fromkeys(query[i : i + size] for i in range(len(query) - size + 1)))


@dataclass(frozen=True)
class TextIndex:
    """The texts (id, text), the lists (gram, id, bucket) and the counts (gram, n, bucket) of an index."""

    texts: DataFrame
    lists: DataFrame
    counts: DataFrame


def write_index(texts: DataFrame, path: str, key: str = "id", text: str = "text") -> TextIndex:
    """Store the index of ``texts`` below ``path``.

    Rows are dealt by n-gram and id, so an n-gram that most texts hold is in many files of its bucket; it is
    counted map side.  A null id can't be found and has no rows.
    """
    spark = texts.sparkSession
    stored = written(texts.select(F.col(key).alias("id"), F.col(text).alias("text")).where("id is not null"), "texts", f"{path}/texts")
    rows = stored.select("id", F.explode(grams(F.col("text"))).alias("gram"))
    dealt = rows.withColumn("bucket", _bucket(F.col("gram"))).repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("bucket", "gram")
    dealt.write.partitionBy("bucket").parquet(f"{path}/lists")
    lists = _read(spark, f"{path}/lists", stored.schema["id"].dataType)
    counts = lists.groupBy("gram", "bucket").agg(F.count("*").alias("n"))
    counts.repartition("bucket").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{path}/counts")
    return read_index(spark, path)


def _read(spark: SparkSession, path: str, key: DataType) -> DataFrame:
    return spark.read.schema(StructType([StructField("gram", StringType()), StructField("id", key), StructField("bucket", IntegerType())])).parquet(path)


def read_index(spark: SparkSession, path: str) -> TextIndex:
    texts = spark.read.parquet(f"{path}/texts")
    counts = spark.read.schema("gram string, n bigint, bucket int").parquet(f"{path}/counts")
    return TextIndex(texts, _read(spark, f"{path}/lists", texts.schema["id"].dataType), counts)


def _of(rows: DataFrame, wanted: list[str]) -> DataFrame:
    """The rows of some n-grams; the buckets are told as literals, so that only their files are read."""
    spark = rows.sparkSession
    buckets = spark.range(1).select(F.explode(F.lit(wanted)).alias("gram")).select(_bucket(F.col("gram")).alias("b")).distinct()
    return rows.where(F.col("bucket").isin([r.b for r in buckets.collect()]) & F.col("gram").isin(wanted))


def chosen_grams(index: TextIndex, wanted: list[str], lists: int = LISTS) -> list[str] | None:
    """The rarest of a query's n-grams; None if one of them is in no text."""
    counts = {r.gram: r.n for r in _of(index.counts, wanted).collect()}  # a row an n-gram of the query
    return sorted(wanted, key=lambda g: (counts[g], g))[:lists] if len(counts) == len(wanted) else None


def find(index: TextIndex, query: str, lists: int = LISTS) -> DataFrame:
    """(id, text) of the texts that hold the trimmed query, ignoring case, as ``views.search_nodes`` has it.

    An empty query finds all texts that have an id, a null text among them; one that is shorter than an
    n-gram is looked for in every text.
    """
    spark = index.texts.sparkSession
    wanted = spark.range(1).select(F.lower(trim(F.lit(query)))).first()[0]
    if not wanted:
        return index.texts
    holds = F.lower(F.coalesce("text", F.lit(""))).contains(wanted)
    parts = query_grams(wanted)[1]
    if not parts:
        return index.texts.where(holds)
    read = chosen_grams(index, parts, lists)
    if read is None:
        return index.texts.limit(0)
    place = F.array_position(F.lit(read), F.col("gram")).cast("int") - 1  # an id may be that of several texts
    found = _of(index.lists, read).select("id", F.pow(F.lit(2), place).cast("bigint").alias("bit"))
    found = found.groupBy("id").agg(F.bit_or("bit").alias("bits")).where(F.col("bits") == (1 << len(read)) - 1)
    return index.texts.join(found.select("id"), "id", "left_semi").where(holds)
