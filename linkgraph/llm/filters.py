"""Interaction audit of corpus filters: what each filter removes alone, after the others and in every order.

Texts are scanned in the Arrow buffer that holds them: one table gives every byte its classes, prefix
sums of the classes at the documents' offsets count words, capitals, code points and symbols, and a
prefix sum of byte values times powers gives every word's hash without cutting the word out.  The
hashes are sorted within each document; neighbours with equal hashes are compared byte by byte, so
distinct words are exact.  A document then is a mask of the filters that it fails, and all orders of the
filters are worked out from the counts of the masks, of which there are at most 2^filters a part.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator, Mapping
from functools import lru_cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, LongType, StructField, StructType

from linkgraph.llm.common import fresh, map_arrow, materialize

#: Bytes that are scanned at a time, and filters at most (their orders are all told).
CHUNK, MOST = 1 << 20, 6
SPACE, CAPITAL, SYMBOL, LEAD = 1, 2, 4, 8
_WHITE = re.compile(rb"[\x20\x09-\x0D]")

MEASURES = StructType(
    [StructField(n, LongType()) for n in ("words", "distinct_words", "capitals", "code_points")]
    + [StructField("has_symbol", BooleanType()), StructField("digest", BinaryType())]
)


@lru_cache(1)
def _classes() -> np.ndarray:
    """The classes of each byte; a code point is counted at its first byte."""
    table = np.zeros(256, np.uint8)
    table[[0x20, *range(0x09, 0x0E)]] |= SPACE
    table[ord("A") : ord("Z") + 1] |= CAPITAL
    table[list(b"#$%&*|")] |= SYMBOL
    table[[b for b in range(256) if b & 0xC0 != 0x80]] |= LEAD
    return table


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A value for each byte; the powers of an odd number, and of its inverse modulo 2^64."""
    base = 0x9E3779B97F4A7C15
    grow = lambda b: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(CHUNK, b, np.uint64)]))
    return np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64), grow(base), grow(pow(base, -1, 1 << 64))


def word_bounds(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of the maximal runs of bytes that are ``inside``, within the documents'
    ``offsets`` into ``data``."""
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    begin[cuts] = inside[cuts]
    end[cuts - 1] = inside[cuts - 1]
    start = np.flatnonzero(begin)
    return np.searchsorted(offsets, start, "right") - 1, start, np.flatnonzero(end) + 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], for at most CHUNK bytes of data."""
    value, power, inverse = _powers()
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value[data] * power[: len(data)])])
    hashes = (prefix[end] - prefix[start]) * inverse[start]
    return hashes ^ hashes >> np.uint64(29)


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether data[a:a+length] and data[b:b+length] are equal, for each of many pairs."""
    step = np.arange(length.sum()) - np.repeat(length.cumsum() - length, length)
    differ = np.concatenate([[0], np.cumsum(data[np.repeat(a, length) + step] != data[np.repeat(b, length) + step])])
    last = length.cumsum()
    return differ[last] == differ[last - length]


def measure(data: np.ndarray, offsets: np.ndarray, hashes=word_hashes) -> list[np.ndarray]:
    """words, distinct words, capitals, code points and has_symbol of the documents at ``offsets``."""
    kind = _classes()[data]
    counts = []
    for flag in (CAPITAL, LEAD, SYMBOL):
        prefix = np.concatenate([[0], np.cumsum(kind & flag != 0)])
        counts.append(prefix[offsets[1:]] - prefix[offsets[:-1]])
    doc, start, end = word_bounds(data, offsets, kind & SPACE == 0)
    words = np.bincount(doc, minlength=len(offsets) - 1)
    hashed = hashes(data, start, end)
    order = np.lexsort((hashed, doc))
    doc, start, end, hashed = doc[order], start[order], end[order], hashed[order]
    again = np.flatnonzero((doc[1:] == doc[:-1]) & (hashed[1:] == hashed[:-1])) + 1
    length = end - start
    fits = length[again] == length[again - 1]
    verified = np.zeros(len(again), bool)
    verified[fits] = same_bytes(data, start[again[fits]], start[again[fits] - 1], length[again[fits]])
    distinct = words - np.bincount(doc[again], minlength=len(words))
    for bad in np.unique(doc[again[~verified]]).tolist():  # two words with one hash
        distinct[bad] = len(set(data[offsets[bad] : offsets[bad + 1]].tobytes().split()))
    return [words, distinct, counts[0], counts[1], counts[2] > 0]


def _measure_long(data: np.ndarray) -> list[np.ndarray]:
    """``measure`` of one text of over CHUNK bytes, cut at white space."""
    text, at, total, seen = data.tobytes(), 0, np.zeros(5, np.int64), set()
    while at < len(text):
        cut = _WHITE.search(text, at + CHUNK // 2)
        stop = min(cut.start(), len(text)) if cut else len(text)
        piece = text[at:stop]
        kind = _classes()[np.frombuffer(piece, np.uint8)]
        words = piece.split()
        seen.update(words)
        total += [len(words), 0, *(int((kind & flag != 0).sum()) for flag in (CAPITAL, LEAD, SYMBOL))]
        at = stop
    total[1] = len(seen)
    return [total[i : i + 1] for i in range(4)] + [total[4:] > 0]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a binary column without nulls, as views of its buffers."""
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs_of(offsets: np.ndarray, most: int, rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """(first, last + 1) documents of at most ``most`` bytes and ``rows`` rows together; a longer one alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), first + rows, n)
        yield first, last
        first = last


def _scan(text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(text_at).cast(pa.binary()))
            for first, last in runs_of(offsets, CHUNK):
                own, part = offsets[first : last + 1] - offsets[first], data[offsets[first] : offsets[last]]
                found = _measure_long(part) if len(part) > CHUNK else measure(part, own)
                view = memoryview(part)
                digests = [hashlib.sha256(view[a:b]).digest() for a, b in zip(own[:-1].tolist(), own[1:].tolist(), strict=True)]
                kept = [batch.column(i).slice(first, last - first) for i in range(text_at)]
                arrays = [*kept, *map(pa.array, found), pa.array(digests, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names[:text_at], *MEASURES.names])

    return run


def text_measures(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``keep`` of every row with words, distinct_words, capitals, code_points (longs),
    has_symbol (boolean) and digest (SHA-256 of the UTF-8 text).

    Words are maximal runs of other than ASCII white space, and differ by case.  A null text counts as
    empty: zeros.  Repeated rows have a row each.  Columns of ``keep`` may not have a measure's name.
    """
    if clash := set(MEASURES.names) & {c.lower() for c in keep}:
        raise ValueError(f"columns {sorted(clash)} would clash with the result's")
    slim = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return map_arrow(slim, _scan(len(keep)), StructType([*slim.schema.fields[:-1], *MEASURES.fields]))


def earlier_copy(measured: DataFrame, order: str) -> DataFrame:
    """``measured`` with ``copied``: whether a row with a lesser ``order`` has the same text.

    A null order is neither less nor greater, and rows of one order aren't copies of each other.  The
    least of each text is counted map side and written, so that a text on very many rows is split.
    """
    least = materialize(measured.groupBy("digest").agg(F.min(order).alias("_least")), "least")
    joined = measured.join(least, "digest")
    return joined.withColumn("copied", F.coalesce(F.col(order) > F.col("_least"), F.lit(False))).drop("_least")


def fail_mask(filters: Mapping[str, Column]) -> Column:
    """The filters' failures as an int, the first one's as the lowest bit; null counts as passed."""
    bits = [F.when(fails, F.lit(1 << i)).otherwise(F.lit(0)) for i, fails in enumerate(filters.values())]
    return sum(bits[1:], bits[0]).cast("int")


def interactions(marked: DataFrame, names: str, mask: str = "mask", part: str = "part", good: str = "good", toxic: str = "toxic") -> DataFrame:
    """What filters named by single letters do to each part, in every order of them.

    ``marked`` has a row a document: its part, its mask of failures (``fail_mask`` of the filters in the
    order of ``names``) and two booleans.  The result has for each part, order (``filter_order``) and step
    (from 1, with the filter at that place) counts of documents:

    kept           pass this filter and all before it
    removed        fail this one and none before
    redundant      fail this one, and were removed before
    unique_fails   fail this one alone
    good_lost, toxic_lost  removed here, and good or toxic
    shapley        removed by this filter, at any step, summed over all orders

    A null part counts as the empty string, null booleans as false; a part without rows has none, and
    an empty table gives no rows.  At most MOST filters, since their orders are all told.
    """
    if not 1 <= len(names) <= MOST:
        raise ValueError(f"1 to {MOST} filters")
    orders = ["".join(p) for p in permutations(names)]
    bit = {c: 1 << i for i, c in enumerate(names)}
    steps = [(k, s) for k in range(len(orders)) for s in range(len(names))]
    own = [bit[orders[k][s]] for k, s in steps]
    before = [sum(bit[c] for c in orders[k][:s]) for k, s in steps]
    counts = marked.groupBy(F.coalesce(part, F.lit("")).alias("part"), F.col(mask).alias("mask")).agg(
        F.count("*").alias("n"), F.count_if(F.col(good)).alias("n_good"), F.count_if(F.col(toxic)).alias("n_toxic")
    )
    at = F.explode(F.sequence(F.lit(0), F.lit(len(steps) - 1))).alias("at")
    told = counts.select("*", at).select(
        "*", F.get(F.lit(own), F.col("at")).alias("own"), F.get(F.lit(before), F.col("at")).alias("before")
    )
    masked, n = F.col("mask"), F.col("n")
    fails, gone = masked.bitwiseAND(F.col("own")) != 0, masked.bitwiseAND(F.col("before")) != 0
    share = F.lit(math.factorial(len(names))).cast("long") / F.bit_count(masked)  # orders in which this filter comes first of those it fails
    total = lambda when, what=n: F.coalesce(F.sum(F.when(when, what)), F.lit(0)).cast("long")
    sums = told.groupBy("part", "at").agg(
        total(~fails & ~gone).alias("kept"),
        total(fails & ~gone).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(masked == F.col("own")).alias("unique_fails"),
        total(fails & ~gone, F.col("n_good")).alias("good_lost"),
        total(fails & ~gone, F.col("n_toxic")).alias("toxic_lost"),
        total(fails, n * share.cast("long")).alias("shapley"),
    )
    width = len(names)
    return sums.select(
        "part",
        F.get(F.lit(orders), (F.col("at") / width).cast("int")).alias("filter_order"),
        (F.col("at") % width + 1).cast("int").alias("step"),
        *[c for c in sums.columns if c not in ("part", "at")],
    )


def contract_filters() -> dict[str, Column]:
    """The five filters over the columns of ``text_measures`` and ``earlier_copy``, as failure conditions."""
    return {
        "A": F.col("words") < 100,
        "B": 100 * F.col("distinct_words") < 80 * F.col("words"),
        "C": 100 * F.col("capitals") > 10 * F.col("code_points"),
        "D": F.col("has_symbol"),
        "E": F.col("copied"),
    }


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``interactions`` of ``contract_filters`` on documents (doc_id, text, lang), by lang.

    Null texts count as empty, a null lang as the part ''; repeated rows count each, and are no copies
    of each other.  A doc_id with several labels counts as good (toxic) if any of them says so; without
    labels it is neither.  A null doc_id has no labels, and is no copy of a lesser one.
    """
    id_, lang = fresh(docs, "_id"), fresh(docs, "_lang")
    slim = docs.select(F.col("doc_id").alias(id_), F.col("lang").alias(lang), "text")
    measured = materialize(text_measures(slim, "text", (id_, lang)), "measures")
    told = labels.groupBy(F.col("doc_id").alias(id_)).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    filters = contract_filters()
    marked = earlier_copy(measured, id_).join(told, id_, "left").select(F.col(lang).alias("part"), fail_mask(filters).alias("mask"), "good", "toxic")
    return interactions(marked, "".join(filters))
