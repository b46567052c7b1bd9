"""Ranked lexical search by a two-level quantised index.

The index has a row for each block of documents, and in it inverted lists of all terms of the block.
Its first level holds every posting's impact in one byte, rounded upwards; its second level holds what
the exact impact is made of: occurrences and lengths.  A search adds up weights times bytes, which
gives every document an upper bound, and a lower bound by what rounding can have added.  Each document
whose upper bound reaches the k-th lower bound (or the k-th exact score, once there is one) is scored
again in exact integers from the second level; the others cannot be among the k first.

Blocks of documents share nothing, so neither index nor search shuffles postings, and a term of every
document is a list of bounded length in each block.  A task returns its k best of each item.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from linkgraph.llm.common import map_arrow, materialize
from linkgraph.llm.filters import CHUNK, runs_of, same_bytes, text_buffer, word_bounds, word_hashes

#: Best documents of an item; documents of a block at most.
BEST, DOCUMENTS = 50, 8192
#: (item, term) rows of a broadcast at most, but for an item that has more alone; items scored side by side.
ASKED, SIDE = 1 << 18, 128
#: The exact impact is below a million, so bytes stand for steps of this size.
STEP = -(-1_000_000 // 255)
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Which bytes are part of a term, and each byte with A-Z lower-cased."""
    inside = np.zeros(256, bool)
    inside[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
    lower = np.arange(256, dtype=np.uint8)
    lower[0x41:0x5B] += 32
    return inside, lower


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The exact impact of ``tf`` occurrences in a document of normal ``m``, below a million."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def normal(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """m of documents of ``n`` terms, where ``documents`` have ``terms`` together."""
    return 100 - 50 + (50 * n * documents) // terms


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _counted(pieces: Iterator[bytes]) -> Counter:
    counts: Counter = Counter()
    for piece in pieces:
        counts.update(_TERM.findall(piece.lower()))
    return counts


def _pieces(text: bytes) -> Iterator[bytes]:
    """A text in pieces of about CHUNK bytes, cut between terms."""
    at, between = 0, re.compile(rb"[^0-9A-Za-z\x80-\xff]")
    while at < len(text):
        cut = between.search(text, min(at + CHUNK, len(text)))
        stop = cut.start() if cut else len(text)
        yield text[at:stop]
        at = stop


def postings(data: np.ndarray, offsets: np.ndarray, hashes=word_hashes) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """(terms, begin, documents, occurrences) of the texts at ``offsets``: the postings of term i stand at
    begin[i] to begin[i + 1], by document."""
    inside, lower = _tables()
    if len(data) > CHUNK:  # one long text
        counts = _counted(_pieces(data.tobytes()))
        return [*counts], np.arange(len(counts) + 1), np.zeros(len(counts), np.int64), np.array([*counts.values()], np.int64)
    data = lower[data]
    doc, start, end = word_bounds(data, offsets, inside[data])
    hashed = hashes(data, start, end)
    order = np.lexsort((doc, hashed))
    doc, start, length, hashed = doc[order], start[order], (end - start)[order], hashed[order]
    equal = hashed[1:] == hashed[:-1]
    again = np.flatnonzero(equal) + 1
    fits = length[again] == length[again - 1]
    if not fits.all() or not same_bytes(data, start[again], start[again - 1], length[again]).all():
        return _plain_postings(data, offsets)  # two terms with one hash
    first = np.concatenate([[True], ~equal]) if len(doc) else np.zeros(0, bool)
    fresh_doc = first | np.concatenate([[True], doc[1:] != doc[:-1]]) if len(doc) else first
    at = np.flatnonzero(fresh_doc)
    tf = np.diff(np.concatenate([at, [len(doc)]]))
    begin = np.concatenate([np.flatnonzero(first[at]), [len(at)]])
    raw = data.tobytes()
    terms = [raw[s : s + n] for s, n in zip(start[first].tolist(), length[first].tolist(), strict=True)]
    return terms, begin, doc[at], tf


def _plain_postings(data: np.ndarray, offsets: np.ndarray):
    found: dict[bytes, list[tuple[int, int]]] = {}
    for i in range(len(offsets) - 1):
        for term, tf in _counted(iter([data[offsets[i] : offsets[i + 1]].tobytes()])).items():
            found.setdefault(term, []).append((i, tf))
    lists = [*found.values()]
    flat = np.array([p for one in lists for p in one], np.int64).reshape(-1, 2)
    return [*found], np.concatenate([[0], np.cumsum([len(one) for one in lists])]).astype(np.int64), flat[:, 0], flat[:, 1]


def _blocks(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = text_buffer(batch.column(at).cast(pa.binary()))
    for first, last in runs_of(offsets, CHUNK, DOCUMENTS):
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a task: documents with a term, and all terms."""
    inside, _ = _tables()
    documents = terms = 0
    for batch in batches:
        for _, _, data, offsets in _blocks(batch, 0):
            doc, _, _ = word_bounds(data, offsets, inside[data])
            documents += len(np.unique(doc))
            terms += len(doc)
    yield pa.RecordBatch.from_arrays([pa.array([documents]), pa.array([terms])], ["documents", "terms"])


INDEX = "documents int, ids binary, known binary, terms array<binary>, begin binary, docs binary, impacts binary, tf binary, lengths binary"


def _index(documents: int, terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in _blocks(batch, 1):
                names, begin, doc, tf = postings(data, offsets)
                n = np.bincount(doc, tf, minlength=last - first).astype(np.int64)
                coarse = -(-impact(tf, normal(n, documents, terms)[doc]) // STEP)
                ids = batch.column(0).slice(first, last - first)
                known = np.array(ids.is_valid())
                arrays = ((ids.fill_null(0).to_numpy(), "<i8"), (known, bool)), ((begin, "<i4"), (doc, "<u2"), (coarse, "u1"), (tf, "<i4"), (n, "<i8"))
                left, right = ([pa.array([np.ascontiguousarray(x, t).tobytes()], pa.binary()) for x, t in part] for part in arrays)
                columns = [pa.array([last - first], pa.int32()), *left, pa.array([names], pa.list_(pa.binary())), *right]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in INDEX.split(", ")])

    return run


@dataclass(frozen=True)
class Index:
    """``rows``: a row a block (INDEX); ``documents`` hold at least one term, and ``terms`` in all."""

    rows: DataFrame
    documents: int
    terms: int


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    """The index of all rows of ``docs``, written once in the shared folder.

    One pass counts documents and terms, on which impacts depend; a second one makes the blocks.  A null
    text has no term.  Repeated rows are documents each; a document without an id can be found, with a
    null id.
    """
    slim = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = map_arrow(slim.select("text"), _lengths, "documents long, terms long").agg(F.sum("documents").alias("d"), F.sum("terms").alias("t")).first()
    documents, terms = total.d or 0, total.t or 0
    return Index(materialize(map_arrow(slim, _index(documents, max(terms, 1)), INDEX), "lexical"), documents, terms)


def _frequencies(shipped):
    """One row for each of the asked terms that a task's blocks hold: how many documents do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shipped.value
        df = np.zeros(len(asked), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                at = pc.index_in(asked, value_set=batch.column(0)[row].values).fill_null(-1).to_numpy()
                begin = np.frombuffer(batch.column(1)[row].as_buffer(), "<i4")
                held = np.flatnonzero(at >= 0)
                df[held] += np.diff(begin)[at[held]]
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(df[held])], ["term", "df"])

    return run


class Asked:
    """Items and their terms: numbers of the terms by item, and numbers of the items by term."""

    def __init__(self, pairs: list[tuple]):
        self.items = list(dict.fromkeys(i for i, _ in pairs))
        terms = list(dict.fromkeys(t for _, t in pairs))
        self.terms = pa.array(map(bytes, terms), pa.binary())
        item_at, term_at = {x: n for n, x in enumerate(self.items)}, {x: n for n, x in enumerate(terms)}
        flat = np.array([(item_at[i], term_at[t]) for i, t in pairs], np.int64).reshape(-1, 2)
        item, term = flat[np.lexsort((flat[:, 1], flat[:, 0]))].T
        self.of_item = np.split(term, np.searchsorted(item, np.arange(1, len(self.items))))
        item, term = flat[np.lexsort((flat[:, 0], flat[:, 1]))].T
        self.of_term = np.split(item, np.searchsorted(term, np.arange(1, len(terms))))
        self.weights = np.zeros(len(terms), np.int64)


class Block:
    """A row of the index, and the two levels of it for some terms."""

    def __init__(self, row: list[pa.Scalar], documents: int, terms: int):
        view = lambda i, t: np.frombuffer(row[i].as_buffer(), t)
        self.size, self.ids, self.known, self.terms = row[0].as_py(), view(1, "<i8"), view(2, bool), row[3].values
        self.begin, self.docs, self.coarse, self.tf = view(4, "<i4"), view(5, "<u2"), view(6, "u1"), view(7, "<i4")
        self.normal = normal(view(8, "<i8"), documents, terms)

    def bounds(self, at: np.ndarray, asked: Asked, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """(upper, lower) bounds of all scores of the items ``first`` to ``last``, from the first level."""
        total, most = np.zeros((last - first, self.size), np.int64), np.zeros(last - first, np.int64)
        for term in np.flatnonzero((at >= 0) & (asked.weights > 0)).tolist():
            items = asked.of_term[term]
            items = items[np.searchsorted(items, first) : np.searchsorted(items, last)] - first
            if len(items):
                s, e = self.begin[at[term]], self.begin[at[term] + 1]
                total[items[:, None], self.docs[s:e]] += asked.weights[term] * self.coarse[s:e].astype(np.int64)
                most[items] += asked.weights[term]
        upper = STEP * total
        return upper, np.maximum(upper - (STEP - 1) * most[:, None], 0)

    def exact(self, terms: np.ndarray, weights: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The scores of the documents ``wanted``, from the second level."""
        start, stop = self.begin[terms], self.begin[terms + 1]
        count = (stop - start).astype(np.int64)
        at = np.arange(count.sum()) - np.repeat(count.cumsum() - count, count) + np.repeat(start, count)
        place = np.full(self.size, -1)
        place[wanted] = np.arange(len(wanted))
        where, each = place[self.docs[at]], np.repeat(weights, count)
        at, each, where = at[where >= 0], each[where >= 0], where[where >= 0]
        scores = np.zeros(len(wanted), np.int64)
        np.add.at(scores, where, each * impact(self.tf[at].astype(np.int64), self.normal[self.docs[at]]))
        return scores


def _search(shipped, documents: int, terms: int, k: int, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: Asked = shipped.value
        none = (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))
        best = [none] * len(asked.items)
        for batch in batches:
            for row in range(batch.num_rows):
                block = Block([c[row] for c in batch.columns], documents, terms)
                at = pc.index_in(asked.terms, value_set=block.terms).fill_null(-1).to_numpy()
                for first in range(0, len(asked.items), SIDE):
                    last = min(first + SIDE, len(asked.items))
                    upper, lower = block.bounds(at, asked, first, last)
                    least = np.ones(last - first, np.int64)  # only scores above 0 count
                    if block.size >= k:
                        least = np.maximum(least, np.partition(lower, block.size - k, axis=1)[:, block.size - k])
                    least = np.maximum(least, [best[i][0][-1] if len(best[i][0]) == k else 1 for i in range(first, last)])
                    reached = upper >= least[:, None]
                    for item in np.flatnonzero(reached.any(axis=1)).tolist():
                        wanted = np.flatnonzero(reached[item])
                        own = asked.of_item[first + item]
                        own = own[at[own] >= 0]
                        score = block.exact(at[own], asked.weights[own], wanted)
                        parts = zip(best[first + item], (score, block.known[wanted], block.ids[wanted]), strict=True)
                        score, known, ids = (np.concatenate(p) for p in parts)
                        order = np.lexsort((ids, ~known, -score))[:k]
                        order = order[score[order] > 0]
                        best[first + item] = score[order], known[order], ids[order]
        rows = [(asked.items[i], d if known else None, s) for i, found in enumerate(best) for s, known, d in zip(*(x.tolist() for x in found), strict=True)]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind, pa.int64(), pa.int64()), strict=True)], ["item_id", "doc_id", "score"])

    return run


def search(index: Index, items: DataFrame, key: str = "item_id", text: str = "text", k: int = BEST) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's ``k`` documents of the highest scores above 0,
    equal scores by ascending doc_id (a null one last).

    An item's terms count once each, whatever number of rows has its key; a null text has none, and an
    item without a term that documents hold has no rows.  Items are dealt into blocks of ASKED
    (item, term) rows or so by hash; one at a time is collected, broadcast and searched, over all rows of
    the index.
    """
    spark = items.sparkSession
    kind = items.schema[key].dataType
    own = items.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in _blocks(batch, 1):
                names, begin, doc, _ = postings(data, offsets)
                keys = batch.column(0).slice(first, last - first).take(pa.array(doc))
                named = pa.array(names, pa.binary()).take(pa.array(np.repeat(np.arange(len(names)), np.diff(begin))))
                yield pa.RecordBatch.from_arrays([keys, named], ["key", "term"])

    pairs = materialize(map_arrow(own, terms_of, StructType([StructField("key", kind)]).add("term", "binary")).distinct(), "asked")
    blocks = -(-pairs.count() // ASKED)
    out = StructType([StructField("item_id", kind), StructField("doc_id", LongType()), StructField("score", LongType())])
    found = []
    for block in range(blocks if index.documents else 0):
        rows = pairs.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == block).orderBy("key", "term").collect()
        if not rows:
            continue
        asked = Asked([(r.key, bytes(r.term)) for r in rows])
        names = spark.sparkContext.broadcast(asked.terms)
        counts = map_arrow(index.rows.select("terms", "begin"), _frequencies(names), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
        for r in counts.collect():  # a row a term of this block of items
            asked.weights[r.term] = weight(index.documents, r.df)
        names.destroy()
        shipped = spark.sparkContext.broadcast(asked)
        rows = map_arrow(index.rows, _search(shipped, index.documents, index.terms, k, to_arrow_type(kind)), out)
        found.append(materialize(rows, "ranked"))
        shipped.destroy()
    if not found:
        return spark.createDataFrame([], StructType([out[0], StructField("rank", IntegerType()), out[1], out[2]]))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def ranked_report(docs: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """``search`` of all ``items`` (item_id, text) in the index of all ``docs`` (doc_id, text).

    Nulls, repeats and ties are as there and in ``build_index``; an empty table on either side gives no rows.
    """
    return search(build_index(docs), items, k=k)
