"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its nearest pivots.  Each pivot has an inverted file of the
vectors that list it among their first POSTED.  A query reads the files of its own nearest LISTS
pivots alone, ranks the vectors in them by Spearman's footrule between the two orders, where a pivot
that isn't listed counts as rank ``depth``, and reranks the nearest by the exact measure.

With permutations of ``depth`` ranks, footrule = depth * (depth + 1) - 2 * sum over shared pivots of
(depth - max(rank, rank')), so that a sum over the shared pivots is enough.

The index is a table of blocks of vectors, each with its inverted files, written once: queries come in
blocks of bounded size, broadcast in turn, and each task reads the files of its own blocks.  Vectors of
one length make an index of their own, since a cosine needs equal lengths.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkgraph.llm.common import map_arrow, materialize, partitions_for

#: Pivots (a fixed sample of distinct vectors, by a hash of vec_id); ranks that are kept of each vector;
#: ranks that are posted, and lists that a query reads; share of a block's distinct orders that is
#: reranked; vectors that pivots are sought among.
PIVOTS, DEPTH, POSTED, LISTS, SHARE, SAMPLE = 1024, 64, 24, 24, 0.1, 4096
#: Cosine from which a vector is too near to a chosen pivot to be one.
APART = 0.8
#: Rows of an index block and queries of a broadcast at most, and the bytes of their vectors.
BLOCK, QUERIES, BYTES = 8192, 4096, 32 << 20
#: Bytes of vectors in a partition of the index.
PARTITION = 64 << 20


def valid_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """row, key, vector: the rows that take part, numbered and written once.

    Out go null keys, null and empty vectors, vectors with a null, infinite or NaN component, and zero
    vectors.  Rows that share a key are candidates and queries each for itself.
    """
    v = F.col("vector")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.where("key is not null and vector is not null and size(vector) > 0")
    rows = rows.where(F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0))
    return materialize(rows.select(F.monotonically_increasing_id().alias("row"), "key", "vector"), "vectors")


def choose_pivots(vectors: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE, apart: float = APART) -> np.ndarray:
    """Unit pivots among the ``sample`` vectors that a hash puts first: in that order, each whose
    cosine with all chosen before is below ``apart``, so that a group of near copies gives one; if
    those don't suffice, the rejected ones that are least near to them follow."""
    rows = vectors.orderBy(F.xxhash64("key"), "key", "row").limit(sample).collect()
    if not rows:
        return np.zeros((0, 0))
    units = np.array([r.vector for r in rows])
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    _, first = np.unique(np.round(units, 6), axis=0, return_index=True)
    units = units[np.sort(first)]
    closest = np.full(len(units), -1.0)
    chosen: list[int] = []
    for i in range(len(units)):
        if len(chosen) == pivots:
            break
        if closest[i] < apart:
            chosen.append(i)
            closest = np.maximum(closest, units @ units[i])
    rest = [i for i in np.argsort(closest, kind="stable").tolist() if i not in set(chosen)]
    return units[chosen + rest[: pivots - len(chosen)]]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def permutations(vectors: np.ndarray, pivots: np.ndarray, depth: int) -> np.ndarray:
    """The ``depth`` nearest pivots of each vector by cosine, nearest first, ties to the first pivot."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.argsort(-np.round(unit @ pivots.T, 12), axis=1, kind="stable")[:, :depth].astype(np.int16)


class InvertedFiles:
    """The postings of a block of orders: for each pivot the orders that have it among their first ones."""

    def __init__(self, rows: np.ndarray, begin: np.ndarray):
        self.rows, self.begin = rows, begin

    @classmethod
    def build(cls, orders: np.ndarray, pivots: int, posted: int) -> InvertedFiles:
        flat = orders[:, :posted].ravel()
        by = np.argsort(flat, kind="stable")
        return cls((by // min(posted, orders.shape[1])).astype(np.int32), np.searchsorted(flat[by], np.arange(pivots + 1)).astype(np.int32))

    def read(self, lists: np.ndarray) -> np.ndarray:
        """The postings of some pivots; an order stands there once for each of them that it has."""
        return np.concatenate([self.rows[self.begin[p] : self.begin[p + 1]] for p in lists.tolist()])


def shared_ranks(orders: np.ndarray, order: np.ndarray, pivots: int) -> np.ndarray:
    """For each of ``orders`` the sum of depth - max(rank, rank') over the pivots shared with ``order``."""
    depth = len(order)
    rank = np.full(pivots, depth, np.int16)
    rank[order] = np.arange(depth)
    return (depth - np.maximum(rank[orders], np.arange(depth, dtype=np.int16))).sum(axis=1, dtype=np.int32)


INDEX = "n int, rows binary, keys binary, vectors binary, which binary, orders binary, posts binary, begin binary"
TYPES = (np.int64, np.int64, np.float64, np.int32, np.int16, np.int32, np.int32)


def build_index(vectors: DataFrame, pivots: np.ndarray, depth: int = DEPTH, posted: int = POSTED) -> DataFrame:
    """A row for each block of vectors of one length: row numbers, keys, vectors, the distinct orders and
    the order of each vector (copies have one, and it counts once), and the inverted files; written once."""
    depth = min(depth, len(pivots))
    size = max(64, min(BLOCK, BYTES // (8 * pivots.shape[1])))

    def block(table: pa.Table) -> pa.RecordBatch:
        row, key, vector = (table.column(i).combine_chunks() for i in range(3))
        vector = _matrix(vector)
        orders, which = np.unique(permutations(vector, pivots, depth), axis=0, return_inverse=True)
        files = InvertedFiles.build(orders, len(pivots), posted)
        arrays = (row.to_numpy(), key.to_numpy(), vector, which, orders, files.rows, files.begin)
        packed = [pa.array([np.ascontiguousarray(x, t).tobytes()], pa.binary()) for x, t in zip(arrays, TYPES, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([table.num_rows], pa.int32()), *packed], [c.split()[0] for c in INDEX.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            while rows >= size:
                table = pa.Table.from_batches(held)
                yield block(table.slice(0, size))
                rows -= size
                held = table.slice(size).to_batches()
        if rows:
            yield block(pa.Table.from_batches(held))

    dealt = vectors.repartition(partitions_for(vectors, PARTITION), "row")
    return materialize(map_arrow(dealt, run, INDEX), "index")


def _search(shipped, k: int, pivots: int, lists: int, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, keys, queries, query_orders = shipped.value
        norms = np.sqrt((queries * queries).sum(axis=1))
        best: list[list[tuple[float, int, int]]] = [[] for _ in keys]
        for batch in batches:
            for at in range(batch.num_rows):
                n = batch.column(0)[at].as_py()
                row, key, vector, which, orders, posts, begin = (np.frombuffer(batch.column(i + 1)[at].as_buffer(), t) for i, t in enumerate(TYPES))
                vector, orders = vector.reshape(n, -1), orders.reshape(-1, query_orders.shape[1])
                norm = np.sqrt((vector * vector).sum(axis=1))
                files = InvertedFiles(posts, begin)
                wanted = max(k + 1, int(np.ceil(share * len(orders))))
                for q in range(len(keys)):
                    found = np.zeros(len(orders), bool)
                    found[files.read(query_orders[q, :lists])] = True
                    some = np.flatnonzero(found)
                    if len(some) > wanted:
                        shared = shared_ranks(orders[some], query_orders[q], pivots)
                        cut = np.partition(shared, len(some) - wanted)[len(some) - wanted]
                        found[some[shared < cut]] = False  # all that tie at the cut stay
                    # a block whose lists hold too few, or a whole rerank, is read in full
                    near = np.flatnonzero(found[which]) if share < 1 else np.arange(n)
                    near = near if len(near) > k else np.arange(n)
                    near = near[row[near] != numbers[q]]
                    score = (vector[near] * queries[q]).sum(axis=1) / (norm[near] * norms[q])
                    first = np.lexsort((row[near], key[near], -score))[:k]
                    best[q] = sorted([*best[q], *((-score[i], int(key[near[i]]), int(row[near[i]])) for i in first.tolist())])[:k]
        found = [(int(numbers[q]), int(keys[q]), i, r, -s) for q, rows in enumerate(best) for s, i, r in rows]
        columns = list(zip(*found, strict=True)) or [()] * 5
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], FOUND_NAMES)

    return run


FOUND = "query_row long, query_id long, vec_id long, row long, score double"
FOUND_NAMES = [c.split()[0] for c in FOUND.split(", ")]


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 5, pivots: int = PIVOTS, depth: int = DEPTH, posted: int = POSTED, lists: int = LISTS, share: float = SHARE
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found by cosine, ties to the lesser vec_id.

    ``vectors`` and ``queries`` come from valid_vectors; a query's own row is left out, others with its
    key are not, and vectors of another length are no candidates.  Rows that share a key are queries each.
    ``share`` is the part of a block's distinct orders that is reranked at most, all ties at its edge
    included; of the others only postings and orders are read.  The queries are dealt into blocks of
    QUERIES or so by hash; a block is collected, broadcast, searched, and its result written before the
    next, so that one alone is on the driver.
    """
    spark = vectors.sparkSession
    parts = []
    for r in queries.groupBy(F.size("vector").alias("length")).count().orderBy("length").collect():
        of_length = F.size("vector") == r.length
        own = vectors.where(of_length)
        centers = choose_pivots(own, pivots)
        index = build_index(own, centers, depth, posted)
        blocks = -(-r["count"] // max(64, min(QUERIES, BYTES // (8 * r.length))))
        for block in range(blocks):
            rows = queries.where(of_length & (F.pmod(F.xxhash64("row"), F.lit(blocks)) == block)).orderBy("row").collect()
            if not rows:
                continue
            asked = np.array([q.vector for q in rows])
            order = permutations(asked, centers, min(depth, len(centers)))
            shipped = spark.sparkContext.broadcast((np.array([q.row for q in rows]), np.array([q.key for q in rows]), asked, order))
            parts.append(materialize(map_arrow(index, _search(shipped, k, len(centers), lists, share), FOUND), "nearest"))
            shipped.destroy()
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    found = reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(order))
    return found.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
