"""Exact Jaccard join of word shingle sets, as a join in a metric space.

The Jaccard distance is a metric, and so is the size of the symmetric difference.  Documents of a corpus
are at distance 1 from nearly all others, so pivots that are documents would tie for nearly all of them:
every document would stand on every boundary.  The join therefore takes pivots at three levels.

1. Single shingles.  A set is nearest to the shingles it holds.  All pivots have one order (shingles
   that are frequent in a sample last, then by hash), and the cell of a set is that of its first ones: a
   set of n within distance r of another lacks at most r * n of the other's, so the two have a shingle in
   common among the first floor(r * n) + 1 of each.  That window replicates each set to its cells.
2. Documents.  The cells of all shingles that have the same least set become the region of that set, its
   pivot, so a group of near copies is one region and not one for each shingle.  Regions are parted by
   distance from the empty set, which is a set's size: a set goes into the band of its size and the next
   one, as far as the triangle inequality lets a partner be.  A region that is still large is parted
   again, into blocks that are joined pair by pair.
3. Inside a block, first by sketches (shingles counted by buckets: the map to counts never lengthens a
   symmetric difference, so what is too far apart in counts is too far apart), which leaves the sets
   that have a possible partner; then by exact intersections of those, where distances from the first
   sets of the block cut out more pairs by the triangle inequality.

No step drops a pair that may be linked, and what is linked is counted exactly.  The sample of frequent
shingles changes the order of pivots, and so the sizes of regions, never a result.  A shingle stands by
its 64-bit hash, and equal sets by a 64-bit hash of theirs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkgraph.llm.common import map_arrow, materialize
from linkgraph.llm.components import connected_components
from linkgraph.llm.filters import text_buffer
from linkgraph.llm.simhash import SEED, _shingle_hashes

SHINGLE, PERCENT = 5, 80
#: Documents of the sample that tells frequent shingles, of which so many at most are broadcast, if in
#: so many documents of the sample.
SAMPLE, FREQUENT, OFTEN = 32_768, 1 << 18, 12
#: Sets of a block, and their shingles, at most; a block of two parts of a region holds twice as many.
CELL, LOAD = 1024, 1 << 21
#: Sets of a block whose distances from all others are kept to cut out pairs.
NEAR_PIVOTS = 8
_EMPTY = np.zeros(0, np.uint64)


def shingle_set(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes; with fewer words the whole sequence is one."""
    parts = [*_shingle_hashes(text, shingle, SEED)]
    return np.unique(np.concatenate(parts)) if parts else _EMPTY


def window(shingles: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles in the order of pivots, one more than a partner may lack."""
    size = len(shingles) - -(-percent * len(shingles) // 100) + 1
    if len(frequent):
        late = frequent[np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)] == shingles
        shingles = np.concatenate([shingles[~late], shingles[late][:size]])
    return shingles[:size]


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Shingles counted by their low bits, in a power of two of buckets, up to 255 a bucket: two to four a bucket."""
    buckets = max(8, 1 << math.ceil(math.log2(max(len(shingles), 1) / 4)) if len(shingles) > 4 else 8)
    return np.minimum(np.bincount((shingles & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets), 255).astype(np.uint8)


def set_id(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED + 1) - (1 << 63)


SETS = "row long, key long, hash long, n long, id long, sketch binary, pivots array<long>"


def _sets(shipped, shingle: int, percent: int):
    """Over (row, key, hash, text).  A set that a task has told before has no pivots again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, seen = shipped.value, set()
        for batch in batches:
            n, ids, sketches, pivots = [], [], [], []
            for text in batch.column(3).cast(pa.binary()):
                own = shingle_set(text.as_py(), shingle)
                x = set_id(own) if len(own) else None
                told = x is None or x in seen
                n.append(len(own))
                ids.append(x)
                sketches.append(None if told else sketch(own).tobytes())
                pivots.append(None if told else window(own, frequent, percent).view(np.int64))
                if not told and len(seen) < 1 << 20:
                    seen.add(x)
            arrays = [pa.array(n, pa.int64()), pa.array(ids, pa.int64()), pa.array(sketches, pa.binary()), pa.array(pivots, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *arrays], [c.split()[0] for c in SETS.split(", ")])

    return run


def frequent_shingles(docs: DataFrame, shingle: int = SHINGLE, sample: int = SAMPLE) -> np.ndarray:
    """The most frequent shingles of about ``sample`` documents (hash, text), FREQUENT at most, sorted."""
    rows = docs.count()
    parts = max(1, -(-rows // sample))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text.as_py(), shingle).view(np.int64))], ["s"])

    chosen = docs.where(F.pmod(F.xxhash64("row"), F.lit(parts)) == 0).select("text")
    counts = map_arrow(chosen, hashes, "s long").groupBy("s").count().where(F.col("count") >= OFTEN)
    found = counts.orderBy(F.desc("count"), "s").limit(FREQUENT).select("s").toArrow().column(0).to_numpy()
    return np.sort(found.view(np.uint64))


def _dealt(rows: DataFrame) -> DataFrame:
    """(region, band, id, n, ...) rows of at least two in region and band, dealt into blocks: with ``cell``,
    ``part`` and ``split`` (whether the block is of two parts, which then are compared with each other alone)."""
    sizes = rows.groupBy("region", "band").agg(F.count("*").alias("sets"), F.sum("n").alias("load")).where("sets > 1")
    parts = F.greatest(F.ceil(F.col("sets") / CELL), F.ceil(F.col("load") / LOAD)).cast("int")
    # written, so that adaptive execution can split the join at a large region
    dealt = rows.join(materialize(sizes.select("region", "band", parts.alias("parts")), "regions"), ["region", "band"])
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.least(own, k) * F.col("parts") + F.greatest(own, k))
    dealt = dealt.withColumn("cell", F.explode(others)).withColumn("part", own)
    split = F.floor(F.col("cell") / F.col("parts")) != F.col("cell") % F.col("parts")
    dealt = dealt.withColumn("split", split).drop("parts")
    return dealt.repartition("region", "band", "cell").sortWithinPartitions("region", "band", "cell")


class Block:
    """The distinct sets of a block, ordered by size.  ``of``: what each set holds (counts or hashes)."""

    def __init__(self, table: pa.Table):
        ids, first = np.unique(table.column("id").to_numpy(), return_index=True)
        n = table.column("n").to_numpy()[first]
        order = np.argsort(n, kind="stable")
        first = first[order]
        self.ids, self.n = ids[order], n[order]
        self.native, self.part = (table.column(c).to_numpy(zero_copy_only=False)[first] for c in ("native", "part"))
        self.split = table.column("split")[0].as_py()
        data, offsets = text_buffer(table.column("held").combine_chunks())
        self.of = [data[offsets[i] : offsets[i + 1]] for i in first.tolist()]

    def partners(self, i: int, percent: int) -> np.ndarray:
        """The later sets whose size allows a link with set ``i``, of those that this block has to compare."""
        last = int(np.searchsorted(self.n, self.n[i] * 100 // percent, "right"))
        j = np.arange(i + 1, last)
        if not self.native[i]:
            j = j[self.native[j]]
        return j[self.part[j] != self.part[i]] if self.split else j


def possible(block: Block, percent: int) -> np.ndarray:
    """Which sets have a partner that is near enough by the counts of their sketches."""
    buckets = min(map(len, block.of))
    counts = np.stack([x.reshape(-1, buckets).sum(axis=0, dtype=np.int32) for x in block.of])
    active = np.zeros(len(counts), bool)
    for i in range(len(counts) - 1):
        j = block.partners(i, percent)
        if active[i]:
            j = j[~active[j]]
        for at in range(0, len(j), 256):
            some = j[at : at + 256]
            apart = np.abs(counts[some] - counts[i]).sum(axis=1)
            near = some[(100 + percent) * apart <= (100 - percent) * (block.n[i] + block.n[some])]
            if len(near):
                active[i] = active[near] = True
    return active


def links(block: Block, percent: int) -> list[tuple[int, int]]:
    """Links that join what is linked within the block, as pairs of places."""
    size = len(block.of)
    sets = [x.view("<u8") for x in block.of]
    flat, owner = np.concatenate(sets), np.repeat(np.arange(size), block.n)
    order = np.argsort(flat, kind="stable")
    new = np.concatenate([[True], np.diff(flat[order]) != 0])
    begin = np.flatnonzero(new)
    many = np.diff(np.concatenate([begin, [len(flat)]]))
    column = np.empty(len(flat), np.int64)
    column[order] = np.cumsum(new) - 1
    owners, at = owner[order], np.concatenate([[0], np.cumsum(block.n)])
    label, kept, found = np.arange(size), [], []
    for i in range(size - 1):
        j = block.partners(i, percent)
        j = j[label[j] != label[i]]
        for distance in kept:
            j = j[np.abs(distance[j] - distance[i]) <= 1 - percent / 100 + 1e-9]
        if not len(j):
            continue
        own = column[at[i] : at[i + 1]]
        own = own[many[own] > 1]
        count = many[own]
        places = np.arange(count.sum()) - np.repeat(count.cumsum() - count, count) + np.repeat(begin[own], count)
        common = np.bincount(owners[places], minlength=size)
        common[i] = block.n[i]
        if len(kept) < NEAR_PIVOTS:
            kept.append(1 - common / (block.n + block.n[i] - common))
        linked = j[(100 + percent) * common[j] >= percent * (block.n[i] + block.n[j])]
        for other in linked.tolist():
            if label[other] != label[i]:
                label[label == label[other]] = label[i]
                found.append((i, other))
    return found


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """The blocks of rows sorted by region, band and cell, one at a time."""
    pending: list[pa.RecordBatch] = []

    def keys(table: pa.Table) -> np.ndarray:
        columns = [table.column(c).to_numpy() for c in ("region", "band", "cell")]
        return np.flatnonzero(np.logical_or.reduce([np.diff(c) != 0 for c in columns])) + 1

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*pending, batch])
        bounds = [0, *keys(table).tolist()]
        for s, e in zip(bounds[:-1], bounds[1:], strict=True):
            yield table.slice(s, e - s)
        pending = table.slice(bounds[-1]).combine_chunks().to_batches()
    if pending:
        yield pa.Table.from_batches(pending)


def _active(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches):
            block = Block(table)
            ids = block.ids[possible(block, percent)]
            if len(ids):
                same = [pa.array(np.full(len(ids), table.column(c)[0].as_py())) for c in ("region", "band")]
                yield pa.RecordBatch.from_arrays([*same, pa.array(ids)], ["region", "band", "id"])

    return run


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches):
            block = Block(table)
            if found := links(block, percent):
                a, b = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(block.ids[a]), pa.array(block.ids[b])], ["u", "v"])

    return run


def _again(shingle: int):
    """(id, held) of the sets of texts, each once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ids, sets = [], []
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                if id_ not in seen:
                    seen.add(id_)
                    ids.append(id_)
                    sets.append(shingle_set(text.as_py(), shingle).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["id", "held"])

    return run


def jaccard_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(key, n, class) of every row: the size of its shingle set, and the id of its class of linked sets.

    Two sets are linked if 100 * intersection >= ``percent`` * union.  A-Z are lower-cased and words parted
    at ASCII white space.  A null, empty or wordless text has n 0 and a null class, and is linked with
    nothing.  Repeated rows have a row each; rows with equal sets share a class; a null key is kept.
    """
    spark = docs.sparkSession
    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))
    frequent = spark.sparkContext.broadcast(frequent_shingles(slim, shingle))
    sets = materialize(map_arrow(slim, _sets(frequent, shingle, percent), SETS), "sets")

    # cells of shingles, and the regions they make up
    cells = sets.where("pivots is not null").select("id", F.explode("pivots").alias("s"))
    least = cells.groupBy("s").agg(F.min("id").alias("region"), F.max("id").alias("last")).where("region <> last")
    regions = cells.join(materialize(least.select("s", "region"), "cells"), "s").select("region", "id").distinct()

    # one row of each set, and its band
    first = sets.where("sketch is not null").groupBy("id").agg(F.min("row").alias("row"))
    one = materialize(sets.join(first.select("row"), "row", "left_semi").select("id", "key", "hash", "n", "sketch"), "one")
    band = F.floor(F.log("n") / F.lit(math.log(100 / percent) * (1 + 1e-6))).cast("long") if percent < 100 else F.col("n")
    placed = regions.join(one.select("id", "n", F.col("sketch").alias("held"), band.alias("own")), "id")
    placed = placed.select("*", F.explode(F.array("own", F.col("own") + 1)).alias("band")).withColumn("native", F.col("own") == F.col("band")).drop("own")
    active = map_arrow(_dealt(placed), _active(percent), "region long, band long, id long").distinct()
    active = materialize(active, "active")

    # the whole sets of what has a possible partner
    wanted = active.select("id").distinct().join(one.select("id", "key", "hash"), "id")
    texts = slim.join(wanted.select("id", F.col("key").alias("_key"), F.col("hash").alias("_hash")), (F.col("hash") == F.col("_hash")) & F.col("key").eqNullSafe(F.col("_key")))
    whole = map_arrow(texts.select("id", "text"), _again(shingle), "id long, held binary")
    bands = one.select("id", "n", band.alias("own"))
    placed = active.join(bands, "id").withColumn("native", F.col("own") == F.col("band")).drop("own")
    placed = placed.join(whole, "id")
    pairs = map_arrow(_dealt(placed), _linked(percent), "u long, v long")
    classes = materialize(connected_components(pairs), "classes")

    some = sets.where("id is not null").select("key", "n", "id").join(classes, sets.id == classes.node, "left")
    found = some.select("key", "n", F.coalesce("component", "id").alias("class"))
    return found.unionByName(sets.where("id is null").select("key", "n", F.lit(None).cast("long").alias("class")))


def jaccard_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id that links reach) of every row.

    A wordless document is its own component.  A null doc_id is never a component_id unless its class has
    no other.  Nulls, repeats and odd texts are as in ``jaccard_classes``.
    """
    found = materialize(jaccard_classes(docs), "found")
    of_class = found.where("class is not null")
    # written, so that adaptive execution can split the join where a class has very many rows
    least = materialize(of_class.groupBy("class").agg(F.min("key").alias("component_id")), "least")
    some = of_class.join(least, "class").select("key", "n", "component_id")
    alone = found.where("class is null").select("key", "n", F.col("key").alias("component_id"))
    return some.unionByName(alone).select(F.col("key").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")
