"""Semantic edges: notes whose vectors have a cosine of at least a threshold, all of them and no others.

The angle between vectors is a metric.  Each vector belongs to the nearest of a few pivots, and the members of
a pivot's region are cut into blocks.  Two blocks make a cell, and a vector is in it if it is within the other
region's radius and ``limit`` of its pivot: by the triangle inequality, no other has a near one there.  So a
vector is copied to as many cells as there are blocks in its reach.  Inside a cell the pairs are cut down twice
before they are measured: by the angles to a pivot, which differ by ``limit`` at most, and by the leading
coordinates on a basis along the pivots, whose product and the product of what they leave out bound the cosine.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkgraph.sources.shared import written

#: Vectors of a sample, pivots that are chosen from it at most, and members of a region for each of them.
SAMPLE, PIVOTS, EACH = 4096, 64, 4096
#: Vectors of a block (a cell holds twice as many), coordinates that are looked at first, rows at a time.
CELL, LEADING, ROWS = 8192, 24, 256
#: Pairs that are measured at a time; where the bound leaves over SOME of the pairs, products decide instead.
MEASURED, SOME = 1 << 16, 0.75
SLACK = 1e-9


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: not null, without null or non-finite components, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def directions(vectors: np.ndarray) -> np.ndarray:
    """Vectors at length 1; scaled before, so that squares of very small or large ones don't leave the doubles."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def farthest(units: np.ndarray, most: int) -> np.ndarray:
    """Vectors of a sample, each the farthest from those before, beginning with the first."""
    chosen, closest = [0], units @ units[0]
    while len(chosen) < min(most, len(units)):
        chosen.append(int(np.argmin(closest)))
        closest = np.maximum(closest, units @ units[chosen[-1]])
    return units[chosen]


def basis(pivots: np.ndarray) -> np.ndarray:
    """An orthonormal basis whose first directions span the pivots."""
    size = pivots.shape[1]
    return np.linalg.qr(np.concatenate([pivots[:size].T, np.eye(size)], axis=1))[0][:, :size]


def near_pairs(units: np.ndarray, angles: np.ndarray, part: np.ndarray, split: bool, axes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, int]:
    """(places, places, measured): the pairs of a cell whose cosine is at least the threshold, of unlike parts if it
    is ``split``, and how many pairs were measured in all their coordinates."""
    order = np.argsort(angles, kind="stable")
    turned = units[order] @ axes
    lead, rest = turned[:, :LEADING], np.sqrt(np.maximum((turned[:, LEADING:] ** 2).sum(axis=1), 0))
    units, angles, part = units[order], angles[order], part[order]
    last = np.searchsorted(angles, angles + math.acos(min(1.0, threshold)) + SLACK, "right")
    left, right, measured = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    # products of single floats first: an error of 2^-24 for each coordinate at most, and as much for its rounding
    single, slack, dense = units.astype(np.float32), SLACK + 4 * units.shape[1] * 2.0**-24, False
    for at in range(0, len(units), ROWS):
        stop = min(at + ROWS, len(units))
        end = int(last[stop - 1])
        if dense:
            near = single[at:stop] @ single[at:end].T >= np.float32(threshold - slack)
        else:
            near = lead[at:stop] @ lead[at:end].T + rest[at:stop, None] * rest[None, at:end] >= threshold - SLACK
            dense = np.count_nonzero(near) > SOME * near.size
        i, j = np.divmod(np.flatnonzero(near), end - at)
        i, j = i + at, j + at
        some = (i < j) & (j < last[i])
        if split:
            some &= part[i] != part[j]
        i, j = i[some], j[some]
        measured += near.size if dense else len(i)
        if not dense and len(i) > MEASURED:  # the bound cuts out little here: one product, and what it leaves is measured again
            near = (units[at:stop] @ units[at:end].T)[i - at, j - at] >= threshold - SLACK
            i, j = i[near], j[near]
        for k in range(0, len(i), MEASURED):
            a, b = i[k : k + MEASURED], j[k : k + MEASURED]
            near = (units[a] * units[b]).sum(axis=1) >= threshold
            left.append(order[a[near]])
            right.append(order[b[near]])
    return np.concatenate(left), np.concatenate(right), measured


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column's values in doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float)


def _of_length(vectors: DataFrame, length: int, rows: int, threshold: float) -> DataFrame:
    """(source, target) of the usable vectors of one length."""
    limit = math.acos(min(1.0, threshold)) + SLACK
    parts = max(1, -(-rows // SAMPLE))
    drawn = vectors.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == 0).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    sample = np.array([r.vector for r in drawn or vectors.limit(1).collect()], float)
    pivots = farthest(directions(sample), max(1, min(PIVOTS, rows // EACH)))
    axes = basis(pivots)

    def place(batches):
        """Each vector with its angles to all pivots."""
        for batch in batches:
            if batch.num_rows:
                angles = np.arccos(np.clip(directions(_matrix(batch.column(1))) @ pivots.T, -1, 1))
                arrays = [batch.column(0), pa.array(angles.argmin(axis=1)), batch.column(1), pa.array([*angles])]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "home", "vector", "angles"])

    kinds = [vectors.schema[c].dataType.simpleString() for c in ("id", "vector")]
    placed = written(vectors.mapInArrow(place, f"id {kinds[0]}, home long, vector {kinds[1]}, angles array<double>"), "placed")
    homes = placed.groupBy("home").agg(F.max(F.get("angles", F.col("home").cast("int"))).alias("radius"), F.count("*").alias("n")).orderBy("home").collect()  # a row a pivot
    region_of = [r.home for r in homes for _ in range(-(-r.n // CELL))]
    blocks, first = len(region_of), {r.home: region_of.index(r.home) for r in homes}
    of_pivot = lambda told, other: F.lit([told.get(k, other) for k in range(len(pivots))])
    reach = of_pivot({r.home: float(r.radius + limit) for r in homes}, -10.0)
    home, region = F.col("home").cast("int"), F.lit([int(k) for k in region_of])
    parts = F.get(of_pivot({r.home: -(-r.n // CELL) for r in homes}, 1), home)
    own = (F.get(of_pivot(first, 0), home) + F.pmod(F.xxhash64("id"), parts)).cast("int").alias("block")
    within = lambda b: (b == F.col("block")) | (F.get("angles", F.get(region, b)) <= F.get(reach, F.get(region, b)))
    others = F.filter(F.sequence(F.lit(0), F.lit(blocks - 1)), within)
    dealt = placed.select("id", "vector", "angles", own).select("*", F.explode(others).alias("other"))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    dealt = dealt.select((low.cast("bigint") * blocks + high).alias("cell"), "id", "vector", F.get("angles", F.get(region, high)).alias("angle"), "block")

    def compare(table: pa.Table) -> pa.Table:
        cell, angle, block = table.column("cell")[0].as_py(), table.column("angle").to_numpy(), table.column("block").to_numpy()
        a, b, _ = near_pairs(directions(_matrix(table.column("vector").combine_chunks())), angle, block, cell // blocks != cell % blocks, axes, threshold)
        ids = table.column("id").combine_chunks()
        return pa.table({"source": ids.take(pa.array(a)), "target": ids.take(pa.array(b))})

    return dealt.groupBy("cell").applyInArrow(compare, f"source {kinds[0]}, target {kinds[0]}")


def semantic_edges(vectors: DataFrame, threshold: float, key: str = "id", vector: str = "vector") -> DataFrame:
    """(source, target, type, tagName) of every two rows whose vectors have a cosine of ``threshold`` (above 0) or
    more; the lesser id is the source.

    Vectors without a direction (``usable``) and rows without an id have no edges, and vectors of different
    lengths none with each other.  Rows that share an id have none with each other, and an edge once.
    """
    if not 0 < threshold <= 1:
        raise ValueError("a threshold above 0, up to 1")
    single = vectors.schema[vector].dataType.simpleString() == "array<float>"  # half of what is copied to cells
    value = F.col(vector) if single else F.col(vector).cast("array<double>")
    slim = vectors.select(F.col(key).alias("id"), value.alias("vector")).where(F.col("id").isNotNull() & usable(F.col("vector")))
    found = [_of_length(slim.where(F.size("vector") == r.length), r.length, r["count"], threshold) for r in slim.groupBy(F.size("vector").alias("length")).count().orderBy("length").collect()]
    kind = slim.schema["id"].dataType.simpleString()
    pairs = slim.sparkSession.createDataFrame([], f"source {kind}, target {kind}")
    for part in found:
        pairs = pairs.unionByName(part)
    ends = pairs.where("source <> target").select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"))
    # every two rows meet in one cell, so a pair comes again only where rows share an id
    if not slim.groupBy("id").count().where("count > 1").isEmpty():
        ends = ends.distinct()
    return ends.select("source", "target", F.lit("semantic").alias("type"), F.lit(None).cast("string").alias("tagName"))
