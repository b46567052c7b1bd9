"""SimHash near-duplicates by anchor-point covering.

Anchors are the words of a covering code: a product of perfect cyclic codes (binary Golay [23,12],
Hamming [15,11]) over the fingerprint's low bits, whose covering radius is the sum of theirs.  Two
fingerprints at most t bits apart have a point at most ceil(t/2) from both, and some anchor lies
within the covering radius R of that point.  So each fingerprint is replicated to every anchor
within R + ceil(t/2) of it, and any pair within t meets at an anchor: no link is lost.  (R + t, the
bound from one end point, would hold as well at several times the copies.)

Similar word sets differ in more bits than so short a fingerprint can tell from chance.  Where a Jaccard
similarity is asked for, fingerprints have WIDE bits, and each of BLOCKS blocks of 23 bits has anchors
of its own: two fingerprints that are within NEAR bits in any block meet there.  That is certain of any
pair within BLOCKS * (NEAR + 1) - 1 = 32 bits, and of 99 in 100 at a similarity of 0.8 (39 bits or so).

Only distinct fingerprints are replicated, so exact copies cost nothing.  An anchor with many
fingerprints is cut into cells of bounded size that are compared in tasks of their own, and a task
returns a spanning forest of the links it found instead of all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from linkgraph.llm.common import fresh, map_arrow, materialize
from linkgraph.llm.components import connected_components

SHINGLE, THRESHOLD, SEED = 4, 4, 42
#: Bits of a wide fingerprint, its blocks of 23, and the bits within which a block brings two together.
WIDE, BLOCKS, NEAR = 256, 11, 2
#: Fingerprints of one cell; a cell of two halves of a large anchor holds twice as many.
CELL = 4096
#: (bits, generator polynomial, covering radius) of perfect cyclic codes.
GOLAY, HAMMING = (23, 0b101011100011, 3), (15, 0b10011, 1)


def code_for(distinct: int) -> tuple[tuple[int, int, int], ...]:
    """The covering code for so many fingerprints: 2^12, 2^24 or 2^35 anchors."""
    return (GOLAY,) if distinct <= 1 << 19 else (GOLAY, GOLAY) if distinct <= 1 << 31 else (GOLAY, GOLAY, HAMMING)


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of a UTF-8 text: a bit is 1 if set in over half the shingles' XXH64.

    A-Z is lower-cased, words are split at ASCII white space, repeated shingles count.  With fewer
    words than ``shingle`` the whole sequence is the one shingle; without words the result is 0.
    """
    n, ones = 0, np.zeros(64, np.int64)
    for hashes in _shingle_hashes(text, shingle, seed):
        ones += _bits(hashes[:, None]).sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _shingle_hashes(text: bytes | None, shingle: int, seed: int) -> Iterator[np.ndarray]:
    """The XXH64 of a text's shingles, many at a time."""
    words = text.lower().split() if text else ()
    if not words:
        return
    joined = b" ".join(words)
    size = min(shingle, len(words))
    length = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(length + 1)
    starts = (ends - length - 1)[: len(words) - size + 1].tolist()
    ends = (ends[size - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(ends), 1 << 16):
        part = zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)], strict=True)
        yield np.array([digest(joined[s:e], seed) for s, e in part], "<u8")


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(len(hashes), -1), axis=1, bitorder="little")


def wide_fingerprint(text: bytes | None, shingle: int = 5, seed: int = SEED) -> bytes:
    """The SimHash of WIDE bits over the set of a text's shingles (repeats count once, as in a Jaccard
    similarity); 0 without words.  A shingle's bits are mixed from its XXH64."""
    parts = [*_shingle_hashes(text, shingle, seed)]
    if not parts:
        return bytes(WIDE // 8)
    hashes = np.unique(np.concatenate(parts))
    ones = np.zeros(WIDE, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        x = hashes[at : at + (1 << 14), None] + np.uint64(0x9E3779B97F4A7C15) * np.arange(WIDE // 64, dtype=np.uint64)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        ones += _bits(x ^ x >> np.uint64(31)).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").tobytes()


def bits_for(similarity: float) -> int:
    """The differing bits up to which two wide fingerprints are linked: what sets of that Jaccard
    similarity differ in on average, and a standard deviation."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(WIDE * share + math.sqrt(WIDE * share * (1 - share)))


def _wide_fingerprints(text_at: int, keep: int, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_at).cast(pa.binary())
            prints = pa.array((wide_fingerprint(x.as_py(), shingle) for x in texts), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], prints], [*batch.schema.names[:keep], "fp"])

    return run


def _fingerprints(text_at: int, keep: int, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_at).cast(pa.binary())
            prints = np.fromiter((fingerprint(x.as_py(), shingle) for x in texts), np.uint64, len(texts))
            columns = [batch.column(i) for i in range(keep)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(prints.view(np.int64))], [*batch.schema.names[:keep], "fp"])

    return run


@lru_cache(4)
def _cosets(code: tuple[int, int, int], most: int):
    """Error patterns of weight <= most by (syndrome, weight); where each syndrome's begin; how many
    of them have weight <= w; and two tables whose xor is a word's syndrome."""
    bits, poly, _ = code
    check = poly.bit_length() - 1

    def remainder(x: int) -> int:
        for i in range(bits - 1, check - 1, -1):
            if x >> i & 1:
                x ^= poly << (i - check)
        return x

    unit = [remainder(1 << i) for i in range(bits)]
    low = np.zeros(1 << 12, np.int32)
    high = np.zeros(1 << max(bits - 12, 0), np.int32)
    for table, at in ((low, 0), (high, 12)):
        for i in range(min(12, bits - at)):
            table[1 << i : 2 << i] = table[: 1 << i] ^ unit[at + i]
    words = np.arange(1 << bits, dtype=np.uint32)
    weight = np.bitwise_count(words)
    words, weight = words[weight <= most], weight[weight <= most]
    syndrome = low[words & 0xFFF] ^ high[words >> 12]
    order = np.lexsort((weight, syndrome))
    words, weight, syndrome = words[order], weight[order], syndrome[order]
    upto = np.zeros((1 << check, most + 1), np.int64)
    np.add.at(upto, (syndrome, weight), 1)
    upto = upto.cumsum(axis=1)
    first = np.concatenate([[0], upto[:, -1].cumsum()[:-1]])
    return words.astype(np.uint64), weight.astype(np.int64), first, upto, low, high


def anchors(prints: np.ndarray, code: tuple[tuple[int, int, int], ...], threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(index into ``prints``, anchor) for every anchor within covering radius + ceil(threshold / 2)."""
    radius = sum(r for _, _, r in code) + -(-threshold // 2)
    index, left = np.arange(len(prints)), np.full(len(prints), radius)
    out, shift = np.zeros(len(prints), np.uint64), 0
    for block in code:
        words, weight, first, upto, low, high = _cosets(block, min(radius, block[0]))
        x = (prints[index] >> np.uint64(shift)) & np.uint64((1 << block[0]) - 1)
        syndrome = low[x & np.uint64(0xFFF)] ^ high[x >> np.uint64(12)]
        count = upto[syndrome, np.minimum(left, upto.shape[1] - 1)]
        row = np.repeat(np.arange(len(index)), count)
        error = np.arange(len(row)) - np.repeat(count.cumsum() - count, count) + first[syndrome][row]
        out = out[row] | ((x[row] ^ words[error]) << np.uint64(shift))
        index, left = index[row], left[row] - weight[error]
        shift += block[0]
    return index, out


def _replicate(code, threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(prints), 2048):
                part = prints[at : at + 2048]
                index, found = anchors(part, code, threshold)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.view(np.int64)), pa.array(part[index].view(np.int64))], ["anchor", "fp"]
                )

    return run


def _replicate_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, fp) of wide fingerprints: in each block the anchors within covering radius + NEAR / 2."""
    weights = 1 << np.arange(23, dtype=np.uint64)
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            prints = batch.column(0).slice(at, 2048)
            bits = np.unpackbits(np.frombuffer(b"".join(prints.to_pylist()), np.uint8).reshape(len(prints), -1), axis=1, bitorder="little")
            found = []
            for block in range(BLOCKS):
                index, anchor = anchors(bits[:, 23 * block : 23 * (block + 1)].astype(np.uint64) @ weights, (GOLAY,), NEAR)
                found.append((index, anchor | np.uint64(block << 23)))
            index, anchor = (np.concatenate(c) for c in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), prints.take(pa.array(index))], ["anchor", "fp"])


def _roots(n: int, a: np.ndarray, b: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Union the edges a-b into the forest ``parent``, whose rows point at roots; the least is the root."""
    while len(a):
        ra, rb = parent[a], parent[b]
        differ = ra != rb
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        if not len(a):
            break
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    return parent


def forest(group: np.ndarray, prints: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, root row) links that join what is within ``threshold`` inside each group of equal, adjacent
    ``group`` numbers; a row of ``prints`` is a fingerprint of one or more words."""
    n = len(prints)
    parent = np.arange(n)
    cuts = np.flatnonzero(np.diff(group)) + 1
    bounds = np.concatenate([[0], cuts, [n]])
    sizes = np.diff(bounds)
    few = np.repeat(sizes <= 48, sizes)
    end = np.repeat(bounds[1:], sizes)
    alive = np.flatnonzero(few)
    step = 1

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        apart = np.bitwise_count(a[..., 0] ^ b[..., 0]).astype(np.uint16)
        for word in range(1, prints.shape[1]):
            apart += np.bitwise_count(a[..., word] ^ b[..., word])
        return apart <= threshold

    while True:
        alive = alive[alive + step < end[alive]]
        if not len(alive):
            break
        linked = alive[near(prints[alive], prints[alive + step])]
        parent = _roots(n, linked, linked + step, parent)
        step += 1
    for s, e in pairwise(bounds.tolist()):
        if e - s <= 48:
            continue
        x, own = prints[s:e], np.arange(e - s)
        for at in range(0, e - s, 64):
            a, b = np.nonzero(near(x[at : at + 64, None], x[None, at:]))
            a, b = a + at, b + at
            up = a < b
            own = _roots(e - s, a[up], b[up], own)
        parent[s:e] = own + s
    moved = np.flatnonzero(parent != np.arange(n))
    return moved, parent[moved]


def _compare(threshold: int):
    """Over rows (anchor, cell, id) sorted by (anchor, cell): the links inside each cell, by id.  The id
    is the fingerprint, unless a wide one stands in a fourth column.  Holds whole cells only."""

    def links(table: pa.Table) -> pa.RecordBatch:
        anchor, cell, ids = (table.column(i).to_numpy() for i in range(3))
        group = np.concatenate([[0], ((np.diff(anchor) != 0) | (np.diff(cell) != 0)).cumsum()])
        prints = ids.view(np.uint64) if table.num_columns == 3 else np.frombuffer(b"".join(table.column(3).to_pylist()), "<u8")
        a, b = forest(group, prints.reshape(len(ids), -1), threshold)
        pairs = np.unique(np.stack([ids[a], ids[b]], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, i])) for i in (0, 1)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < 1 << 17:
                continue
            table = pa.Table.from_batches(held)
            anchor, cell = table.column(0).to_numpy(), table.column(1).to_numpy()
            last = np.flatnonzero((anchor != anchor[-1]) | (cell != cell[-1]))
            whole = int(last[-1]) + 1 if len(last) else 0
            if whole:
                yield links(table.slice(0, whole))
            held = table.slice(whole).combine_chunks().to_batches()
            rows = table.num_rows - whole
        if rows:
            yield links(pa.Table.from_batches(held))

    return run


def link_fingerprints(prints: DataFrame, threshold: int = THRESHOLD, code=None, cell: int = CELL) -> DataFrame:
    """(fp) distinct longs -> (node, component) of the links at most ``threshold`` bits apart."""
    code = code or code_for(prints.count())
    copies = map_arrow(prints.select("fp"), _replicate(code, threshold), "anchor long, fp long")
    return _linked(materialize(copies, "anchors"), [F.col("fp").alias("id")], threshold, cell)


def link_wide_fingerprints(prints: DataFrame, threshold: int, cell: int = CELL) -> DataFrame:
    """(fp) distinct wide fingerprints -> (node, component) of the links at most ``threshold`` bits
    apart, where a node is the 64-bit hash of a fingerprint."""
    copies = materialize(map_arrow(prints.select("fp"), _replicate_blocks, "anchor long, fp binary"), "anchors")
    return _linked(copies, [F.xxhash64("fp").alias("id"), F.col("fp")], threshold, cell)


def _linked(copies: DataFrame, columns: list[Column], threshold: int, cell: int) -> DataFrame:
    """The components of what is near inside an anchor of (anchor, fp); ``columns``: id and perhaps fp."""
    large = copies.groupBy("anchor").count().where(F.col("count") > cell)
    # written, so that adaptive execution can split the join at a large anchor
    parts = materialize(large.select("anchor", F.ceil(F.col("count") / cell).cast("int").alias("parts")), "large")
    dealt = copies.join(parts, "anchor", "left")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    others = F.sequence(F.lit(0), F.col("parts") - 1)
    pair = F.transform(others, lambda k: F.least(own, k) * F.col("parts") + F.greatest(own, k))
    dealt = dealt.select(
        "anchor", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(pair)).alias("cell"), *columns
    )
    dealt = dealt.repartition("anchor", "cell").sortWithinPartitions("anchor", "cell")
    return connected_components(map_arrow(dealt, _compare(threshold), "u long, v long"))


def near_duplicates(
    docs: DataFrame, text: str = "text", keep: tuple[str, ...] = (), threshold: int = THRESHOLD, shingle: int = SHINGLE, similarity: float | None = None
) -> DataFrame:
    """The columns ``keep`` of every row with ``fp`` and ``class`` (long, the least linked id).

    By default fingerprints have 64 bits (fp is a long, and its own id) and link at ``threshold`` bits.
    With ``similarity`` they are wide ones (fp is binary, and its 64-bit hash the id) over sets of
    ``shingle`` words, linked where they differ as sets of that Jaccard similarity do.

    A null text counts as empty; empty texts have fingerprint 0 and are linked like others.  Rows
    with equal fingerprints share a class, whatever else they hold; nulls in ``keep`` are carried, and
    columns of ``keep`` that are named ``fp`` or ``class`` are not: rename them before.
    """
    if clash := {"fp", "class"} & {c.lower() for c in keep}:
        raise ValueError(f"columns {sorted(clash)} would clash with the result's")
    slim = docs.select(*keep, F.col(text).alias("_text"))
    fields = StructType(slim.schema.fields[:-1])
    wide = similarity is not None
    hashed = _wide_fingerprints(len(keep), len(keep), shingle) if wide else _fingerprints(len(keep), len(keep), shingle)
    tagged = materialize(map_arrow(slim, hashed, StructType([*fields.fields, StructField("fp", BinaryType() if wide else LongType())])), "fingerprints")
    distinct = tagged.select("fp").distinct()
    classes = link_wide_fingerprints(distinct, bits_for(similarity)) if wide else link_fingerprints(distinct, threshold)
    own = F.xxhash64("fp") if wide else F.col("fp")
    return tagged.withColumn("node", own).join(classes, "node", "left").select(*keep, "fp", F.coalesce("component", "node").alias("class"))


def simhash_digest(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the least doc_id that is reachable).

    A null doc_id is never a component_id unless its component has no other.
    """
    found = near_duplicates(docs, keep=("doc_id",))
    # written, so that adaptive execution can split the join where a class has very many rows
    least = materialize(found.groupBy("class").agg(F.min("doc_id").alias("component_id")), "least")
    return found.join(least, "class").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one_of_each(docs: DataFrame, text: str = "text", order: str = "doc_id", shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """One row of each class of near-duplicates, the first by ``order`` (nulls last); all columns kept.

    Rows get an id in a written copy, so that equal rows stay apart; the choice itself runs on
    (id, order, fingerprint) alone, and the texts are joined by id once.  ``shingle`` and ``similarity``
    are those of ``near_duplicates``.
    """
    row = fresh(docs, "_row")
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    slim = rows.select(F.col(row).alias("_row"), F.col(order).alias("_order"), F.col(text).alias("_text"))
    found = near_duplicates(slim, "_text", ("_row", "_order"), shingle=shingle, similarity=similarity)
    first = found.groupBy("class").agg(F.min(F.struct(F.col("_order").isNull(), "_order", "_row")).alias("first"))
    # a hash table of ids on one side, so that the texts aren't sorted
    kept = first.select(F.col("first._row").alias(row)).hint("shuffle_hash")
    return rows.join(kept, row, "left_semi").select(*docs.columns)
