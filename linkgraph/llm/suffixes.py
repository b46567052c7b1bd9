"""Repeated passages by sparse suffix arrays.

Texts are sequences of words (split at white space).  Of all suffixes only those are retained that
begin at a minimiser: a position whose GRAM-word hash is the least of some WINDOW consecutive ones.
The choice depends on the words alone, so any passage of GRAM + WINDOW - 1 = 50 words is sampled at
the same places wherever it stands.  Suffixes are sorted, neighbours in that order are compared, and
matches are extended left and right; as the next minimiser is fewer than WINDOW words away, WINDOW - 1
words of context on either side reach a passage's true ends.

1. Narrow rows (hash, row, position) of the retained suffixes are sorted by hash; a suffix stays if
   a neighbour has its hash.  Repeats inside a task are settled before the shuffle, so that a hash on
   very many rows is a row a task there.
2. Positions that stay meet the texts once, by row, and get their contexts.
3. These suffixes are range-sorted by hash, left and right context; neighbours of other rows are
   compared, and matches of at least LEAST words become spans, which are merged per row.  A table in
   memory is put in order once for each number of words to the left: in the order by hash, so many
   words of left context, and right context, the neighbours are the mates that share most to the right
   among all that share those words.  So the furthest reach to either side is found, whatever stands
   between.
4. Hashes that a table's borders may cut are settled apart, exactly: of their suffixes the CONTEXT + 1
   windows of LEAST words around each are counted by content, and one that stands in two rows is a span
   of both.  A window that several rows of a table hold is a span of each already, so that two of them
   ask the other tables for all, and a content has few rows however many copies there are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkgraph.llm.common import map_arrow, partitions_for

#: Words of a passage that is found for certain; of those, words in the sampled hash.
LEAST, GRAM = 50, 38
WINDOW = LEAST - GRAM + 1
CONTEXT = WINDOW - 1
#: Words that a worker remembers; words of texts, and rows of suffixes, that it handles at a time.
REMEMBERED, CHUNK, ROWS = 500_000, 1 << 19, 1 << 17
#: Suffixes among which a worker seeks repeats before they are shuffled.
HELD = 1 << 20
#: Bytes of a table's files for each partition.
PARTITION = 64 << 20
RETAINED = ["h", "row", "pos", "proof", "kept"]


class WordHashes(dict):
    """word -> 64-bit hash, never 0; forgets all when full."""

    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 7) or 1
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _slide(x: np.ndarray, n: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each n consecutive values, by doubling."""
    width = 1
    while 2 * width <= n:
        x = pick(x[:-width], x[width:])
        width *= 2
    return pick(x[: len(x) - (n - width)], x[n - width :]) if n > width else x


def _grams(x: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive values, by doubling."""
    base = 0x9E3779B97F4A7C15
    power = lambda k: np.uint64(pow(base, k, 1 << 64))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    total, done, width = None, 0, 1
    blocks = x
    while True:
        if n & width:
            if total is None:
                total = blocks
            else:
                size = len(x) - done - width + 1
                total = total[:size] + blocks[done : done + size] * power(done)
            done += width
        if 2 * width > n:
            break
        blocks = blocks[:-width] + blocks[width:] * power(width)
        width *= 2
    total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    return total ^ total >> np.uint64(32)


def minimisers(words: np.ndarray, ends: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the retained suffixes of texts that lie one after another in ``words``."""
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(words) < gram + window - 1:
        return none
    h = _grams(words, gram)
    begins = np.concatenate([[0], ends[:-1]])
    cross = np.zeros(len(h) + 1, np.int64)  # grams and windows that leave their text
    for reach, size in ((gram, len(h)),):
        low, high = np.clip(np.maximum(ends - reach + 1, begins), 0, size), np.clip(ends, 0, size)
        np.add.at(cross, low, 1)
        np.add.at(cross, high, -1)
    inside = cross.cumsum()[:-1] == 0
    least = _slide(h, window, np.minimum)
    whole = ~_slide(~inside, window, np.maximum)
    # a window whose first and last grams are inside one text has all of them there
    least = np.where(whole & (np.searchsorted(ends, np.arange(len(least)), "right") == np.searchsorted(ends, np.arange(len(least)) + window - 1, "right")), least, 0)
    padded = np.concatenate([np.zeros(window - 1, np.uint64), least, np.zeros(window - 1, np.uint64)])
    place = np.flatnonzero(inside & (_slide(padded, window, np.maximum) == h))
    return place, h[place]


def _texts(batches: Iterable[pa.RecordBatch], text_at: int, hashes: WordHashes) -> Iterator[tuple[list[tuple], np.ndarray, np.ndarray]]:
    """(other columns of the rows, word hashes, ends), about CHUNK words at a time."""
    rows, words, ends, size = [], [], [], 0
    for batch in batches:
        others = [batch.column(i) for i in range(batch.num_columns) if i != text_at]
        for k, t in enumerate(batch.column(text_at)):
            cut = (t.as_py() or "").split()
            rows.append(tuple(c[k].as_py() for c in others))
            words.append(hashes.of(cut))
            size += len(cut)
            ends.append(size)
            if size >= CHUNK:
                yield rows, np.concatenate(words), np.array(ends)
                rows, words, ends, size = [], [], [], 0
    if rows:
        yield rows, np.concatenate(words), np.array(ends)


def _retain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, row, pos, proof, kept) of the retained suffixes.  Of those with one hash among HELD or so
    one is the proof that goes to the hash's task; if there are others, all are kept already.  A hash
    thus has a proof a task, on however many rows it stands."""
    hashes = WordHashes()
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        h, row, pos = (np.concatenate(c) for c in zip(*held, strict=True))
        _, first, inverse, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        proof = np.zeros(len(h), bool)
        proof[first] = True
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (h.view(np.int64), row, pos, proof, count[inverse] > 1)], RETAINED)

    for rows, words, ends in _texts(batches, 1, hashes):
        place, h = minimisers(words, ends)
        text = np.searchsorted(ends, place, "right")
        ids = np.array([r[0] for r in rows], np.int64)
        begins = np.concatenate([[0], ends[:-1]])
        held.append((h, ids[text], (place - begins[text]).astype(np.int32)))
        size += len(h)
        if size >= HELD:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def _chunks(batches: Iterable[pa.RecordBatch], again: int = 0) -> Iterator[pa.Table]:
    """Tables of ROWS rows or more, each beginning with the last ``again`` (0 or 1) rows of the one before."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if rows >= ROWS:
            table = pa.Table.from_batches(held)
            yield table
            held, rows = table.slice(table.num_rows - again).to_batches(), again
        held.append(batch)
        rows += batch.num_rows
    if rows:
        yield pa.Table.from_batches(held)


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, pos) of the suffixes that are kept already or whose neighbour proves their hash, over
    rows sorted by (proof, h)."""
    for table in _chunks(batches, 1):
        h, row, pos, proof, kept = (table.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        same = (h[1:] == h[:-1]) & proof[1:] & proof[:-1]
        kept = kept.copy()
        kept[1:] |= same
        kept[:-1] |= same
        yield pa.RecordBatch.from_arrays([pa.array(row[kept]), pa.array(pos[kept])], ["row", "pos"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the positions of each row: hash, contexts (nearest word first; 0 beyond the text)."""
    hashes = WordHashes()
    for rows, words, ends in _texts(batches, 2, hashes):
        begins = np.concatenate([[0], ends[:-1]])
        text = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows])
        if not len(text):
            continue
        pos = np.concatenate([np.array(r[2], np.int64) for r in rows])
        fits = begins[text] + pos + GRAM <= ends[text]  # always, but for two rows with one key
        text, pos = text[fits], pos[fits]
        h = _grams(words, GRAM)[begins[text] + pos]
        short = np.concatenate([(words | np.uint64(1)).astype(np.uint32), np.zeros(1, np.uint32)])
        out = len(short) - 1
        step = np.arange(CONTEXT)
        place = (begins[text] + pos)[:, None]
        left, right = place - 1 - step, place + GRAM + step
        left = short[np.where(left >= begins[text][:, None], left, out)].astype(">u4")
        right = short[np.where(right < ends[text][:, None], right, out)].astype(">u4")
        pack = lambda x: pa.Array.from_buffers(pa.binary(4 * CONTEXT), len(x), [None, pa.py_buffer(x.tobytes())]).cast(pa.binary())
        ids = [pa.array([r[i] for r in rows], pa.int64()).take(pa.array(text)) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pack(left), pack(right), *ids, pa.array(pos.astype(np.int32))], ["h", "left", "right", "row", "doc_id", "pos"])


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logical_and.accumulate((a == b) & (a != 0), axis=1).sum(axis=1)


SUFFIX = "h long, left binary, right binary, row long, doc_id long, pos int"
SPAN = "row long, doc_id long, start int, end int, other_row long, other_id long"


def compare_neighbours(table: pa.Table) -> dict[str, np.ndarray]:
    """Spans of suffixes with a neighbour's of another row, in an order for each number of shared words
    to the left; ``table`` is sorted by hash, left and right context."""
    h, row, pos = (table.column(n).to_numpy() for n in ("h", "row", "pos"))
    left, right = (np.frombuffer(b"".join(table.column(n).to_pylist()), ">u4").reshape(-1, CONTEXT).astype(np.uint32) for n in ("left", "right"))
    n = len(h)
    packed = [right[:, i].astype(np.uint64) << np.uint64(32) | right[:, i + 1] for i in range(0, CONTEXT, 2)]
    by_right = np.lexsort(packed[::-1])
    new = np.concatenate([[False], (right[by_right][1:] != right[by_right][:-1]).any(axis=1)])
    place = np.empty(n, np.int64)  # of each right context among all
    place[by_right] = new.cumsum()
    # of the mates that share LEAST words: the one that shares most to the left, and most to the right
    best = {side: {k: np.full(n, -1, np.int64) for k in ("lo", "hi", "mate")} for side in ("lo", "hi")}
    begins = np.concatenate([[True], h[1:] != h[:-1]])
    for shared in range(CONTEXT + 1):
        if shared:
            begins = begins.copy()
            begins[1:] |= left[1:, shared - 1] != left[:-1, shared - 1]
        group = begins.cumsum()
        order = np.argsort(group * n + place, kind="stable")
        # runs of one row; every suffix meets the last of the run before and the first of the run after
        turn = np.concatenate([[True], (row[order][1:] != row[order][:-1]) | (group[order][1:] != group[order][:-1])])
        run = turn.cumsum() - 1
        begin = np.flatnonzero(turn)
        finish = np.concatenate([begin[1:], [n]])
        for mate in (begin[run] - 1, finish[run]):
            ok = (mate >= 0) & (mate < n)
            a, b = order[ok], order[mate[ok]]
            same = group[a] == group[b]
            a, b = a[same], b[same]
            hi = _common(right[a], right[b])
            enough = hi >= LEAST - GRAM - shared
            a, b, hi = a[enough], b[enough], hi[enough]
            lo = _common(left[a], left[b])
            # a group may share the beginning of texts, which is no word
            enough = lo + hi >= LEAST - GRAM
            a, b, lo, hi = a[enough], b[enough], lo[enough], hi[enough]
            for side, x in (("lo", lo), ("hi", hi)):
                own = best[side]
                more = (x > own[side][a]) | ((x == own[side][a]) & (lo + hi > own["lo"][a] + own["hi"][a]))
                own["lo"][a[more]], own["hi"][a[more]], own["mate"][a[more]] = lo[more], hi[more], b[more]
    one, two = best["lo"], best["hi"]
    first = np.flatnonzero(one["mate"] >= 0)
    second = np.flatnonzero((two["mate"] >= 0) & (two["hi"] > one["hi"]))
    kept = np.concatenate([first, second])
    lo, hi, mate = (np.concatenate([one[k][first], two[k][second]]) for k in ("lo", "hi", "mate"))
    return {"kept": kept, "start": (pos[kept] - lo).astype(np.int32), "end": (pos[kept] + GRAM + hi).astype(np.int32), "mate": mate}


def _spans(table: pa.Table) -> pa.RecordBatch:
    found = compare_neighbours(table)
    kept, mate = pa.array(found["kept"]), pa.array(found["mate"])
    slim = table.select(["row", "doc_id"]).combine_chunks()
    columns = [slim.column("row").take(kept), slim.column("doc_id").take(kept), pa.array(found["start"]), pa.array(found["end"]), slim.column("row").take(mate), slim.column("doc_id").take(mate)]
    return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], ["row", "doc_id", "start", "end", "other_row", "other_id"])


def _matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _chunks(batches):
        yield _spans(table)


def _outer(new: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Of runs that hold two rows or more the first and the last place, of others all.  A run begins
    wherever ``new``, which leaves out the first place; rows are in order inside a run."""
    begin, end = np.concatenate([[True], new]), np.concatenate([new, [True]])
    several = row[begin] != row[end]
    return begin | end | ~several[begin.cumsum() - 1]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of hashes that stand at a border of a table, and so perhaps in the next one too.

    Of equal contexts in two rows or more the first and the last row do: the ones between have met a
    mate with all of their context, and any other row can meet one of these two instead."""
    for table in _chunks(batches):
        h = table.column("h").to_numpy()
        first, last = np.searchsorted(h, h[0], "right"), np.searchsorted(h, h[-1], "left")
        if first < last:
            table = pa.concat_tables([table.slice(0, first), table.slice(last)])
        h, row = (table.column(k).to_numpy() for k in ("h", "row"))
        new = h[1:] != h[:-1]
        for side in ("left", "right"):
            x = table.column(side)
            new |= pc.not_equal(x.slice(1), x.slice(0, len(x) - 1)).to_numpy()
        yield from table.filter(pa.array(_outer(new, row))).combine_chunks().to_batches()


WINDOW_ROW = "h long, key long, row long, doc_id long, start int"


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, key, row, doc_id, start): for each suffix that ``_cut`` passes on, the windows of LEAST words
    around its gram that are inside the text; h and key are hashes of the gram and of the rest.

    A window that two rows or more of the table hold goes out twice, for the first and the last row:
    ``compare_neighbours`` has found it for all of them, and any other row can meet one of these two."""
    for batch in _cut(batches):
        h, row, pos = (batch.column(batch.schema.get_field_index(k)).to_numpy() for k in ("h", "row", "pos"))
        sides = [np.frombuffer(b"".join(batch.column(batch.schema.get_field_index(k)).to_pylist()), ">u4").reshape(-1, CONTEXT).astype(np.uint64) for k in ("left", "right")]
        # a hash of so many words of either side, and whether the text has them
        hashes, whole = [], []
        for side in sides:
            total, inside = np.zeros(len(h), np.uint64), np.ones(len(h), bool)
            hashes.append([total])
            whole.append([inside])
            for k in range(CONTEXT):
                total = (total ^ total >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) + side[:, k]
                inside = inside & (side[:, k] != 0)
                hashes[-1].append(total)
                whole[-1].append(inside)
        for shared in range(CONTEXT + 1):
            ok = np.flatnonzero(whole[0][shared] & whole[1][CONTEXT - shared])
            if not len(ok):
                continue
            key = (hashes[0][shared] * np.uint64(0x94D049BB133111EB) ^ hashes[1][CONTEXT - shared]) + np.uint64(shared)
            ok = ok[np.lexsort((row[ok], key[ok], h[ok]))]
            ok = ok[_outer((h[ok][1:] != h[ok][:-1]) | (key[ok][1:] != key[ok][:-1]), row[ok])]
            doc_id = batch.column(batch.schema.get_field_index("doc_id")).take(pa.array(ok))
            yield pa.RecordBatch.from_arrays([pa.array(h[ok]), pa.array(key[ok].view(np.int64)), pa.array(row[ok]), doc_id, pa.array((pos[ok] - shared).astype(np.int32))], ["h", "key", "row", "doc_id", "start"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union overlapping or touching spans of each row; input is sorted by (row, start)."""

    def merge(table: pa.Table) -> pa.RecordBatch:
        row, start, end = (table.column(n).to_numpy() for n in ("row", "start", "end"))
        # the furthest end so far within the row
        shift = np.int64(1) << 33
        rank = np.concatenate([[0], (np.diff(row) != 0).cumsum()])
        reach = np.maximum.accumulate(end + rank * shift) - rank * shift
        new = np.concatenate([[True], (np.diff(rank) != 0) | (start[1:] > reach[:-1])])
        at = np.flatnonzero(new)
        last = np.concatenate([at[1:], [len(row)]]) - 1
        columns = [table.column(n).take(pa.array(at)).combine_chunks() for n in ("doc_id", "row", "start")]
        mates = table.column("other_id").take(pa.array(at)).combine_chunks()
        return pa.RecordBatch.from_arrays([*columns, pa.array(reach[last].astype(np.int32)), mates], ["doc_id", "row", "start", "end", "other_id"])

    held, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < ROWS:
            continue
        table = pa.Table.from_batches(held)
        row = table.column("row").to_numpy()
        before = np.flatnonzero(row != row[-1])
        cut = int(before[-1]) + 1 if len(before) else 0
        if cut:
            yield merge(table.slice(0, cut))
            held = table.slice(cut).to_batches()
            rows = table.num_rows - cut
    if rows:
        yield merge(pa.Table.from_batches(held))


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, row, start, end, other_id: the word spans of each row that stand in another row too.

    A span is a union of matches of at least LEAST words, each as long as both texts agree around it
    (a longer passage is found in pieces that overlap); ``other_id`` is the doc_id of a row that
    shares its beginning.  ``row`` is a hash of doc_id and text: it tells rows of one doc_id apart,
    and rows that are equal in both count as one.  A text is not matched with itself, null and short
    texts have no spans, and null doc_ids are carried.

    The words covered are those of all windows of LEAST words that another row holds (up to 64-bit hashes
    of words and rows: among 10^10 rows a few pairs are taken for one).  The texts are shuffled once, one
    row of those that are equal; nothing but the shuffles is written, and all of it is one job, so that the
    sorted suffixes are shuffled once for what reads them.
    """
    n = partitions_for(docs, PARTITION)
    rows = docs.select(F.xxhash64(doc_id, text).alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    suffixes = map_arrow(rows.select("row", "text"), _retain, "h long, row long, pos int, proof boolean, kept boolean")
    # proofs meet by hash; what is kept already goes anywhere
    dealt = suffixes.repartition(n, F.when(F.col("proof"), F.col("h")).otherwise(F.xxhash64("row", "pos")))
    ordered = dealt.sortWithinPartitions("proof", "h")
    # a row has as many positions as words at most
    found = map_arrow(ordered, _repeated, "row long, pos int").groupBy("row").agg(F.collect_set("pos").alias("pos"))
    # equal rows are one before they are shuffled; positions make the hash table, and the texts stream past it
    once = rows.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    placed = found.hint("shuffle_hash").join(once, "row").select("row", "doc_id", "text", F.array_sort("pos").alias("pos"))
    key = ["h", "left", "right", "row", "pos"]
    context = map_arrow(placed, _contexts, SUFFIX).repartitionByRange(n, *key).sortWithinPartitions(*key)
    spans = map_arrow(context, _matches, SPAN).select("row", "doc_id", "start", "end", "other_id")
    # what the tables part; a content has two rows a table, or the places of one row, so a task can hold it
    windows = map_arrow(context, _windows, WINDOW_ROW).repartition(n, "h", "key")
    own, content = F.struct("row", "doc_id"), Window.partitionBy("h", "key")
    shared = windows.withColumns({"lo": F.min(own).over(content), "hi": F.max(own).over(content)}).where("lo.row <> hi.row")
    other = F.when(F.col("row") == F.col("lo.row"), F.col("hi.doc_id")).otherwise(F.col("lo.doc_id"))
    spans = spans.unionByName(shared.select("row", "doc_id", "start", (F.col("start") + LEAST).alias("end"), other.alias("other_id")))
    merged = spans.repartition(n, "row").sortWithinPartitions("row", "start", "end", "other_id")
    return map_arrow(merged, _merged, "doc_id long, row long, start int, end int, other_id long")


def passage_report(docs: DataFrame) -> DataFrame:
    """doc_id, start, end, words, other_id of every repeated passage."""
    found = repeated_passages(docs)
    return found.select("doc_id", "start", "end", (F.col("end") - F.col("start")).alias("words"), "other_id")
