"""Benchmark decontamination: CGK embeddings, bit-sampling LSH, and exact edit verification.

A document is contaminated by an item if some passage of it is within an edit distance of
(1 - similarity) of the item's length; texts are compared in lower case with white space as single
blanks.  Texts are embedded by the random walk of Chakraborty, Goldenberg and Koucky: it copies the
character it stands on at each step and moves on by a random bit that depends on step and character,
so that two texts which differ by edits fall into step again, and Hamming distance stands for edit
distance.

1. Item-sized windows begin at every STRIDE-th place of a document, and at every place of an item, so
   wherever a passage stands its windows meet those of the item in many alignments.  The index holds,
   for each of several walks, the items' windows by a hash of SAMPLES of the first STEPS characters
   that the walk copies: two windows that are in step stay so there most likely, so each alignment and
   walk is one more repetition of the sampling.  Characters that are dropped at even distances are
   what throws walks out of step most, so the index also holds windows of thinned copies of the items
   (each DROPS-th character left out, from each first place on).  The number of walks is the least
   that reaches RECALL on copies of the items with random edits up to the bound, and EVEN where as
   many edits of one kind stand at even distances (``walks_for``).
2. A pair of windows that collide goes on walking to both ends of the item.  Pairs whose embeddings
   agree in fewer than AGREE of the characters are dropped; unrelated texts agree in about 0.08.
3. What is left is decided by the exact semi-global edit distance (Myers' bit vectors).

Items under SHORT characters, too short for such samples, are found exactly: of allowed + 1 parts one
is free of edits, so every place of a part is verified.

With ``exact`` every place of every text is verified against every item instead: nothing is missed,
at a cost of texts times items.

The benchmark is broadcast in blocks of bounded size; documents are mapped row by row, without a
shuffle, whatever number of them shares a passage.
"""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from linkgraph.llm.common import fresh, held, map_arrow, materialize

SIMILARITY = 0.8
#: Windows begin at every STRIDE-th character of a document; a walk's steps and how many are sampled.
STRIDE, STEPS, SAMPLES = 2, 32, 16
#: Recall that the walks must reach on edited copies, and on those with even edits of each kind; the
#: least walks, and the most.
RECALL, EVEN, LEAST, MOST = 0.995, 0.95, 5, 16
#: Distances of the characters that thinned copies leave out, where the bound allows as many.
DROPS = (5, 6)
#: Items that the recall is measured on at most, the shortest ones: they have the fewest alignments.
MEASURED = 256
#: Steps of the walk to either side of a pair that collides.
FURTHER = 96
#: Share of the characters on the way to both ends that must agree, and where collisions don't stand
#: SPREAD characters apart.
AGREE, ALONE, SPREAD = 0.12, 0.25, 24
#: Bits that are dropped of an early key.
EARLY = np.uint32(12)
#: Length from which items go through the index.
SHORT = 32
#: Characters of benchmark items in a broadcast; characters of documents that are searched at a time;
#: windows that walk side by side; pairs that are verified side by side; collisions that are told at a time.
BLOCK, CHUNK, SIDE, PAIRS, TOLD = 1 << 20, 1 << 22, 1 << 15, 2048, 1 << 20
FOUND = "array<struct<item_id:bigint,distance:int,similarity:double,start:int,end:int>>"


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().replace("\0", " ").split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def small(x: np.ndarray) -> np.ndarray:
    """A byte for each character, 0 for the separator alone: what the walks copy."""
    byte = ((x ^ x >> np.uint32(8)) & np.uint32(255)).astype(np.uint8)
    byte[(byte == 0) & (x != 0)] = 255
    return byte


def hashed(key: np.ndarray) -> np.ndarray:
    key = (key ^ key >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
    return key ^ key >> np.uint32(13)


def edit_distance(item: str, text: str) -> tuple[int, int]:
    """(least edits from ``item`` to a substring of ``text``, where the first best one ends)."""
    m = len(item)
    if not m:
        return 0, 0
    eq: dict[str, int] = {}
    for i, ch in enumerate(item):
        eq[ch] = eq.get(ch, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best = (m, 0)
    for at, ch in enumerate(text, 1):
        same = eq.get(ch, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        plus = down | (full & ~(diagonal | up))
        minus = up & diagonal
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = plus << 1 & full, minus << 1 & full
        up = minus | (full & ~(diagonal | plus))
        down = plus & diagonal
        if score < best[0]:
            best = score, at
    return best


def edit_distances(items: list[str], texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``edit_distance`` of many pairs side by side: 64 characters of the items a word, the words joined
    by the differences that leave one and enter the next (Hyyro)."""
    m = len(items)
    if not m:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # the longest text first, so that the pairs still at work are the first ones
    order = np.argsort([-len(t) for t in texts], kind="stable")
    items, texts = [items[k] for k in order.tolist()], [texts[k] for k in order.tolist()]
    letters = np.unique(codes("".join(set(items))))
    dense = lambda text: np.where(letters.take(at := np.searchsorted(letters, text), mode="clip") == text, at + 1, 0)
    distinct, which = np.unique(np.array(items, object), return_inverse=True)
    size = np.array([len(t) for t in distinct], np.int64)
    words = -(-int(size.max()) // 64)
    eq = np.zeros((words, len(distinct) * (len(letters) + 1)), np.uint64)
    for k, t in enumerate(distinct):
        place = np.arange(len(t))
        np.bitwise_or.at(eq, (place // 64, k * (len(letters) + 1) + dense(codes(t))), np.uint64(1) << (place % 64).astype(np.uint64))
    row = [dense(codes(t)) + w * (len(letters) + 1) for t, w in zip(texts, which.tolist(), strict=True)]
    begin = np.cumsum([0, *map(len, row)])[:-1]
    rows = np.concatenate(row)
    active = np.searchsorted([-len(t) for t in texts], -np.arange(len(texts[0])), "left")
    last = (size[which] - 1) // 64
    top = np.uint64(1) << ((size[which] - 1) % 64).astype(np.uint64)
    all_up, all_down = np.full((words, m), ~np.uint64(0)), np.zeros((words, m), np.uint64)
    score, best, end = size[which], size[which], np.zeros(m, np.int64)
    one, high = np.uint64(1), np.uint64(63)
    for at, k in enumerate(active.tolist()):
        ch, up, down = rows.take(begin[:k] + at), all_up[:, :k], all_down[:, :k]
        more, less = np.zeros(k, np.uint64), np.zeros(k, np.uint64)
        for w in range(words):
            same, pv, mv = eq[w].take(ch), up[w], down[w]
            xv = same | mv
            same |= less
            xh = ((same & pv) + pv) ^ pv | same
            ph, mh = mv | ~(xh | pv), pv & xh
            score[:k] += (last[:k] == w) * ((ph & top[:k] != 0).astype(np.int64) - (mh & top[:k] != 0))
            ph1, mh1 = ph << one | more, mh << one | less
            more, less = ph >> high, mh >> high
            up[w], down[w] = mh1 | ~(xv | ph1), ph1 & xv
        better = np.flatnonzero(score[:k] < best[:k])
        best[better], end[better] = score[better], at + 1
    back = np.argsort(order)
    return best[back], end[back]


def triples(x: np.ndarray) -> np.ndarray:
    """For each place the classes (the low 5 bits) of its character and the two after it, as one number."""
    low = (x & np.uint8(31)).astype(np.uint16)
    low = np.concatenate([low, np.zeros(2, np.uint16)])
    return low[:-2] | low[1:-1] << np.uint16(5) | low[2:] << np.uint16(10)


class Walk:
    """One random walk: a bit for each step and class of characters, and the steps that are sampled.

    Three steps at a time see three characters at most: tables tell for each triple of classes how far
    the walk moves on (2 bits) and what the samples add to the key.
    """

    def __init__(self, seed: int):
        rng = np.random.default_rng((20, seed))
        self.bits = rng.integers(0, 2, (STEPS, 32))
        on = rng.integers(0, 2, (STEPS + FURTHER, 256), np.uint8).astype(np.int64)  # for the way on, to either side
        on[:, 0] = 0
        self.on = np.stack([np.zeros_like(on), on, -on], axis=1)
        self.sampled = np.zeros(STEPS, bool)
        self.sampled[0] = True
        self.sampled[1 + rng.permutation(STEPS - 1)[: SAMPLES - 1]] = True
        classes = np.arange(1 << 15) >> np.array([[0], [5], [10]]) & 31
        self.tables = []
        for first in range(0, STEPS, 3):
            at, adds = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int64)
            for step in range(first, min(first + 3, STEPS)):
                ch = classes[at, np.arange(1 << 15)]
                if self.sampled[step]:
                    adds = adds * 33 + ch + 1
                at += self.bits[step][ch]
            self.tables.append((adds << 2 | at).astype(np.int32))

    def walked(self, x3: np.ndarray, place: np.ndarray, key: np.ndarray, tables: list[np.ndarray]) -> None:
        """Move ``place`` on and add to ``key``, in place."""
        code, move = np.empty(len(place), np.uint16), np.empty(len(place), np.int32)
        for table in tables:
            x3.take(place, out=code, mode="clip")
            table.take(code, out=move, mode="clip")
            key *= np.uint32(0x9E3779B1)
            key += (move >> 2).view(np.uint32)
            move &= 3
            place += move

    def keys(self, x3: np.ndarray, starts: np.ndarray, early: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(windows, early keys, keys): 32-bit hashes of the characters that are sampled in the first half
        of the walk, and in all of it, from each start on, over ``triples`` that end in STEPS zeros.  With
        ``early``, a table of early keys that occur, only windows that have one walk on."""
        half = len(self.tables) // 2
        out = []
        for at in range(0, len(starts), SIDE):
            place = starts[at : at + SIDE].copy()
            key = np.zeros(len(place), np.uint32)
            self.walked(x3, place, key, self.tables[:half])
            first = hashed(key)
            window = np.arange(at, at + len(place))
            if early is not None:
                kept = np.flatnonzero(early.take(first >> EARLY))
                window, place, key, first = window[kept], place[kept], key[kept], first[kept]
            self.walked(x3, place, key, self.tables[half:])
            out.append((window, first, hashed(key)))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), *[np.zeros(0, np.uint32)] * 2)

    def agreement(self, x: np.ndarray, place: np.ndarray, y: np.ndarray, other: np.ndarray) -> np.ndarray:
        """The share, in thousandths, of agreeing steps of a walk over x and y side by side, forwards and
        backwards from pairs that collide, without the first STEPS forwards, which agree by the sample.
        Texts in y are ended by a 0, where a walk stays."""
        out = np.zeros(len(place), np.int64)
        for at in range(0, len(place), SIDE // 4):
            part = slice(at, at + SIDE // 4)
            steps, same = np.zeros(len(place[part]), np.int16), np.zeros(len(place[part]), np.int16)
            for way, first in ((1, STEPS), (-1, 0)):
                p, q = (place[part], other[part]) if way > 0 else (place[part] - 1, other[part] - 1)
                p, q = p.copy(), q.copy()
                for n in range(first + FURTHER):
                    a, b = x.take(p, mode="clip"), y.take(q, mode="clip")
                    if n >= first:
                        inside = b != 0
                        steps += inside
                        same += inside & (a == b)
                    bits = self.on[n, way]
                    p += bits.take(a)
                    q += bits.take(b)
            out[part] = 1000 * same.astype(np.int64) // np.maximum(steps, 1)
        return out


def thinned(size: int, similarity: float) -> Iterator[tuple[int, np.ndarray]]:
    """(step, places that stay) of each thinned copy of a text: windows of it begin at each step-th place."""
    for every in DROPS:
        if size // every <= (1 - similarity) * size + 1e-9:
            for first in range(every):
                yield every, np.flatnonzero(np.arange(size) % every != first)


def _edited(rng: np.random.Generator, x: np.ndarray, places: np.ndarray, kind: int | None = None) -> np.ndarray:
    """x with an edit at each of some ascending places: replaced (0), deleted (1) or inserted (2), or a
    third of each."""
    parts, at = [], 0
    for place in places.tolist():
        edit, letter = rng.integers(3) if kind is None else kind, rng.choice(x)
        parts += [x[at:place], np.array([letter] if edit == 0 else [] if edit == 1 else [letter, x[place]], np.uint8)]
        at = place + 1
    return np.concatenate([*parts, x[at:]])


def walks_for(texts: list[str], similarity: float = SIMILARITY) -> int:
    """The least number of walks, LEAST at least, by which enough edited copies of items share a key.

    RECALL of the copies that have all the edits that are allowed at random places, or half as many at
    even distances, and EVEN of those that have all of them at even distances, for each kind of edit
    by itself; copies begin anywhere in a document's stride.  The items are the MEASURED shortest that
    go through the index.  Where MOST walks don't do, a warning tells what they reach.
    """
    rng = np.random.default_rng(21)
    chosen = sorted({t for t in texts if len(t) >= SHORT}, key=lambda t: (len(t), t))[:MEASURED]
    pairs, sort = [], []
    for text in chosen:
        x = small(codes(text))
        edits = max(1, int((1 - similarity) * len(x) + 1e-9))
        even = lambda n, x=x: np.linspace(0, len(x) - 1, n + 2).astype(int)[1:-1]
        random = np.sort(rng.choice(len(x), edits, replace=False))
        for which, places, kind in ((0, random, None), (0, even(edits // 2), None), *((1 + kind, even(edits), kind) for kind in range(3))):
            pairs.append((x, np.concatenate([rng.choice(x, int(rng.integers(STRIDE))), _edited(rng, x, places, kind)])))
            sort.append(which)
    wanted, sort = (RECALL, EVEN, EVEN, EVEN), np.array(sort, np.int64)
    found = np.zeros(len(pairs), bool)
    share = lambda: [float(found[sort == k].mean()) for k in range(4)]
    for k in range(MOST):
        if k >= LEAST and (found.all() or all(a >= b for a, b in zip(share(), wanted, strict=True))):
            return k
        walk = Walk(k)
        held_keys: dict[int, np.ndarray] = {}
        for i in np.flatnonzero(~found).tolist():
            x, copy = pairs[i]
            if id(x) not in held_keys:
                held_keys[id(x)] = np.concatenate([_keys(walk, x, 0, 1), *(_keys(walk, x[stay], 0, every) for every, stay in thinned(len(x), similarity))])
            found[i] = np.isin(_keys(walk, copy, 1, STRIDE), held_keys[id(x)]).any()
    if found.size and not all(a >= b for a, b in zip(share(), wanted, strict=True)):
        warnings.warn(f"{MOST} walks share keys with {[round(a, 3) for a in share()]} of edited copies (wanted {wanted})", stacklevel=2)
    return MOST


def _keys(walk: Walk, x: np.ndarray, follows: int, every: int) -> np.ndarray:
    """The keys of a walk from each ``every``-th place of x on; ``follows`` is what stands after it."""
    return walk.keys(triples(np.concatenate([x, np.full(STEPS, follows, np.uint8)])), np.arange(0, len(x), every))[2]


@dataclass
class Items:
    """A block of benchmark items and the index over their windows; built once a worker."""

    ids: list[int | None]
    texts: list[str]
    similarity: float = SIMILARITY
    walks: int = 0
    exact: bool = False

    def __post_init__(self):
        self.length = np.array([len(t) for t in self.texts], np.int64)
        self.allowed = np.floor((1 - self.similarity) * self.length + 1e-9).astype(np.int64)
        long = np.flatnonzero(self.length >= SHORT)
        # the long items and their thinned copies, each between zeros; what windows there are of them
        self.begin = np.zeros(len(self.texts), np.int64)
        pieces, owner, place, offset, piece, at = [np.zeros(1, np.uint8)], [], [], [], [], 1
        for i in long.tolist():
            text = small(codes(self.texts[i]))
            self.begin[i] = at
            for every, stay in ((1, np.arange(len(text))), *thinned(len(text), self.similarity)):
                pieces += [text[stay], np.zeros(1, np.uint8)]
                windows = np.arange(0, len(stay), every, dtype=np.int32)
                owner.append(np.full(len(windows), i, np.int32))
                piece.append(np.full(len(windows), len(piece), np.int32))
                place.append(windows + np.int32(at))
                offset.append(stay[windows].astype(np.int32))
                at += len(stay) + 1
        self.y = np.concatenate([*pieces, np.zeros(STEPS, np.uint8)])
        joined = lambda parts: np.concatenate([np.zeros(0, np.int32), *parts])
        #: of each window: the item, which of the texts in y, its place in y, and that in the item
        self.owner, self.piece, self.place, self.offset = joined(owner), joined(piece), joined(place), joined(offset)
        window = self.place
        self.index = []
        bits = max(12, (16 * len(window)).bit_length())
        self.shift = np.uint32(32 - min(bits, 28))
        y3 = triples(self.y)
        for k in range((self.walks or walks_for(self.texts, self.similarity)) if len(long) and not self.exact else 0):
            walk = Walk(k)
            _, first, key = walk.keys(y3, self.place.astype(np.int64))
            order = self._ends(key)
            key, first = key[order], first[order]
            early, seen = np.zeros(1 << (32 - int(EARLY)), bool), np.zeros(1 << (32 - int(self.shift)), bool)
            early[first >> EARLY], seen[key >> self.shift] = True, True
            values, begin, count = np.unique(key, return_index=True, return_counts=True)
            self.index.append((walk, early, seen, values, begin.astype(np.int32), count.astype(np.int32), order.astype(np.int32)))
        self.parts = self._parts(np.flatnonzero((self.length > 0) & (self.length < SHORT)))

    def _ends(self, key: np.ndarray) -> np.ndarray:
        """The windows in the order of their keys; of those that a text has in common with itself the first
        and the last, which is enough: a passage of a document repeats itself alike."""
        order = np.lexsort((self.piece, key))
        same = (np.diff(key[order]) == 0) & (np.diff(self.piece[order]) == 0)
        return order[~(np.concatenate([[False], same]) & np.concatenate([same, [False]]))] if len(order) else order

    def _parts(self, items: np.ndarray) -> list[tuple[str, int, int]]:
        """(part, item, offset): each short item cut into one part more than edits are allowed."""
        out = []
        for i in items.tolist():
            cuts = np.linspace(0, self.length[i], int(self.allowed[i]) + 2).astype(int).tolist()
            out += [(self.texts[i][a:b], i, a) for a, b in pairwise(cuts)]
        return out

    def collisions(self, x: np.ndarray) -> Iterator[tuple[Walk, np.ndarray, np.ndarray]]:
        """For each walk (walk, place in x, window of an item) of the windows that collide, TOLD of them at a
        time or so: a key that many windows on either side have makes many, not one large table."""
        starts, x3 = np.arange(0, len(x) - STEPS, STRIDE), triples(x)
        for walk, early, seen, values, begin, count, order in self.index:
            near, _, key = walk.keys(x3, starts, early)
            some = np.flatnonzero(seen.take(key >> self.shift))
            near, key = near[some], key[some]
            at = np.searchsorted(values, key)
            at[at == len(values)] = 0
            hit = values[at] == key
            near, at = near[hit], at[hit]
            total = count[at].cumsum()
            first = 0
            while first < len(at):
                last = max(int(np.searchsorted(total, (total[first - 1] if first else 0) + TOLD, "right")), first + 1)
                few, many = at[first:last], count[at[first:last]]
                yield walk, np.repeat(starts[near[first:last]], many), order[np.repeat(begin[few] - (many.cumsum() - many), many) + np.arange(int(many.sum()))]
                first = last

    def candidates(self, x: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Rows (document, item, start of the item in x, agreeing share in thousandths, first and last
        place of a collision in the item) of alignments whose embeddings agree.  x holds documents that are
        each followed by a 0; ``ends`` are the places of those."""
        rows = [np.zeros((0, 6), np.int64)]
        walked, tested, passed = None, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for walk, place, window in self.collisions(x):
            if walk is not walked:  # alignments are walked once, however many tables they come in
                walked, tested, passed = walk, tested[:0], passed[:0]
            piece, offset = self.piece[window], self.offset[window].astype(np.int64)
            start = place - offset
            # one pair for each alignment: the walks from it tell the same
            alignment = piece.astype(np.int64) << 34 | start + (1 << 32)
            group = np.lexsort((offset, alignment))
            if not len(group):
                continue
            begin = np.flatnonzero(np.concatenate([[True], np.diff(alignment[group]) != 0]))
            end = np.concatenate([begin[1:], [len(group)]]) - 1
            pick, low, high = group[(begin + end) // 2], offset[group[begin]], offset[group[end]]
            place, window, start, alignment = place[pick], window[pick], start[pick], alignment[pick]
            item, other = self.owner[window].astype(np.int64), self.place[window].astype(np.int64)
            new = ~np.isin(alignment, tested)
            share = np.where(np.isin(alignment, passed), int(1000 * AGREE), 0)
            share[new] = walk.agreement(x, place[new], self.y, other[new])
            agrees = share >= 1000 * AGREE
            tested, passed = np.concatenate([tested, alignment[new]]), np.concatenate([passed, alignment[new & agrees]])
            document = np.searchsorted(ends, place)
            rows.append(np.stack([document, item, start, share, low, high], axis=1)[agrees])
        return np.concatenate(rows)

    def placements(self, x: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, first start, last start) of candidates whose starts differ by the allowed
        edits at most from one to the next, if their collisions stand SPREAD characters apart in the item,
        which one phrase in common doesn't do, or one agrees in ALONE."""
        found = self.candidates(x, ends)
        found = found[np.lexsort(found.T[2::-1])]
        document, item, start, share, low, high = found.T
        if not len(found):
            return
        apart = (np.diff(document) != 0) | (np.diff(item) != 0) | (np.diff(start) > self.allowed[item[:-1]])
        begin = np.concatenate([[0], np.flatnonzero(apart) + 1])
        end = np.concatenate([begin[1:], [len(found)]]) - 1
        spread = np.maximum.reduceat(high, begin) - np.minimum.reduceat(low, begin)
        for k in np.flatnonzero((spread >= SPREAD) | (np.maximum.reduceat(share, begin) >= 1000 * ALONE)).tolist():
            yield int(document[begin[k]]), int(item[begin[k]]), int(start[begin[k]]), int(start[end[k]])

    def short_placements(self, texts: list[str]) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, start, start) within a document for every place of a part of a short item."""
        for d, text in enumerate(texts):
            for part, i, offset in self.parts:
                at = text.find(part)
                while at >= 0:
                    yield d, i, at - offset, at - offset
                    at = text.find(part, at + 1)

    def pieces(self, placed: Iterable[tuple[int, int, int, int]]) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, begin, end), long stretches cut into overlapping pieces that are verified side by
        side: whatever an item may match is whole in one of them."""
        for d, i, low, high in placed:
            most = int(self.length[i] + self.allowed[i])
            while high - low > 4 * most:
                yield d, i, low, low + 3 * most
                low += 2 * most
            yield d, i, low, high

    def search(self, texts: list[str]) -> list[list[tuple]]:
        """For each normalised text (item_id, distance, similarity, start, end) of the items found in
        it, the best place each, by item."""
        joined = "\0".join([*texts, ""])
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        begins = np.concatenate([[0], ends[:-1] + 1])
        best: list[dict[int, tuple]] = [{} for _ in texts]

        placed = [(d, int(i), 0, len(t)) for d, t in enumerate(texts) for i in np.flatnonzero(self.length)] if self.exact else []
        if self.index and not self.exact:
            x = np.concatenate([small(codes(joined)), np.zeros(STEPS, np.uint8)])
            for d, i, first, last in self.placements(x, ends):
                # starts come from any alignment: within the allowed edits of the passage's own
                n, allowed, base = int(self.length[i]), int(self.allowed[i]), int(begins[d])
                placed.append((d, i, max(first - allowed - base, 0), min(last + n + 2 * allowed - base, len(texts[d]))))
        for d, i, first, last in self.short_placements(texts) if not self.exact else ():
            placed.append((d, i, max(first - int(self.allowed[i]), 0), min(last + int(self.length[i] + self.allowed[i]), len(texts[d]))))
        placed.sort(key=lambda p: (p[3] - p[2], p))
        pieces = self.pieces(placed)
        while part := list(islice(pieces, PAIRS)):
            distances, stops = edit_distances([self.texts[p[1]] for p in part], [texts[d][low:high] for d, _, low, high in part])
            for (d, i, low, _), distance, stop in zip(part, distances.tolist(), stops.tolist(), strict=True):
                if distance <= self.allowed[i] and (i not in best[d] or (distance, low + stop) < (best[d][i][1], best[d][i][4])):
                    n = int(self.length[i])
                    best[d][i] = (self.ids[i], distance, 1 - distance / n, max(0, low + stop - n), low + stop)
        return [[found[i] for i in sorted(found)] for found in best]


def _search(shipped, columns: list[str], out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, *block = shipped.value
        items = held(f"items {key}", lambda: Items(*block))
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("similarity", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            found: list[list[tuple]] = []
            texts, size = [], 0
            for t in batch.column(batch.num_columns - 1):
                texts.append(normalise(t.as_py()))
                size += len(texts[-1])
                if size > CHUNK:
                    found += items.search(texts)
                    texts, size = [], 0
            found += items.search(texts) if texts else []
            names = ("item_id", "distance", "similarity", "start", "end")
            rows = pa.array([[dict(zip(names, f, strict=True)) for f in x] for x in found], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], rows], [*columns, out])

    return run


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", out: str = "contamination", similarity: float = SIMILARITY, block: int = BLOCK, exact: bool = False
) -> DataFrame:
    """Append ``out``: the benchmark items that a document holds a passage of, with the edit distance,
    and start and end in the normalised text.

    Null and empty texts hold none; null and empty items are not sought; items with one text are each
    reported; repeated documents each get their row, and other columns are carried (one named like
    ``out`` is replaced).  The benchmark is sought in blocks of ``block`` characters or so, one after
    the other: only one is on the driver and in a broadcast.  Several blocks need an id a row: then
    the documents are written with one, and the finds of each block, which are few, are joined to it.
    ``exact`` verifies every place of every text, without the index.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block))
    docs = docs.drop(out)
    columns = docs.columns
    row, last = fresh(docs, "_row"), fresh(docs, "_text")

    def sought(df: DataFrame, k: int) -> tuple[DataFrame, Broadcast] | None:
        """df, whose last column is a text, with that replaced by the finds of block k."""
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        rows = sorted(((r.item_id, normalise(r.text)) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        rows = [(i, t) for i, t in rows if t]
        if not rows:
            return None
        texts = [t for _, t in rows]
        shipped = spark.sparkContext.broadcast((uuid.uuid4().hex, [i for i, _ in rows], texts, similarity, 0 if exact else walks_for(texts, similarity), exact))
        kept = df.columns[:-1]
        return map_arrow(df, _search(shipped, kept, out), StructType([*df.schema.fields[:-1], *StructType.fromDDL(f"`{out}` {FOUND}")])), shipped

    none = F.array().cast(FOUND)
    if blocks == 1:
        found = sought(docs.withColumn(last, F.col(text)), 0)
        return found[0] if found else docs.withColumn(out, none)
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    finds = []
    for k in range(blocks):
        if found := sought(rows.select(row, text), k):
            finds.append(materialize(found[0].where(F.size(out) > 0), "finds"))
            found[1].destroy()
    if not finds:
        return docs.withColumn(out, none)
    whole = reduce(DataFrame.unionByName, finds).groupBy(row).agg(F.flatten(F.collect_list(out)).alias(out))
    return rows.join(whole, row, "left").select(*columns, F.coalesce(F.array_sort(out), none).alias(out))


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, distance, similarity for every contaminated document and item."""
    found = find_contamination(docs.select("doc_id", "text"), benchmark)
    return found.select("doc_id", F.explode("contamination").alias("c")).select("doc_id", "c.item_id", "c.distance", "c.similarity")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark passage, with their columns."""
    columns = docs.columns
    name = fresh(docs, "_items")
    return find_contamination(docs, benchmark, out=name).where(F.size(name) == 0).select(*columns)
