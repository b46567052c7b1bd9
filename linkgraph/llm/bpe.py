"""Byte-level BPE encoding and decoding with segment trees.

The text is cut by the vocabulary's pattern; within a piece, a segment tree over byte positions
holds at each leaf the rank of the pair that begins there, and at each inner node the least
(rank, position) below it.  The root is thus the leftmost pair of minimum rank.  A merge writes
three leaves - the merged token's, its live left neighbour's, and that of the token it swallowed -
and the logarithmic paths above them.

Pieces of like size are merged side by side: one numpy array holds all their trees, and each round
does one merge in every piece that still has one.  Few or long pieces go through the same tree one
by one.  Pieces are remembered in a bounded table, since words repeat.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkgraph.llm.common import fresh, held, map_arrow

NONE = np.iinfo(np.int32).max
#: Characters that are cut into pieces at a time, and pieces that are remembered.
CHUNK, REMEMBERED = 1 << 20, 400_000
#: Pieces above so many bytes, or fewer than ALONE of a size, get a tree each.
WIDE, ALONE = 256, 6


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """The ranks of a file with a base64 token and its rank on each line."""
    return {base64.b64decode(t): int(r) for t, r in map(bytes.split, filter(None, data.splitlines()))}


class PairTable:
    """(left id, right id) -> rank of their concatenation, as an open-addressing table in numpy."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pairs = pairs
        bits = max(4, (4 * len(pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, NONE, np.int32)
        key = np.fromiter(pairs, np.int64, len(pairs))
        value = np.fromiter(pairs.values(), np.int32, len(pairs))
        at = self._slot(key)
        while len(key):
            free = self.keys[at] == -1
            self.keys[at[free]] = key[free]
            taken = self.keys[at] == key
            self.values[at[taken]] = value[taken]
            key, value, at = key[~taken], value[~taken], (at[~taken] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; NONE where the pair is no token or an id is negative."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = self._slot(key)
        out = self.values[at]
        held = self.keys[at]
        open_ = np.flatnonzero((held != key) & (held != -1))
        out[held != key] = NONE
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            held = self.keys[at[open_]]
            hit = held == key[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (held != -1)]
        return out


def merge_one(ids: list[int], pairs: dict[int, int]) -> list[int]:
    """Merge one piece, given as the ids of its bytes, with a segment tree of its own."""
    n = len(ids)
    size = 1 << max(n - 1, 1).bit_length()
    none = 1 << 62
    token, after, before = ids[:], [*range(1, n), -1], [*range(-1, n - 1)]
    tree = [none] * (2 * size)
    for i in range(n - 1):
        rank = pairs.get(ids[i] << 32 | ids[i + 1])
        if rank is not None:
            tree[size + i] = rank * size + i
    for i in range(size - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])

    def put(i: int, value: int) -> None:
        i += size
        tree[i] = value
        while i > 1:
            i >>= 1
            least = min(tree[2 * i], tree[2 * i + 1])
            if tree[i] == least:
                break
            tree[i] = least

    def rank_at(i: int) -> int:
        j = after[i]
        rank = pairs.get(token[i] << 32 | token[j]) if j >= 0 else None
        return none if rank is None else rank * size + i

    while tree[1] < none:
        merged, i = divmod(tree[1], size)
        gone = after[i]
        token[i], after[i] = merged, after[gone]
        if after[i] >= 0:
            before[after[i]] = i
        put(gone, none)
        put(i, rank_at(i))
        if before[i] >= 0:
            put(before[i], rank_at(before[i]))
    out, i = [], 0
    while i >= 0:
        out.append(token[i])
        i = after[i]
    return out


def merge_many(ids: np.ndarray, lengths: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Merge pieces side by side: ``ids`` has a row of byte ids each, -1 beyond its length.

    Returns the rows with the token at each live position and -1 elsewhere, and the live counts.
    """
    n, size = ids.shape
    token = ids.astype(np.int32)
    at = np.arange(size, dtype=np.int32)
    after = np.where(at + 1 < lengths[:, None], at + 1, -1).astype(np.int32)
    before = np.broadcast_to(at - 1, (n, size)).astype(np.int32).copy()
    tree = np.full((n, 2 * size), NONE, np.int32)
    rank = table.get(token[:, :-1].ravel(), token[:, 1:].ravel()).reshape(n, size - 1)
    has = rank != NONE
    tree[:, size:-1] = np.where(has, np.where(has, rank, 0) * size + at[:-1], NONE)
    width = size
    while width > 1:
        half = width // 2
        tree[:, half:width] = np.minimum(tree[:, width : 2 * width : 2], tree[:, width + 1 : 2 * width : 2])
        width = half
    flat, tok, aft, bef = tree.ravel(), token.ravel(), after.ravel(), before.ravel()
    live = lengths.astype(np.int64).copy()
    rows = np.flatnonzero(tree[:, 1] != NONE)
    while len(rows):
        best = flat[rows * 2 * size + 1]
        i = best % size
        leaf, base = rows * size, rows * 2 * size
        gone = aft[leaf + i]
        following = aft[leaf + gone]
        tok[leaf + i] = best // size
        tok[leaf + gone] = -1
        aft[leaf + i] = following
        live[rows] -= 1
        ahead = following >= 0
        bef[(leaf + following)[ahead]] = i[ahead]
        previous = bef[leaf + i]
        behind = previous >= 0
        nothing = np.full(len(rows), -1, np.int32)
        right = np.where(ahead, tok[leaf + np.maximum(following, 0)], nothing)
        left = np.where(behind, tok[leaf + np.maximum(previous, 0)], nothing)
        merged = tok[leaf + i]
        ranks = table.get(np.concatenate([merged, left]), np.concatenate([right, merged]))
        ranks[: len(rows)][~ahead] = NONE
        ranks[len(rows) :][~behind] = NONE
        places = np.concatenate([i, np.maximum(previous, 0)])
        leaves = np.where(ranks != NONE, np.where(ranks != NONE, ranks, 0) * size + places, NONE)
        flat[base + size + gone] = NONE
        flat[base + size + i] = leaves[: len(rows)]
        some = np.flatnonzero(behind)
        flat[base[some] + size + previous[some]] = leaves[len(rows) :][some]
        above = np.concatenate([base, base, base[some]])
        node = np.concatenate([gone, i, previous[some]]) + size
        while node[0] > 1:
            node >>= 1
            child = above + 2 * node
            flat[above + node] = np.minimum(flat[child], flat[child + 1])
        rows = rows[flat[base + 1] != NONE]
    return token, live


class Codec:
    """Encodes texts to ids and decodes ids to bytes by a table of ranks and a cutting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.table = PairTable(ranks)
        self.pairs = self.table.pairs
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.bytes_of = {r: t for t, r in ranks.items()}
        # \s is Unicode's White_Space; the separators U+001C to U+001F aren't in it
        self.cut = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.known: dict[str, bytes] = {}

    def _merge(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece, as packed 32-bit integers."""
        raw = [p.encode() for p in pieces]
        out: list[bytes] = [b""] * len(raw)
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        sizes = 1 << np.ceil(np.log2(np.maximum(lengths, 2))).astype(np.int64)
        for size in np.unique(sizes).tolist():
            chosen = np.flatnonzero(sizes == size)
            if size > WIDE or len(chosen) < ALONE:
                for i in chosen.tolist():
                    ids = self.byte_id[np.frombuffer(raw[i], np.uint8)].tolist()
                    out[i] = np.array(merge_one(ids, self.pairs), "<i4").tobytes()
                continue
            for at in range(0, len(chosen), 16384):
                part = chosen[at : at + 16384]
                packed = b"".join([raw[i].ljust(size, b"\0") for i in part.tolist()])
                n = lengths[part]
                ids = self.byte_id[np.frombuffer(packed, np.uint8).reshape(len(part), size)]
                ids[np.arange(size) >= n[:, None]] = -1
                token, live = merge_many(ids, n, self.table)
                packed = token[token >= 0].astype("<i4").tobytes()
                ends = (4 * live.cumsum()).tolist()
                start = 0
                for i, end in zip(part.tolist(), ends, strict=True):
                    out[i] = packed[start:end]
                    start = end
        return out

    def _learn(self, pieces: set[str]) -> None:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = [p for p in pieces if p not in self.known]
        self.known.update(zip(new, self._merge(new), strict=True))

    def _pieces(self, text: str) -> Iterator[list[str]]:
        if len(text) <= CHUNK:
            yield self.cut.findall(text)
            return
        found = (m.group() for m in self.cut.finditer(text))
        while part := list(islice(found, CHUNK >> 2)):
            yield part

    def encode_batch(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text, in order; null is empty.  Cuts about CHUNK characters at a time."""
        held: list[list[str]] = []
        weight = 0

        def flush() -> Iterator[np.ndarray]:
            self._learn(set().union(*held))
            for pieces in held:
                yield np.frombuffer(b"".join([self.known[p] for p in pieces]), "<i4")
            held.clear()

        for text in texts:
            text = text or ""
            if len(text) > CHUNK:
                yield from flush()
                weight = 0
                parts = []
                for pieces in self._pieces(text):
                    self._learn(set(pieces))
                    parts.append(np.frombuffer(b"".join([self.known[p] for p in pieces]), "<i4"))
                yield np.concatenate(parts)
                continue
            held.extend(self._pieces(text))
            weight += len(text)
            if weight > CHUNK:
                yield from flush()
                weight = 0
        yield from flush()

    def encode(self, text: str | None) -> np.ndarray:
        return next(self.encode_batch([text]))

    def decode(self, ids: Iterable[int]) -> bytes:
        """The bytes of ids; an id that isn't in the vocabulary is a KeyError."""
        return b"".join([self.bytes_of[i] for i in ids])


def _codec(shipped) -> Codec:
    """One codec for a vocabulary in each Python worker."""
    data, pattern = shipped.value
    return held(f"bpe {hashlib.sha256(data + pattern.encode()).hexdigest()}", lambda: Codec(parse_ranks(data), pattern))


def _map_texts(df: DataFrame, text: str, vocabulary: str, pattern: str, fields: str, rows: Callable, carry: bool = True) -> DataFrame:
    """Append ``fields``; ``rows(codec, texts)`` yields their values for each text.  Without ``carry`` the
    text isn't among the columns of the result, and crosses to Python once and not back."""
    # the vocabulary's file is of fixed size (below 1 MB); executors needn't have it
    shipped = df.sparkSession.sparkContext.broadcast((Path(vocabulary).read_bytes(), pattern))
    schema = df.sparkSession.createDataFrame([], fields).schema
    names = [f.name for f in schema]
    gone = {n.lower() for n in names} | (set() if carry else {text.lower()})
    kept = [c for c in df.columns if c.lower() not in gone]
    last = fresh(df, "_text")
    slim = df.select(*kept, F.col(text).alias(last))
    types = [pa.list_(pa.int32()) if "array" in f.dataType.simpleString() else {"long": pa.int64(), "bigint": pa.int64()}.get(f.dataType.simpleString(), pa.string()) for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shipped)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            values = list(rows(codec, (x.as_py() for x in texts)))
            made = [pa.array([v[i] for v in values], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*kept, *names])

    shape = slim.drop(last).schema
    for field in schema:
        shape = shape.add(field)
    return map_arrow(slim, run, shape)


def encode(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Append ``out``: array<int> of the ids of the whole text.  Special tokens have no meaning here.

    A null or empty text has no ids; other columns are carried, nulls and repeats included, and one
    named like ``out`` is replaced.
    """
    return _map_texts(df, text, vocabulary, pattern, f"{out} array<int>", lambda c, texts: ((x,) for x in c.encode_batch(texts)))


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Append ``out``: the bytes (binary) that an array<int> of ids stands for; null ids give none."""
    shipped = df.sparkSession.sparkContext.broadcast((Path(vocabulary).read_bytes(), ""))
    kept = [c for c in df.columns if c.lower() != out.lower()]
    last = fresh(df, "_ids")
    slim = df.select(*kept, F.col(ids).alias(last))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = {r: t for t, r in parse_ranks(shipped.value[0]).items()}
        for batch in batches:
            texts = [b"".join([bytes_of[i] for i in x.as_py() or ()]) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.binary())], [*kept, out])

    return map_arrow(slim, run, slim.drop(last).schema.add(out, "binary"))


def token_digest(docs: DataFrame, vocabulary: str, pattern: str, keep: Iterable[str | Column] = ("doc_id",)) -> DataFrame:
    """Encode each whole text, decode the ids, and return digests of both: n_tokens, ids_sha256,
    decoded_sha256.  The ids stay in the worker, so no array leaves it.  A null text counts as empty."""

    def rows(codec: Codec, texts: Iterable[str | None]) -> Iterator[tuple]:
        word = [str(i) for i in range(max(codec.bytes_of) + 1)]
        for ids in codec.encode_batch(texts):
            listed = ids.tolist()
            text = " ".join([word[i] for i in listed]).encode()
            yield len(listed), hashlib.sha256(text).hexdigest(), hashlib.sha256(codec.decode(listed)).hexdigest()

    slim = docs.select(*keep, "text")
    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _map_texts(slim, "text", vocabulary, pattern, fields, rows, carry=False)
