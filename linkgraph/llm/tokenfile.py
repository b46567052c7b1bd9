"""Token ids as binary files with Elias-Fano coded document boundaries.

A shard file is the concatenated ids of its documents (2 bytes each where the vocabulary allows,
else 4), two Elias-Fano sequences - where each document ends, and the doc_ids - and a footer.  A
monotone sequence of n values below u takes n * (2 + log2(u / n)) bits or so: the low bits are
packed, the high parts are written in unary, and a select directory of 32-bit bit positions, one
for every 256th value, leads to any value in constant time.  No 64-bit table is kept.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import pairwise
from operator import itemgetter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkgraph.llm.common import held, map_arrow, materialize, partitions_for, scratch_path

MAGIC = b"LGTOK001"
#: magic, id width, documents, ids, null doc_ids, least doc_id, bytes of the ids, of the boundaries
FOOTER = struct.Struct("<8sIQQQqQQ")
SAMPLE = 256
#: Chunks that an encoder remembers.
REMEMBERED = 600_000
#: Bytes of ids that are read at once; bytes of a table's files that go to a shard.
READ, SHARD = 16 << 20, 256 << 20
#: What a text of plain Latin characters lacks: all past the Latin letters that no normal form takes
#: apart, and the one capital there whose small form isn't a single letter.
BEYOND = re.compile("[^\\x00-\\u024f]|\u0130")
_MARKS = "".join(re.escape(c) for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
#: What would join a run of ASCII marks beside white space, letters, digits and those marks: the
#: apostrophe, which begins word endings, control characters and Latin-1's own marks.
_OTHERS = "".join(re.escape(c) for c in map(chr, range(0x250)) if not c.isalnum() and c not in " \t\n\r" and not ("!" <= c <= "~" and c != "'"))
OTHERS = re.compile(f"[{_OTHERS}]")
#: Runs of ASCII marks, in texts without the others, and those that none of the others adjoins.
RUNS = re.compile(f"[{_MARKS}]+")
APART = re.compile(f"(?<![{_OTHERS}{_MARKS}])[{_MARKS}]++(?![{_OTHERS}])")


class EliasFano:
    """A monotone sequence of integers from 0 on, with access by index."""

    HEAD = struct.Struct("<QIQ")

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, select: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.select = n, low_bits, low, high, select

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        most = int(values[-1]) if n else 0
        low_bits = max(0, (most // max(n, 1)).bit_length() - 1)
        # a multiple of 8 values at a time ends at a byte
        places = np.arange(low_bits, dtype=np.uint64)
        parts = (values[k : k + (1 << 16), None] >> places & np.uint64(1) for k in range(0, n, 1 << 16))
        low = np.concatenate([np.zeros(0, np.uint8), *(np.packbits(p.astype(np.uint8).ravel(), bitorder="little") for p in parts)])
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        unary[ones] = 1
        return cls(n, low_bits, low, np.packbits(unary, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        head = self.HEAD.pack(self.n, self.low_bits, len(self.high))
        return head + self.low.tobytes() + self.high.tobytes() + self.select.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, low_bits, high = cls.HEAD.unpack_from(data)
        at = cls.HEAD.size
        low = np.frombuffer(data, np.uint8, -(-n * low_bits // 8), at)
        at += len(low)
        return cls(n, low_bits, low, np.frombuffer(data, np.uint8, high, at), np.frombuffer(data, "<u4", -1, at + high))

    def _low(self, i: int) -> int:
        first = i * self.low_bits
        packed = int.from_bytes(self.low[first >> 3 : (first + self.low_bits + 7) >> 3].tobytes(), "little")
        return packed >> (first & 7) & ((1 << self.low_bits) - 1)

    def __getitem__(self, i: int) -> int:
        """Value i: select its one among the high bits, from the sample before it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, rank = int(self.select[i // SAMPLE]), i % SAMPLE
        byte, skipped = at >> 3, int(self.high[at >> 3] & ((1 << (at & 7)) - 1)).bit_count()
        rank += skipped
        while rank >= (ones := int(self.high[byte]).bit_count()):
            rank -= ones
            byte += 1
        word = int(self.high[byte])
        for _ in range(rank):
            word &= word - 1
        at = (byte << 3) + (word & -word).bit_length() - 1
        return (at - i) << self.low_bits | self._low(i)

    def range(self, start: int, stop: int) -> np.ndarray:
        """Values start to stop as uint64: one select, then a scan of the high bits between."""
        if start >= stop:
            return np.zeros(0, np.uint64)
        first = int(self.select[start // SAMPLE])
        last = int(self.select[-(-stop // SAMPLE)]) if -(-stop // SAMPLE) < len(self.select) else 8 * len(self.high)
        bits = np.unpackbits(self.high[first >> 3 : (last >> 3) + 1], bitorder="little")
        bits[: first & 7] = 0
        ones = np.flatnonzero(bits)[start % SAMPLE :][: stop - start] + (first & ~7)
        high = (ones - np.arange(start, stop)).astype(np.uint64) << np.uint64(self.low_bits)
        at, end = start * self.low_bits, stop * self.low_bits
        low = np.unpackbits(self.low[at >> 3 : (end + 7) >> 3], bitorder="little")[at & 7 :][: end - at]
        weights = np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64)
        return high + low.reshape(-1, self.low_bits).astype(np.uint64) @ weights if self.low_bits else high


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder that the executors share (file, hdfs, s3, gs, or a path)."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


class ShardWriter:
    """Writes one shard: documents in ascending doc_id order, null doc_ids first."""

    def __init__(self, fs: pafs.FileSystem, path: str, width: int):
        self.fs, self.path, self.width = fs, path, width
        self.ids = self.nulls = 0
        self.ends, self.docs = array("Q"), array("q")  # 8 bytes a document
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = fs.open_output_stream(path)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.out.write(ids.astype(f"<u{self.width}").tobytes())
        self.ids += len(ids)
        self.ends.append(self.ids)
        if doc_id is None:
            self.nulls += 1
        else:
            self.docs.append(doc_id)

    def close(self) -> None:
        least = self.docs[0] if self.docs else 0
        ends = EliasFano.build(np.frombuffer(self.ends, np.uint64)).to_bytes()
        docs = EliasFano.build((np.frombuffer(self.docs, np.int64) - least).view(np.uint64)).to_bytes()
        self.out.write(ends)
        self.out.write(docs)
        # last, since the stream is written once, front to back
        self.out.write(FOOTER.pack(MAGIC, self.width, len(self.ends), self.ids, self.nulls, least, len(ends), len(docs)))
        self.out.close()


class ShardReader:
    """Random access to a shard file: ``doc_id(i)``, ``bounds(i)`` and ``ids(i)``."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.file = fs.open_input_file(path)
        size = self.file.size()
        magic, self.width, self.n, self.total, self.nulls, self.least, ends, docs = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no token file")
        self.ends = EliasFano.from_bytes(self._read(self.total * self.width, ends))
        self.docs = EliasFano.from_bytes(self._read(self.total * self.width + ends, docs))

    def _read(self, at: int, size: int) -> bytes:
        return self.file.read_at(size, at)

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.docs[i - self.nulls] + self.least

    def bounds(self, i: int) -> tuple[int, int]:
        return (self.ends[i - 1] if i else 0), self.ends[i]

    def ids(self, i: int) -> np.ndarray:
        start, end = self.bounds(i)
        return np.frombuffer(self._read(start * self.width, (end - start) * self.width), f"<u{self.width}")

    def block(self, start: int, stop: int, most: int = READ) -> tuple[list[int | None], np.ndarray, list[np.ndarray]]:
        """doc_ids, bounds (one more) and ids of documents from start on, to stop or as far as ``most``
        bytes of ids go (one document at least); the ids are read in one range."""
        ends = self.ends.range(start, stop).astype(np.int64)
        first = self.ends[start - 1] if start else 0
        stop = start + max(1, int(np.searchsorted(ends, first + most // self.width, "right")))
        bounds = np.concatenate([[first], ends[: stop - start]])
        some = max(start, self.nulls)
        docs = [None] * (some - start if some < stop else stop - start)
        docs += [int(x) + self.least for x in self.docs.range(some - self.nulls, stop - self.nulls)] if some < stop else []
        data = np.frombuffer(self._read(first * self.width, int(bounds[-1] - first) * self.width), f"<u{self.width}")
        return docs, bounds, [data[a:b] for a, b in pairwise((bounds - first).tolist())]


class CachedEncoder:
    """The tokenizers library's ids of whole texts, through a bounded table of words.

    For a tokenizer that lower-cases, drops white space and keeps marks apart from letters
    (``splits`` is what was checked of that), the ids of a text are those of its chunks between
    blanks, tabs and line ends in turn.  A text of plain Latin characters is lower-cased before, and
    ASCII marks are set apart from its letters and digits, so that fewer chunks differ.  New chunks
    are encoded many at a time, and offsets deal out the ids.

    Added tokens are found in the raw text, before any of that, so a text that holds one goes to the
    library whole.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker per core already
        import tokenizers

        self.tokenizer = tokenizers.Tokenizer.from_str(definition)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = re.compile("|".join(re.escape(t.content) for t in added) or r"(?!)")
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        probe = ["ab", " ab", "ab ", "ab cd", "a\tb\r\n c", "Ab.", "(ab) &CD&", "é! 7a?", "It's!'"]
        # one that is sought in the normalised text could stand there alone
        self.splits = not any(t.normalized for t in added) and all(self._plain(p) == [i for c in self._chunks(p) for i in self._plain(c)] for p in probe)
        self.known: dict[str, bytes] = {}

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    @staticmethod
    def _chunks(text: str) -> list[str]:
        """A text in parts that the tokenizer keeps apart."""
        if text.isascii() or not BEYOND.search(text):
            text = (APART if OTHERS.search(text) else RUNS).sub(r" \g<0> ", text.lower())
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")

    def _encode(self, chunks: list[str]) -> Iterator[bytes]:
        """The packed ids of each chunk."""
        for at in range(0, len(chunks), 512):
            part = chunks[at : at + 512]
            starts = np.cumsum([0, *(len(c) + 1 for c in part)])
            coded = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            first = np.fromiter((o[0] for o in coded.offsets), np.int64, len(coded.ids))
            bounds = (4 * np.searchsorted(first, starts)).tolist()
            packed = np.array(coded.ids, "<u4").tobytes()
            yield from (packed[a:b] for a, b in pairwise(bounds))

    def encode_batch(self, texts: list[str], end_id: int) -> list[np.ndarray]:
        end = np.array([end_id], "<u4").tobytes()
        whole = [i for i, t in enumerate(texts) if not self.splits or self.added.search(t)]
        library = dict(zip(whole, self.tokenizer.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False), strict=True))
        cut = [[] if i in library else self._chunks(t) for i, t in enumerate(texts)]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list(set().union(*cut).difference(self.known))
        self.known.update(zip(new, self._encode(new), strict=True))
        # one look-up of all chunks of a text; the two more keep it a tuple
        self.known[""] = b""
        found = (itemgetter("", "", *chunks)(self.known) for chunks in cut)
        packed = (np.array(library[i].ids, "<u4").tobytes() if i in library else b"".join(f) for i, f in enumerate(found))
        return [np.frombuffer(p + end, "<u4") for p in packed]


def _encoder(definition: str) -> CachedEncoder:
    return held(f"tokenizer {definition}", lambda: CachedEncoder(definition))


def _groups(batches: Iterable[pa.RecordBatch], most: int = 1 << 21) -> Iterator[tuple[list, list[str]]]:
    """doc_ids and texts, about ``most`` characters at a time."""
    docs, texts, size = [], [], 0
    for batch in batches:
        for d, t in zip(batch.column(0), batch.column(1), strict=True):
            docs.append(d.as_py())
            texts.append(t.as_py() or "")
            size += len(texts[-1])
            if size >= most:
                yield docs, texts
                docs, texts, size = [], [], 0
    if docs:
        yield docs, texts


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 1, shards: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the ids of every whole text, each followed by ``end_id``, as shard files in ``folder``.

    Documents stand in ascending doc_id order over the shards (null doc_ids first; of one doc_id,
    by a hash of the text, so that a doc_id on very many rows is split).  Returns the manifest, one
    row per shard: shard, file, documents, ids.  An attempt writes a file of its own and the manifest
    names those of the attempts that counted, so a repeated task leaves no mark.  Null texts are
    empty; an empty table has no shards; further columns are ignored.  Without ``shards`` there is one
    for each SHARD bytes of the table's files, and as many as shuffle partitions at least.
    """
    spark = docs.sparkSession
    n = shards or partitions_for(docs, SHARD)
    shipped = spark.sparkContext.broadcast(Path(tokenizer).read_text(encoding="utf-8"))  # a file of fixed size
    slim = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t"))
    ordered = slim.withColumn("h", F.xxhash64("t")).repartitionByRange(n, "d", "h").sortWithinPartitions("d", "h", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        encoder = _encoder(shipped.value)
        fs, base = open_folder(folder)
        name, writer = f"shard-{shard:06d}-{uuid.uuid4().hex[:8]}.tok", None
        for ids, texts in _groups(batches):
            writer = writer or ShardWriter(fs, f"{base}/{name}", encoder.width)
            for d, coded in zip(ids, encoder.encode_batch(texts, end_id), strict=True):
                writer.add(d, coded)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "file": [name], "documents": [len(writer.ends)], "ids": [writer.ids]})

    made = map_arrow(ordered.select("d", "t"), run, "shard int, file string, documents long, ids long")
    return materialize(made, "manifest")


def read_tokens(manifest: DataFrame, folder: str, block: int = 4096) -> DataFrame:
    """Read the shard files back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    A shard's base is the sum over the shards before it; the manifest has a row per shard, so that
    sum is over a few rows whatever the corpus.  Blocks of documents are read one at a time.
    """
    before = F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    based = manifest.withColumn("base", F.coalesce(before, F.lit(0)))
    n = max(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), manifest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_folder(folder)
        for batch in batches:
            for row in batch.to_pylist():
                reader = ShardReader(fs, f"{root}/{row['file']}")
                at = 0
                while at < reader.n:
                    docs, bounds, ids = reader.block(at, min(at + block, reader.n))
                    at += len(docs)
                    crcs = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(docs, pa.int64()), pa.array(bounds[:-1] + row["base"]), pa.array(np.diff(bounds)), pa.array(crcs, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    spread = based.select("file", "base").repartition(n, "file")
    return map_arrow(spread, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenfile_digest(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write the corpus to token files in the shared folder and return what reading them gives."""
    folder = scratch_path(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, tokenizer, folder, end_id), folder)
