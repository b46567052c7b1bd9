"""Token files against the tokenizers library, and Elias-Fano against plain lists."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow.fs as pafs
import pytest
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from linkgraph.llm import tokenfile

WORDS = P.path("word_bpe_49k.json")
#: The library as it loads the file, added tokens in a text included.
BRUTE = tokenizers.Tokenizer.from_file(WORDS)
TEXTS = [None, "", "  ", "Plain words, don't!", "é́ Σ ΑΣ ΟΔΟΣ\tx\r\ny\x0bz\x1cw\x85v  u", "<|endoftext|> a<|startoftext|>b", "<|EndOfText|> a <|endoftext|", "Word.<|endoftext|>(word", "x" * 5000, "ab " * 9000, " ́a ﷺ ǅ İstanbul 123"]


#: Added tokens in either case and in parts, beside letters, marks and blanks.
PIECES = st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|StartOfText|>", "<|", "|>", "endoftext", "a", "É", " ", "\n", ".", "'s", "x1"]), max_size=12).map("".join)


def brute(text):
    return [*BRUTE.encode(text or "", add_special_tokens=False).ids, 1]


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(0, 1 << 45), max_size=700), st.integers(0, 40))
def test_elias_fano(values, shift):
    values = sorted(v >> shift for v in values)
    ef = tokenfile.EliasFano.from_bytes(tokenfile.EliasFano.build(np.array(values, np.uint64)).to_bytes())
    assert [ef[i] for i in range(len(values))] == values
    for a in range(0, len(values), 97):
        assert ef.range(a, len(values)).tolist() == values[a:]
        assert ef.range(a, min(a + 50, len(values))).tolist() == values[a : a + 50]
    with pytest.raises(IndexError):
        ef[len(values)]


def test_space(tmp_path):
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2000, 50_000))
    assert len(tokenfile.EliasFano.build(ends).to_bytes()) * 8 / len(ends) < 2.3 + np.log2(ends[-1] / len(ends))


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=80) | st.text("aBÉß'.!(&*= \n\u0301\u00a01²़क़ſ", max_size=40) | PIECES)
def test_chunks_equal_whole_texts(text):
    encoder = tokenfile._encoder(open(WORDS, encoding="utf-8").read())
    assert encoder.splits
    assert encoder.encode_batch([text], 1)[0].tolist() == brute(text)


def test_written_and_read(spark, docs, documents, tmp_path):
    rows = [(r.doc_id, r.text) for r in documents.collect()] + [(1000 + 3 * i, t) for i, t in enumerate(TEXTS)]
    rows += [(None, "null id"), (-7, "below zero"), (5, "again"), (5, "again")]
    random.Random(3).shuffle(rows)
    want, at, ordered = [], 0, {}
    for i, t in rows:
        ordered.setdefault(i, []).append(brute(t))
    out = tokenfile.tokenfile_digest(docs(rows), WORDS).collect()
    got = sorted(out, key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    for r in got:
        assert r.start == at
        at += r.n_tokens
        want = [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ordered[r.doc_id] if len(x) == r.n_tokens]
        assert r.ids_crc32 in want
    assert at == sum(len(x) for v in ordered.values() for x in v)


def test_random_access(docs, tmp_path):
    folder = str(tmp_path / "tokens")
    rows = [(i * 10, f"document number {i}") for i in range(700)] + [(None, "x")]
    manifest = tokenfile.write_tokens(docs(rows), WORDS, folder, shards=3).collect()
    assert sum(m.documents for m in manifest) == 701
    seen = []
    for m in sorted(manifest, key=lambda m: m.shard):
        reader = tokenfile.ShardReader(pafs.LocalFileSystem(), f"{folder}/{m.file}")
        for i in range(reader.n):
            seen.append(reader.doc_id(i))
            if i % 50 == 7:
                assert reader.ids(i).tolist() == brute(f"document number {seen[-1] // 10}")
    assert seen == [None, *range(0, 7000, 10)]


def test_blocks_are_read_in_ranges(docs, tmp_path):
    folder = str(tmp_path / "tokens")
    rows = [(i, "word " * (i % 5) + "long " * (3000 if i == 40 else 0)) for i in range(90)]
    manifest = tokenfile.write_tokens(docs(rows), WORDS, folder, shards=1).collect()
    reader = tokenfile.ShardReader(pafs.LocalFileSystem(), f"{folder}/{manifest[0].file}")
    reads = []
    read = reader._read
    reader._read = lambda at, size: reads.append(size) or read(at, size)
    at, seen = 0, []
    while at < reader.n:
        ids, bounds, found = reader.block(at, min(at + 50, reader.n), 100)
        assert [x.tolist() for x in found] == [brute(dict(rows)[i]) for i in ids] and len(bounds) == len(ids) + 1
        at += len(ids)
        seen += ids
    assert seen == list(range(90)) and len(reads) < 20
    assert max(reads) == 2 * 3001 and all(r <= 100 or r == max(reads) for r in reads)


def test_clashing_columns(spark, docs):
    clash = "d t h shard file documents ids base start n_tokens ids_crc32".split()
    df = docs([(2, "two words", *clash), (1, None, *clash)], "doc_id long, text string, " + ", ".join(f"{c} string" for c in clash))
    out = sorted(map(tuple, tokenfile.tokenfile_digest(df, WORDS).collect()))
    crc = lambda t: zlib.crc32(np.array(brute(t), "<u4").tobytes())
    assert out == [(1, 0, 1, crc("")), (2, 1, len(brute("two words")), crc("two words"))]


def test_empty(docs):
    assert tokenfile.tokenfile_digest(docs([]), WORDS).count() == 0
