"""Byte-level BPE against the library that reads the same ranks, and exact round trips."""

import hashlib
import random
from pathlib import Path

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from linkgraph.llm import bpe

VOCABULARY = P.path("byte_bpe_50k.tiktoken")
RANKS = bpe.parse_ranks(Path(VOCABULARY).read_bytes())
CODEC = bpe.Codec(RANKS, P.PATTERN)
BRUTE = tiktoken.Encoding("brute", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXTS = [None, "", " ", "a", "it's  we'll\n\n x", "<|endoftext|>", "\x1c\x1d \x85  x﻿", "é" * 700 + "ab" * 3000, "1234567890" * 90, "😀😀 ñandú ßtraße 日本語"]


@pytest.mark.parametrize("text", TEXTS[1:])
def test_like_library(text):
    assert CODEC.encode(text).tolist() == BRUTE.encode_ordinary(text)


def test_every_code_point():
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 5000):
        text = "a".join(points[at : at + 5000])
        assert bpe.Codec.decode(CODEC, CODEC.encode(text).tolist()) == text.encode()
        if at < 0x3000:
            assert CODEC.encode(text).tolist() == BRUTE.encode_ordinary(text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=300))
def test_random_texts(text):
    ids = CODEC.encode(text).tolist()
    assert ids == BRUTE.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


def test_side_by_side_equals_one_by_one():
    rng = random.Random(1)
    pieces = ["".join(rng.choices("etaoin shé", k=rng.randint(1, 70))) for _ in range(3000)]
    fresh = bpe.Codec(RANKS, P.PATTERN)
    many = fresh._merge(pieces)
    for p, got in zip(pieces, many, strict=True):
        want = bpe.merge_one(fresh.byte_id[list(p.encode())].tolist(), fresh.pairs)
        assert got == b"".join(i.to_bytes(4, "little") for i in want)


def test_bounded_memory_and_long_texts(monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 100)
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    texts = ["word%d other " % i * 30 for i in range(40)]
    fresh = bpe.Codec(RANKS, P.PATTERN)
    assert [x.tolist() for x in fresh.encode_batch(texts)] == [BRUTE.encode_ordinary(t) for t in texts]


def test_query_and_operators(docs, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()] + [(1000 + i, t) for i, t in enumerate(TEXTS)] + [(None, "x"), (1, None)]
    got = sorted((tuple(r) for r in bpe.token_digest(docs(rows), VOCABULARY, P.PATTERN).collect()), key=str)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in rows:
        ids = BRUTE.encode_ordinary(t or "")
        want.append((i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert got == sorted(want, key=str)
    df = docs([(1, "two words", "kept"), (1, "two words", "kept"), (None, None, None)], "doc_id long, text string, ids string")
    there = bpe.decode(bpe.encode(df, VOCABULARY, P.PATTERN), VOCABULARY)
    assert sorted((bytes(r.decoded) for r in there.collect())) == [b"", b"two words", b"two words"]
    assert there.columns == ["doc_id", "text", "ids", "decoded"]
    assert bpe.token_digest(docs([]), VOCABULARY, P.PATTERN).count() == 0
