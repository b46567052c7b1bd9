"""The ranked search against plain Python over all documents, with odd texts, hot terms, ties and odd rows."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkgraph.llm import ranked
from linkgraph.llm.filters import CHUNK
from linkgraph.llm.ranked import STEP, Asked, Block, build_index, impact, normal, postings, ranked_report, search, weight

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k=50):
    """(item_id, rank, doc_id, score), every document scored for every item."""
    counts = [(d, Counter(terms_of(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    total, terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms_of(t))
    out = []
    for item, own in asked.items():
        scored = []
        for doc_id, c in counts:
            m = 100 - 50 + (50 * sum(c.values()) * total) // terms
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        out += [(item, r, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


ODD = st.lists(st.text(st.sampled_from("aAbB1 -_\n\x00\x7f\x80éÉ漢😀ıK[{`@/:"), max_size=30), min_size=1, max_size=10)


def told(texts, **how):
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
    terms, begin, doc, tf = postings(np.frombuffer(b"".join(data), np.uint8), offsets, **how)
    return {(terms[i].decode(), int(doc[p])): int(tf[p]) for i in range(len(terms)) for p in range(begin[i], begin[i + 1])}, len(terms)


@settings(max_examples=300, deadline=None)
@given(ODD, st.booleans())
def test_postings(texts, weak):
    hashes = {"hashes": lambda data, start, end: (end - start).astype(np.uint64) % np.uint64(2)} if weak else {}
    want = {(t, i): n for i, text in enumerate(texts) for t, n in Counter(terms_of(text)).items()}
    assert told(texts, **hashes) == (want, len({t for t, _ in want}))


def test_a_long_text():
    text = " ".join(f"Term{i % 3000}é" for i in range(150_000))
    assert len(text.encode()) > CHUNK
    assert told([text])[0] == {(t, 0): n for t, n in Counter(terms_of(text)).items()}


@pytest.mark.parametrize("k", [1, 50])
def test_documents(spark, documents, k):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    assert rows_of(ranked_report(documents, items, k)) == plain(docs, [(r.item_id, r.text) for r in items.collect()], k)


def test_odd_rows(spark, docs):
    """Nulls, empty and term-less texts, ties, repeated rows on either side, and clashing columns."""
    rows = [(i, f"common word{i % 7} tie" + " more" * (i % 3)) for i in range(80)]
    rows += [(None, "common tie"), (None, None), (200, None), (201, ""), (202, "... - !"), (3, "common word3 tie"), (3, "common word3 tie"), (-5, "COMMON Tie")]
    items = [(1, "Common WORD3"), (1, "tie tie tie"), (2, None), (3, ""), (None, "word5 more"), (4, "absent words"), (5, "common"), (5, "common"), (6, "?!")]
    df = docs(rows).withColumns({"key": F.lit("x"), "term": F.lit(1), "score": F.lit(None), "rank": F.lit(0)})
    asked = spark.createDataFrame(items, "item_id int, text string").withColumns({"key": F.lit(9), "doc_id": F.lit("d")})
    found = ranked_report(df, asked, 20)
    assert found.dtypes == [("item_id", "int"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert rows_of(found) == plain(rows, items, 20)
    assert {r[0] for r in rows_of(found)} == {1, None, 5}


def test_small_blocks(spark, docs, monkeypatch):
    """Items and documents in many blocks: the same rows, though each block knows less."""
    rows = [(i, " ".join(f"t{(i * j) % 37}" for j in range(i % 30))) for i in range(300)]
    items = [(i, " ".join(f"t{(i + j) % 37}" for j in range(9))) for i in range(12)]
    monkeypatch.setattr(ranked, "ASKED", 40)
    monkeypatch.setattr(ranked, "SIDE", 5)
    assert rows_of(search(build_index(docs(rows).repartition(7)), spark.createDataFrame(items, "item_id long, text string"), k=7)) == plain(rows, items, 7)


def test_empty_tables(spark, docs):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_report(docs([]), items).collect() == []
    assert ranked_report(docs([(1, None), (2, "!")]), items).collect() == []
    assert ranked_report(docs([(1, "a")]), items.where("false")).collect() == []
    assert ranked_report(docs([(1, "a")]), items.where("false")).dtypes == ranked_report(docs([(1, "a")]), items).dtypes


def test_bounds_hold_the_exact_score(spark, docs):
    """Bytes round upwards: lower <= exact <= upper for each item and document, and few have to be scored again."""
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"t{x}" for x in rng.zipf(1.3, rng.integers(1, 400)) % 500)) for i in range(400)]
    index = build_index(docs(rows).coalesce(1))
    asked = Asked([(i, f"t{t}".encode()) for i in range(20) for t in {*rng.integers(0, 60, 12).tolist()}])
    df = Counter(t for _, text in rows for t in {*text.split()})
    asked.weights[:] = [weight(index.documents, df[t.decode()]) if df[t.decode()] else 0 for t in asked.terms.to_pylist()]
    again = total = 0
    for batch in index.rows.toArrow().to_batches():
        for row in range(batch.num_rows):
            block = Block([c[row] for c in batch.columns], index.documents, index.terms)
            where = {t: i for i, t in enumerate(block.terms.to_pylist())}
            at = np.array([where.get(t, -1) for t in asked.terms.to_pylist()])
            upper, lower = block.bounds(at, asked, 0, 20)
            for item in range(20):
                own = asked.of_item[item][at[asked.of_item[item]] >= 0]
                exact = block.exact(at[own], asked.weights[own], np.arange(block.size))
                assert (lower[item] <= exact).all() and (exact <= upper[item]).all()
                if block.size >= 5:
                    again, total = again + int((upper[item] >= np.sort(lower[item])[-5]).sum()), total + block.size
    assert total and again < total / 4


def test_impacts_fit_a_byte():
    n = np.arange(1, 200_000, 97)
    for tf in (1, 3, 10**6):
        x = impact(np.full(len(n), tf), normal(n, 10**6, 10**8))
        assert (x < 1_000_000).all() and (-(-x // STEP) <= 255).all()
