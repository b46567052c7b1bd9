"""The filter audit against plain Python: measures of odd texts, every order of the filters, and odd rows."""

import hashlib
import itertools
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkgraph.llm import filters
from linkgraph.llm.filters import contract_filters, earlier_copy, fail_mask, filter_audit, interactions, measure, text_measures

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_measures(text):
    words = WORD.findall(text)
    return [len(words), len(set(words)), sum("A" <= c <= "Z" for c in text), len(text), any(c in "#$%&*|" for c in text)]


def scanned(texts, **how):
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
    return [list(x) for x in zip(*(c.tolist() for c in measure(np.frombuffer(b"".join(data), np.uint8), offsets, **how)), strict=True)]


TEXTS = st.lists(st.text(st.sampled_from("ab A\t\n\x0b\x0c\r\x1c\x85 é漢😀#|B"), max_size=40), min_size=1, max_size=12)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_measures(texts):
    assert scanned(texts) == [plain_measures(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_colliding_hashes_are_verified(texts):
    weak = lambda data, start, end: (end - start).astype(np.uint64) % np.uint64(2)
    assert scanned(texts, hashes=weak) == [plain_measures(t) for t in texts]


def test_texts_over_a_chunk(spark, docs, monkeypatch):
    long = " ".join(f"Word{i % 5000} é$" for i in range(120_000))
    one_word = "x" * (filters.CHUNK + 17)
    rows = [(1, long), (2, one_word), (3, f"{one_word} {one_word} y"), (4, ""), (5, None), (6, "a b a")]
    assert len(long.encode()) > filters.CHUNK
    got = {r.doc_id: list(r)[1:] for r in text_measures(docs(rows), keep=("doc_id",)).collect()}
    for doc_id, text in rows:
        assert got[doc_id] == [*plain_measures(text or ""), hashlib.sha256((text or "").encode()).digest()]


def plain_audit(rows, labels):
    """From (doc_id, text, lang) and (doc_id, quality, toxic): each document through each order, one by one."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    failed = []
    for doc_id, text, lang in rows:
        words, distinct, capitals, points, symbol = plain_measures(text or "")
        copied = any(o is not None and doc_id is not None and o < doc_id and (t or "") == (text or "") for o, t, _ in rows)
        fails = {"A": words < 100, "B": 100 * distinct < 80 * words, "C": 100 * capitals > 10 * points, "D": symbol, "E": copied}
        failed.append((lang or "", {c for c in "ABCDE" if fails[c]}, doc_id in good, doc_id in toxic))
    out, shapley = {}, {}
    for part in {f[0] for f in failed}:
        for order in map("".join, itertools.permutations("ABCDE")):
            alive = [f for f in failed if f[0] == part]
            for step, c in enumerate(order, 1):
                here = [f for f in alive if c in f[1]]
                redundant = sum(c in f[1] for f in failed if f[0] == part) - len(here)
                alive = [f for f in alive if c not in f[1]]
                unique = sum(f[1] == {c} for f in failed if f[0] == part)
                out[part, order, step] = [len(alive), len(here), redundant, unique, sum(f[2] for f in here), sum(f[3] for f in here)]
                shapley[part, c] = shapley.get((part, c), 0) + len(here)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def told(df):
    rows = df.collect()
    found = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in rows}
    assert len(found) == len(rows)
    return found


def test_audit_of_odd_rows(spark):
    words = " ".join(f"w{i}" for i in range(120))
    rows = [(5, words, "en"), (2, words, "en"), (2, words, "en"), (9, words, "de"), (None, words, "en"), (7, words + " #", None), (8, None, ""), (1, "", "en"),
            (11, "", None), (12, "A B", "de"), (12, "A B", "de"), (13, "x " * 200, "en"), (14, "X " * 200 + "|", "en"), (None, None, "de"), (15, words.upper(), "de")]
    labels = [(5, 1, 0), (5, 0, 1), (2, None, 1), (2, 1, None), (None, 1, 1), (14, 0, 1), (15, 1, 1), (99, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"words": F.lit(1), "mask": F.lit("m"), "_id": F.lit(0), "n": F.lit(None)})
    labels_df = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit("clash"))
    found = told(filter_audit(docs, labels_df))
    assert found == plain_audit(rows, labels)
    assert len(found) == 600 * len({r[2] or "" for r in rows})


def test_audit_of_documents(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rows = [(r.doc_id, r.text, r.lang) for r in documents.collect()]
    assert told(filter_audit(documents, labels)) == plain_audit(rows, [(r.doc_id, r.quality, r.toxic) for r in labels.collect()])


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert filter_audit(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
    some = spark.createDataFrame([(1, "a", "en")], none.schema)
    assert filter_audit(some, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 600


def test_other_filters(spark, docs):
    """Two filters of one's own: 2 orders of 2 steps."""
    measured = text_measures(docs([(1, "a b"), (2, "a"), (3, "B"), (4, "b b b")]), keep=("doc_id",)).withColumn("lang", F.lit("x"))
    own = {"s": F.col("words") < 2, "c": F.col("capitals") > 0}
    marked = measured.select(fail_mask(own).alias("mask"), F.col("lang").alias("part"), F.lit(True).alias("good"), F.lit(None).cast("boolean").alias("toxic"))
    found = told(interactions(marked, "sc"))
    assert found == {("x", "sc", 1): (2, 2, 0, 1, 2, 0, 3), ("x", "sc", 2): (2, 0, 1, 0, 0, 0, 1), ("x", "cs", 1): (3, 1, 0, 0, 1, 0, 1), ("x", "cs", 2): (2, 1, 1, 1, 1, 0, 3)}
    with pytest.raises(ValueError):
        interactions(marked, "abcdefg")


def test_copies_and_clashes(spark, docs):
    measured = text_measures(docs([(3, "t"), (1, "t"), (None, "t"), (2, "u")]), keep=("doc_id",))
    assert {(r.doc_id, r.copied) for r in earlier_copy(measured, "doc_id").collect()} == {(3, True), (1, False), (None, False), (2, False)}
    assert list(contract_filters()) == list("ABCDE")
    with pytest.raises(ValueError):
        text_measures(docs([(1, "t")]).withColumn("digest", F.lit(1)), keep=("digest",))
