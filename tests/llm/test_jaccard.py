"""The Jaccard join against all pairs in plain Python: families of near copies, hot passages, blocks, odd rows."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkgraph.llm import jaccard
from linkgraph.llm.jaccard import jaccard_classes, jaccard_report, shingle_set, sketch, window

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text, shingle=5):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + shingle]) for i in range(max(len(words) - shingle + 1, 1))} if words else set()


def plain(rows, percent=80, shingle=5):
    sets = [plain_set(t, shingle) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and root(a) != root(b):
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def families(seed, groups=12, most=14, edits=(0.0, 0.05)):
    """Texts of unlike lengths with copies of a few edits each, all with a passage in common, and some only of it."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(4000)}" for _ in range(rng.choice([6, 9, 30, 120, 400]))] + passage
        for _ in range(rng.randrange(1, most)):
            share = rng.uniform(*edits)
            words = [f"e{rng.randrange(9999)}" if rng.random() < share else w for w in base]
            cut = rng.randrange(len(words) // 12 + 1)
            rows.append(" ".join(words[cut:] if rng.random() < 0.5 else words))
    rows += [" ".join(passage), " ".join(passage[:30]), " ".join(passage[:34]), " ".join(passage[2:])]
    rng.shuffle(rows)
    return [*enumerate(rows)]


def test_documents(spark, documents):
    assert rows_of(jaccard_report(documents)) == plain([(r.doc_id, r.text) for r in documents.collect()])


@pytest.mark.parametrize("seed", [1, 2])
def test_families_in_small_blocks(spark, docs, monkeypatch, seed):
    """Regions over the bounds are parted into blocks, and shingles of many documents come last in the order."""
    rows = families(seed)
    monkeypatch.setattr(jaccard, "CELL", 6)
    monkeypatch.setattr(jaccard, "LOAD", 4000)
    monkeypatch.setattr(jaccard, "NEAR_PIVOTS", 2)
    want = plain(rows)
    assert 12 < len({c for _, _, c in want}) < len(rows)
    assert rows_of(jaccard_report(docs(rows).repartition(5))) == want


@pytest.mark.parametrize(("often", "percent", "shingle"), [(3, 80, 5), (10**9, 80, 5), (12, 60, 3), (12, 100, 5)])
def test_other_orders_and_bounds(spark, docs, monkeypatch, often, percent, shingle):
    """Whatever the sample calls frequent, the classes are the same; and the operator's own bounds."""
    rows = families(3, groups=8, most=9)
    monkeypatch.setattr(jaccard, "OFTEN", often)
    found = jaccard_classes(docs(rows), percent=percent, shingle=shingle)
    least = {}
    for key, _, label in found.collect():
        least[label] = min(key, least.get(label, key))
    assert sorted(((k, n, least[c]) for k, n, c in found.collect()), key=str) == plain(rows, percent, shingle)


def test_a_large_group_of_unlike_copies(spark, docs):
    """Copies of one text that are too far from each other, and linked through it alone."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(300)]
    rows = [(0, " ".join(base))]
    for i in range(1, 150):
        words = base[:]
        for at in rng.sample(range(300), rng.choice([3, 5, 7, 11])):
            words[at] = f"e{i}x{at}"
        rows.append((i, " ".join(words)))
    assert rows_of(jaccard_report(docs(rows))) == plain(rows)


def test_odd_rows(spark, docs):
    rows = [(5, "A b c D e f"), (2, "a B c d e F"), (2, "a B c d e F"), (None, "a b\tc\x0bd\ne f"), (7, None), (6, ""), (8, " \t\n"), (9, "one"), (4, "ONE"), (3, "one two"),
            (None, None), (None, "only null"), (10, "a b c d"), (11, "a b c d e"), (12, "é b c d e"), (13, "É b c d e"), (14, "x" * 200_000), (1, "x" * 200_000), (15, "a b c d\x1ce f")]
    df = docs(rows).withColumns({"row": F.lit("r"), "id": F.lit(0), "hash": F.lit(None), "n": F.lit(1), "component_id": F.lit(9), "key": F.lit("k")})
    assert rows_of(jaccard_report(df)) == plain(rows)


def test_empty_table(spark, docs):
    found = jaccard_report(docs([]))
    assert found.collect() == [] and found.dtypes == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint")]
    assert rows_of(jaccard_report(docs([(1, None), (2, "")]))) == [(1, 0, 1), (2, 0, 2)]


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(0, 60), min_size=1), st.sets(st.integers(0, 60), min_size=1), st.integers(50, 100), st.sets(st.integers(0, 60)))
def test_linked_sets_share_a_pivot_and_sketches_bound_their_distance(a, b, percent, late):
    """The two lemmas that the join rests on, for any order of pivots."""
    mixed = lambda xs: np.sort(np.array([x * 0x9E3779B97F4A7C15 % (1 << 64) for x in xs], np.uint64))
    x, y, frequent = mixed(a), mixed(b), mixed(late)
    if 100 * len(a & b) >= percent * len(a | b):
        assert {*window(x, frequent, percent).tolist()} & {*window(y, frequent, percent).tolist()}
    p, q = sketch(x), sketch(y)
    m = min(len(p), len(q))
    counts = [s.reshape(-1, m).sum(axis=0, dtype=np.int64) for s in (p, q)]
    assert np.abs(counts[0] - counts[1]).sum() <= len(a ^ b)


def test_shingles():
    for text in ("", "a", "a b c d", "a b c d e", "A a A a A a A", "é É x\x85y z \x1c w v"):
        assert len(shingle_set(text.encode())) == len(plain_set(text))
