"""Repeated passages against brute force over all 50-word windows."""

import random
from collections import defaultdict

import numpy as np
import pytest

from linkgraph.llm import suffixes as sx


def brute(rows):
    """(index, word) of each word in a 50-word window that another row holds too."""
    where = defaultdict(set)
    words = [(t or "").split() for _, t in rows]
    for i, w in enumerate(words):
        for k in range(len(w) - sx.LEAST + 1):
            where[tuple(w[k : k + sx.LEAST])].add(i)
    covered = set()
    for i, w in enumerate(words):
        for k in range(len(w) - sx.LEAST + 1):
            if len(where[tuple(w[k : k + sx.LEAST])]) > 1:
                covered.update((i, j) for j in range(k, k + sx.LEAST))
    return covered


def covered(spark, rows):
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    out = sx.passage_report(df).collect()
    assert all(r.words == r.end - r.start >= sx.LEAST and r.other_id != r.doc_id for r in out)
    assert len({(r.doc_id, r.start) for r in out}) == len(out)
    return {(r.doc_id, j) for r in out for j in range(r.start, r.end)}


def test_minimisers_depend_on_the_passage_alone():
    rng = np.random.default_rng(1)
    passage = rng.integers(1, 1 << 60, sx.LEAST).astype(np.uint64)
    texts = [np.concatenate([rng.integers(1, 1 << 60, a).astype(np.uint64), passage, rng.integers(1, 1 << 60, 30).astype(np.uint64)]) for a in (0, 7, 90)]
    ends = np.cumsum([len(t) for t in texts])
    place, h = sx.minimisers(np.concatenate(texts), ends)
    begin = ends - 30 - sx.LEAST
    inside = [{int(p - b): int(x) for p, x in zip(place, h) if b <= p <= b + sx.WINDOW - 1} for b in begin]
    assert all(inside) and set.intersection(*(set(x.items()) for x in inside))
    for k, e in enumerate(ends):  # no gram leaves its text
        own = place[(place >= e - len(texts[k])) & (place < e)]
        assert (own + sx.GRAM <= e).all()


@pytest.mark.parametrize("size", [48, 1 << 17])
def test_equal_to_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(sx, "ROWS", size)  # small tables cut nearly every hash
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [text(n) for n in (49, 50, 51, 60, 90, 130, 400)]
    rows = []
    for i in range(160):
        parts = [text(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            parts += [p[: rng.choice([len(p), len(p), rng.randint(20, len(p))])], text(rng.randint(0, 40))]
        rows.append((i, " ".join(sum(parts, []))))
    rows += [(200, rows[3][1]), (201, None), (202, ""), (203, "same " * 300), (204, "same " * 80), (205, " ".join(passages[0]))]
    want, got = brute(rows), covered(spark, rows)
    assert got == want


def test_on_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    want, got = brute(rows), covered(spark, rows)
    assert got == want


def test_hot_copies_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(sx, "ROWS", 64)
    text = " ".join(f"v{i}" for i in range(120))
    rows = [(i, f"own{i} {text} end{i}") for i in range(120)] + [(500, "alone " + " ".join(f"z{i}" for i in range(100)))]
    assert covered(spark, rows) == {(i, j) for i in range(120) for j in range(1, 121)}


def test_right_contexts_alone_over_many_partitions(spark):
    rng = random.Random(9)
    # a gram of so small a hash that it is the minimiser; pairs of rows share it and what follows alone
    hashes = sx.WordHashes()
    grams = [[f"v{rng.randrange(10**6)}" for _ in range(sx.GRAM)] for _ in range(3000)]
    gram = " ".join(min(grams, key=lambda g: int(sx._grams(hashes.of(g), sx.GRAM)[0])))
    rows = []
    for i in range(400):
        before = " ".join(f"l{rng.randrange(10**6)}x{i}" for _ in range(20))
        after = " ".join(f"r{i // 2}y{k}" for k in range(sx.CONTEXT))
        rows.append((i, f"{before} {gram} {after} " + " ".join(f"e{i}z{k}" for k in range(20))))
    want, got = brute(rows), covered(spark, rows)
    assert len(want) == 400 * sx.LEAST
    assert got == want


def test_best_left_and_best_right_mates():
    pack = lambda *x: np.array([*x, *range(900 + x[-1], 900 + x[-1] + sx.CONTEXT - len(x))], ">u4").tobytes()
    one, two = list(range(1, 13)), list(range(101, 113))
    # row 0 shares 12 words to the left and 2 to the right with row 1, 12 to the right with row 2
    sides = [(pack(*one), pack(*two)), (pack(*one), pack(*two[:2], 500)), (pack(700), pack(*two))]
    order = sorted(range(3), key=lambda k: sides[k])
    columns = [[5] * 3, [sides[k][0] for k in order], [sides[k][1] for k in order], order, order, [100] * 3]
    found = sx.compare_neighbours(sx.pa.table(dict(zip(["h", "left", "right", "row", "doc_id", "pos"], columns, strict=True))))
    got = {(order[k], int(s), int(e), order[m]) for k, s, e, m in zip(*(found[n] for n in ("kept", "start", "end", "mate")), strict=True)}
    assert got == {(0, 88, 140, 1), (0, 100, 150, 2), (1, 88, 140, 0), (2, 100, 150, 0)}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "few words")], [(None, "x " * 60), (None, "x " * 60)]])
def test_odd_tables(docs, rows):
    out = sx.passage_report(docs(rows)).collect()
    assert [(r.doc_id, r.start, r.end, r.other_id) for r in out] == ([])


def test_rows_of_one_id(docs):
    rows = [(None, "x " * 60), (None, "x " * 70), (1, "y " * 60), (1, "y " * 60), (2, "z " * 60)]
    out = sx.passage_report(docs(rows)).collect()
    assert sorted((r.doc_id, r.start, r.end, r.other_id) for r in out) == [(None, 0, 60, None), (None, 0, 70, None)]


def test_best_mates_equal_brute_force():
    """The reach of every suffix to either side over all mates of its hash, in one table."""
    rng = random.Random(3)
    rows = sorted((h, *(np.array([(1 if rng.random() < 0.97 else 2) if k < cut else rng.randrange(3, 10**6) for k in range(sx.CONTEXT)], ">u4").tobytes() for cut in (rng.randint(0, 12), rng.randint(0, 12))), i % 60, i) for i, h in enumerate([5] * 150 + [6] * 100))
    names = ["h", "left", "right", "row", "doc_id", "pos"]
    found = sx.compare_neighbours(sx.pa.table(dict(zip(names, [*zip(*(r[:4] for r in rows), strict=True), [r[3] for r in rows], [100] * len(rows)], strict=True))))
    got = {}
    for k, s, e in zip(found["kept"].tolist(), found["start"].tolist(), found["end"].tolist(), strict=True):
        low, high = got.get(k, (s, e))
        got[k] = min(low, s), max(high, e)
    words = lambda b: np.frombuffer(b, ">u4")
    reach = lambda a, b: int(np.logical_and.accumulate(words(a) == words(b)).sum())
    want = {}
    for k, a in enumerate(rows):
        mates = [(reach(a[1], b[1]), reach(a[2], b[2])) for b in rows if b[0] == a[0] and b[3] != a[3]]
        mates = [m for m in mates if sum(m) >= sx.LEAST - sx.GRAM]
        if mates:
            want[k] = 100 - max(lo for lo, _ in mates), 100 + sx.GRAM + max(hi for _, hi in mates)
    assert got == want and len(want) > 50


def test_long_text_and_clashing_columns(spark, docs):
    clash = "row pos h left right text_ start end other_id kept proof key".split()
    long = " ".join(f"w{i * 7919 % 99991}" for i in range(200_000))
    part = " ".join(f"w{i * 7919 % 99991}" for i in range(60_000, 60_100))
    df = docs([(1, long, *clash), (2, "a b " + part, *clash)], "doc_id long, text string, " + ", ".join(f"{c} string" for c in clash))
    out = {(r.doc_id, r.start, r.end, r.other_id) for r in sx.passage_report(df).collect()}
    assert (2, 2, 102, 1) in out and (1, 60_000, 60_100, 2) in out


def test_repeated_rows_are_one(docs):
    text = " ".join(f"v{i}" for i in range(70))
    out = sx.passage_report(docs([(1, text)] * 300 + [(2, text)] * 3)).collect()
    assert sorted(map(tuple, out)) == [(1, 0, 70, 70, 2), (2, 0, 70, 70, 1)]


def test_cut_hashes_are_passed_on(monkeypatch):
    def passed(size, rows):
        monkeypatch.setattr(sx, "ROWS", size)
        batches = [sx.pa.RecordBatch.from_pylist([dict(zip(("h", "left", "right", "row"), x, strict=True)) for x in rows[k : k + 2]]) for k in range(0, len(rows), 2)]
        return [tuple(r.values()) for b in sx._cut(batches) for r in b.to_pylist()]

    # tables 1 2 2 3, 3 3 4 5, 6 6 7 8: all rows of 3, which is in two of them, but none of 2, 4 and 7
    rows = [(h, b"l%d" % k, b"r", k) for k, h in enumerate([1, 2, 2, 3, 3, 3, 4, 5, 6, 6, 7, 8])]
    assert [r[0] for r in passed(4, rows)] == [1, 3, 3, 3, 5, 6, 6, 8]
    # equal contexts of several rows: the first and the last; of one row: all
    copies = [(1, b"a", b"b", k) for k in range(5)] + [(1, b"a", b"c", 7)] * 3
    assert passed(8, copies) == [copies[0], copies[4], *copies[5:]]


def test_windows_of_near_copies_are_two_rows_a_table(monkeypatch):
    """Rows of one hash that differ in one word each: a window of many rows isn't passed on for each of them."""
    monkeypatch.setattr(sx, "ROWS", 1 << 10)
    pack = lambda k, at: np.array([9000 + k if j == at else 1 + j for j in range(sx.CONTEXT)], ">u4").tobytes()
    rows = sorted((5, pack(k, k % sx.CONTEXT), pack(0, -1), k, k, 100) for k in range(240))
    names = ["h", "left", "right", "row", "doc_id", "pos"]
    batches = [sx.pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in rows[k : k + 50]]) for k in range(0, len(rows), 50)]
    got = [tuple(r.values()) for b in sx._windows(iter(batches)) for r in b.to_pylist()]
    mates = defaultdict(set)  # by shared words to the left, content of the window
    for _, left, _, row, _, _ in rows:
        for shared in range(sx.CONTEXT + 1):
            mates[shared, left[: 4 * shared]].add(row)
    assert len(got) == sum(min(len(x), 2) for x in mates.values()) < len(rows) * (sx.CONTEXT + 1) * 0.6
    assert {r[2:] for r in got} <= {(k, k, 100 - shared) for k in range(240) for shared in range(sx.CONTEXT + 1)}
    # each window of one row is there, and of those of several rows two different ones
    held = defaultdict(set)
    for _, key, row, _, _ in got:
        held[key].add(row)
    assert sorted(map(len, held.values())) == sorted(min(len(x), 2) for x in mates.values())


def test_windows_are_made_once(spark):
    df = sx.passage_report(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert sum("MapInArrow" in x and "key#" in x for x in plan.splitlines()) == 1


@pytest.mark.parametrize("size", [16, 64])
def test_near_copies_over_many_partitions(spark, monkeypatch, size):
    monkeypatch.setattr(sx, "ROWS", size)
    rng = random.Random(6)
    text = [f"v{i}" for i in range(130)]
    rows = []
    for i in range(150):
        own = [f"n{i}" if rng.random() < 0.02 else w for w in text]
        # some rows hold it twice, so that one row can stand for a window in two tables
        rows.append((i, " ".join([f"own{i}", *own, *(text if i % 5 == 0 else []), f"end{i}"])))
    want, got = brute(rows), covered(spark, rows)
    assert got == want and len(want) > 10_000


@pytest.mark.parametrize("shared", [sx.GRAM, 45, sx.LEAST - 1, sx.LEAST])
def test_texts_that_begin_alike(spark, shared):
    """Less than LEAST words at the beginning of two texts aren't a passage."""
    rng = random.Random(shared)
    rows = []
    for k in range(60):  # in some, the first gram is the minimiser
        begin = [f"b{k}x{rng.randrange(10**6)}" for _ in range(shared)]
        rows += [(0, " ".join([*begin, *(f"e{k}s{side}y{i}" for i in range(20))])) for side in range(2)]
    want, got = brute(rows), covered(spark, rows)
    assert got == want and len(want) == (120 * sx.LEAST if shared == sx.LEAST else 0)
