"""The permutation index against brute force over all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkgraph.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, step=50, k=5):
    ids = np.array([i for i, _ in rows])
    v = np.array([x for _, x in rows], np.float32).astype(np.float64)
    norm = np.sqrt((v * v).sum(axis=1))
    out = {}
    for q in np.flatnonzero(ids % step == 0):
        score = (v * v[q]).sum(axis=1) / (norm * norm[q])
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[i]), score[i]) for i in order]
    return out


def run(df, **more):
    vectors = ann.valid_vectors(df)
    out = {}
    for r in sorted(ann.nearest(vectors, vectors.where("key % 50 = 0"), **more).collect()):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def recall(got, want):
    hit = [{i for i, _ in w} & {i for i, _ in got[q]} for q, w in want.items()]
    return sum(map(len, hit)) / sum(len(w) for w in want.values())


def test_recall_on_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    want, got = brute([tuple(r) for r in rows.collect()]), run(rows)
    assert got.keys() == want.keys() and recall(got, want) >= 0.9
    for q, found in got.items():
        scores = dict(want[q])
        assert len(found) == 5 and all(abs(scores[i] - s) < 1e-12 for i, s in found if i in scores)


def test_exact_with_full_share(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), rng.normal(size=16).astype(np.float32).tolist()) for i in rng.permutation(900)]
    rows += [(1000 + i, rows[0][1]) for i in range(300)]  # a large group of equal vectors
    got = run(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), share=1.0)
    want = brute(rows)
    assert {q: [i for i, _ in f] for q, f in got.items()} == {q: [i for i, _ in f] for q, f in want.items()}


def test_rows_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0], 1), (50, None, 1), (100, [0.0, 0.0], 1), (150, [1.0, None], 1), (200, [float("nan"), 1.0], 1)]
    rows += [(250, [float("inf"), 1.0], 1), (None, [1.0, 1.0], 1), (3, [], 1), (4, [1.0, 2.0, 3.0], 1), (5, [0.5, 0.0], None), (6, [0.0, 2.0], 2)]
    rows += [(6, [0.0, 2.0], 2)]
    got = run(spark.createDataFrame(rows, SCHEMA))
    assert got == {0: [(5, 1.0), (6, 0.0), (6, 0.0)]}


def test_rows_of_one_key_and_mixed_lengths(spark):
    """Every row is a candidate; those of one length are compared among themselves."""
    rows = [(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (1, [0.9, 0.1], 1), (50, [1.0, 2.0, 3.0], 1), (51, [1.0, 2.0, 3.5], 1), (52, [3.0, 0.0, 0.0], 1)]
    got = run(spark.createDataFrame(rows, SCHEMA))
    assert [i for i, _ in got[0]] == [1, 1] and abs(got[0][0][1] - 0.9939) < 1e-3 and got[0][1][1] == 0.0
    assert [i for i, _ in got[50]] == [51, 52]
    twice = [(100, [1.0, 0.0], 1), (100, [0.0, 1.0], 1), (7, [1.0, 1.0], 1)]
    vectors = ann.valid_vectors(spark.createDataFrame(twice, SCHEMA))
    found = sorted(map(tuple, ann.nearest(vectors, vectors.where("key % 50 = 0")).collect()))
    assert [f[:3] for f in found] == [(100, 1, 7), (100, 1, 7), (100, 2, 100), (100, 2, 100)]


def test_clashing_columns(spark):
    clash = "row key vector rank query_id score order length".split()
    df = spark.createDataFrame([(0, [1.0, 0.0], *clash), (1, [1.0, 1.0], *clash)], "vec_id long, embedding array<float>, " + ", ".join(f"{c} string" for c in clash))
    assert [i for i, _ in run(df)[0]] == [1]


def test_a_query_reads_its_lists_alone(spark):
    """Few postings a query, on the table and on clustered vectors, and the footrule is the definition's."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    table = np.array([r.embedding for r in rows], np.float64)
    rng = np.random.default_rng(9)
    clusters = rng.normal(size=(40, 64))[rng.integers(0, 40, 3000)] + 0.3 * rng.normal(size=(3000, 64))
    for v, part in ((table, 0.45), (clusters, 0.3)):
        pivots = v[:: max(1, len(v) // ann.PIVOTS)][: ann.PIVOTS]
        pivots = pivots / np.linalg.norm(pivots, axis=1, keepdims=True)
        orders = ann.permutations(v, pivots, ann.DEPTH)
        files = ann.InvertedFiles.build(orders, len(pivots), ann.POSTED)
        read = [len(np.unique(files.read(orders[q, : ann.LISTS]))) for q in range(0, len(v), 50)]
        assert np.mean(read) < part * len(v)
        rank = np.full((len(v), len(pivots)), ann.DEPTH)
        np.put_along_axis(rank, orders.astype(np.int64), np.arange(ann.DEPTH)[None].repeat(len(v), 0), 1)
        footrule = np.abs(rank - rank[7]).sum(axis=1)
        assert (ann.DEPTH * (ann.DEPTH + 1) - 2 * ann.shared_ranks(orders, orders[7], len(pivots)) == footrule).all()


def test_recall_on_clusters(spark):
    rng = np.random.default_rng(10)
    v = rng.normal(size=(60, 32))[rng.integers(0, 60, 4000)] + 0.4 * rng.normal(size=(4000, 32))
    rows = [(i, x.astype(np.float32).tolist()) for i, x in enumerate(v)]
    assert recall(run(spark.createDataFrame(rows, "vec_id long, embedding array<float>")), brute(rows)) >= 0.9


@pytest.mark.parametrize("rows", [[], [(50, None, 1)], [(50, [1.0, 2.0], 1)], [(7, [1.0, 2.0], 1)]])
def test_nothing_to_find(spark, rows):
    assert run(spark.createDataFrame(rows, SCHEMA)) == {}


def test_query_blocks(spark, monkeypatch):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").withColumn("vec_id", F.col("vec_id") * 10)
    whole = run(rows)
    monkeypatch.setattr(ann, "QUERIES", 30)
    assert run(rows) == whole and len(whole) == 100


def test_recall_beside_a_large_group_of_near_copies(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()]
    rng = np.random.default_rng(6)
    top = max(i for i, _ in rows) + 1
    rows += [(top + i, (np.array(rows[3][1]) + rng.normal(scale=0.01, size=64)).astype(np.float32).tolist()) for i in range(len(rows) // 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want, got = brute(rows), run(df)
    assert recall(got, want) >= 0.95
