"""Semantic edges against all pairs in numpy: random, clustered and odd vectors; and how few pairs are measured."""

import numpy as np
import pytest

from linkgraph.operators import semantic
from linkgraph.operators.semantic import basis, farthest, near_pairs, semantic_edges

SCHEMA = "id long, vector array<double>"


def all_pairs(rows, threshold):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    found = set()
    for n, (i, x) in enumerate(ok):
        for j, y in ok[n + 1 :]:
            if i != j and len(x) == len(y) and (x / np.linalg.norm(x)) @ (y / np.linalg.norm(y)) >= threshold:
                found.add((min(i, j), max(i, j)))
    return found


def edges(df):
    rows = [tuple(r) for r in df.collect()]
    assert {r[2:] for r in rows} <= {("semantic", None)} and len({r[:2] for r in rows}) == len(rows)
    return {r[:2] for r in rows}


def clustered(rng, n, size=24, groups=9, spread=0.25):
    return (rng.normal(size=(groups, size))[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, size))) * rng.uniform(0.1, 9, (n, 1))


@pytest.mark.parametrize(("kind", "threshold"), [("clustered", 0.9), ("clustered", 0.5), ("random", 0.35)])
def test_all_and_only_near_pairs(spark, monkeypatch, kind, threshold):
    """In regions and blocks far smaller than usual, so that guests, parts and windows all occur."""
    for name, value in (("EACH", 40), ("CELL", 50), ("ROWS", 16), ("LEADING", 6), ("MEASURED", 100)):
        monkeypatch.setattr(semantic, name, value)
    rng = np.random.default_rng(3)
    x = clustered(rng, 260) if kind == "clustered" else rng.normal(size=(260, 24))
    rows = [(int(i), [float(c) for c in v]) for i, v in zip(rng.permutation(900)[:260], x, strict=True)]
    want = all_pairs(rows, threshold)
    assert len(want) > 200
    assert edges(semantic_edges(spark.createDataFrame(rows, SCHEMA), threshold)) == want


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.1]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (None, [1.0, 0.0]), (9, [1.0, 0.0, 0.0]), (10, [3.0, 0.0, 0.1]), (11, [-1.0, 0.0]), (12, [1e-200, 0.0]), (1, [1.0, 0.0])]
    assert edges(semantic_edges(spark.createDataFrame(rows, SCHEMA), 0.9)) == {(1, 2), (9, 10), (1, 12), (2, 12)}
    none = semantic_edges(spark.createDataFrame([], SCHEMA), 0.9)
    assert none.collect() == [] and none.columns == ["source", "target", "type", "tagName"]
    for bad in (0, -1, 1.5):
        with pytest.raises(ValueError):
            semantic_edges(spark.createDataFrame([], SCHEMA), bad)


@pytest.mark.parametrize(("kind", "threshold", "share"), [("clustered", 0.9, 0.2), ("random", 0.8, 0.05)])
def test_few_pairs_are_measured(kind, threshold, share):
    rng = np.random.default_rng(5)
    n = 800
    x = clustered(rng, n, size=64, spread=0.3) if kind == "clustered" else rng.normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pivots = farthest(x[:200], 16)
    angles = np.arccos(np.clip(x @ pivots[0], -1, 1))
    a, b, measured = near_pairs(x, angles, np.zeros(n, int), False, basis(pivots), threshold)
    assert {(min(i, j), max(i, j)) for i, j in zip(a.tolist(), b.tolist(), strict=True)} == {(i, j) for i, j in zip(*(c.tolist() for c in np.nonzero(np.triu(x @ x.T, 1) >= threshold)), strict=True)}
    assert measured < share * n * (n - 1) / 2


def test_dense_pairs_and_single_floats(spark, monkeypatch):
    """Where the bound cuts out little, products decide; vectors of floats aren't widened on their way."""
    for name, value in (("CELL", 60), ("ROWS", 16)):
        monkeypatch.setattr(semantic, name, value)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 24)).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    want = all_pairs(rows, 0.3)
    found = semantic_edges(spark.createDataFrame(rows, "id long, vector array<float>"), 0.3)
    assert edges(found) == want and len(want) > 2000
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "array<double>" not in plan.split("FlatMapGroupsInArrow")[0]
    again = semantic_edges(spark.createDataFrame([*rows, *rows[:50]], "id long, vector array<float>"), 0.3)
    assert edges(again) == want


def test_stats_of_a_built_graph_look_at_edges_once(spark):
    from linkgraph.operators.graph import Graph, build_graph
    from linkgraph.operators.views import graph_stats

    notes = spark.createDataFrame([("a", "t"), ("b", "t")], "id string, title string")
    rows = [("a", "b", k, n) for k, n in (("link", None), ("explicit", None), ("semantic", None), ("tag", "x, y"), ("tag", "y, z"), ("tag", ""), ("tag", None), ("other", "w"), ("semantic", "q"))]
    edges = spark.createDataFrame(rows, "source string, target string, type string, tagName string").repartition(3)
    built = build_graph(notes, lambda _: edges, closed=True)
    assert tuple(graph_stats(built).first()) == (2, 2, 2, 3) == tuple(graph_stats(Graph(built.nodes, built.edges)).first())
    assert graph_stats(built)._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") + graph_stats(built)._jdf.queryExecution().optimizedPlan().toString().count("Repartition 3") == 1
    assert tuple(graph_stats(build_graph(notes.where("id is null"), lambda _: edges, closed=True)).first()) == (0, 0, 0, 0)
