"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkgraph.llm.common import materialize

MAX_ROUNDS = 60


def _least(edges: DataFrame) -> DataFrame:
    """(u, m): the least neighbour, a row per node.  It is written, so that the join with it has a
    plain exchange on either side, which adaptive execution can split where a node has very many edges."""
    return materialize(edges.groupBy("u").agg(F.min("v").alias("m")), "least")


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every neighbour above a node to the least of the node and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and all its neighbours below it to the least of them.  Edges come as u > v."""
    least = _least(edges)
    moved = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) edges over long ids -> (node, component): the least id that the node reaches.

    Nodes without an edge, loops and nulls have no row.  Each round is two aggregations and two
    equi-joins (Kiveris et al., "Connected components in MapReduce and beyond"); a round's edges
    are written to the shared folder, so plans stay short and lost executors cost one read.
    """
    edges = edges.where("u is not null and v is not null and u <> v")
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, before = materialize(edges, "edges"), None
    for _ in range(MAX_ROUNDS):
        edges = materialize(_small_star(_large_star(edges)), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = now
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
