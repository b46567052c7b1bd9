"""The graph: nodes with labels and degrees, visible edges, summary counts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkgraph.functions.text import label
from linkgraph.operators.edges import all_edges


@dataclass(frozen=True)
class Graph:
    """Nodes and visible edges.  A graph that was built tells what from, so that it can be stored in one go:
    ``notes``, all edges ``found``, and whether these are visible by construction (``closed``)."""

    nodes: DataFrame
    edges: DataFrame
    notes: DataFrame | None = None
    found: DataFrame | None = None
    closed: bool = False


def endpoints(edges: DataFrame) -> DataFrame:
    """(id) twice per edge; a loop gives its node twice."""
    return edges.select(F.explode(F.array("source", "target")).alias("id"))


def degrees(edges: DataFrame) -> DataFrame:
    return endpoints(edges).groupBy("id").agg(F.count("*").alias("degree"))


def build_nodes(notes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label, noteId, degree) of every note; the degree counts all edges, visible or not."""
    joined = notes.select("id", label(F.col("title")).alias("label")).join(degrees(edges), "id", "left")
    return joined.select("id", "label", F.col("id").alias("noteId"), F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"))


def visible_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are both nodes."""
    ids = nodes.select("id").distinct()
    for end in ("source", "target"):
        edges = edges.join(ids.withColumnRenamed("id", end), end, "left_semi")
    return edges.select("source", "target", "type", "tagName")


def build_graph(notes: DataFrame, edges: Callable[[DataFrame], DataFrame] = all_edges, closed: bool | None = None) -> Graph:
    """The graph of enriched notes.  ``edges`` may be any function from notes to edges; ``closed`` promises that
    both ends of what it finds are notes (by default it is known of ``all_edges`` alone)."""
    found = edges(notes)
    nodes = build_nodes(notes, found)
    closed = edges is all_edges if closed is None else closed
    edges = found.select("source", "target", "type", "tagName") if closed else visible_edges(found, nodes)
    return Graph(nodes, edges, notes, found, closed)


def isolated_nodes(graph: Graph) -> DataFrame:
    """Nodes without a visible edge."""
    return graph.nodes.join(endpoints(graph.edges).distinct(), "id", "left_anti").select(*graph.nodes.columns)


def graph_summary(graph: Graph) -> DataFrame:
    """One row: nodes, edges, isolated, max_degree (1 at least)."""
    n = graph.nodes.agg(F.count("*").alias("nodes"), F.greatest(F.lit(1), F.coalesce(F.max("degree"), F.lit(1))).alias("max_degree"))
    e = graph.edges.agg(F.count("*").alias("edges"))
    i = isolated_nodes(graph).agg(F.count("*").alias("isolated"))
    rows = [n.selectExpr("nodes", "max_degree", "0L edges", "0L isolated"), e.selectExpr("0L nodes", "0L max_degree", "edges", "0L isolated"), i.selectExpr("0L nodes", "0L max_degree", "0L edges", "isolated")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).agg(*[F.sum(c).alias(c) for c in ("nodes", "edges", "isolated", "max_degree")])
