"""The viewer's questions to a graph: statistics, search, filters, focus."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkgraph.functions.links import trim
from linkgraph.functions.text import html_escape, or_else, split_names, UNTITLED
from linkgraph.operators.graph import Graph

EXPLICIT, SEMANTIC, TAG = ("link", "explicit"), "semantic", "tag"


def flat_edges(edges: DataFrame) -> DataFrame:
    """Edges of either shape, flat or wrapped in ``data``, as flat ones."""
    if "data" not in edges.columns:
        return edges
    names = edges.schema["data"].dataType.names
    return edges.select(*[F.coalesce(F.col(f"data.{c}"), F.col(c)).alias(c) if c in edges.columns else F.col(f"data.{c}").alias(c) for c in names])


def edge_kind(kind: Column) -> Column:
    """explicit, semantic or tag; null for any other type."""
    return F.when(kind.isin(*EXPLICIT), "explicit").when(kind == SEMANTIC, SEMANTIC).when(kind == TAG, TAG)


def node_stats(edges: DataFrame) -> DataFrame:
    """(id, linkCount, tagCount) of every end of an edge; other types count as neither."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id"), edge_kind(F.col("type")).alias("kind"))
    return ends.groupBy("id").agg(
        F.count_if(F.col("kind").isin("explicit", SEMANTIC)).alias("linkCount"), F.count_if(F.col("kind") == TAG).alias("tagCount")
    )


def graph_stats(graph: Graph) -> DataFrame:
    """One row: notes, explicit, semantic, tags (distinct names on tag edges).  All 0 without nodes.

    Edges are looked at once: what is counted of them is a row a kind, and a row a name on tag edges.
    """
    kind = edge_kind(F.col("type"))
    name = F.when(F.col("type") == TAG, split_names(F.col("tagName")))
    kinds = graph.edges.select(kind.alias("kind"), F.explode_outer(name).alias("name")).groupBy("kind", "name").agg(F.count("*").alias("n"))
    of = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0))
    counts = kinds.agg(of("explicit").alias("explicit"), of(SEMANTIC).alias("semantic"), F.count("name").alias("tags"))
    # a built graph has a node a note, and its nodes would find the edges once more
    notes = (graph.nodes if graph.notes is None else graph.notes).agg(F.count("*").alias("notes"))
    zero = F.lit(0).cast("bigint")
    return notes.crossJoin(counts).select("notes", *[F.when(F.col("notes") > 0, F.col(c)).otherwise(zero).alias(c) for c in ("explicit", "semantic", "tags")])


def hover(graph: Graph) -> DataFrame:
    """What the viewer shows of a node: escaped label, degree, linkCount, tagCount."""
    joined = graph.nodes.join(node_stats(graph.edges), "id", "left")
    zero = F.lit(0).cast("bigint")
    return joined.select(
        "id", html_escape(or_else(F.col("label"), UNTITLED)).alias("label"), "degree", F.coalesce("linkCount", zero).alias("linkCount"), F.coalesce("tagCount", zero).alias("tagCount")
    )


def named_tag_edges(edges: DataFrame) -> DataFrame:
    """The tag edges that show a name."""
    return edges.where((F.col("type") == TAG) & (F.length("tagName") > 0))


def search_nodes(nodes: DataFrame, query: str) -> DataFrame:
    """Nodes whose label holds the trimmed query, ignoring case; an empty query keeps all."""
    wanted = F.lower(trim(F.lit(query)))
    return nodes.where((F.length(wanted) == 0) | F.lower(F.coalesce("label", F.lit(""))).contains(wanted))


def show_edges(edges: DataFrame, off: Iterable[str] = ()) -> DataFrame:
    """Edges but those of the types that are switched off."""
    off = list(off)
    return edges.where(~F.coalesce(F.col("type").isin(*off), F.lit(False))) if off else edges


def directed(edges: DataFrame) -> DataFrame:
    """Edges with ``directed``: all but tag edges point somewhere."""
    return edges.withColumn("directed", F.col("type") != TAG)


def focus(graph: Graph, selected: DataFrame) -> Graph:
    """The selected ids, their neighbours and those of them, with the edges that touch the selected
    or their neighbours; an edge between two second neighbours stays hidden.

    Each hop is an equi-join of the edges in both directions with the ids found so far.
    """
    ways = F.array(F.struct(F.col("source").alias("a"), F.col("target").alias("b")), F.struct(F.col("target").alias("a"), F.col("source").alias("b")))
    both = graph.edges.select(F.explode(ways).alias("way")).select("way.a", "way.b")

    def hop(ids: DataFrame) -> DataFrame:
        return both.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct()

    start = selected.select("id").distinct().join(graph.nodes.select("id"), "id", "left_semi")
    near = start.unionByName(hop(start)).distinct()
    shown = near.unionByName(hop(near)).distinct()
    return Graph(graph.nodes.join(shown, "id", "left_semi").select(*graph.nodes.columns), touching(graph.edges, near))


def touching(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with an end among ``ids``, which are distinct."""
    by_source = ids.select(F.col("id").alias("source"), F.lit(True).alias("_s"))
    by_target = ids.select(F.col("id").alias("target"), F.lit(True).alias("_t"))
    marked = edges.join(by_source, "source", "left").join(by_target, "target", "left")
    return marked.where("_s or _t").select(*edges.columns)
