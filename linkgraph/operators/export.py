"""Stored snapshots of a graph, and its export."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from linkgraph.operators.graph import Graph, build_nodes, visible_edges
from linkgraph.operators.store import KEEP, SnapshotStore
from linkgraph.sources.shared import delete

#: Names under which the current snapshot is in the catalog, and the setting that tells its store.
NODES, EDGES, FOLDER = "graph_nodes", "graph_edges", "linkgraph.snapshots"


def write_graph(graph: Graph, path: str) -> dict[str, StructType]:
    """Write edges and nodes below ``path``; their schemas by name.

    All edges of a built graph are found once and written; degrees and visible edges come from that table.
    """
    spark = graph.nodes.sparkSession
    found = graph.found
    if found is not None:
        name = "edges" if graph.closed else "found"
        found.select("source", "target", "type", "tagName").write.parquet(f"{path}/{name}")
        found = spark.read.schema(graph.edges.schema).parquet(f"{path}/{name}")
    nodes = graph.nodes if found is None else build_nodes(graph.notes, found)
    nodes.write.parquet(f"{path}/nodes")
    if found is None:
        graph.edges.write.parquet(f"{path}/edges")
    elif not graph.closed:
        visible_edges(found, spark.read.schema(nodes.schema).parquet(f"{path}/nodes")).write.parquet(f"{path}/edges")
        delete(spark, f"{path}/found")
    return {"nodes": nodes.schema, "edges": graph.edges.schema}


def store(graph: Graph, folder: str, spark: SparkSession | None = None) -> Graph:
    """Write nodes and edges below ``folder`` and return the graph that reads them.

    A snapshot has a folder of its own, so readers of an earlier one aren't disturbed; views of it are
    scans, and don't run extraction and joins again.  ``spark``: the session that reads them.
    """
    path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}"
    spark = spark or graph.nodes.sparkSession
    schemas = write_graph(graph, path)
    return Graph(*[spark.read.schema(schemas[name]).parquet(f"{path}/{name}") for name in ("nodes", "edges")])


def publish(graph: Graph, folder: str, spark: SparkSession | None = None, batch: tuple[str, int] | None = None, keep: int = KEEP) -> bool:
    """Make ``graph`` the current version of the snapshot store at ``folder``, and that the one of a session;
    whether there was one before.  A batch (stream, number) that the store knows adds nothing.

    Nodes and edges become visible together, to every session that reads the store.
    """
    spark = spark or graph.nodes.sparkSession
    versions = SnapshotStore(spark, folder, keep)
    before = versions.latest() is not None
    versions.commit(lambda path: write_graph(graph, path), batch)
    spark.conf.set(FOLDER, folder)
    current = read_snapshot(spark, folder)
    current.nodes.createOrReplaceTempView(NODES)
    current.edges.createOrReplaceTempView(EDGES)
    return before


def read_snapshot(spark: SparkSession, folder: str, number: int | None = None) -> Graph | None:
    """The current version of a store, or that of a number; None before the first, or where it has gone."""
    versions = SnapshotStore(spark, folder)
    version = versions.latest() if number is None else next((v for v in versions.versions() if v.number == number), None)
    return Graph(versions.table("nodes", version), versions.table("edges", version)) if version else None


def snapshot(spark: SparkSession) -> Graph | None:
    """The current version of the store that the session has published to, or None before that."""
    return read_snapshot(spark, spark.conf.get(FOLDER)) if spark.catalog.tableExists(NODES) else None


def elements(graph: Graph) -> DataFrame:
    """(kind, element): one JSON object {"data": ...} per node and edge; nulls are left out."""
    node = F.to_json(F.struct(F.struct("id", "label", "noteId", "degree").alias("data")))
    edge = F.to_json(F.struct(F.struct("source", "target", "type", "tagName").alias("data")))
    nodes = graph.nodes.select(F.lit("nodes").alias("kind"), node.alias("element"))
    return nodes.unionByName(graph.edges.select(F.lit("edges").alias("kind"), edge.alias("element")))


def write_json(graph: Graph, path: str) -> None:
    """Write all elements as JSON lines, below kind=nodes and kind=edges; as parallel as the graph is."""
    elements(graph).write.mode("overwrite").partitionBy("kind").text(path)


#: Bytes of the document that ``document`` makes at most, which is what one value can hold, and elements of a piece of it.
VIEWED, PIECE = (1 << 31) - (1 << 16), 4096


def document(graph: Graph) -> DataFrame:
    """One row with the whole graph as an indented JSON document, for a viewer.

    Elements are rendered, sorted and joined to pieces in parallel; as the document is one value, one task joins
    the pieces, and holds text alone.  A document that no value can hold is refused (``write_json`` exports any graph).
    """
    # line feeds inside of strings are escaped, so these are the layout's
    shown = lambda *names: F.replace(F.to_json(F.struct(F.struct(*names).alias("data")), {"pretty": "true"}), F.lit("\n"), F.lit("\n  "))
    kinds = {"nodes": (graph.nodes, ("id", "label", "noteId", "degree")), "edges": (graph.edges, ("source", "target", "type", "tagName"))}
    sizes = [rows.agg(F.sum(F.octet_length(shown(*names)) + 2)).first()[0] or 0 for rows, names in kinds.values()]
    if sum(sizes) > VIEWED:
        raise ValueError(f"a document holds {VIEWED} bytes at most; write_json exports any graph")
    pieces = []
    for kind, (rows, names) in kinds.items():
        placed = rows.select(*names).orderBy(*names).select(F.monotonically_increasing_id().alias("at"), shown(*names).alias("text"))
        listed = placed.groupBy(F.shiftright("at", PIECE.bit_length() - 1).alias("piece")).agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("t"))
        pieces.append(listed.select(F.lit(kind).alias("kind"), "piece", F.array_join(F.transform("t", lambda x: x["text"]), ", ").alias("text")))
    whole = pieces[0].unionByName(pieces[1]).agg(*[F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("piece", "text")))).alias(k) for k in kinds])
    listed = {k: F.concat(F.lit(f'"{k}" : [ '), F.array_join(F.transform(k, lambda x: x["text"]), ", "), F.when(F.size(k) > 0, " ]").otherwise("]")) for k in kinds}
    return whole.select(F.concat(F.lit("{\n  "), listed["nodes"], F.lit(",\n  "), listed["edges"], F.lit("\n}")).alias("document"))
