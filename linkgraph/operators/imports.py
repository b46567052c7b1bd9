"""Import of an exported graph: elements are checked line by line, and what is broken is kept apart with a reason."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkgraph.operators.graph import Graph
from linkgraph.operators.views import EXPLICIT, SEMANTIC, TAG



@dataclass(frozen=True)
class Imported:
    """The graph of the sound elements, and the others: (kind, element, reason)."""

    graph: Graph
    rejected: DataFrame


def _lacks(name: str) -> Column:
    return F.coalesce(F.length(F.col(f"d.{name}")) == 0, F.lit(True))


def _reason() -> Column:
    """Why a parsed element isn't sound, or null; the first of these that holds."""
    degree = F.col("d.degree")
    node = (
        F.when(_lacks("id"), "no id").when(_lacks("label"), "no label").when(F.col("d.noteId") != F.col("d.id"), "another note's id")
        .when(F.coalesce(~degree.rlike(r"\A[0-9]{1,18}\z"), F.lit(True)), "no degree")
    )
    kinds = [*EXPLICIT, SEMANTIC, TAG]
    edge = F.when(_lacks("source") | _lacks("target"), "no end").when(F.coalesce(~F.col("d.type").isin(kinds), F.lit(True)), "unknown type").when((F.col("d.type") == TAG) & _lacks("tagName"), "no tag name")
    parsed = F.when(F.col("d").isNull(), "no element")
    return F.when(F.col("kind") == "nodes", F.coalesce(parsed, node)).when(F.col("kind") == "edges", F.coalesce(parsed, edge)).otherwise("unknown kind")


def check_elements(lines: DataFrame) -> DataFrame:
    """(kind, element, d, reason) of lines (kind, element): what an element holds, as strings, and why it isn't sound.

    An element is an object {"data": {...}} or, as viewers also take it, the inner object alone; other fields are
    passed over.  A line that is no JSON object, or holds neither, is no element.
    """
    fields = "id string, label string, noteId string, degree string, source string, target string, type string, tagName string"
    parsed = F.from_json("element", f"data struct<{fields.replace(' string', ': string')}>, {fields}")
    inner = F.struct(*[F.coalesce(F.col(f"p.data.{n}"), F.col(f"p.{n}")).alias(n) for n in fields.replace(" string", "").split(", ")])
    some = F.coalesce(*[F.col(f"d.{n}") for n in ("id", "label", "source", "target")]).isNotNull()
    told = lines.select("kind", "element", parsed.alias("p")).withColumn("d", inner).withColumn("d", F.when(some, F.col("d")))
    return told.select("kind", "element", "d", _reason().alias("reason"))


def import_elements(lines: DataFrame) -> Imported:
    """The graph of exported lines (kind, element), in parallel; lines are rows, so none depends on another.

    Of elements that are repeated each counts; edges whose ends are no nodes stay (``graph.visible_edges``).
    """
    told = check_elements(lines)
    sound = told.where("reason is null")
    nodes = sound.where("kind = 'nodes'").select("d.id", "d.label", "d.noteId", F.col("d.degree").cast("bigint").alias("degree"))
    edges = sound.where("kind = 'edges'").select("d.source", "d.target", "d.type", "d.tagName")
    return Imported(Graph(nodes, edges), told.where("reason is not null").select("kind", "element", "reason"))


def read_export(spark: SparkSession, path: str) -> Imported:
    """What ``export.write_json`` wrote at ``path``."""
    lines = spark.read.schema("value string, kind string").text(path)
    return import_elements(lines.select("kind", F.col("value").alias("element")))
