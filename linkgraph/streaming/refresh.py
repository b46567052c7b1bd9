"""Refresh a published graph from a stream of notes; the latest batch wins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from linkgraph.operators.export import publish
from linkgraph.operators.graph import Graph


def refresh(changes: DataFrame, rebuild: Callable[[DataFrame], Graph], folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Call ``rebuild`` with each micro-batch and publish the graph that it returns.

    The graph is written below ``folder`` while the batch is there; what is published are the stored
    tables, which outlive it, in the store at ``folder``: any session reads them.  A batch that is handled
    again after a failure adds nothing, since the store knows the last batch of each query by its id.
    """
    spark = changes.sparkSession

    def handle(batch: DataFrame, number: int) -> None:
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
        publish(rebuild(batch), folder, spark, (stream, number))

    return changes.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
