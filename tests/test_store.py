"""The snapshot store: versions that other sessions read, repeated batches, lost writers, retention."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from linkgraph.operators import export
from linkgraph.operators.graph import build_graph
from linkgraph.operators.store import SnapshotStore
from linkgraph.streaming.refresh import refresh

NOTES = "id string, title string, pos bigint, links array<string>, tags array<string>"


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path / "store")


@pytest.fixture
def notes(spark):
    def make(*rows):
        return spark.createDataFrame([(i, i.upper(), k, list(links), list(tags)) for k, (i, links, tags) in enumerate(rows)], NOTES)

    return make


def numbers(spark, n):
    return {"numbers": spark.range(n).withColumnRenamed("id", "n")}


def test_versions_replace_each_other(spark, folder):
    store = SnapshotStore(spark, folder)
    assert store.latest() is None and store.versions() == []
    with pytest.raises(KeyError):
        store.table("numbers")
    for n in (3, 5):
        store.save(numbers(spark, n))
    assert [v.number for v in store.versions()] == [2, 1] and store.table("numbers").count() == 5
    assert store.table("numbers", store.versions()[1]).count() == 3
    other = SnapshotStore(spark.newSession(), folder)
    assert other.table("numbers").count() == 5 and other.latest() == store.latest()


def test_a_repeated_batch_adds_nothing(spark, folder, tmp_path):
    store = SnapshotStore(spark, folder)
    assert store.save(numbers(spark, 1), ("s", 0)).number == 1
    assert store.save(numbers(spark, 2), ("s", 1)).number == 2
    for again in (0, 1):
        assert store.save(numbers(spark, 9), ("s", again)) is None
    assert store.save(numbers(spark, 3), ("other", 0)).number == 3
    assert store.save(numbers(spark, 9), ("s", 1)) is None  # other streams' commits carry it on
    assert store.latest().batches == {"s": 1, "other": 0} and store.table("numbers").count() == 3
    assert len([*(tmp_path / "store" / "data").iterdir()]) == 3


def test_old_versions_go(spark, folder, tmp_path):
    store = SnapshotStore(spark, folder, keep=2)
    for n in range(1, 6):
        store.save(numbers(spark, n), ("s", n))
    assert [v.number for v in store.versions()] == [5, 4]
    assert {p.name for p in (tmp_path / "store" / "data").iterdir()} == {v.data for v in store.versions()}
    assert store.save(numbers(spark, 9), ("s", 1)) is None  # a batch of a version that has gone
    with pytest.raises(ValueError):
        SnapshotStore(spark, folder, keep=0)


def test_writers_that_were_lost(spark, folder, tmp_path):
    """Tables without a commit are never read, and go in time; a torn commit doesn't hide the one before."""
    store = SnapshotStore(spark, folder)
    store.save(numbers(spark, 4))

    def write(path):
        spark.range(1).write.parquet(f"{path}/numbers")
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        store.commit(write)
    (tmp_path / "store" / "commits" / f"{2:020d}.json").write_text('{"number": 2, "da')
    assert store.latest().number == 1 and store.table("numbers").count() == 4
    assert store.save(numbers(spark, 6)).number == 3 and store.table("numbers").count() == 6
    assert len([*(tmp_path / "store" / "data").iterdir()]) == 3
    time.sleep(1.1)
    SnapshotStore(spark, folder, abandoned=1).vacuum()
    assert len([*(tmp_path / "store" / "data").iterdir()]) == 2


def test_writers_side_by_side(spark, folder):
    def run(name):
        for n in range(3):
            SnapshotStore(spark, folder, keep=100).save(numbers(spark, 2), (name, n))

    threads = [threading.Thread(target=run, args=(f"s{i}",)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    store = SnapshotStore(spark, folder, keep=100)
    assert [v.number for v in store.versions()] == [*range(12, 0, -1)]
    assert store.latest().batches == {f"s{i}": 2 for i in range(4)}


def test_a_graph_is_found_once(spark, notes, folder, tmp_path):
    """Edges that aren't visible count for degrees, are left out of the snapshot, and leave no table behind."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        calls.add(1)
        return x

    def edges(rows):
        told = rows.select(F.col("id").alias("source"), F.explode("links").alias("target"))
        return told.select("source", counted("target").alias("target"), F.lit("link").alias("type"), F.lit(None).cast("string").alias("tagName"))

    graph = export.store(build_graph(notes(("a", ["b", "gone"], []), ("b", ["a"], [])), edges), folder)
    assert sorted((r.source, r.target) for r in graph.edges.collect()) == [("a", "b"), ("b", "a")]
    assert {r.id: r.degree for r in graph.nodes.collect()} == {"a": 3, "b": 2}
    assert calls.value == 3
    assert {p.name for p in next((tmp_path / "store").iterdir()).iterdir()} == {"nodes", "edges"}


def test_nodes_and_edges_of_one_version(spark, notes, folder):
    spark.catalog.dropTempView(export.NODES)
    first, second = build_graph(notes(("a", ["b"], []), ("b", [], []))), build_graph(notes(("a", ["c"], ["t"]), ("c", [], ["t"]), ("d", [], [])))
    assert not export.publish(first, folder) and export.publish(second, folder)
    other = spark.newSession()
    for session in (spark, other):
        graph = export.read_snapshot(session, folder)
        assert graph.nodes.count() == 3 and sorted(r.type for r in graph.edges.collect()) == ["link", "tag"]
    assert export.read_snapshot(other, folder, 1).nodes.count() == 2 and export.read_snapshot(other, folder, 7) is None
    assert export.snapshot(other) is None  # that session hasn't published
    spark.catalog.dropTempView(export.NODES)
    spark.catalog.dropTempView(export.EDGES)


def test_a_stream_that_starts_again(spark, notes, folder, tmp_path):
    """A batch whose end wasn't noted is handled again, and adds nothing; new files make a new version."""
    path, checkpoint = str(tmp_path / "notes"), tmp_path / "state"
    notes(("a", ["b"], []), ("b", [], [])).coalesce(1).write.parquet(path)
    run = lambda: refresh(spark.readStream.schema(NOTES).parquet(path), build_graph, folder, str(checkpoint)).awaitTermination(120)
    run()
    store = SnapshotStore(spark, folder)
    assert store.latest().number == 1 and [*store.latest().batches.values()] == [0]
    for name in ("0", ".0.crc"):
        (checkpoint / "commits" / name).unlink()
    run()
    assert store.latest().number == 1 and store.latest().time == store.versions()[-1].time
    notes(("c", ["d"], []), ("d", ["c"], [])).coalesce(1).write.mode("append").parquet(path)
    run()
    assert store.latest().number == 2 and export.read_snapshot(spark.newSession(), folder).edges.count() == 2
    spark.catalog.dropTempView(export.NODES)
    spark.catalog.dropTempView(export.EDGES)
