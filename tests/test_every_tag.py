"""Tags on any number of notes: queries on which no limit of a group holds, and pairs without one."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from linkgraph.operators import edges as E
from linkgraph.plans.oracle import ORACLE
from linkgraph.plans.queries import QUERIES

NOTES = "id string, pos bigint, tags array<string>"


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    """25 orders of part 1, three of them of part 2 too."""
    folder = str(tmp_path_factory.mktemp("orders"))
    spark.range(25).select(F.col("id").alias("o_orderkey")).write.parquet(f"{folder}/orders.parquet")
    lines = [(k, 1) for k in range(25)] + [(k, 2) for k in range(3)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint").write.parquet(f"{folder}/lineitem.parquet")
    return folder


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    return written_documents(spark, tmp_path_factory, 1000)


def written_documents(spark, tmp_path_factory, first):
    """77 documents of one source in one hundred: notes with a tag in common, and others by ninths."""
    folder = str(tmp_path_factory.mktemp("documents"))
    docs = spark.range(first, first + 77).select(F.col("id").alias("doc_id"), F.lit("a title").alias("text"), F.lit("web").alias("source"), F.lit(7).cast("bigint").alias("n_chars"))
    docs.write.parquet(f"{folder}/documents.parquet")
    return folder


def in_sql(folder, name):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    return sorted(duck.execute(ORACLE[name]).fetchall())


@pytest.mark.parametrize("block, wide", [(256, 64), (5, 64), (5, 3)])
def test_pairs_without_a_limit(spark, monkeypatch, block, wide):
    """Those of a limit that no tag reaches, in small blocks and with notes of many tags too; a null is no tag."""
    monkeypatch.setattr(E, "BLOCK", block)
    monkeypatch.setattr(E, "WIDE", wide)
    rng = random.Random(block)
    rows = [(f"n{i:03d}", i, [rng.choice([f"t{int(rng.random() ** 2 * 9)}", "x", None]) for _ in range(rng.randrange(6))]) for i in range(50)]
    want = E.tag_edges(spark.createDataFrame([(i, p, [t for t in tags if t]) for i, p, tags in rows], NOTES), 10**6)
    occ = E.occurrences(spark.createDataFrame(rows, NOTES))
    told = lambda df: sorted(map(tuple, df.select("source", "target", "type", "tagName").collect()))
    assert told(E.merged_pairs(occ, None)) == told(E.merge(E.tag_pairs(occ, None))) == told(want)
    assert want.count() > 200


def test_nodes_of_orders_with_a_common_part(spark, orders):
    assert {r.degree for r in QUERIES["graph_nodes"](spark, orders).collect()} == {24}


def test_elements_of_orders_with_a_common_part(spark, orders):
    told = QUERIES["export_elements"](spark, orders).where("kind = 'edges'")
    assert told.count() == 300 and told.where(F.col("element").contains('"tagName":"part-1, part-2"')).count() == 3


def test_nodes_of_a_feed_with_a_common_tag(spark, documents):
    """Notes that no change met have the source's tag in common, which over 20 have."""
    nodes = QUERIES["feed_nodes"](spark, documents)
    assert sorted(map(tuple, nodes.collect())) == in_sql(documents, "feed_nodes")
    same = [k for k in range(1000, 1077) if k % 7 != 3 and k % 11]
    assert len(same) > 21 and {r.degree >= len(same) - 1 for r in nodes.where(F.col("id").isin([f"{k:032x}" for k in same])).collect()} == {True}


def test_nodes_of_a_snapshot_with_a_common_tag(spark, documents):
    nodes = QUERIES["snapshot_nodes"](spark, documents).collect()
    assert sorted(map(tuple, nodes)) == in_sql(documents, "snapshot_nodes")
    assert len(nodes) == 77 and min(r.degree for r in nodes) == 76


def test_focus_by_a_common_tag(spark, tmp_path_factory):
    """The notes that are selected reach all others by it."""
    folder = written_documents(spark, tmp_path_factory, 0)
    nodes = QUERIES["snapshot_focus"](spark, folder).collect()
    assert len(nodes) == 77 and sorted(map(tuple, nodes)) == in_sql(folder, "snapshot_focus")
