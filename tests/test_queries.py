"""Every registered query with SQL against that SQL in DuckDB, and plans at a glance."""

import os

import duckdb
import pytest

import __spark_entry__
from linkgraph.plans.oracle import ORACLE
from linkgraph.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    result = duck.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted((tuple(r[i] for i in at) for r in result.fetchall()), key=str)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["id", "label", "noteId", "degree"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(QUERIES) == set(ORACLE)


def test_scan_reads_what_it_needs(spark):
    plan = QUERIES["tag_edges"](spark, SF)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>" in plan and "Python" not in plan and "Cartesian" not in plan
