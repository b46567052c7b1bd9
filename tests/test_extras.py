"""Text search by n-grams, item data by last write, and import: against plain Python, and in their plans."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from linkgraph.operators import export, imports, itemdata
from linkgraph.operators.graph import Graph
from linkgraph.operators.search import BUCKETS, chosen_grams, find, grams, read_index, write_index
from linkgraph.operators.store import SnapshotStore
from linkgraph.operators.views import search_nodes


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# search


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(6)
    words = ["Alpha", "alphabet", "beta", "BETA max", "éclair", "ÉTÉ", "gamma-ray", "x", "", "the", "theta", "a%b_c", "tab\there", "漢字かな", "😀 smile"]
    made = [(f"n{i}", " ".join(rng.choices(words, k=rng.randrange(5)))) for i in range(300)]
    return spark.createDataFrame([*made, ("null", None), (None, "alpha"), ("n0", "alpha again"), ("short", "al")], "id string, text string")


@pytest.fixture(scope="module")
def index(texts, tmp_path_factory):
    return write_index(texts, str(tmp_path_factory.mktemp("index") / "i"))


QUERIES = ["alpha", "  ALPHAbet ", "th", "the", "theta the", "", "   ", "éclair", "été", "%b_", "b\th", "漢字か", "字", "😀 s", "zzz", "alpha zzz", "x", "max beta", "aaaa", " the﻿"]


@pytest.mark.parametrize("query", QUERIES)
def test_find_is_a_search(index, texts, query):
    plain = search_nodes(texts.where("id is not null").withColumnRenamed("text", "label"), query)
    assert rows(find(index, query)) == rows(plain)
    assert rows(find(index, query, lists=1)) == rows(plain)


def test_a_stored_index_reads_the_lists_of_the_query_alone(spark, index, texts):
    stored = read_index(spark, index.texts.inputFiles()[0].rsplit("/", 2)[0].removeprefix("file://"))
    assert rows(find(stored, "alphabet")) == rows(find(index, "alphabet"))
    plan = find(stored, "alphabet")._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan and "PushedFilters: [In(gram" in plan
    picked = chosen_grams(stored, ["alp", "lph", "pha", "abe"], lists=2)
    assert picked[0] == "abe" and chosen_grams(stored, ["alp", "qqq"]) is None
    assert {r.bucket for r in stored.lists.select("bucket").distinct().collect()} <= set(range(BUCKETS))


def test_grams(spark):
    got = spark.createDataFrame([("ABcab",), ("ab",), (None,), ("aaaa",)], "t string").select(grams(F.col("t")).alias("g")).collect()
    assert [r.g for r in got] == [["abc", "bca", "cab"], [], [], ["aaa"]]


# item data


def plain_merge(writes):
    best = {}
    for t, i, k, value, deleted, updated, client in writes:
        if None in (t, i, k, updated):
            continue
        gone = bool(deleted)
        order = (updated, client or "", gone, value is not None and not gone, "" if gone or value is None else value, client is not None)
        row = (t, i, k, None if gone else value, gone, updated, client)
        if (t, i, k) not in best or order > best[t, i, k][0]:
            best[t, i, k] = (order, row)
    return sorted((r for _, r in best.values()), key=str)


def test_any_split_and_order_of_writes(spark):
    rng = random.Random(8)
    pick = lambda *xs: rng.choice(xs)
    writes = [(pick(1, 2, None), pick("a", "b", None), pick("k", "l"), pick('"x"', '"y"', "1", None), pick(True, False, None), pick(1, 2, 3, None), pick("c1", "c2", None)) for _ in range(120)]
    parts = [spark.createDataFrame(writes[k::3], itemdata.WRITE) for k in range(3)]
    want = plain_merge(writes)
    assert rows(itemdata.merge_writes(*parts)) == want
    for a, b, c in itertools.islice(itertools.permutations(parts), 3):
        assert rows(itemdata.merge_writes(a, itemdata.merge_writes(itemdata.merge_writes(c, b), b))) == want


def test_the_rules_of_a_merge(spark, tmp_path):
    """Changed, then changed by another: the other's.  Changed, then deleted: gone.  Deleted, then changed: restored."""
    write = lambda key, value, gone, at, client: spark.createDataFrame([(1, "note", key, value, gone, at, client)], itemdata.WRITE)
    store = SnapshotStore(spark, str(tmp_path / "items"))
    there = lambda: {r.key: r.value for r in itemdata.values(store.table("items")).collect()}
    for number, batch in enumerate([write("a", "1", False, 1, "one"), write("a", "2", False, 2, "two"), write("b", "1", False, 1, "one"), write("b", None, True, 2, "two"), write("c", None, True, 5, "one"), write("c", "3", False, 6, "two"), write("b", "late", False, 1, "three")]):
        assert itemdata.put_writes(store, batch, ("s", number)).number == number + 1
        assert itemdata.put_writes(store, batch, ("s", number)) is None
    assert there() == {"a": "2", "c": "3"}
    kept = itemdata.forget(store.table("items"), 2)
    assert kept.count() == 3 and itemdata.forget(kept, 3).count() == 2


# import


def test_export_and_import(spark, tmp_path):
    nodes = spark.createDataFrame([("a", 'la"bel\n<&> \\ é😀', "a", 2), ("b", "(untitled)", "b", 0), ("a", 'la"bel\n<&> \\ é😀', "a", 2)], "id string, label string, noteId string, degree bigint")
    edges = spark.createDataFrame([("a", "b", "link", None), ("a", "b", "tag", "t, u"), ("b", "gone", "semantic", None), ("a", "b", "explicit", None)], "source string, target string, type string, tagName string")
    export.write_json(Graph(nodes, edges), str(tmp_path / "export"))
    told = imports.read_export(spark, str(tmp_path / "export"))
    assert rows(told.graph.nodes) == rows(nodes) and rows(told.graph.edges) == rows(edges) and told.rejected.count() == 0
    assert told.graph.nodes.dtypes == nodes.dtypes and told.graph.edges.dtypes == edges.dtypes


def test_broken_lines_are_kept_apart(spark, tmp_path):
    lines = {
        "nodes": [('{"data":{"id":"a","label":"l","noteId":"a","degree":1,"x":7}}', None), ('{"id":"b","label":"l","degree":"2"}', None), ('{"data":{"label":"l","degree":1}}', "no id"), ('{"data":{"id":"","label":"l","degree":1}}', "no id"), ('{"data":{"id":"c","degree":1}}', "no label"),
                  ('{"data":{"id":"d","label":"l","noteId":"e","degree":1}}', "another note's id"), ('{"data":{"id":"d","label":"l"}}', "no degree"), ('{"data":{"id":"d","label":"l","degree":1.5}}', "no degree"), ('{"data":{"id":"d","label":"l","degree":99999999999999999999}}', "no degree"), ("{", "no element"), ("", "no element"), ("null", "no element"), ("7", "no element"), ("{}", "no element")],
        "edges": [('{"data":{"source":"a","target":"b","type":"link","tagName":null}}', None), ('{"data":{"source":"a","target":"b","type":"tag","tagName":"t"}}', None), ('{"data":{"source":"a","target":"b","type":"tag"}}', "no tag name"), ('{"data":{"source":"a","type":"link"}}', "no end"), ('{"data":{"target":"a","type":"link"}}', "no end"), ('{"data":{"source":"a","target":"b"}}', "unknown type"), ('{"data":{"source":"a","target":"b","type":"LINK"}}', "unknown type"), ('[{"source":"a"}]', "no element")],
        "pictures": [('{"data":{"id":"a","label":"l","degree":1}}', "unknown kind")],
    }
    made = [(kind, line) for kind, of in lines.items() for line, _ in of]
    told = imports.import_elements(spark.createDataFrame(made, "kind string, element string"))
    want = sorted((kind, line, reason) for kind, of in lines.items() for line, reason in of if reason)
    assert sorted(tuple(r) for r in told.rejected.collect()) == want
    assert rows(told.graph.nodes) == [("a", "l", "a", 1), ("b", "l", None, 2)] and told.graph.edges.count() == 2
