"""Scans, enrichment, edges, graph, views and export on literal cases."""

import json

import pytest
from pyspark.sql import functions as F

from linkgraph.functions import text as T
from linkgraph.operators import edges as E
from linkgraph.operators import export, views
from linkgraph.operators.enrich import enrich, tag_titles
from linkgraph.operators.graph import Graph, build_graph, graph_summary, isolated_nodes
from linkgraph.sources import notes as S
from linkgraph.streaming.refresh import refresh

NOTES = "id string, title string, pos bigint, links array<string>, tags array<string>"


@pytest.fixture(scope="module")
def make(spark):
    """Enriched notes of (id, links, tags); positions follow the order of the rows."""

    def notes(*rows):
        return spark.createDataFrame([(i, f"title {i}", k, list(links), list(tags)) for k, (i, links, tags) in enumerate(rows)], NOTES)

    return notes


def pairs(edges):
    return sorted((r.source, r.target, r.type, r.tagName) for r in edges.collect())


def test_bounds(spark):
    notes = spark.createDataFrame([(f"n{i}", "p", "t", "b", 1, 2, i) for i in range(30)], S.NOTE)
    assert [S.scan_notes(notes, n).truncated for n in (29, 30, 31, None)] == [True, False, False, False]
    assert [r.id for r in S.scan_notes(notes, 3).rows.orderBy("pos").collect()] == ["n0", "n1", "n2"]
    assert S.scan_notes(notes, None).rows.count() == 30
    tags = spark.createDataFrame([(f"t{i}", "x", i) for i in range(30)], S.TAG)
    assert [S.scan_tags(tags, n).truncated for n in (29, 30, 31, None)] == [True, True, False, False]
    none = S.empty(spark, S.NOTE)
    assert S.scan_notes(none).rows.count() == 0 and not S.scan_notes(none).truncated


def test_read_and_open(spark, tmp_path):
    path = str(tmp_path / "notes")
    spark.createDataFrame([("a", "x", "body"), ("b", None, None)], "id string, title string, body string").write.parquet(path)
    notes = S.read_notes(spark, path)
    assert notes.columns == S.NOTE.names and notes.where("pos is null").count() == 0
    one = S.open_note(notes, "b")
    assert one.count() == 1 and "EqualTo(id,b)" in one._jdf.queryExecution().toString()


def test_tags_and_enrichment(spark):
    notes = spark.createDataFrame([("n1", f"[x](:/{'a' * 32})", 0), ("n2", None, 1), ("n3", "", 2)], "id string, body string, pos bigint")
    tags = spark.createDataFrame([("t1", "zeta", 0), ("t2", "alpha", 1), ("t3", "zeta", 2)], S.TAG)
    bridge = spark.createDataFrame([("t2", "n1"), ("t1", "n1"), ("t3", "n1"), ("t1", "n3"), ("gone", "n2")], S.NOTE_TAG)
    got = {r.id: (r.links, r.tags) for r in enrich(notes, tag_titles(tags, bridge)).collect()}
    assert got == {"n1": (["a" * 32], ["zeta", "alpha", "zeta"]), "n2": ([], []), "n3": ([], ["zeta"])}
    plain = enrich(notes, tag_titles(tags, bridge), lambda body: F.array(F.lit("own")))
    assert plain.first().links == ["own"]


def test_links(make):
    assert pairs(E.all_edges(make())) == []
    assert pairs(E.all_edges(make(("a", [], []), ("b", [], [])))) == []
    assert pairs(E.link_edges(make(("a", ["resource"], [])))) == []
    assert pairs(E.link_edges(make(("a", ["a"], [])))) == []
    got = pairs(E.link_edges(make(("a", ["b", "b"], []), ("b", ["a"], []), ("a", ["b"], []))))
    assert got == [("a", "b", "link", None), ("b", "a", "link", None)]


def test_tags(make):
    one = lambda *rows: pairs(E.tag_edges(make(*rows)))
    assert one(("a", [], ["shared"]), ("b", [], ["shared"])) == [("a", "b", "tag", "shared")]
    assert one(("a", [], ["t1", "t2"]), ("b", [], ["t1", "t2"])) == [("a", "b", "tag", "t1, t2")]
    assert len(one(*[(i, [], ["t"]) for i in "abc"])) == 3
    # order of first sight, not of names; source is the first to come
    assert one(("b", [], ["zz", "aa"]), ("a", [], ["aa", "zz"])) == [("b", "a", "tag", "zz, aa")]
    # one title twice on a note: a loop, and the name again in the pair
    assert one(("a", [], ["x", "x"]), ("b", [], ["x"])) == [("a", "a", "tag", "x"), ("a", "b", "tag", "x, x")]
    assert one(("b", [], ["x"]), ("a", [], ["x"]), ("b", [], ["x"])) == [("b", "a", "tag", "x, x"), ("b", "b", "tag", "x")]


@pytest.mark.parametrize(("n", "count"), [(20, 190), (21, 0)])
def test_group_limit(make, n, count):
    assert E.tag_edges(make(*[(f"n{i:02d}", [], ["t"]) for i in range(n)])).count() == count


def test_group_limit_counts_occurrences(make):
    rows = [(f"n{i:02d}", [], ["t"]) for i in range(19)]
    assert E.tag_edges(make(*rows, ("z", [], ["t", "t"]))).count() == 0
    assert E.tag_edges(make(*rows, ("z", [], ["t", "t"])), max_group=21).count() == 191


def test_both_kinds(make):
    got = pairs(E.all_edges(make(("a", ["b"], ["t"]), ("b", [], ["t"]))))
    assert got == [("a", "b", "link", None), ("a", "b", "tag", "t")]


@pytest.fixture(scope="module")
def injected(spark, make):
    """Any edges may be given in place of the built-in ones."""

    def graph(ids, edges):
        found = spark.createDataFrame(edges, "source string, target string, type string, tagName string")
        return build_graph(make(*[(i, [], []) for i in ids]), lambda notes: found)

    return graph


def test_degrees_and_visibility(injected):
    g = injected("abc", [("a", "b", "link", None), ("a", "missing", "link", None), ("c", "c", "tag", "t")])
    assert {r.id: r.degree for r in g.nodes.collect()} == {"a": 2, "b": 1, "c": 2}
    assert pairs(g.edges) == [("a", "b", "link", None), ("c", "c", "tag", "t")]
    g = injected("abcd", [("a", "b", "link", None)])
    assert sorted(r.id for r in isolated_nodes(g).collect()) == ["c", "d"]
    assert tuple(graph_summary(g).first()) == (4, 1, 2, 1)
    assert tuple(graph_summary(injected("", [])).first()) == (0, 0, 0, 1)


def test_labels(spark):
    cases = {"x" * 64: "x" * 64, "x" * 100: "x" * 61 + "...", "": "(untitled)", None: "(untitled)", "😀" * 64: "😀" * 64, "😀" * 65: "😀" * 61 + "..."}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", T.label(F.col("t")).alias("l"))
    assert {r.t: r.l for r in rows.collect()} == cases


def test_scalars(spark):
    row = spark.range(1).select(
        T.html_escape(F.lit("a<b>&c")), T.split_names(F.lit("a, b, ")), T.split_names(F.lit("")), T.split_names(F.lit(None).cast("string")),
        T.is_dark(F.lit("#1e1e1e")), T.is_dark(F.lit("#ffffff")), T.is_dark(F.lit("")), T.is_dark(F.lit("#828282")),
    ).first()
    assert tuple(row) == ("a&lt;b&gt;&amp;c", ["a", "b", ""], [], [], True, False, False, False)


EDGES = [("a", "b", "link", None), ("b", "c", "explicit", None), ("a", "c", "semantic", None), ("a", "b", "tag", "x, y"), ("b", "c", "tag", "y"), ("c", "c", "tag", ""), ("a", "c", "other", None)]


def test_statistics(injected, spark):
    g = injected("abcd", EDGES)
    assert tuple(views.graph_stats(g).first()) == (4, 2, 1, 2)
    assert {r.id: (r.linkCount, r.tagCount) for r in views.node_stats(g.edges).collect()} == {"a": (2, 1), "b": (2, 2), "c": (2, 3)}
    hover = {r.id: tuple(r)[1:] for r in views.hover(g).collect()}
    assert hover["d"] == ("title d", 0, 0, 0) and hover["a"] == ("title a", 4, 2, 1)
    assert tuple(views.graph_stats(Graph(g.nodes.where("false"), g.edges)).first()) == (0, 0, 0, 0)
    assert views.named_tag_edges(g.edges).count() == 2


def test_search_and_toggle(injected):
    g = injected("abcd", EDGES)
    found = lambda q: sorted(r.id for r in views.search_nodes(g.nodes, q).collect())
    assert found("  TITLE B ") == ["b"] and found("") == found(" ﻿") == list("abcd") and found("none") == []
    assert views.show_edges(g.edges, ["tag", "link"]).count() == 3 and views.show_edges(g.edges).count() == 7
    assert {(r.type, r.directed) for r in views.directed(g.edges).collect()} >= {("tag", False), ("link", True)}


def test_focus(injected):
    chain = [("a", "b"), ("b", "c"), ("c", "d"), ("b", "e"), ("x", "b"), ("c", "e")]
    g = injected("abcdex", [(s, t, "link", None) for s, t in chain])
    f = views.focus(g, g.nodes.where("id = 'a'").select("id"))
    assert sorted(r.id for r in f.nodes.collect()) == list("abcex")
    assert sorted((r.source, r.target) for r in f.edges.collect()) == [("a", "b"), ("b", "c"), ("b", "e"), ("x", "b")]
    loop = injected("ab", [("a", "a", "tag", "t"), ("a", "a", "tag", "t")])
    assert views.focus(loop, loop.nodes.select("id")).edges.count() == 2


def test_flat_edges(spark):
    rows = spark.createDataFrame([(("a", "b", "link", "n"), None), (None, "z")], "data struct<source:string,target:string,type:string,tagName:string>, source string")
    assert [r.source for r in views.flat_edges(rows).collect()] == ["a", "z"]
    assert views.flat_edges(rows.select("source")).columns == ["source"]


def test_export(injected, spark, tmp_path):
    g = injected("ab", [("a", "b", "tag", "x"), ("a", "b", "link", None)])
    out = json.loads(export.document(g).first().document)
    assert out["nodes"][0]["data"] == {"id": "a", "label": "title a", "noteId": "a", "degree": 2} and len(out["edges"]) == 2
    export.write_json(g, str(tmp_path / "out"))
    lines = [json.loads(r.value)["data"] for r in spark.read.text(f"{tmp_path}/out/kind=edges").collect()]
    assert {e.get("tagName") for e in lines} == {"x", None}


def test_snapshot_and_refresh(injected, spark, make, tmp_path):
    for name in (export.NODES, export.EDGES):
        spark.catalog.dropTempView(name)
    assert export.snapshot(spark) is None
    folder = str(tmp_path / "snapshots")
    g = injected("ab", [("a", "b", "link", None)])
    assert not export.publish(g, folder) and export.publish(g, folder)
    first = export.snapshot(spark)
    assert first.edges.count() == 1 and "FileScan" in first.nodes._jdf.queryExecution().toString()
    path = str(tmp_path / "notes")
    make(("a", ["b"], []), ("b", [], []), ("c", ["a"], [])).write.parquet(path)
    stream = spark.readStream.schema(NOTES).parquet(path)
    refresh(stream, build_graph, folder, str(tmp_path / "state")).awaitTermination(120)
    assert export.snapshot(spark).edges.count() == 2 and export.snapshot(spark).nodes.count() == 3
    assert first.edges.count() == 1  # an earlier snapshot stands


def test_document_is_for_a_viewer(injected, monkeypatch):
    g = injected("ab", [("a", "b", "link", None)])
    monkeypatch.setattr(export, "VIEWED", 2)
    with pytest.raises(ValueError):
        export.document(g)


def test_associations_give_the_same_edges(spark):
    notes = spark.createDataFrame([(f"n{i}", 50 - i) for i in range(30)], "id string, pos bigint")
    tags = spark.createDataFrame([("t1", "zeta", 3), ("t2", "alpha", 1), ("t3", "zeta", 2), ("t4", "all", 0)], S.TAG)
    bridge = [(f"t{k}", f"n{i}") for i in range(30) for k in (1, 2, 3, 4) if k == 4 or (i * k) % 5 == k % 3] + [("gone", "n1"), ("t1", "gone")]
    bridge = spark.createDataFrame(bridge, S.NOTE_TAG)
    rich = enrich(notes.withColumn("body", F.lit("")), tag_titles(tags, bridge))
    want = pairs(E.tag_edges(rich))
    assert want and pairs(E.merged_pairs(E.associated(notes, tags, bridge))) == want


def test_hot_tags(make, monkeypatch):
    monkeypatch.setattr(E, "HOT_ROWS", 1)
    monkeypatch.setattr(E, "HOT", 2)
    rows = [(f"n{i:02d}", [], ["all", "half" if i % 2 else "other", "few" if i < 3 else f"own{i}"]) for i in range(60)]
    assert pairs(E.tag_edges(make(*rows))) == [("n00", "n01", "tag", "few"), ("n00", "n02", "tag", "few"), ("n01", "n02", "tag", "few")]


def test_a_document_of_many_pieces(injected, monkeypatch):
    """As Spark's own writer shows one struct of lists, however many pieces: odd labels, nulls, repeats, no edges."""
    monkeypatch.setattr(export, "PIECE", 2)
    odd = ["b", "a\n\"q\" \\ }, {", "é😀", "", "c"]
    for edges in ([], [("b", "c", "tag", "t\nu"), ("b", "c", "link", None), ("", "b", "link", None), ("b", "c", "link", None)]):
        g = injected(odd, edges)
        nodes, pairs_ = (F.collect_list(F.struct(F.struct(*names).alias("data"))) for names in (("id", "label", "noteId", "degree"), ("source", "target", "type", "tagName")))
        n, e = (sorted(x.agg(c.alias("l")).first().l, key=str) for x, c in ((g.nodes, nodes), (g.edges, pairs_)))
        got = export.document(g).first().document
        told = json.loads(got)
        assert [x["data"]["id"] for x in told["nodes"]] == sorted(odd) and len(told["edges"]) == len(e) and len(n) == len(odd)
        lists = F.struct(F.array_sort(nodes).alias("nodes"), F.lit(None).alias("edges"))
        assert got.startswith(g.nodes.agg(F.to_json(lists, {"pretty": "true"}).alias("d")).first().d[:-2])
        assert got.endswith('"edges" : [ ]\n}' if not edges else "} ]\n}")


def test_a_document_is_bounded_by_its_bytes(spark):
    """Over a million elements, which were refused."""
    ids = spark.range(1_000_001).select(F.col("id").cast("string").alias("id"))
    nodes = ids.select("id", F.lit("l").alias("label"), F.col("id").alias("noteId"), F.lit(0).cast("bigint").alias("degree"))
    edges = spark.createDataFrame([], "source string, target string, type string, tagName string")
    size, rest = export.document(Graph(nodes, edges)).select(F.length("document"), F.regexp_count("document", F.lit('"data" : '))).first()
    assert rest == 1_000_001 and size > 100_000_000


def test_luminance_of_128(spark):
    """Weights of a thousandth: a sum of exactly 128 isn't dark, though doubles make it less."""
    colors = [(r, g, b) for r in range(0, 256, 3) for g in range(0, 256, 3) for b in range(256) if 299 * r + 587 * g + 114 * b in (127_999, 128_000, 128_001)] + [(128, 128, 128)]
    rows = spark.createDataFrame([(f"#{r:02x}{g:02x}{b:02X}", 299 * r + 587 * g + 114 * b < 128_000) for r, g, b in colors], "c string, dark boolean")
    assert len(colors) > 5 and rows.where(T.is_dark(F.col("c")) != F.col("dark")).count() == 0


def test_bodies_are_read_once_and_not_shuffled(spark):
    """Links are extracted once for the edges, before the notes meet their tags."""
    notes = spark.createDataFrame([("n1", f"[x](:/{'a' * 32})", "t", 0)], "id string, body string, title string, pos bigint")
    tags, bridge = spark.createDataFrame([("t1", "zeta", 0)], S.TAG), spark.createDataFrame([("t1", "n1")], S.NOTE_TAG)
    rich = enrich(notes.repartition(2), tag_titles(tags, bridge))
    times = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all")
    assert times(E.raw_links(rich)) == times(rich.select("id", "links")) > 0
    plan = rich.select("id", "links", "tags")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("regexp_extract_all")  # the plan's first line is its last step
    found = spark.createDataFrame([("a", ["a", None, "b", "b"]), ("b", []), ("c", None)], "id string, links array<string>")
    assert E.raw_links(found).collect() == [("a", "b")]


def test_occurrences_are_made_twice(make, spark):
    """For the sizes of tags and for their lists, and not once more for those under the limit."""
    occ = E.occurrences(make(("a", [], ["t"]), ("b", [], ["t"])))
    assert E.tag_pairs(occ)._jdf.queryExecution().optimizedPlan().toString().count("Generate posexplode(tags") == 2
    assert pairs(E.merged_pairs(occ)) == [("a", "b", "tag", "t")]
