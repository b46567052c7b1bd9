"""The change feed: after any sequence of changes the stored graph is that of a rebuild."""

import random

import pytest

from linkgraph.operators import export
from linkgraph.operators.edges import all_edges
from linkgraph.operators.feed import CHANGE, CREATE, DELETE, UPDATE, GraphFeed, follow, latest_changes
from linkgraph.operators.graph import build_graph

NOTES = "id string, title string, pos bigint, links array<string>, tags array<string>"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def same_as_rebuild(spark, feed, notes, max_group):
    """``notes``: id -> (title, pos, links, tags) of those that are there."""
    now = spark.createDataFrame([(i, *n) for i, n in notes.items()], NOTES)
    want = build_graph(now, lambda df: all_edges(df, max_group))
    got = feed.graph()
    columns = ("source", "target", "type", "tagName")
    assert rows(got.edges.select(*columns)) == rows(want.edges.select(*columns))
    assert rows(got.nodes.select("id", "label", "noteId", "degree")) == rows(want.nodes.select("id", "label", "noteId", "degree"))


def random_note(rng, ids, pos):
    tags = [rng.choice(["hot", "t1", "t2", "t3", "t4", "zz"]) for _ in range(rng.randrange(4))]
    return (f"title {rng.randrange(99)}", pos, rng.sample(ids, rng.randrange(4)), tags)


@pytest.mark.parametrize("seed", [1])
def test_random_changes(spark, tmp_path, seed):
    """Tags pass the limit of 4 both ways, notes come, go and come back, links dangle and are met."""
    rng = random.Random(seed)
    ids = [f"n{i}" for i in range(12)]
    notes = {i: random_note(rng, ids, k) for k, i in enumerate(ids[:7])}
    feed = GraphFeed(spark, str(tmp_path / "feed"), max_group=4)
    feed.start(spark.createDataFrame([(i, *n) for i, n in notes.items()], NOTES))
    same_as_rebuild(spark, feed, notes, 4)
    seq = 0
    for batch in range(3):
        changes = []
        for i in rng.choices(ids, k=rng.randrange(1, 6)):
            seq += 1
            if i in notes and rng.random() < 0.35:
                del notes[i]
                changes.append((i, DELETE, seq, None, None, None, None))
            else:
                kind = UPDATE if i in notes else CREATE
                notes[i] = random_note(rng, ids, rng.randrange(40))
                changes.append((i, kind, seq, *notes[i]))
        rng.shuffle(changes)
        feed.apply(spark.createDataFrame(changes, CHANGE), ("s", batch))
        same_as_rebuild(spark, feed, notes, 4)


def change(i, event, seq, links=(), tags=(), pos=0):
    return (i, event, seq, f"title {i}", pos, list(links), list(tags))


def test_the_limit_of_a_group(spark, tmp_path):
    """The 21st note of a tag takes all its 190 pairs out; without it they are back."""
    notes = {f"n{i:02d}": (f"title {i}", i, [], ["t"]) for i in range(20)}
    feed = GraphFeed(spark, str(tmp_path / "feed"))
    feed.start(spark.createDataFrame([(i, *n) for i, n in notes.items()], NOTES))
    assert feed.graph().edges.count() == 190
    feed.apply(spark.createDataFrame([change("x", CREATE, 1, tags=["t"], pos=99)], CHANGE))
    assert feed.graph().edges.count() == 0 and {r.degree for r in feed.graph().nodes.collect()} == {0}
    feed.apply(spark.createDataFrame([change("x", UPDATE, 2, pos=99)], CHANGE))
    same_as_rebuild(spark, feed, notes | {"x": ("title x", 99, [], [])}, 20)
    assert feed.graph().edges.count() == 190


def test_batches_again_and_out_of_order(spark, tmp_path):
    """The same state whatever the order: an older change of a note is none, a deletion stays."""
    first = [change("a", CREATE, 1, ["b"], ["t"]), change("b", CREATE, 1, [], ["t"], 1), change("c", CREATE, 1, ["a", "a", "c"])]
    second = [change("a", UPDATE, 2, ["c"], ["u", "t"]), change("b", DELETE, 2), change("c", UPDATE, 1, ["b"])]
    third = [change("d", CREATE, 1, ["a"], ["t"], 3), change("a", DELETE, 1)]
    states = []
    for order in ((first, second, third), (third, second, first, second)):
        feed = GraphFeed(spark, str(tmp_path / f"feed{len(states)}"))
        for batch in order:
            feed.apply(spark.createDataFrame(batch, CHANGE))
        columns = ("source", "target", "type", "tagName")
        states.append((rows(feed.graph().nodes), rows(feed.graph().edges.select(*columns))))
    assert states[0] == states[1] and [r[0] for r in states[0][0]] == ["a", "c", "d"]
    assert [r for r in states[0][1] if "b" in r[:2]] == []


def test_a_batch_again_by_number(spark, tmp_path):
    feed = GraphFeed(spark, str(tmp_path / "feed"))
    one = spark.createDataFrame([change("a", CREATE, 1)], CHANGE)
    assert feed.graph() is None
    assert feed.apply(one, ("s", 0)) and feed.apply(spark.createDataFrame([change("b", CREATE, 1)], CHANGE), ("s", 0)) is None
    assert [r.id for r in feed.graph().nodes.collect()] == ["a"]


def test_odd_changes(spark, tmp_path):
    odd = [(None, CREATE, 1, "t", 1, [], []), ("a", None, 1, "t", 1, [], []), ("a", 7, 9, "t", 1, [], []), ("a", CREATE, None, "t", 1, [], []), ("a", CREATE, 3, None, None, None, None), ("a", CREATE, 3, None, None, None, None),
           ("b", DELETE, 5, None, None, None, None), ("b", UPDATE, 5, "t", 1, [], []), ("c", UPDATE, 1, "old", 1, ["a", None], ["x", None]), ("c", UPDATE, 2, "new", 2, ["a"], ["x"])]
    found = {(r.id, r.event, r.seq, r.title) for r in latest_changes(spark.createDataFrame(odd, CHANGE)).collect()}
    assert found == {("a", CREATE, 3, None), ("b", DELETE, 5, None), ("c", UPDATE, 2, "new")}
    feed = GraphFeed(spark, str(tmp_path / "feed"))
    feed.apply(spark.createDataFrame(odd, CHANGE))
    assert rows(feed.graph().nodes) == [("a", "(untitled)", "a", 1), ("c", "new", "c", 1)]
    feed.apply(spark.createDataFrame([], CHANGE))
    assert rows(feed.graph().nodes.select("id")) == [("a",), ("c",)]


def test_a_stream_of_changes(spark, tmp_path):
    path, folder = str(tmp_path / "changes"), str(tmp_path / "feed")
    feed = GraphFeed(spark, folder)
    for batch in ([change("a", CREATE, 1, ["b"], ["t"]), change("b", CREATE, 2, [], ["t"], 1)], [change("b", DELETE, 3)], [change("b", CREATE, 4, ["a"])]):
        spark.createDataFrame(batch, CHANGE).coalesce(1).write.mode("append").json(path)
        follow(spark.readStream.schema(CHANGE).json(path), feed, str(tmp_path / "state")).awaitTermination(120)
    assert feed.store.latest().number == 4  # the empty one, and one a batch
    graph = export.read_snapshot(spark.newSession(), folder)
    assert rows(graph.edges.select("source", "target", "type")) == [("a", "b", "link"), ("b", "a", "link")]


def test_a_batch_without_a_change_copies_nothing(spark, tmp_path):
    """Late changes make a version of the same tables, which outlive the version they came with."""
    feed = GraphFeed(spark, str(tmp_path / "feed"), keep=2)
    first = feed.apply(spark.createDataFrame([change("a", CREATE, 5, ["b"]), change("b", CREATE, 5)], CHANGE), ("s", 0))
    late = [spark.createDataFrame([change("a", UPDATE, 1, ["c"])], CHANGE), spark.createDataFrame([], CHANGE)]
    for number in range(1, 5):
        version = feed.apply(late[number % 2], ("s", number))
        assert version.data == first.data and version.batches == {"s": number}
    assert len(feed.store.versions()) == 2
    assert rows(feed.graph().edges.select("source", "target")) == [("a", "b")]
    feed.apply(spark.createDataFrame([change("a", UPDATE, 6)], CHANGE), ("s", 5))
    feed.apply(late[0], ("s", 6))
    assert feed.graph().edges.count() == 0 and not (tmp_path / "feed" / "data" / first.data).exists()
