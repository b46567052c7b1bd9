"""Paged scans: a service on this machine that answers, fails and cuts off pages, and stored envelopes."""

import json
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from linkgraph.operators.enrich import tag_titles
from linkgraph.sources.notes import NOTE, TAG
from linkgraph.sources.pages import NOTE_ITEM, REFERENCE, TAG_ITEM, PageReader, Pages, envelope, fetch_pages, page_status, paged_notes, paged_tags, read_pages


class Service:
    """Serves lists of items by path, in pages; keeps what was asked.  ``broken``: (path, page) that fail,
    as often as the number says; ``odd``: answers that are sent as they are."""

    def __init__(self, lists, broken=(), odd=()):
        self.lists, self.broken, self.odd, self.asked, self.lock = lists, dict(broken), dict(odd), [], threading.Lock()
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                url = urllib.parse.urlparse(self.path)
                query, path = dict(urllib.parse.parse_qsl(url.query)), urllib.parse.unquote(url.path).strip("/")
                page, limit = int(query["page"]), int(query["limit"])
                with outer.lock:
                    outer.asked.append((path, page, query["fields"], limit, query.get("token")))
                    left = outer.broken.get((path, page), 0)
                    outer.broken[path, page] = left - 1
                if left > 0:
                    self.send_error(500)
                    return
                items = outer.lists.get(path, [])
                told = outer.odd.get((path, page)) or json.dumps({"items": items[(page - 1) * limit : page * limit], "has_more": page * limit < len(items)})
                self.send_response(200)
                self.end_headers()
                self.wfile.write(told.encode())

            def log_message(self, *_):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_address[1]}"


@pytest.fixture
def serve():
    running = []

    def make(*args, **kw):
        running.append(Service(*args, **kw))
        return running[-1]

    yield make
    for s in running:
        s.server.shutdown()


def notes(n):
    return [{"id": f"n{i:04d}", "parent_id": "f", "title": f"t{i}", "body": "b", "created_time": i, "updated_time": i} for i in range(n)]


def ids(scan):
    return [r.id for r in scan.rows.orderBy("pos").collect()]


def test_all_pages_in_ranges(spark, serve):
    """Ranges of pages are partitions; fields, limit and token are asked for; pages beyond the end are asked once a range."""
    service = serve({"notes": notes(730)})
    how = {"pages": 12, "pages_each": 4, "query": {"token": "secret"}}
    assert read_pages(spark, service.url, "notes", NOTE_ITEM, **how).rdd.getNumPartitions() == 3
    pages = fetch_pages(spark, service.url, "notes", NOTE_ITEM, **how)
    scan = paged_notes(pages)
    assert ids(scan) == [f"n{i:04d}" for i in range(730)] and not scan.truncated and scan.failed is None
    assert scan.rows.columns == [*NOTE_ITEM.names, "pos"] and set(scan.rows.columns) == set(NOTE.names)
    assert {a[2:] for a in service.asked} == {("id,parent_id,title,body,created_time,updated_time", 100, "secret")}
    assert sorted({a[1] for a in service.asked}) == [1, 2, 3, 4, 5, 6, 7, 8, 9]


def test_fields_follow_the_schema_and_filters_the_request(spark, serve):
    service = serve({"tags/a b/notes": [{"id": "x"}], "tags/c/notes": [{"id": "y"}]})
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    pages = read_pages(spark, service.url, "tags/{key}/notes", REFERENCE, keys=["a b", "c", "d"])
    assert [r["items"][0].id for r in pages.where("key = 'a b'").collect()] == ["x"]
    assert {a[0] for a in service.asked} == {"tags/a b/notes"} and {a[2] for a in service.asked} == {"id"}
    service.asked.clear()
    assert pages.where("key in ('c', 'd') and page = 1").count() == 2
    assert {a[:2] for a in service.asked} == {("tags/c/notes", 1), ("tags/d/notes", 1)}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    pages = read_pages(spark, service.url, "tags/{key}/notes", REFERENCE, keys=["a b", "c", "d"])
    assert [r["items"][0].id for r in pages.where("key = 'a b'").collect()] == ["x"]


def test_partitions():
    schema = envelope(REFERENCE)
    plan = lambda **o: PageReader({"url": "", "path": "", **o}, schema).partitions()
    assert plan() == [Pages(("",), 1, None)]
    assert plan(pages="101", pages_each="50") == [Pages(("",), 1, 50), Pages(("",), 51, 100), Pages(("",), 101, None)]
    assert plan(last="3") == [Pages(("",), 1, 3)]
    assert plan(keys='["a","b","c"]', keys_each="2") == [Pages(("a", "b")), Pages(("c",))]


@pytest.mark.parametrize(("broken", "want"), [(2, 100), (1, 0), (8, 700)])
def test_a_failing_page_leaves_what_was_read(spark, serve, broken, want):
    service = serve({"notes": notes(730)}, broken={("notes", broken): 9})
    scan = paged_notes(fetch_pages(spark, service.url, "notes", NOTE_ITEM, pages=8, pages_each=3))
    assert ids(scan) == [f"n{i:04d}" for i in range(want)] and scan.truncated and scan.failed == broken


def test_a_failed_page_is_asked_again(spark, serve):
    service = serve({"notes": notes(130)}, broken={("notes", 2): 1})
    scan = paged_notes(fetch_pages(spark, service.url, "notes", NOTE_ITEM, attempts=2))
    assert len(ids(scan)) == 130 and not scan.truncated
    service = serve({"notes": notes(130)}, broken={("notes", 2): 1})
    first, second = (fetch_pages(spark, service.url, "notes", NOTE_ITEM) for _ in range(2))
    assert paged_notes(first).failed == 2
    for both in (first.unionByName(second), second.unionByName(first)):
        scan = paged_notes(both)  # an answer counts more than a failure, whenever it came
        assert len(ids(scan)) == 130 and not scan.truncated


def test_what_was_fetched_is_kept(spark, serve, tmp_path):
    service = serve({"notes": notes(250)})
    fetch_pages(spark, service.url, "notes", NOTE_ITEM, store=str(tmp_path / "pages"), pages=3, pages_each=1)
    asked = len(service.asked)
    assert len(ids(paged_notes(spark.read.parquet(str(tmp_path / "pages"))))) == 250 and len(service.asked) == asked


def test_odd_answers(spark, serve):
    cases = {"no items": ('{"has_more": false}', 0, None), "null items": ('{"items": null}', 0, None), "no promise": ('{"items": [{"id": "a"}]}', 1, None), "a word as promise": ('{"items": [{"id": "a"}], "has_more": "yes"}', 1, None),
             "no json": ("<html>", 0, 1), "a list": ("[1]", 0, 1), "items of numbers": ('{"items": [1]}', 0, 1), "a time in words": ('{"items": [{"id": "a", "created_time": "noon"}]}', 0, 1), "a number as title": ('{"items": [{"id": "a", "title": 7}]}', 1, None)}
    for name, (answer, rows, failed) in cases.items():
        service = serve({}, odd={("notes", 1): answer})
        scan = paged_notes(fetch_pages(spark, service.url, "notes", NOTE_ITEM))
        assert (len(ids(scan)), scan.failed, scan.truncated) == (rows, failed, failed is not None), name


def told(spark, item, *pages):
    """Envelopes of (key, page, ids or None for an error, has_more, fetched)."""
    rows = [(k, p, None if i is None else [tuple([x] + [None] * (len(item) - 1)) for x in i], m, f, "error" if i is None else None) for k, p, i, m, f in pages]
    return spark.createDataFrame(rows, envelope(item))


def test_bounds(spark):
    two = told(spark, NOTE_ITEM, ("", 1, ["a", "b"], True, 0), ("", 2, ["c", "d"], False, 0))
    facts = {limit: ((s := paged_notes(two, limit)).truncated, ids(s)) for limit in (1, 2, 3, 4, 5, None)}
    assert facts == {1: (True, ["a"]), 2: (True, ["a", "b"]), 3: (True, ["a", "b", "c"]), 4: (False, [*"abcd"]), 5: (False, [*"abcd"]), None: (False, [*"abcd"])}
    more = told(spark, NOTE_ITEM, ("", 1, ["a", "b"], True, 0), ("", 2, [], False, 0))
    assert paged_notes(more, 2).truncated and not paged_notes(more, 3).truncated


def test_gaps_and_none(spark):
    gap = told(spark, NOTE_ITEM, ("", 1, ["a"], True, 0), ("", 3, ["c"], False, 0), ("", 0, ["no"], False, 0))
    assert (ids(paged_notes(gap)), paged_notes(gap).failed) == (["a"], 2)
    late = told(spark, NOTE_ITEM, ("", 2, ["a"], False, 0))
    assert (ids(paged_notes(late)), paged_notes(late).failed) == ([], 1)
    beyond = told(spark, NOTE_ITEM, ("", 1, ["a"], False, 0), ("", 2, ["b"], False, 0), ("", 3, None, None, 0))
    assert (ids(paged_notes(beyond)), paged_notes(beyond).truncated) == (["a"], False)
    none = paged_notes(told(spark, NOTE_ITEM))
    assert (ids(none), none.truncated, none.failed) == ([], True, 1)


def test_the_latest_answer_counts(spark):
    again = told(spark, NOTE_ITEM, ("", 1, ["old"], True, 1), ("", 1, ["new"], False, 2), ("", 1, None, None, 3))
    assert ids(paged_notes(again)) == ["new"]


def tag_map(found):
    return {r.note_id: r.tags for r in tag_titles(found.tags, found.note_tag).collect()}


def tag_pages(spark, *titles, more=False):
    return spark.createDataFrame([("", 1, [(f"t{i}", t) for i, t in enumerate(titles)], more, 0, None)], envelope(TAG_ITEM))


def test_tag_maps(spark):
    two = tag_pages(spark, "b", "a")
    assert set(paged_tags(two, told(spark, REFERENCE)).tags.columns) == set(TAG.names)
    both = told(spark, REFERENCE, ("t0", 1, ["n1"], True, 0), ("t0", 2, ["n2"], False, 0), ("t1", 1, ["n1"], False, 0), ("other", 1, ["n9"], False, 0))
    found = paged_tags(two, both)
    assert tag_map(found) == {"n1": ["b", "a"], "n2": ["b"]} and not found.truncated
    assert paged_tags(two, both, 2).truncated and paged_tags(two, both, 1).truncated
    assert tag_map(paged_tags(two, both, 1)) == {"n1": ["b"], "n2": ["b"]}


def test_partial_tag_maps(spark):
    """Of a failing tag the pages before, of later tags nothing; without all tags nothing at all."""
    three = tag_pages(spark, "x", "y", "z")
    pages = [("t0", 1, ["n1"], False, 0), ("t1", 1, ["n1", "n2"], True, 0), ("t1", 2, None, None, 0), ("t2", 1, ["n3"], False, 0)]
    found = paged_tags(three, told(spark, REFERENCE, *pages))
    assert tag_map(found) == {"n1": ["x", "y"], "n2": ["y"]} and found.truncated
    found = paged_tags(three, told(spark, REFERENCE, pages[0], pages[3]))
    assert tag_map(found) == {"n1": ["x"]} and found.truncated
    found = paged_tags(three, told(spark, REFERENCE, ("t0", 1, None, None, 0), *pages[1:]))
    assert tag_map(found) == {} and found.truncated
    broken = tag_pages(spark, "x", more=True).unionByName(told(spark, TAG_ITEM, ("", 2, None, None, 0)))
    found = paged_tags(broken, told(spark, REFERENCE, *pages))
    assert tag_map(found) == {} and found.truncated


def test_no_task_holds_all_pages_of_a_key(spark):
    plan = page_status(told(spark, REFERENCE, ("", 1, ["a"], False, 0)))._jdf.queryExecution().toString()
    assert "Window" not in plan and "collect_list" not in plan and "Cartesian" not in plan


def test_shuffles_grow_with_the_tables(spark, monkeypatch, tmp_path):
    """More partitions than the session's for the shuffles of a larger table, and the same tags."""
    from linkgraph.operators.enrich import tag_titles
    from linkgraph.sources import shared

    spark.range(3000).selectExpr("concat('t', id % 7) tag_id", "concat('n', id % 500) note_id").distinct().write.parquet(str(tmp_path / "bridge"))
    bridge = spark.read.parquet(str(tmp_path / "bridge"))
    tags = spark.createDataFrame([(f"t{i}", f"title {i}", -i) for i in range(7)], "id string, title string, ord long")
    want = sorted(tag_titles(tags, bridge).collect())
    assert "RepartitionByExpression" not in tag_titles(tags, bridge)._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(shared, "EACH", 100)
    got = tag_titles(tags, bridge)
    assert got.rdd.getNumPartitions() > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted(got.collect()) == want
