"""The registered queries of the note graph, over the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkgraph.functions import links as L
from linkgraph.functions import text as T
from linkgraph.operators import edges as E
from linkgraph.operators import export, imports, itemdata, semantic, views
from linkgraph.operators import search as text_search
from linkgraph.operators.enrich import enrich, tag_titles
from linkgraph.operators.feed import CREATE, DELETE, UPDATE, GraphFeed
from linkgraph.operators.graph import Graph, build_graph, build_nodes, degrees, graph_summary, isolated_nodes, visible_edges
from linkgraph.plans import tables as D
from linkgraph.sources import notes as S
from linkgraph.sources import pages as P
from linkgraph.sources.notes import open_note, scan_notes, scan_tags
from linkgraph.sources.shared import hadoop_path, run_folder
from linkgraph.streaming.refresh import refresh

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: Ids that focus queries start from, the text a search looks for, and the note that is opened.
SELECTED, SEARCHED, OPENED = (1, 33), "  THE ", 7
#: The cosine of a semantic edge: the vectors of the tables are nearly random, so few pairs have more.
SIMILAR = 0.3
#: What the stored n-grams are asked for: a short text, a longer one, one that begins a label, none.
PHRASES = (SEARCHED, "ation", "de", "qqqq")


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def tagged(source: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    """Notes with their tags, and no links."""
    notes, tags, note_tag = source
    none = lambda body: F.array().cast("array<string>")
    return enrich(notes, tag_titles(tags, note_tag), none)


def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of documents with their links, and no tags."""
    return with_links(D.document_notes(spark, sf_dir))


def with_links(notes: DataFrame) -> DataFrame:
    return notes.select("id", "title", "pos", L.linked_ids(F.col("body")).alias("links"), F.array().cast("array<string>").alias("tags"))


def order_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Orders by the parts they share, of whatever number of orders."""
    notes, *tagging = D.order_tags(spark, sf_dir)
    return build_graph(notes, lambda notes: E.merged_pairs(E.associated(notes, *tagging), None), closed=True)


def document_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Links only: the notes carry no tags."""
    return build_graph(linked(spark, sf_dir), E.link_edges, closed=True)


def mixed_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of documents with links, tagged by source and thirteenth, so that both kinds of edges occur."""
    notes = D.document_notes(spark, sf_dir)
    tags = F.array(F.concat(F.lit("low-"), F.floor(F.col("pos") / 9)), F.concat(F.col("parent_id"), F.lit("/"), F.floor(F.col("pos") / 100)))
    return notes.select("id", "title", "pos", L.linked_ids(F.col("body")).alias("links"), tags.alias("tags"))


_STORED: dict[tuple, Graph] = {}


def _stored(spark: SparkSession, sf_dir: str, build: Callable[[SparkSession, str], Graph], keep: Callable[[Graph, str], Graph] = export.store) -> Graph:
    """The snapshot of a graph, built and stored once for a session and the state that its tables' files are
    in, in the folder that driver and executors share; queries on a snapshot read what the first one stored."""
    fs, folder = hadoop_path(spark, sf_dir)
    files = [(f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(folder)]
    key = (spark.sparkContext.applicationId, sf_dir, build.__name__, *sorted(files))
    if key not in _STORED:
        _STORED[key] = keep(build(spark, sf_dir), run_folder(spark))
    return _STORED[key]


def whole_graph(spark: SparkSession, sf_dir: str, max_group: int | None = None) -> Graph:
    """From scans to the graph: notes of documents, tagged by associations, links from bodies."""
    notes, tags, note_tag = D.document_tags(spark, sf_dir)
    rich = enrich(scan_notes(notes, None).rows, tag_titles(scan_tags(tags, None).rows, note_tag))
    return build_graph(rich, lambda notes: E.all_edges(notes, max_group), closed=True)


def limited_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The same with edges of tags within the group limit, as the SQL of those who read it has them."""
    return whole_graph(spark, sf_dir, E.MAX_GROUP)


def mixed_graph(spark: SparkSession, sf_dir: str) -> Graph:
    return build_graph(mixed_notes(spark, sf_dir))


def typed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of every type between documents, a third of them wrapped in ``data``, as a viewer gets them."""
    notes = D.document_notes(spark, sf_dir)
    kinds = F.array(*[F.lit(k) for k in ("link", "explicit", "semantic", "tag", "other")])
    target = D.note_id((F.col("pos") * 7 + 3) % D.TARGETS)
    kind = F.element_at(kinds, (F.col("pos") % 5).cast("int") + 1)
    name = F.when(kind == "tag", F.concat(F.lit("t"), F.col("pos") % 13, F.lit(", u"), F.col("pos") % 3))
    data = F.struct(F.col("id").alias("source"), target.alias("target"), kind.alias("type"), name.alias("tagName"))
    rows = notes.select("pos", data.alias("edge"))
    wrapped = F.col("pos") % 3 == 0
    return rows.select(F.when(wrapped, F.col("edge")).alias("data"), *[F.when(~wrapped, F.col(f"edge.{c}")).alias(c) for c in ("source", "target", "type", "tagName")])


# links


def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("doc_id")
    one = D.note_id(number)
    shapes = [
        F.concat(F.lit(":/"), one),
        F.concat(F.lit(D.SCHEME), one, F.lit("#sec+two%21")),
        F.concat(F.lit("https://example.com/"), one),
        F.concat(F.lit(":/"), F.substring(one, 2, 31), F.lit("g")),
        F.concat(F.lit(":/"), one, F.lit(' "a title"')),
        F.concat(F.lit(D.SCHEME.upper()), one),
        F.concat(F.lit(":/"), one, F.lit("#a b")),
        F.lit(""),
    ]
    return D.table(spark, sf_dir, "documents").select("doc_id", F.element_at(F.array(*shapes), (number % 8).cast("int") + 1).alias("url"))


@query
def url_predicate(spark, sf_dir):
    return _urls(spark, sf_dir).select("doc_id", L.is_resource_url(F.col("url")).alias("is_resource"))


@query
def url_parse(spark, sf_dir):
    parsed = _urls(spark, sf_dir).select("doc_id", L.parse_resource_url(F.col("url")).alias("p"))
    return parsed.select("doc_id", F.col("p.itemId").alias("item_id"), F.col("p.hash").alias("hash"))


@query
def code_strip(spark, sf_dir):
    return D.document_notes(spark, sf_dir).select("id", F.md5(L.strip_code(F.col("body"))).alias("digest"))


def _kind(spark: SparkSession, sf_dir: str, urls) -> DataFrame:
    cleaned = D.document_notes(spark, sf_dir).select("id", L.strip_code(F.col("body")).alias("c"))
    found = F.when(L.may_link(F.col("c")), F.transform(urls(F.col("c")), lambda u: L.parse_resource_url(u)))
    return cleaned.select("id", F.explode(found).alias("u")).select("id", F.col("u.itemId").alias("link"), F.col("u.hash").alias("hash"))


@query
def links_inline(spark, sf_dir):
    return _kind(spark, sf_dir, L.inline_urls)


@query
def links_reference(spark, sf_dir):
    return _kind(spark, sf_dir, L.reference_urls)


@query
def links_html(spark, sf_dir):
    return _kind(spark, sf_dir, L.html_urls)


@query
def links_unique(spark, sf_dir):
    return linked(spark, sf_dir).select("id", F.posexplode("links").alias("nth", "link"))


@query
def links_in_pages(spark, sf_dir):
    """Web pages have links, none of them to a note."""
    pages = D.table(spark, sf_dir, "pages").select(F.size(L.resource_urls(F.col("html"))).alias("n"))
    return pages.agg(F.count("*").alias("pages"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("links"))


# scans


@query
def note_scan_limit(spark, sf_dir):
    """The bound is the operator: the first 150 notes by position."""
    return scan_notes(D.document_notes(spark, sf_dir), 150).rows.select("id", "parent_id", "title", "created_time", "pos")


@query
def note_truncated(spark, sf_dir):
    """Bounds about the number of notes, which one count of the whole table gives."""
    notes = D.document_notes(spark, sf_dir)
    n = notes.count()
    return spark.createDataFrame([(k, scan_notes(notes, n + k).truncated) for k in (-1, 0, 1)], "beyond bigint, truncated boolean")


@query
def missing_items(spark, sf_dir):
    """A page without items: no notes, no tags, nothing truncated, and the graph of the other notes stands."""
    none = S.empty(spark, S.NOTE)
    notes = scan_notes(D.document_notes(spark, sf_dir).select(*none.columns).unionByName(none), None)
    counts = notes.rows.agg(F.count("*").alias("notes"))
    return counts.select("notes", F.lit(scan_notes(none).rows.count()).cast("bigint").alias("missing"), F.lit(scan_notes(none).truncated or scan_tags(S.empty(spark, S.TAG)).truncated).alias("truncated"))


@query
def tag_truncated(spark, sf_dir):
    tags = D.part_tags(spark, sf_dir)[1]
    return spark.createDataFrame([(n, scan_tags(tags, n).truncated) for n in (9, 10, 100_000)], "bound bigint, truncated boolean")


@query
def tag_scan_limit(spark, sf_dir):
    """The bound is the operator: the first 40 tags in order."""
    return scan_tags(D.user_tags(spark, sf_dir)[1], 40).rows


@query
def paged_notes(spark, sf_dir):
    """All pages of notes answer: nothing is lacking."""
    return P.paged_notes(D.note_pages(spark, sf_dir, fails=False), None).rows.select("id", "title", "pos")


@query
def paged_notes_partial(spark, sf_dir):
    """A page fails: the notes of the pages before it."""
    return P.paged_notes(D.note_pages(spark, sf_dir, fails=True), None).rows.select("id", "title", "pos")


@query
def paged_scan_flags(spark, sf_dir):
    """Whether scans of pages are truncated: with and without a failing page, and by bounds about the number of notes."""
    whole, partial = D.note_pages(spark, sf_dir, fails=False), D.note_pages(spark, sf_dir, fails=True)
    n = D.document_notes(spark, sf_dir).count()
    scans = [("whole", whole, None), ("partial", partial, None), ("one less", whole, n - 1), ("exact", whole, n), ("one more", whole, n + 1)]
    found = [(name, (scan := P.paged_notes(pages, limit)).truncated, scan.failed) for name, pages, limit in scans]
    return spark.createDataFrame(found, "scan string, truncated boolean, failed bigint")


def _titles(tags: P.PagedTags) -> DataFrame:
    return tag_titles(tags.tags, tags.note_tag).select("note_id", F.size("tags").cast("bigint").alias("n"), F.md5(F.array_join("tags", ",")).alias("digest"))


@query
def paged_tag_map(spark, sf_dir):
    return _titles(P.paged_tags(*D.part_tag_pages(spark, sf_dir, fails=False), None))


@query
def paged_tag_map_partial(spark, sf_dir):
    """A page of a tag's notes fails: the tags before it, and the pages of it before."""
    return _titles(P.paged_tags(*D.part_tag_pages(spark, sf_dir, fails=True), None))


@query
def note_tags(spark, sf_dir):
    _, tags, note_tag = D.user_tags(spark, sf_dir)
    return tag_titles(tags, note_tag).select("note_id", F.size("tags").cast("bigint").alias("n"), F.md5(F.array_join("tags", ",")).alias("digest"))


@query
def enriched_notes(spark, sf_dir):
    notes, (_, tags, note_tag) = D.document_notes(spark, sf_dir), D.user_tags(spark, sf_dir)
    rich = enrich(notes, tag_titles(tags, note_tag))
    return rich.select("id", "parent_id", "title", F.array_join("links", ",").alias("links"), F.size("tags").cast("bigint").alias("n_tags"), F.coalesce(F.get("tags", F.lit(0)), F.lit("")).alias("first_tag"))


# edges


@query
def link_edges(spark, sf_dir):
    return E.link_edges(linked(spark, sf_dir)).select("source", "target", "type")


@query
def tag_edges(spark, sf_dir):
    return E.merged_pairs(E.associated(*D.order_tags(spark, sf_dir)))


@query
def tag_edges_merged(spark, sf_dir):
    """Users by hour: pairs that share several tags."""
    return E.merged_pairs(E.associated(*D.user_tags(spark, sf_dir)))


@query
def tag_edges_cap_boundary(spark, sf_dir):
    """Notes of documents in groups of 20 and 21: the former give 190 edges each, the latter none."""
    size = 41
    group = F.concat(F.floor(F.col("pos") / size), F.when(F.col("pos") % size < 20, F.lit("a")).otherwise(F.lit("b")))
    notes = D.document_notes(spark, sf_dir).select("id", "pos", F.array(group).alias("tags"))
    return E.tag_edges(notes)


@query
def tag_edges_all_dropped(spark, sf_dir):
    return E.tag_edges(tagged(D.part_tags(spark, sf_dir)))


@query
def tag_self_loops(spark, sf_dir):
    """A note with one title twice gets a loop, and a pair repeats the name."""
    tag = F.concat(F.lit("t"), F.floor(F.col("pos") / 3))
    tags = F.when(F.col("pos") % 3 == 0, F.array(tag, tag)).otherwise(F.array(tag, F.lit("common")))
    return E.tag_edges(D.document_notes(spark, sf_dir).select("id", "pos", tags.alias("tags")))


@query
def all_edges(spark, sf_dir):
    return E.all_edges(mixed_notes(spark, sf_dir))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "embeddings").select(D.note_id(F.col("vec_id")).alias("id"), F.col("embedding").alias("vector"))


@query
def semantic_edges(spark, sf_dir):
    """Pairs of vectors with a cosine of SIMILAR or more, of all pairs."""
    return semantic.semantic_edges(_vectors(spark, sf_dir), SIMILAR)


@query
def semantic_graph_stats(spark, sf_dir):
    """Links of notes and semantic edges of their vectors in one graph; those of vectors without a note wouldn't be
    visible, so these vectors leave before they are compared."""
    known = lambda notes: _vectors(spark, sf_dir).join(notes.select("id"), "id", "left_semi")
    both = lambda notes: E.link_edges(notes).unionByName(semantic.semantic_edges(known(notes), SIMILAR))
    return views.graph_stats(build_graph(linked(spark, sf_dir), both, closed=True))


@query
def unwrapped_edges(spark, sf_dir):
    return views.flat_edges(typed_edges(spark, sf_dir))


@query
def typed_node_stats(spark, sf_dir):
    """Explicit and semantic edges count as links, other types as neither."""
    return views.node_stats(views.flat_edges(typed_edges(spark, sf_dir)))


@query
def typed_graph_stats(spark, sf_dir):
    notes = D.document_notes(spark, sf_dir)
    edges = views.flat_edges(typed_edges(spark, sf_dir))
    return views.graph_stats(Graph(build_nodes(notes, edges), edges))


# the whole way: scans, enrichment, edges, graph, stored snapshot, and views of that


@query
def snapshot_nodes(spark, sf_dir):
    """Tags on any number of notes link them."""
    return _stored(spark, sf_dir, whole_graph).nodes


@query
def snapshot_edges(spark, sf_dir):
    return _stored(spark, sf_dir, limited_graph).edges


@query
def snapshot_stats(spark, sf_dir):
    return views.graph_stats(_stored(spark, sf_dir, limited_graph))


@query
def snapshot_focus(spark, sf_dir):
    """In the graph of snapshot_nodes, where tags on any number of notes link them."""
    graph = _stored(spark, sf_dir, whole_graph)
    return views.focus(graph, spark.range(1).select(F.explode(F.array(*[D.note_id(F.lit(i)) for i in SELECTED])).alias("id"))).nodes


@query
def snapshot_search(spark, sf_dir):
    return views.search_nodes(_stored(spark, sf_dir, limited_graph).nodes, SEARCHED)


@query
def refreshed_nodes(spark, sf_dir):
    """The documents as a stream: each micro-batch publishes a graph, and another session reads the last one."""
    folder = f"{run_folder(spark)}/refreshed-{uuid.uuid4().hex[:8]}"
    own = spark.newSession()
    rebuild = lambda docs: build_graph(with_links(D.notes_of(docs)), E.link_edges, closed=True)
    refresh(D.document_stream(own, sf_dir), rebuild, f"{folder}/store", f"{folder}/checkpoint").awaitTermination()
    return export.read_snapshot(spark, f"{folder}/store").nodes


def change_batches(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Changes of the mixed notes: some go, some get other links and tags, new ones come and some come back."""
    pos = F.col("pos")
    links = lambda k: F.array(D.note_id((pos * k + 3) % D.TARGETS))
    tags = lambda name, size: F.array(F.concat(F.lit(name), F.floor(pos / size)))
    notes = D.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"))
    told = lambda where, event, seq, at=pos, link=links(5), tag=tags("moved-", 20): notes.where(where).select(
        D.note_id(at).alias("id"), F.lit(event).alias("event"), F.lit(seq).cast("bigint").alias("seq"), F.concat(F.lit("Changed "), pos).alias("title"), at.alias("pos"), link.alias("links"), tag.alias("tags")
    )
    return [
        told("pos % 11 = 0", DELETE, 2).unionByName(told("pos % 7 = 3", UPDATE, 1)),
        told("pos % 13 = 5", CREATE, 3, at=pos + 10_000_000, link=links(11), tag=tags("low-", 9)).unionByName(told("pos % 22 = 0", CREATE, 4)),
        told("pos % 7 = 3", UPDATE, 0).unionByName(told("pos % 11 = 0", UPDATE, 1)),  # late ones, which are none
    ]


def changed_graph(spark: SparkSession, sf_dir: str, max_group: int | None = None) -> Graph:
    """The graph of the mixed notes after the changes, kept up batch by batch."""
    feed = GraphFeed(spark, f"{run_folder(spark)}/feed-{uuid.uuid4().hex[:8]}", max_group)
    feed.start(mixed_notes(spark, sf_dir))
    for number, batch in enumerate(change_batches(spark, sf_dir)):
        feed.apply(batch, ("changes", number))
    return feed.graph()


def limited_changed_graph(spark: SparkSession, sf_dir: str) -> Graph:
    return changed_graph(spark, sf_dir, E.MAX_GROUP)


def _fed(spark: SparkSession, sf_dir: str, build: Callable[[SparkSession, str], Graph]) -> Graph:
    """The changed graph, which the feed has stored already."""
    return _stored(spark, sf_dir, build, lambda graph, _: graph)


@query
def feed_nodes(spark, sf_dir):
    """Tags on any number of notes link them."""
    return _fed(spark, sf_dir, changed_graph).nodes


@query
def feed_edges(spark, sf_dir):
    """Those of tags within the group limit, as its SQL has them."""
    return _fed(spark, sf_dir, limited_changed_graph).edges


# graph


@query
def node_labels(spark, sf_dir):
    return D.document_notes(spark, sf_dir).select("id", T.label(F.col("title")).alias("label"))


@query
def node_degree(spark, sf_dir):
    return degrees(E.all_edges(mixed_notes(spark, sf_dir)))


@query
def graph_nodes(spark, sf_dir):
    return order_graph(spark, sf_dir).nodes


def _injected(spark: SparkSession, sf_dir: str) -> Graph:
    """Notes with an edge each, a third of which end at no note."""
    notes = D.document_notes(spark, sf_dir)
    target = F.when(F.col("pos") % 3 == 0, F.lit("missing")).otherwise(D.note_id((F.col("pos") * 7 + 3) % D.TARGETS))
    edges = notes.select(F.col("id").alias("source"), target.alias("target"), F.lit("link").alias("type"), F.lit(None).cast("string").alias("tagName"))
    nodes = build_nodes(notes, edges)
    return Graph(nodes, visible_edges(edges, nodes))


@query
def visible_edges_only(spark, sf_dir):
    return _injected(spark, sf_dir).edges.select("source", "target", "type")


@query
def isolated(spark, sf_dir):
    return isolated_nodes(_injected(spark, sf_dir))


@query
def summary(spark, sf_dir):
    return graph_summary(_injected(spark, sf_dir))


# views


@query
def graph_stats(spark, sf_dir):
    return views.graph_stats(_stored(spark, sf_dir, mixed_graph))


@query
def graph_stats_empty(spark, sf_dir):
    return views.graph_stats(build_graph(mixed_notes(spark, sf_dir).where("pos < 0")))


@query
def node_stats(spark, sf_dir):
    return views.node_stats(E.all_edges(mixed_notes(spark, sf_dir)))


@query
def node_hover(spark, sf_dir):
    return views.hover(document_graph(spark, sf_dir))


@query
def search_nodes(spark, sf_dir):
    return views.search_nodes(document_graph(spark, sf_dir).nodes, SEARCHED)


@query
def indexed_search(spark, sf_dir):
    """The same search by stored n-grams of the labels."""
    labels = D.document_notes(spark, sf_dir).select("id", T.label(F.col("title")).alias("label"))
    index = text_search.write_index(labels, f"{run_folder(spark)}/labels-{uuid.uuid4().hex[:8]}", text="label")
    found = [text_search.find(index, q).select(F.lit(q).alias("query"), "id", F.col("text").alias("label")) for q in PHRASES]
    return reduce(DataFrame.unionByName, found)


@query
def item_data(spark, sf_dir):
    """Values of users by kind of event, from three clients' writes, merged in an order that is not that of time."""
    events, number = D.table(spark, sf_dir, "events"), F.col("event_id")
    writes = events.select(
        F.lit(1).alias("item_type"), F.col("user_id").cast("string").alias("item_id"), F.col("event_type").alias("key"), F.col("props").alias("value"),
        (number % 5 == 0).alias("deleted"), F.unix_micros(F.col("ts").cast("timestamp")).alias("updated"), F.concat(F.lit("client"), number % 3).alias("client"),
    )
    of = [writes.where(number % 3 == k) for k in range(3)]
    merged = itemdata.merge_writes(itemdata.merge_writes(of[2], of[0]), of[1])
    return merged.select("item_id", "key", "value", "deleted", "client")


def _imported(spark: SparkSession, sf_dir: str) -> Graph:
    """The document graph, exported and imported."""
    path = f"{run_folder(spark)}/export-{uuid.uuid4().hex[:8]}"
    export.write_json(_stored(spark, sf_dir, document_graph), path)
    return imports.read_export(spark, path).graph


@query
def imported_nodes(spark, sf_dir):
    return _imported(spark, sf_dir).nodes


@query
def imported_edges(spark, sf_dir):
    return _imported(spark, sf_dir).edges


@query
def import_rejects(spark, sf_dir):
    """Lines of every kind of flaw, by document, and why they are rejected; sound ones are counted as such."""
    lines = D.table(spark, sf_dir, "documents").select(F.element_at(F.lit([k for k, _ in D.LINES]), (F.col("doc_id") % len(D.LINES)).cast("int") + 1).alias("kind"), F.replace(F.element_at(F.lit([x for _, x in D.LINES]), (F.col("doc_id") % len(D.LINES)).cast("int") + 1), F.lit("ID"), D.note_id(F.col("doc_id"))).alias("element"))
    return imports.check_elements(lines).groupBy("kind", F.coalesce("reason", F.lit("sound")).alias("reason")).agg(F.count("*").alias("n"))


@query
def edge_toggle(spark, sf_dir):
    return views.show_edges(E.all_edges(mixed_notes(spark, sf_dir)), ["link"])


@query
def edge_direction(spark, sf_dir):
    return views.directed(E.all_edges(mixed_notes(spark, sf_dir))).groupBy("type", "directed").agg(F.count("*").alias("n"))


@query
def edge_hover(spark, sf_dir):
    return views.named_tag_edges(E.all_edges(mixed_notes(spark, sf_dir))).select("source", "target", "tagName")


def _focused(spark: SparkSession, sf_dir: str) -> Graph:
    graph = _stored(spark, sf_dir, document_graph)
    return views.focus(graph, spark.range(1).select(F.explode(F.array(*[D.note_id(F.lit(i)) for i in SELECTED])).alias("id")))


@query
def focus_nodes(spark, sf_dir):
    return _focused(spark, sf_dir).nodes


@query
def focus_edges(spark, sf_dir):
    return _focused(spark, sf_dir).edges.select("source", "target", "type")


@query
def opened_note(spark, sf_dir):
    return open_note(D.document_notes(spark, sf_dir), f"{OPENED:032x}").select("id", "title", "pos")


@query
def dark_themes(spark, sf_dir):
    color = F.concat(F.lit("#"), F.lpad(F.lower(F.hex(F.col("doc_id") * 7919 % 16777216)), 6, "0"))
    return D.table(spark, sf_dir, "documents").select("doc_id", T.is_dark(color).alias("dark"))


@query
def export_elements(spark, sf_dir):
    return export.elements(order_graph(spark, sf_dir))


@query
def export_json(spark, sf_dir):
    return export.document(_stored(spark, sf_dir, document_graph))
