"""The registered queries in DuckDB's SQL, written apart from the Spark plans."""

from __future__ import annotations

from linkgraph.plans.queries import OPENED, PHRASES, SEARCHED, SELECTED, SIMILAR
from linkgraph.plans.tables import LINES, SUFFIXES, TARGETS

WS = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
EOL = r"\n\r\x{2028}\x{2029}"
PREFIX = "(?:note://|:/)"
URL = rf'^{PREFIX}([A-Fa-f0-9]{{32}})(#[^{WS}]*)?(?:[{WS}]"[^{EOL}]*")?$'


def text(value: str) -> str:
    """A SQL literal; line ends are spelled out."""
    parts = value.replace("'", "''").replace("\r", "' || chr(13) || '").replace("\n", "' || chr(10) || '")
    return f"('{parts}')"


def hexed(number: str) -> str:
    return f"lpad(lower(to_hex(({number})::BIGINT)), 32, '0')"


_ENDINGS = ", ".join(text(s) for s in SUFFIXES)
NOTES = f"""notes AS (SELECT {hexed('doc_id')} AS id, source AS parent_id,
  CASE WHEN doc_id % 17 = 0 THEN '' ELSE split_part(text, chr(10), 1) END AS title,
  coalesce(text, '') || replace(replace(([{_ENDINGS}])[(doc_id % 12) + 1], 'TARGET', {hexed(f'(doc_id * 7 + 3) % {TARGETS}')}), 'SELF', {hexed('doc_id')}) AS body,
  n_chars AS created_time, doc_id AS pos FROM documents)"""
CLEANED = r"""cleaned AS (SELECT id, pos, regexp_replace(regexp_replace(body, '```[\s\S]*?```', '', 'g'), '`[^`]+`', '', 'g') AS c FROM notes)"""
_E = r"replace(replace(c, '\]', chr(1)), '\)', chr(2))"
_PATTERNS = (
    (_E, rf"\]\(([^){EOL}]*)\)"),
    (_E, rf"\]:([^{EOL}]*)(?:\n|\z)"),
    ("c", rf"(?i)<(?:img|a)[{WS}][\s\S]*?(?:src|href)=[\"'']({PREFIX}[A-Fa-f0-9]{{32}}(?:#[^\"''{WS}]*)?)[\"''][\s\S]*?>"),
)
_LISTS = " UNION ALL ".join(f"SELECT id, pos, {k} AS kind, regexp_extract_all({e}, '{p}', 1) AS l FROM cleaned" for k, (e, p) in enumerate(_PATTERNS))
LINKS = f"""lists AS ({_LISTS}),
raw AS (SELECT id, pos, kind, unnest(l) AS u, generate_subscripts(l, 1) AS i FROM lists),
urls AS (SELECT id, pos, kind, i, regexp_replace(replace(replace(u, chr(1), '\\]'), chr(2), '\\)'), '^[{WS}]+|[{WS}]+$', '', 'g') AS u FROM raw),
links AS (SELECT id, pos, kind, i, regexp_extract(u, '{URL}', 1) AS link, url_decode(replace(substr(regexp_extract(u, '{URL}', 2), 2), '+', ' ')) AS hash FROM urls WHERE regexp_matches(u, '{URL}')),
firsts AS (SELECT id, pos, link, min(kind * 1000000 + i) AS place FROM links GROUP BY ALL)"""
ALL_LINKS = f"{NOTES}, {CLEANED}, {LINKS}"
LINK_EDGES = "link_edges AS (SELECT DISTINCT f.id AS source, f.link AS target, 'link' AS type, NULL::VARCHAR AS tagName FROM firsts f WHERE f.link <> f.id AND f.link IN (SELECT id FROM notes))"


def tag_source(kind: str) -> str:
    """CTEs notes(id, title, pos), tags(id, title, ord) and note_tag(tag_id, note_id)."""
    pairs, prefix, notes = {
        "order": ("SELECT DISTINCT l_orderkey AS n, l_partkey AS t FROM lineitem", "part-", f"SELECT {hexed('o_orderkey')} AS id, 'Order ' || o_orderkey AS title, o_orderkey AS pos FROM orders"),
        "user": ("SELECT DISTINCT user_id AS n, strftime(ts, '%Y%m%d%H')::BIGINT AS t FROM events", "hour-", f"SELECT DISTINCT {hexed('user_id')} AS id, 'User ' || user_id AS title, user_id AS pos FROM events"),
        "part": ("SELECT DISTINCT l_partkey AS n, l_suppkey AS t FROM lineitem", "supplier-", f"SELECT DISTINCT {hexed('l_partkey')} AS id, 'Part ' || l_partkey AS title, l_partkey AS pos FROM lineitem"),
    }[kind]
    return f"""pairs AS ({pairs}), notes AS ({notes}),
tags AS (SELECT DISTINCT '{prefix}' || t AS id, '{prefix}' || t AS title, t AS ord FROM pairs),
note_tag AS (SELECT '{prefix}' || t AS tag_id, {hexed('n')} AS note_id FROM pairs),
occ AS (SELECT g.title AS tag, n.pos, row_number() OVER (PARTITION BY n.id ORDER BY g.ord, g.id) - 1 AS idx, n.id FROM note_tag b JOIN tags g ON g.id = b.tag_id JOIN notes n ON n.id = b.note_id)"""


#: From occ(tag, pos, idx, id) to tag_edges(source, target, type, tagName).
TAG_EDGES = """groups AS (SELECT tag, count(*) AS n, min((pos, idx)) AS seen FROM occ GROUP BY tag HAVING count(*) <= 20),
tag_pairs AS (SELECT g.tag, g.seen, a.id AS x, b.id AS y, (g.seen, (a.pos, a.idx), (b.pos, b.idx)) AS place FROM groups g JOIN occ a ON a.tag = g.tag JOIN occ b ON b.tag = g.tag AND (a.pos < b.pos OR (a.pos = b.pos AND a.idx < b.idx))),
tag_edges AS (SELECT arg_min(x, place) AS source, arg_min(y, place) AS target, 'tag' AS type, string_agg(tag, ', ' ORDER BY place) AS tagName FROM tag_pairs GROUP BY least(x, y), greatest(x, y))"""
#: The same of all tags, on however many notes.
EVERY_TAG = TAG_EDGES.replace(" HAVING count(*) <= 20", "")

MIXED = f"""{ALL_LINKS}, occ AS (
  SELECT 'low-' || (pos // 9) AS tag, pos, 0 AS idx, id FROM notes UNION ALL SELECT parent_id || '/' || (pos // 100), pos, 1, id FROM notes),
{TAG_EDGES}, {LINK_EDGES}, edges AS (SELECT * FROM link_edges UNION ALL SELECT * FROM tag_edges),
ends AS (SELECT source AS id, type FROM edges UNION ALL SELECT target, type FROM edges)"""
ORDERS = f"""{tag_source('order')}, {EVERY_TAG}, edges AS (SELECT * FROM tag_edges),
degree AS (SELECT id, count(*) AS d FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id),
nodes AS (SELECT n.id, n.title AS label, n.id AS noteId, coalesce(d, 0)::BIGINT AS degree FROM notes n LEFT JOIN degree USING (id))"""
LABEL = "CASE WHEN length(t) > 64 THEN substr(t, 1, 61) || '...' ELSE t END"
LABELS = f"labels AS (SELECT id, {LABEL} AS label FROM (SELECT id, coalesce(nullif(title, ''), '(untitled)') AS t FROM notes))"
DOCUMENTS = f"""{ALL_LINKS}, {LABELS}, {LINK_EDGES},
degree AS (SELECT id, count(*) AS d FROM (SELECT source AS id FROM link_edges UNION ALL SELECT target FROM link_edges) GROUP BY id),
nodes AS (SELECT id, label, id AS noteId, coalesce(d, 0)::BIGINT AS degree FROM labels LEFT JOIN degree USING (id))"""
INJECTED = f"""{NOTES}, {LABELS},
injected AS (SELECT id AS source, CASE WHEN pos % 3 = 0 THEN 'missing' ELSE {hexed(f'(pos * 7 + 3) % {TARGETS}')} END AS target, 'link' AS type FROM notes),
visible AS (SELECT * FROM injected WHERE target IN (SELECT id FROM notes)),
degree AS (SELECT id, count(*) AS d FROM (SELECT source AS id FROM injected UNION ALL SELECT target FROM injected) GROUP BY id),
nodes AS (SELECT id, label, id AS noteId, coalesce(d, 0)::BIGINT AS degree FROM labels LEFT JOIN degree USING (id)),
alone AS (SELECT * FROM nodes WHERE id NOT IN (SELECT source FROM visible UNION ALL SELECT target FROM visible))"""
FOCUS = f"""{DOCUMENTS}, start AS (SELECT id FROM nodes WHERE id IN ({', '.join(f"'{i:032x}'" for i in SELECTED)})),
both_ways AS (SELECT source AS a, target AS b FROM link_edges UNION ALL SELECT target, source FROM link_edges),
near AS (SELECT id FROM start UNION SELECT b FROM both_ways WHERE a IN (SELECT id FROM start)),
shown AS (SELECT id FROM near UNION SELECT b FROM both_ways WHERE a IN (SELECT id FROM near))"""
_URLS = f"""urls AS (SELECT doc_id, ([':/' || x, 'note://' || x || '#sec+two%21', 'https://example.com/' || x, ':/' || substr(x, 2, 31) || 'g', ':/' || x || ' "a title"', 'NOTE://' || x, ':/' || x || '#a b', ''])[(doc_id % 8) + 1] AS url FROM (SELECT doc_id, {hexed('doc_id')} AS x FROM documents))"""
_HEX = "lpad(lower(to_hex((doc_id * 7919 % 16777216)::BIGINT)), 6, '0')"
_CHANNEL = lambda at: f"('0x' || substr({_HEX}, {at}, 2))::INTEGER"


def _kind(k: int) -> str:
    return f"WITH {ALL_LINKS} SELECT id, link, hash FROM links WHERE kind = {k}"


#: The end-to-end graph: notes with links, tags by association in the order (length, name) on each note.
WHOLE = f"""{ALL_LINKS}, {LABELS}, named AS (
  SELECT id, pos, parent_id || '/' || (pos // 100) AS tag FROM notes WHERE parent_id IS NOT NULL UNION ALL SELECT id, pos, 'low-' || (pos // 9) FROM notes),
occ AS (SELECT tag, pos, row_number() OVER (PARTITION BY id ORDER BY length(tag), tag) - 1 AS idx, id FROM named),
{TAG_EDGES}, {LINK_EDGES}, edges AS (SELECT * FROM link_edges UNION ALL SELECT * FROM tag_edges),
degree AS (SELECT id, count(*) AS d FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id),
nodes AS (SELECT id, label, id AS noteId, coalesce(d, 0)::BIGINT AS degree FROM labels LEFT JOIN degree USING (id)),
start AS (SELECT id FROM nodes WHERE id IN ({', '.join(f"'{i:032x}'" for i in SELECTED)})),
both_ways AS (SELECT source AS a, target AS b FROM edges UNION ALL SELECT target, source FROM edges),
near AS (SELECT id FROM start UNION SELECT b FROM both_ways WHERE a IN (SELECT id FROM start)),
shown AS (SELECT id FROM near UNION SELECT b FROM both_ways WHERE a IN (SELECT id FROM near))"""
_STATS = "SELECT (SELECT count(*) FROM notes) AS notes, count(*) FILTER (type IN ('link', 'explicit')) AS explicit, count(*) FILTER (type = 'semantic') AS semantic, (SELECT count(DISTINCT p) FROM (SELECT unnest(string_split(tagName, ', ')) AS p FROM edges WHERE type = 'tag')) AS tags FROM edges"
TYPED = f"""{NOTES}, edges AS (SELECT id AS source, {hexed(f'(pos * 7 + 3) % {TARGETS}')} AS target, (['link', 'explicit', 'semantic', 'tag', 'other'])[(pos % 5) + 1] AS type,
  CASE WHEN pos % 5 = 3 THEN 't' || (pos % 13) || ', u' || (pos % 3) END AS tagName FROM notes),
ends AS (SELECT source AS id, type FROM edges UNION ALL SELECT target, type FROM edges)"""


def _document(nodes: str, edges: str) -> str:
    """The indented JSON document: objects two blanks a level, keys and values as the writer spells them."""
    q = lambda column: f"""'"' || {column} || '"'"""
    escaped = "replace(replace(replace(replace(replace(label, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34)), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't')"
    nl = "chr(10)"
    field = lambda name, value: f"""'      "{name}" : ' || {value}"""
    joined = lambda *fields: f" || ',' || {nl} || ".join(fields)
    obj = lambda body: f"""'{{' || {nl} || '    "data" : {{' || {nl} || {body} || {nl} || '    }}' || {nl} || '  }}'"""
    node = obj(joined(field("id", q("id")), field("label", q(escaped)), field("noteId", q('"noteId"')), field("degree", "degree")))
    edge = obj(joined(field("source", q("source")), field("target", q("target")), field("type", q("type"))))
    listed = lambda what, table, order: f"(SELECT string_agg({what}, ', ' ORDER BY {order}) FROM {table})"
    return f"""SELECT '{{' || {nl} || '  "nodes" : [ ' || {listed(node, nodes, 'id, label, "noteId", degree')} || ' ],' || {nl} || '  "edges" : [ ' || {listed(edge, edges, 'source, target')} || ' ]' || {nl} || '}}' AS document"""


#: Pages of a hundred numbers: the place of a note is that of its page and its own; the page after the first half fails.
PAGED = f"""{NOTES}, failing AS (SELECT (max(pos) // 100 + 1) // 2 + 1 AS page, count(*) AS n FROM notes),
paged AS (SELECT id, title, pos // 100 + 1 AS page, (pos // 100 + 1) * 1000000 + row_number() OVER (PARTITION BY pos // 100 ORDER BY pos) - 1 AS pos FROM notes)"""


def _paged_tags(read: str) -> str:
    """Titles by note of the associations that are ``read``: ten orders a page, a page of the tag in the middle fails."""
    return f"""WITH {tag_source('order')}, top AS (SELECT max(ord) // 2 AS failing FROM tags),
placed AS (SELECT g.ord, g.title, b.note_id, (row_number() OVER (PARTITION BY g.id ORDER BY b.note_id) - 1) // 10 + 1 AS page FROM note_tag b JOIN tags g ON g.id = b.tag_id),
got AS (SELECT * FROM placed, top WHERE {read})
SELECT note_id, count(*) AS n, md5(string_agg(title, ',' ORDER BY ord)) AS digest FROM got GROUP BY note_id"""


#: The mixed notes after the changes: links and tags of those that are as they were, and of those that changed or came.
FED = f"""{ALL_LINKS}, {LABELS}, gone AS (SELECT id FROM notes WHERE pos % 11 = 0 AND pos % 22 <> 0),
changed AS (SELECT id, pos, pos AS p, 5 AS k, 'moved-' || (pos // 20) AS tag FROM notes WHERE pos % 22 = 0 OR (pos % 7 = 3 AND pos % 11 <> 0)),
added AS (SELECT {hexed('pos + 10000000')} AS id, pos + 10000000 AS pos, pos AS p, 11 AS k, 'low-' || (pos // 9) AS tag FROM notes WHERE pos % 13 = 5),
moved AS (SELECT * FROM changed UNION ALL SELECT * FROM added),
same AS (SELECT id, pos, parent_id FROM notes WHERE id NOT IN (SELECT id FROM gone) AND id NOT IN (SELECT id FROM changed)),
present AS (SELECT s.id, l.label FROM same s JOIN labels l USING (id) UNION ALL SELECT id, 'Changed ' || p FROM moved),
raw_links AS (SELECT f.id AS source, f.link AS target FROM firsts f JOIN same USING (id) UNION SELECT id, {hexed(f'(pos * k + 3) % {TARGETS}')} FROM moved),
link_edges AS (SELECT source, target, 'link' AS type, NULL::VARCHAR AS tagName FROM raw_links WHERE source <> target AND target IN (SELECT id FROM present)),
occ AS (SELECT 'low-' || (pos // 9) AS tag, pos, 0 AS idx, id FROM same UNION ALL SELECT parent_id || '/' || (pos // 100), pos, 1, id FROM same UNION ALL SELECT tag, pos, 0, id FROM moved),
{TAG_EDGES}, edges AS (SELECT * FROM link_edges UNION ALL SELECT * FROM tag_edges),
degree AS (SELECT id, count(*) AS d FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id),
nodes AS (SELECT id, label, id AS noteId, coalesce(d, 0)::BIGINT AS degree FROM present LEFT JOIN degree USING (id))"""


#: By kind and line of LINES, in their order: what an import makes of them.
_REASONS = ("sound", "no id", "no label", "another note''s id", "no degree", "no element", "sound", "no end", "unknown type", "no tag name", "sound", "unknown kind", "no element")


#: All pairs of vectors.
SEMANTIC = f"""semantic AS (SELECT least(a.id, b.id) AS source, greatest(a.id, b.id) AS target, 'semantic' AS type, NULL::VARCHAR AS tagName FROM vectors a JOIN vectors b ON a.vec_id < b.vec_id AND list_cosine_similarity(a.v, b.v) >= {SIMILAR})"""
VECTORS = f"vectors AS (SELECT vec_id, {hexed('vec_id')} AS id, embedding::DOUBLE[] AS v FROM embeddings)"


ORACLE: dict[str, str] = {
    "semantic_edges": f"WITH {VECTORS}, {SEMANTIC} SELECT * FROM semantic",
    "semantic_graph_stats": f"""WITH {ALL_LINKS}, {LINK_EDGES}, {VECTORS}, {SEMANTIC}
        SELECT (SELECT count(*) FROM notes) AS notes, (SELECT count(*) FROM link_edges) AS explicit, (SELECT count(*) FROM semantic WHERE source IN (SELECT id FROM notes) AND target IN (SELECT id FROM notes)) AS semantic, 0::BIGINT AS tags""",
    "indexed_search": f"WITH {NOTES}, {LABELS}, asked AS (SELECT unnest([{', '.join(text(q) for q in PHRASES)}]) AS query) SELECT query, id, label FROM labels, asked WHERE contains(lower(label), lower(trim(query)))",
    "item_data": """WITH writes AS (SELECT user_id::VARCHAR AS item_id, event_type AS key, CASE WHEN event_id % 5 <> 0 THEN props END AS value, event_id % 5 = 0 AS deleted, ts, 'client' || (event_id % 3) AS client FROM events),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id, key ORDER BY ts DESC, client DESC, deleted DESC, value DESC NULLS LAST) AS r FROM writes WHERE item_id IS NOT NULL AND key IS NOT NULL AND ts IS NOT NULL)
        SELECT item_id, key, value, deleted, client FROM ranked WHERE r = 1""",
    "imported_nodes": f"WITH {DOCUMENTS} SELECT * FROM nodes",
    "imported_edges": f"WITH {DOCUMENTS} SELECT * FROM link_edges",
    "import_rejects": f"SELECT k.kind, k.reason, count(*) AS n FROM documents d JOIN (VALUES {', '.join(f"({i}, '{kind}', '{reason}')" for i, ((kind, _), reason) in enumerate(zip(LINES, _REASONS, strict=True)))}) k(i, kind, reason) ON k.i = d.doc_id % {len(LINES)} GROUP BY k.kind, k.reason",
    "feed_nodes": f"WITH {FED.replace(TAG_EDGES, EVERY_TAG)} SELECT * FROM nodes",
    "feed_edges": f"WITH {FED} SELECT * FROM edges",
    "paged_notes": f"WITH {PAGED} SELECT id, title, pos FROM paged",
    "paged_notes_partial": f"WITH {PAGED} SELECT id, title, pos FROM paged WHERE page < (SELECT page FROM failing)",
    "paged_scan_flags": f"""WITH {PAGED} SELECT s.* FROM (VALUES ('whole', false, NULL::BIGINT), ('one less', true, NULL), ('exact', false, NULL), ('one more', false, NULL)) s(scan, truncated, failed)
        UNION ALL SELECT 'partial', true, page FROM failing""",
    "paged_tag_map": _paged_tags("true"),
    "paged_tag_map_partial": _paged_tags("ord < failing OR (ord = failing AND page < 2) OR (SELECT count(*) FROM placed p WHERE p.ord = failing AND p.page = 2) = 0"),
    "url_predicate": f"WITH {_URLS} SELECT doc_id, regexp_matches(url, '{URL}') AS is_resource FROM urls",
    "url_parse": f"WITH {_URLS} SELECT doc_id, CASE WHEN regexp_matches(url, '{URL}') THEN regexp_extract(url, '{URL}', 1) END AS item_id, CASE WHEN regexp_matches(url, '{URL}') THEN url_decode(replace(substr(regexp_extract(url, '{URL}', 2), 2), '+', ' ')) END AS hash FROM urls",
    "code_strip": f"WITH {NOTES}, {CLEANED} SELECT id, md5(c) AS digest FROM cleaned",
    "links_inline": _kind(0),
    "links_reference": _kind(1),
    "links_html": _kind(2),
    "links_unique": f"WITH {ALL_LINKS} SELECT id, (row_number() OVER (PARTITION BY id ORDER BY place) - 1)::INTEGER AS nth, link FROM firsts",
    "links_in_pages": rf"SELECT count(*) AS pages, coalesce(sum(len(regexp_extract_all(html, ':/{{1,2}}[A-Fa-f0-9]{{32}}'))), 0)::BIGINT AS links FROM pages",
    "note_scan_limit": f"WITH {NOTES} SELECT id, parent_id, title, created_time, pos FROM notes ORDER BY pos LIMIT 150",
    "note_truncated": "SELECT b AS beyond, (SELECT count(*) FROM documents) > (SELECT count(*) FROM documents) + b AS truncated FROM (VALUES (-1::BIGINT), (0), (1)) v(b)",
    "missing_items": "SELECT count(*) AS notes, 0::BIGINT AS missing, false AS truncated FROM documents",
    "unwrapped_edges": f"WITH {TYPED} SELECT * FROM edges",
    "typed_node_stats": f"WITH {TYPED} SELECT id, count(*) FILTER (type IN ('link', 'explicit', 'semantic')) AS \"linkCount\", count(*) FILTER (type = 'tag') AS \"tagCount\" FROM ends GROUP BY id",
    "typed_graph_stats": f"WITH {TYPED} {_STATS}",
    "snapshot_nodes": f"WITH {WHOLE.replace(TAG_EDGES, EVERY_TAG)} SELECT * FROM nodes",
    "snapshot_edges": f"WITH {WHOLE} SELECT * FROM edges",
    "refreshed_nodes": f"WITH {DOCUMENTS} SELECT * FROM nodes",
    "snapshot_stats": f"WITH {WHOLE} {_STATS}",
    "snapshot_focus": f"WITH {WHOLE.replace(TAG_EDGES, EVERY_TAG)} SELECT * FROM nodes WHERE id IN (SELECT id FROM shown)",
    "snapshot_search": f"WITH {WHOLE} SELECT * FROM nodes WHERE contains(lower(label), '{SEARCHED.strip().lower()}')",
    "export_json": f"WITH {DOCUMENTS} {_document('nodes', 'link_edges')}",
    "tag_truncated": "SELECT b AS bound, (SELECT count(DISTINCT l_suppkey) FROM lineitem) >= b AS truncated FROM (VALUES (9::BIGINT), (10), (100000)) v(b)",
    "tag_scan_limit": f"WITH {tag_source('user')} SELECT id, title, ord FROM tags ORDER BY ord LIMIT 40",
    "note_tags": f"WITH {tag_source('user')} SELECT b.note_id, count(*) AS n, md5(string_agg(g.title, ',' ORDER BY g.ord)) AS digest FROM note_tag b JOIN tags g ON g.id = b.tag_id GROUP BY b.note_id",
    "enriched_notes": f"""WITH {ALL_LINKS}, u AS (SELECT {hexed('user_id')} AS id, count(DISTINCT strftime(ts, '%Y%m%d%H')) AS n, 'hour-' || min(strftime(ts, '%Y%m%d%H')::BIGINT) AS first_tag FROM events GROUP BY user_id),
        k AS (SELECT id, string_agg(link, ',' ORDER BY place) AS links FROM firsts GROUP BY id)
        SELECT n.id, n.parent_id, n.title, coalesce(k.links, '') AS links, coalesce(u.n, 0)::BIGINT AS n_tags, coalesce(u.first_tag, '') AS first_tag FROM notes n LEFT JOIN k USING (id) LEFT JOIN u USING (id)""",
    "link_edges": f"WITH {ALL_LINKS}, {LINK_EDGES} SELECT source, target, type FROM link_edges",
    "tag_edges": f"WITH {tag_source('order')}, {TAG_EDGES} SELECT * FROM tag_edges",
    "tag_edges_merged": f"WITH {tag_source('user')}, {TAG_EDGES} SELECT * FROM tag_edges",
    "tag_edges_cap_boundary": f"WITH {NOTES}, occ AS (SELECT (pos // 41) || CASE WHEN pos % 41 < 20 THEN 'a' ELSE 'b' END AS tag, pos, 0 AS idx, id FROM notes), {TAG_EDGES} SELECT * FROM tag_edges",
    "tag_edges_all_dropped": f"WITH {tag_source('part')}, {TAG_EDGES} SELECT * FROM tag_edges",
    "tag_self_loops": f"WITH {NOTES}, occ AS (SELECT 't' || (pos // 3) AS tag, pos, 0 AS idx, id FROM notes UNION ALL SELECT CASE WHEN pos % 3 = 0 THEN 't' || (pos // 3) ELSE 'common' END, pos, 1, id FROM notes), {TAG_EDGES} SELECT * FROM tag_edges",
    "all_edges": f"WITH {MIXED} SELECT * FROM edges",
    "node_labels": f"WITH {NOTES}, {LABELS} SELECT * FROM labels",
    "node_degree": f"WITH {MIXED} SELECT id, count(*) AS degree FROM ends GROUP BY id",
    "graph_nodes": f"WITH {ORDERS} SELECT * FROM nodes",
    "visible_edges_only": f"WITH {INJECTED} SELECT * FROM visible",
    "isolated": f"WITH {INJECTED} SELECT * FROM alone",
    "summary": f"WITH {INJECTED} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM visible) AS edges, (SELECT count(*) FROM alone) AS isolated, (SELECT greatest(1, max(degree)) FROM nodes)::BIGINT AS max_degree",
    "graph_stats": f"WITH {MIXED} SELECT (SELECT count(*) FROM notes) AS notes, count(*) FILTER (type = 'link') AS explicit, 0::BIGINT AS semantic, (SELECT count(DISTINCT p) FROM (SELECT unnest(string_split(tagName, ', ')) AS p FROM edges WHERE type = 'tag')) AS tags FROM edges",
    "graph_stats_empty": "SELECT 0::BIGINT AS notes, 0::BIGINT AS explicit, 0::BIGINT AS semantic, 0::BIGINT AS tags",
    "node_stats": f"WITH {MIXED} SELECT id, count(*) FILTER (type = 'link') AS \"linkCount\", count(*) FILTER (type = 'tag') AS \"tagCount\" FROM ends GROUP BY id",
    "node_hover": f"WITH {DOCUMENTS} SELECT id, replace(replace(replace(label, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS label, degree, degree AS \"linkCount\", 0::BIGINT AS \"tagCount\" FROM nodes",
    "search_nodes": f"WITH {DOCUMENTS} SELECT * FROM nodes WHERE contains(lower(label), '{SEARCHED.strip().lower()}')",
    "edge_toggle": f"WITH {MIXED} SELECT * FROM edges WHERE type <> 'link'",
    "edge_direction": f"WITH {MIXED} SELECT type, type <> 'tag' AS directed, count(*) AS n FROM edges GROUP BY type",
    "edge_hover": f"WITH {MIXED} SELECT source, target, tagName FROM edges WHERE type = 'tag' AND tagName <> ''",
    "focus_nodes": f"WITH {FOCUS} SELECT * FROM nodes WHERE id IN (SELECT id FROM shown)",
    "focus_edges": f"WITH {FOCUS} SELECT source, target, type FROM link_edges WHERE source IN (SELECT id FROM near) OR target IN (SELECT id FROM near)",
    "opened_note": f"WITH {NOTES} SELECT id, title, pos FROM notes WHERE pos = {OPENED}",
    "dark_themes": f"SELECT doc_id, 0.299 * {_CHANNEL(1)} + 0.587 * {_CHANNEL(3)} + 0.114 * {_CHANNEL(5)} < 128 AS dark FROM documents",
    "export_elements": f"""WITH {ORDERS} SELECT 'nodes' AS kind, '{{"data":{{"id":"' || id || '","label":"' || label || '","noteId":"' || noteId || '","degree":' || degree || '}}}}' AS element FROM nodes
        UNION ALL SELECT 'edges', '{{"data":{{"source":"' || source || '","target":"' || target || '","type":"tag","tagName":"' || tagName || '"}}}}' FROM edges""",
}
