"""Queries of the core engine over the link-graph tables, with SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetrail.functions import wikitext as W
from pagetrail.operators import heavy_keys
from pagetrail.operators.dag import AnnotatedDag, LinkOrder
from pagetrail.operators.graph import LinkGraph
from pagetrail.operators.ingest import Ingest, inclusion, with_links
from pagetrail.operators.search import LOCAL_ROWS, distances, shortest_path, shortest_path_dag
from pagetrail.plans.scratch import Scratch
from pagetrail.sources.graph_file import read_graph, write_graph
from pagetrail.sources.metadata_db import read_metadata, write_metadata
from pagetrail.sources.wiki_xml import read_dump, tag_statistics

#: The pair of pages that the search queries join, and the steps that the SQL of their path DAG takes.
START, FINISH, STEPS = 88, 21, 12


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def graph(spark: SparkSession, sf: str) -> LinkGraph:
    return LinkGraph(_t(spark, sf, "pages"), _t(spark, sf, "links"))


def _dag(spark: SparkSession, sf: str, local_rows: int = LOCAL_ROWS) -> AnnotatedDag:
    g = graph(spark, sf)
    dag, _ = shortest_path_dag(g.adjacency(), START, FINISH, local_rows=local_rows)
    if dag is None:
        raise ValueError(f"no path from {START} to {FINISH}")
    return AnnotatedDag(g, dag)


# -- graph and references -----------------------------------------------------------------------------


def vertex_edge_count(spark, sf):
    return graph(spark, sf).counts()


def degree_in_out(spark, sf):
    return graph(spark, sf).degrees()


def dangling_pages(spark, sf):
    return graph(spark, sf).degrees().filter("out_degree = 0 OR in_degree = 0").select("page_id")


def forward_edges(spark, sf):
    return graph(spark, sf).forward(START)


def backward_edges(spark, sf):
    return graph(spark, sf).backward(START)


def reversed_edges(spark, sf):
    return graph(spark, sf).reversed_edges()


def inspect_page(spark, sf):
    return graph(spark, sf).inspect(START)


def page_by_id(spark, sf):
    return _t(spark, sf, "pages").filter(F.col("page_id") == START)


def page_by_title(spark, sf):
    return _t(spark, sf, "pages").filter(F.col("title") == "Atlas of places")


def valid_page_ids(spark, sf):
    g = graph(spark, sf)
    top = g.vertex_count()
    asked = _t(spark, sf, "core_pages").select(F.explode(F.array(F.col("page_id"), -F.col("page_id"), F.col("page_id") * 100)).alias("page_id"))
    return asked.select("page_id", ((F.col("page_id") > 0) & (F.col("page_id") < top)).alias("valid"))


def link_lookup(spark, sf):
    return graph(spark, sf).links.filter(F.col("from_page_id") == START)


def first_occurrence_links(spark, sf):
    return graph(spark, sf).links


def page_ref(spark, sf):
    return _t(spark, sf, "pages").select("page_id", W.page_ref(F.col("page_id"), F.col("title")).alias("ref"))


def link_text(spark, sf):
    g = graph(spark, sf)
    return g.annotated(g.edges).select("src", "dst", "text")


def link_refs(spark, sf):
    g = graph(spark, sf)
    return g.references(g.edges).select("src", "dst", "forward_ref", "backward_ref")


def pipe_trick(spark, sf):
    return _t(spark, sf, "pages").select("page_id", W.pipe_trick(F.col("title")).alias("shown"))


def first_upper(spark, sf):
    lowered = F.concat(F.lower(F.substring("title", 1, 1)), F.expr("substring(title, 2)"))
    return _t(spark, sf, "pages").select("page_id", W.first_upper(lowered).alias("title"))


def ns_parse(spark, sf):
    return _t(spark, sf, "raw_pages").select("raw_id", W.namespace_number(F.col("ns")).alias("ns_number"))


def wiki_url(spark, sf):
    return _t(spark, sf, "pages").select("page_id", W.wiki_url("https://wiki.example/", F.col("title")).alias("url"))


def dot_quote(spark, sf):
    return _t(spark, sf, "pages").select("page_id", W.dot_quote(F.concat(F.lit('"'), "title")).alias("quoted"))


def format_count(spark, sf):
    return _t(spark, sf, "pages").select("page_id", F.format_number(F.col("page_id") * 1000, 0).alias("shown"))


def resolve_targets(spark, sf):
    """Targets of parsed links as page ids: an inner join on the exact title."""
    pages = _t(spark, sf, "pages")
    links = _t(spark, sf, "parsed_links").filter("target IS NOT NULL AND target <> ''")
    return links.join(pages, links.target == pages.title).select("link_id", "page_id")


def dangling_targets(spark, sf):
    pages = _t(spark, sf, "pages")
    links = _t(spark, sf, "parsed_links").filter("target IS NOT NULL AND target <> ''")
    return links.join(pages, links.target == pages.title, "left_anti").select("link_id", "target")


# -- ingest ----------------------------------------------------------------------------------------------


def _ingest(spark, sf):
    return Ingest(_t(spark, sf, "raw_pages"), ["raw_id"])


def include_filter_counts(spark, sf):
    raw = _t(spark, sf, "raw_pages")
    why = inclusion(F.col("title"), F.col("ns"), F.col("redirect._title"))
    return raw.groupBy(F.coalesce(why, F.lit("included")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def ingest_pages(spark, sf):
    return _ingest(spark, sf).pages


def ingest_links(spark, sf):
    return _ingest(spark, sf).links


def ingest_counts(spark, sf):
    return _ingest(spark, sf).counts()


def extract_links(spark, sf):
    text = _t(spark, sf, "raw_pages").select("raw_id", W.page_text(F.col("revision")).alias("text"))
    return with_links(text).select("raw_id", F.explode("links").alias("l")).select("raw_id", "l.place", "l.target", "l.anchor", "l.title")


def duplicate_titles(spark, sf):
    raw = _t(spark, sf, "raw_pages").filter("title <> ''")
    return raw.groupBy("title").agg(F.count(F.lit(1)).alias("n"), F.min("raw_id").alias("first_raw_id")).filter("n > 1")


# -- exchange ------------------------------------------------------------------------------------------------


def _folder(spark: SparkSession) -> str:
    """A new folder for files that one process writes; it has to be mounted where it is read."""
    path = Scratch(spark).base.removeprefix("file://")
    os.makedirs(path)
    return path


def dump_records(spark, sf):
    """The records of raw_pages, written as an XML dump and read again."""
    path = f"{Scratch(spark).base}/dump"
    raw = _t(spark, sf, "raw_pages").select("title", "ns", "redirect", "revision")
    raw.write.format("xml").option("rootTag", "mediawiki").option("rowTag", "page").save(path)
    read = read_dump(spark, path)
    return read.select(
        F.coalesce("title", F.lit("")).alias("title"), F.coalesce("ns", F.lit("")).alias("ns"), F.coalesce("redirect._title", F.lit("")).alias("redirect"),
        F.coalesce(W.page_text(F.col("revision")), F.lit("")).alias("text"),
    )


def dump_tags(spark, sf):
    """How often each element occurs in such a dump."""
    path = f"{_folder(spark)}/dump"
    raw = _t(spark, sf, "raw_pages").select("title", "ns", "redirect", "revision")
    raw.write.format("xml").option("rootTag", "mediawiki").option("rowTag", "page").save(path)
    return tag_statistics(spark, sorted(str(p) for p in Path(path).glob("part-*"))).filter("path IN ('/mediawiki/page', '/mediawiki/page/title')")


def graph_file_edges(spark, sf):
    g = graph(spark, sf)
    path = f"{_folder(spark)}/links.graph"
    write_graph(g.edges, g.vertex_count(), path)
    return read_graph(spark, path)


def metadata_file_links(spark, sf):
    g = graph(spark, sf)
    path = f"{_folder(spark)}/links.metadata"
    write_metadata(g.pages, g.links, path)
    return read_metadata(spark, path, "links")


def saved_graph_edges(spark, sf):
    """The backward order of a saved and opened graph, turned round."""
    path = f"{Scratch(spark).base}/graph"
    graph(spark, sf).save(path)
    return LinkGraph.open(spark, path).adjacency().backward.select(F.col("w").alias("src"), F.col("v").alias("dst"))


# -- search -----------------------------------------------------------------------------------------------


def bfs_layers(spark, sf):
    start = spark.range(1).select(F.lit(START).cast("bigint").alias("start"))
    return distances(graph(spark, sf).adjacency(), start).groupBy("distance").agg(F.count(F.lit(1)).alias("n"))


def distance_from_page(spark, sf):
    start = spark.range(1).select(F.lit(START).cast("bigint").alias("start"))
    return distances(graph(spark, sf).adjacency(), start).select("page_id", "distance")


def distance_from_page_joined(spark, sf):
    start = spark.range(1).select(F.lit(START).cast("bigint").alias("start"))
    return distances(graph(spark, sf).adjacency(), start, local_rows=0).select("page_id", "distance")


def distance_pairs(spark, sf):
    """Distances from the index pages to the hub pages, all searches in one loop."""
    core = _t(spark, sf, "core_pages")
    found = distances(graph(spark, sf).adjacency(), core.filter("role = 'index'").select(F.col("page_id").alias("start")))
    hubs = core.filter("role = 'hub'").select("page_id")
    return found.join(hubs, "page_id", "left_semi").select("start", "page_id", "distance")


def classic_path(spark, sf):
    path, _ = shortest_path(graph(spark, sf).adjacency(), START, FINISH)
    return spark.createDataFrame([(i, p) for i, p in enumerate(path)], "step int, page_id bigint")


def classic_path_links(spark, sf):
    """How many steps the path has, and how many of them are links."""
    g = graph(spark, sf)
    path, _ = shortest_path(g.adjacency(), START, FINISH)
    steps = spark.createDataFrame(list(zip(path, path[1:])), "src bigint, dst bigint")
    return steps.join(g.edges, ["src", "dst"]).agg(F.lit(len(path) - 1).cast("bigint").alias("steps"), F.count(F.lit(1)).alias("links"))


def classic_distance(spark, sf):
    path, _ = shortest_path(graph(spark, sf).adjacency(), START, FINISH)
    return spark.createDataFrame([(len(path) - 1,)], "distance int")


def search_stats(spark, sf):
    return _stats(spark, sf, LOCAL_ROWS)


def _stats(spark, sf, local_rows):
    edges = graph(spark, sf).adjacency()
    _, one = shortest_path(edges, START, FINISH, local_rows)
    _, all_ = shortest_path_dag(edges, START, FINISH, local_rows=local_rows)
    rows = [(n, s.vertices_reached, s.vertices_expanded, s.edges_expanded) for n, s in (("path", one), ("dag", all_))]
    return spark.createDataFrame(rows, "search string, vertices_reached bigint, vertices_expanded bigint, edges_expanded bigint")


def dag_edges(spark, sf):
    return _dag(spark, sf).dag.edges.select("src", "dst", "layer")


def count_paths(spark, sf):
    d = _dag(spark, sf)
    return spark.createDataFrame([(d.count_paths(),)], "n_paths bigint")


def path_counts(spark, sf):
    return _dag(spark, sf).path_counts()


def search_stats_joined(spark, sf):
    """The counters of both searches as joins."""
    return _stats(spark, sf, 0)


def classic_distance_joined(spark, sf):
    path, _ = shortest_path(graph(spark, sf).adjacency(), START, FINISH, 0)
    return spark.createDataFrame([(len(path) - 1,)], "distance int")


def dag_edges_joined(spark, sf):
    """The path DAG by joins alone, as for a search that outgrows the driver."""
    return _dag(spark, sf, 0).dag.edges.select("src", "dst", "layer")


def count_paths_joined(spark, sf):
    return spark.createDataFrame([(_dag(spark, sf, 0).count_paths(),)], "n_paths bigint")


def path_counts_joined(spark, sf):
    return _dag(spark, sf, 0).path_counts()


def paths_by_id_joined(spark, sf):
    return _dag(spark, sf, 0).paths(0, None, LinkOrder.ID).select("rank", F.array_join("path", ">").alias("path"))


def paths_by_id(spark, sf):
    return _paths(spark, sf, LinkOrder.ID)


def paths_by_title(spark, sf):
    return _paths(spark, sf, LinkOrder.TITLE)


def paths_by_text(spark, sf):
    return _paths(spark, sf, LinkOrder.TEXT)


def _paths(spark, sf, order, skip=0, maximum=None):
    return _dag(spark, sf).paths(skip, maximum, order).select("rank", F.array_join("path", ">").alias("path"))


def paths_page(spark, sf):
    return _paths(spark, sf, LinkOrder.ID, 1, 5)


def first_path(spark, sf):
    return _paths(spark, sf, LinkOrder.TITLE, 0, 1)


def path_steps(spark, sf):
    return _dag(spark, sf).path_steps(0, 3).select("rank", "step", "src", "dst", "ref")


def random_path(spark, sf):
    return _dag(spark, sf).random_path(seed=1).select("rank", F.array_join("path", ">").alias("path"))


def random_page(spark, sf):
    return spark.createDataFrame([(graph(spark, sf).random_page_id(seed=1),)], "page_id bigint")


def dag_page_links(spark, sf):
    return _dag(spark, sf).page_links(START, LinkOrder.TITLE).drop("dst_title")


def dag_edge_lines(spark, sf):
    return _dag(spark, sf).edge_lines()


def dag_dot(spark, sf):
    return _dag(spark, sf).dot_lines().select("line")


# -- heavy keys ---------------------------------------------------------------------------------------------


def p3_found(spark, sf):
    return heavy_keys.heavy_keys(_t(spark, sf, "links"))


def p3_degrees(spark, sf):
    return heavy_keys.key_degrees(_t(spark, sf, "links"))


def p3_neighbours(spark, sf):
    chunks = heavy_keys.neighbour_chunks(_t(spark, sf, "links"))
    places = chunks.select("side", "page_id", "first_place", F.posexplode("neighbours").alias("at", "neighbour_id"))
    return places.select("side", "page_id", (F.col("first_place") + F.col("at")).alias("place"), "neighbour_id")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return dag_edges(spark, sf)


_QUERIES = (
    vertex_edge_count, degree_in_out, dangling_pages, forward_edges, backward_edges, reversed_edges, inspect_page, page_by_id, page_by_title,
    valid_page_ids, link_lookup, first_occurrence_links, page_ref, link_text, link_refs, pipe_trick, first_upper, ns_parse, wiki_url, dot_quote,
    format_count, resolve_targets, dangling_targets, include_filter_counts, ingest_pages, ingest_links, ingest_counts, extract_links,
    duplicate_titles, dump_records, dump_tags, graph_file_edges, metadata_file_links, saved_graph_edges, bfs_layers, distance_from_page, distance_pairs, classic_path, classic_path_links, classic_distance, search_stats, dag_edges, count_paths,
    path_counts, paths_by_id, paths_by_title, paths_by_text, paths_page, first_path, path_steps, random_path, random_page, dag_page_links,
    dag_edge_lines, dag_dot, distance_from_page_joined, search_stats_joined, classic_distance_joined, dag_edges_joined, count_paths_joined, path_counts_joined, paths_by_id_joined, p3_found, p3_degrees, p3_neighbours,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


# -- SQL ---------------------------------------------------------------------------------------------------------

_SPACE = r"[ \t\n\x0B\f\r]"
_LINKS = """l AS (SELECT from_page_id, to_page_id, title FROM (SELECT *, row_number() OVER (PARTITION BY from_page_id, to_page_id
  ORDER BY seen_at NULLS LAST, title NULLS FIRST) AS n FROM links WHERE from_page_id <> to_page_id) WHERE n = 1),
e AS (SELECT from_page_id AS src, to_page_id AS dst FROM l)"""


def _pipe(x: str) -> str:
    rest = rf"(CASE WHEN strpos(substr({x}, 2), ':') > 0 THEN substr({x}, strpos(substr({x}, 2), ':') + 2) ELSE regexp_replace({x}, '^:', '') END)"
    return rf"trim(CASE WHEN strpos({rest}, '(') > 0 THEN regexp_replace({rest}, '\([^(]*$', '', 's') ELSE regexp_replace({rest}, ',.*$', '', 's') END, E' \t\n\x0b\x0c\r')"


_TEXT = f"CASE WHEN l.title IS NULL THEN q.title WHEN l.title = '' THEN {_pipe('q.title')} ELSE l.title END"
_NAMED = f"a AS (SELECT l.from_page_id AS src, l.to_page_id AS dst, p.title AS src_title, q.title AS dst_title, {_TEXT} AS text FROM l JOIN pages p ON p.page_id = l.from_page_id JOIN pages q ON q.page_id = l.to_page_id)"
_SHOWN = "CASE WHEN text <> dst_title THEN '; displayed as: ' || text ELSE '' END || ')'"
_FORWARD, _BACKWARD = f"'#' || dst || ' (' || dst_title || {_SHOWN}", f"'#' || src || ' (' || src_title || {_SHOWN}"
_BFS = f"""d AS (SELECT {START}::BIGINT AS page_id, 0 AS distance UNION SELECT e.dst, d.distance + 1 FROM d JOIN e ON e.src = d.page_id WHERE d.distance < {{steps}}),
m AS (SELECT page_id, min(distance) AS distance FROM d GROUP BY page_id)"""
#: Without a bound on the steps: a page that has been reached stays as it is.
_FAR = f"""d(page_id, distance) USING KEY (page_id) AS (SELECT {START}::BIGINT, 0
  UNION SELECT DISTINCT e.dst, d.distance + 1 FROM d JOIN e ON e.src = d.page_id LEFT JOIN recurring.d AS r ON r.page_id = e.dst WHERE r.page_id IS NULL)"""
_DAG = f"""{_BFS.format(steps=STEPS)},
b AS (SELECT {FINISH}::BIGINT AS page_id, 0 AS distance UNION SELECT e.src, b.distance + 1 FROM b JOIN e ON e.dst = b.page_id WHERE b.distance < {STEPS}),
f AS (SELECT page_id, min(distance) AS distance FROM b GROUP BY page_id),
g AS (SELECT e.src, e.dst, m.distance AS layer FROM e JOIN m ON m.page_id = e.src JOIN f ON f.page_id = e.dst WHERE m.distance + 1 + f.distance = (SELECT distance FROM m WHERE page_id = {FINISH}))"""
_COUNT = f"""c AS (SELECT {FINISH}::BIGINT AS v, {FINISH}::BIGINT AS w UNION ALL SELECT g.src, c.w FROM c JOIN g ON g.dst = c.v)"""


def _kept(encoded: str) -> str:
    """Takes back the escapes of the characters that an address may hold as they are."""
    for ch in ";,/?:@&=+$!*'()#":
        encoded = f"replace({encoded}, '%{ord(ch):02X}', '{ch.replace(chr(39), chr(39) * 2)}')"
    return encoded


def _walk(key: str) -> str:
    return f"""o AS (SELECT g.src, g.dst, row_number() OVER (PARTITION BY g.src ORDER BY {key}) AS k FROM g JOIN a USING (src, dst)),
w AS (SELECT {START}::BIGINT AS v, '{START}' AS path, CAST([] AS BIGINT[]) AS ks UNION ALL SELECT o.dst, w.path || '>' || o.dst, list_append(w.ks, o.k) FROM w JOIN o ON o.src = w.v),
r AS (SELECT row_number() OVER (ORDER BY ks) - 1 AS rank, path FROM w WHERE v = {FINISH})"""


def _paths_sql(key: str, more: str = "") -> str:
    return f"WITH RECURSIVE {_LINKS}, {_NAMED}, {_DAG}, {_walk(key)} SELECT rank, path FROM r {more}"


_OUTCOME = """CASE WHEN coalesce(title, '') = '' THEN 'title' WHEN coalesce(redirect._title, '') <> '' THEN 'redirect'
  WHEN coalesce(ns, '') <> '' AND NOT regexp_full_match(ns, '[ \\t\\n\\x0B\\f\\r]*[+-]?[0-9]+') THEN 'ns'
  WHEN coalesce(ns, '') <> '' AND CAST(trim(ns) AS BIGINT) <> 0 THEN 'namespace' ELSE 'included' END"""


# The marks of a text one after the other, with a stack of the open ones; a link reaches from an open mark to the closing one.
_EXTRACTED = r"""m AS (SELECT raw_id, string_split_regex(t, '\[\[|\]\]') AS p, regexp_extract_all(t, '\[\[|\]\]') AS k
  FROM (SELECT raw_id, coalesce(array_to_string([y.text FOR y IN revision], ''), '') AS t FROM raw_pages) WHERE contains(t, '[[')),
s AS (SELECT raw_id, 0 AS n, CAST([] AS BIGINT[]) AS opened, NULL::BIGINT AS a FROM m
  UNION ALL SELECT s.raw_id, s.n + 1, CASE WHEN m.k[s.n + 1] = '[[' THEN list_append(s.opened, s.n + 1) ELSE s.opened[:-2] END,
    CASE WHEN m.k[s.n + 1] = ']]' THEN s.opened[-1] END FROM s JOIN m USING (raw_id) WHERE s.n < len(m.k)),
c AS (SELECT raw_id, row_number() OVER (PARTITION BY raw_id ORDER BY s.n) - 1 AS place,
  regexp_replace(array_to_string([m.p[j] || CASE WHEN j < s.n THEN m.k[j] ELSE '' END FOR j IN range(s.a + 1, s.n + 1)], ''), '^:', '') AS body
  FROM s JOIN m USING (raw_id) WHERE a IS NOT NULL),
h AS (SELECT raw_id, place, CASE WHEN strpos(body, '|') > 0 THEN substr(body, 1, strpos(body, '|') - 1) ELSE body END AS head,
  CASE WHEN strpos(body, '|') > 0 THEN substr(body, strpos(body, '|') + 1) END AS title FROM c),
g AS (SELECT raw_id, place, title, CASE WHEN strpos(head, '#') > 0 THEN substr(head, 1, strpos(head, '#') - 1) ELSE head END AS target,
  CASE WHEN strpos(head, '#') > 0 THEN substr(head, strpos(head, '#') + 1) END AS anchor FROM h),
x AS (SELECT raw_id, place, CASE WHEN regexp_matches(target, '^[a-z]') THEN upper(target[1]) || target[2:] ELSE target END AS target, anchor, title FROM g)"""
_INDEXED = f"""i AS (SELECT row_number() OVER (ORDER BY raw_id) AS page_id, title, raw_id FROM (SELECT title, min(raw_id) AS raw_id FROM raw_pages WHERE {_OUTCOME} = 'included' GROUP BY title)),
w AS (SELECT i.page_id, x.target, arg_min({{'t': x.title}}, x.place).t AS title FROM x JOIN i USING (raw_id) WHERE x.target <> '' AND x.target <> i.title GROUP BY ALL),
v AS (SELECT w.page_id AS from_page_id, i.page_id AS to_page_id, w.title FROM w JOIN i ON i.title = w.target)"""


def oracle_sql() -> dict[str, str]:
    both = "(SELECT 'from' AS side, from_page_id AS page_id, to_page_id AS n FROM links UNION ALL SELECT 'to', to_page_id, from_page_id FROM links)"
    sql = {
        "vertex_edge_count": f"WITH {_LINKS} SELECT (SELECT max(page_id) + 1 FROM pages) AS vertex_count, (SELECT count(*) FROM pages) AS page_count, (SELECT count(*) FROM e) AS edge_count",
        "degree_in_out": f"WITH {_LINKS} SELECT page_id, (SELECT count(*) FROM e WHERE src = page_id) AS out_degree, (SELECT count(*) FROM e WHERE dst = page_id) AS in_degree FROM pages",
        "dangling_pages": f"WITH {_LINKS} SELECT page_id FROM pages WHERE page_id NOT IN (SELECT src FROM e) OR page_id NOT IN (SELECT dst FROM e)",
        "forward_edges": f"WITH {_LINKS} SELECT dst FROM e WHERE src = {START}",
        "backward_edges": f"WITH {_LINKS} SELECT src FROM e WHERE dst = {START}",
        "reversed_edges": f"WITH {_LINKS} SELECT dst AS src, src AS dst FROM e",
        "inspect_page": f"""WITH {_LINKS}, {_NAMED} SELECT 'page' AS part, 0::BIGINT AS place, '#' || page_id || ' (' || title || ')' AS ref FROM pages WHERE page_id = {START}
          UNION ALL SELECT 'out', dst, {_FORWARD} FROM a WHERE src = {START} UNION ALL SELECT 'in', src, {_BACKWARD} FROM a WHERE dst = {START}""",
        "page_by_id": f"SELECT page_id, title FROM pages WHERE page_id = {START}",
        "page_by_title": "SELECT page_id, title FROM pages WHERE title = 'Atlas of places'",
        "valid_page_ids": "SELECT p AS page_id, p > 0 AND p <= (SELECT max(page_id) FROM pages) AS valid FROM (SELECT unnest([page_id, -page_id, page_id * 100]) AS p FROM core_pages)",
        "link_lookup": f"WITH {_LINKS} SELECT * FROM l WHERE from_page_id = {START}",
        "first_occurrence_links": f"WITH {_LINKS} SELECT * FROM l",
        "page_ref": "SELECT page_id, '#' || page_id || ' (' || title || ')' AS ref FROM pages",
        "link_text": f"WITH {_LINKS}, {_NAMED} SELECT src, dst, text FROM a",
        "link_refs": f"WITH {_LINKS}, {_NAMED} SELECT src, dst, {_FORWARD} AS forward_ref, {_BACKWARD} AS backward_ref FROM a",
        "pipe_trick": f"SELECT page_id, {_pipe('title')} AS shown FROM pages",
        "first_upper": "SELECT page_id, CASE WHEN regexp_matches(t, '^[a-z]') THEN upper(t[1]) || t[2:] ELSE t END AS title FROM (SELECT page_id, lower(title[1]) || title[2:] AS t FROM pages)",
        "ns_parse": r"SELECT raw_id, CASE WHEN coalesce(ns, '') = '' THEN 0 WHEN regexp_full_match(ns, '[ \t\n\x0B\f\r]*[+-]?[0-9]+') THEN TRY_CAST(trim(ns) AS BIGINT) END AS ns_number FROM raw_pages",
        "wiki_url": f"SELECT page_id, 'https://wiki.example/' || {_kept('url_encode(title)')} AS url FROM pages",
        "dot_quote": """SELECT page_id, '"' || replace('"' || title, '"', '\\"') || '"' AS quoted FROM pages""",
        "format_count": "SELECT page_id, format('{:,}', page_id * 1000) AS shown FROM pages",
        "resolve_targets": "SELECT link_id, page_id FROM parsed_links JOIN pages ON target = pages.title WHERE target <> ''",
        "dangling_targets": "SELECT link_id, target FROM parsed_links WHERE target <> '' AND target NOT IN (SELECT title FROM pages)",
        "include_filter_counts": f"SELECT {_OUTCOME} AS outcome, count(*) AS n FROM raw_pages GROUP BY 1",
        "ingest_pages": f"SELECT row_number() OVER (ORDER BY raw_id) AS page_id, title FROM (SELECT title, min(raw_id) AS raw_id FROM raw_pages WHERE {_OUTCOME} = 'included' GROUP BY title)",
        "duplicate_titles": "SELECT title, count(*) AS n, min(raw_id) AS first_raw_id FROM raw_pages WHERE title <> '' GROUP BY title HAVING count(*) > 1",
        "bfs_layers": f"WITH RECURSIVE {_LINKS}, {_FAR} SELECT distance, count(*) AS n FROM d GROUP BY 1",
        "distance_from_page": f"WITH RECURSIVE {_LINKS}, {_FAR} SELECT page_id, distance FROM d",
        "distance_pairs": f"""WITH RECURSIVE {_LINKS}, d(start, page_id, distance) USING KEY (start, page_id) AS (SELECT page_id, page_id, 0 FROM core_pages WHERE role = 'index'
          UNION SELECT DISTINCT d.start, e.dst, d.distance + 1 FROM d JOIN e ON e.src = d.page_id LEFT JOIN recurring.d AS r ON r.start = d.start AND r.page_id = e.dst WHERE r.page_id IS NULL)
          SELECT start, page_id, distance FROM d WHERE page_id IN (SELECT page_id FROM core_pages WHERE role = 'hub')""",
        "classic_distance": f"WITH RECURSIVE {_LINKS}, {_BFS.format(steps=STEPS)} SELECT distance FROM m WHERE page_id = {FINISH}",
        "dag_edges": f"WITH RECURSIVE {_LINKS}, {_DAG} SELECT src, dst, layer FROM g",
        "count_paths": f"WITH RECURSIVE {_LINKS}, {_DAG}, {_COUNT} SELECT count(*) AS n_paths FROM c WHERE v = {START}",
        "path_counts": f"WITH RECURSIVE {_LINKS}, {_DAG}, {_COUNT} SELECT v AS page_id, count(*) AS n_paths FROM c GROUP BY 1",
        "paths_by_id": _paths_sql("g.dst"),
        "paths_by_title": _paths_sql("dst_title, g.dst"),
        "paths_by_text": _paths_sql("text, g.dst"),
        "paths_page": _paths_sql("g.dst", "WHERE rank BETWEEN 1 AND 5"),
        "first_path": _paths_sql("dst_title, g.dst", "WHERE rank = 0"),
        "dag_page_links": f"WITH RECURSIVE {_LINKS}, {_NAMED}, {_DAG} SELECT (row_number() OVER (ORDER BY dst_title, dst) - 1)::INT AS place, src, dst, text, {_FORWARD} AS ref FROM g JOIN a USING (src, dst) WHERE src = {START}",
        "dag_edge_lines": f"WITH RECURSIVE {_LINKS}, {_NAMED}, {_DAG} SELECT src, dst, '#' || src || ' (' || src_title || ') -> ' || {_FORWARD} AS line FROM g JOIN a USING (src, dst)",
        "p3_found": f"SELECT side, page_id FROM {both} WHERE page_id IS NOT NULL GROUP BY ALL HAVING count(*) * 50 >= (SELECT count(*) FROM links)",
        "p3_degrees": f"SELECT side, page_id, count(*) AS n_rows, count(DISTINCT n) AS n_neighbours FROM {both} WHERE page_id IS NOT NULL GROUP BY ALL",
        "p3_neighbours": f"SELECT side, page_id, row_number() OVER (PARTITION BY side, page_id ORDER BY n) - 1 AS place, n AS neighbour_id FROM (SELECT DISTINCT * FROM {both} WHERE page_id IS NOT NULL AND n IS NOT NULL)",
    }
    sql |= {f"{name}_joined": sql[name] for name in ("distance_from_page", "classic_distance", "dag_edges", "count_paths", "path_counts", "paths_by_id")}
    sql["dump_records"] = """SELECT coalesce(title, '') AS title, coalesce(ns, '') AS ns, coalesce(redirect._title, '') AS redirect,
      coalesce(array_to_string([y.text FOR y IN revision], ''), '') AS text FROM raw_pages"""
    sql["dump_tags"] = """SELECT '/mediawiki/page' AS path, count(*) AS "count" FROM raw_pages UNION ALL SELECT '/mediawiki/page/title', count(title) FROM raw_pages"""
    sql |= {name: f"WITH {_LINKS} SELECT src, dst FROM e" for name in ("graph_file_edges", "saved_graph_edges")}
    sql["metadata_file_links"] = f"WITH {_LINKS} SELECT * FROM l"
    sql["classic_path_links"] = f"WITH RECURSIVE {_LINKS}, {_BFS.format(steps=STEPS)} SELECT distance::BIGINT AS steps, distance::BIGINT AS links FROM m WHERE page_id = {FINISH}"
    sql["extract_links"] = f"WITH RECURSIVE {_EXTRACTED} SELECT raw_id, place::INT AS place, target, anchor, title FROM x"
    sql["ingest_links"] = f"WITH RECURSIVE {_EXTRACTED}, {_INDEXED} SELECT from_page_id, to_page_id, title FROM v"
    sql["ingest_counts"] = f"""WITH RECURSIVE {_EXTRACTED}, {_INDEXED} SELECT (SELECT count(*) FROM i) AS included_pages,
      (SELECT count(*) FROM raw_pages WHERE {_OUTCOME} IN ('title', 'redirect', 'namespace')) AS excluded_pages,
      (SELECT count(*) FROM i JOIN x USING (raw_id)) AS total_links, (SELECT count(*) FROM v) AS unique_valid_links"""
    quoted = """'"' || replace({}, '"', '\\"') || '"'"""
    sql["dag_dot"] = f"""WITH RECURSIVE {_LINKS}, {_NAMED}, {_DAG}, x AS (SELECT a.* FROM g JOIN a USING (src, dst))
      SELECT DISTINCT v || ' [label=' || {quoted.format('t')} || '];' AS line FROM (SELECT src AS v, src_title AS t FROM x UNION SELECT dst, dst_title FROM x)
      UNION ALL SELECT src || ' -> ' || dst || CASE WHEN text <> dst_title THEN ' [label=' || {quoted.format('text')} || ']' ELSE '' END || ';' FROM x
      UNION ALL SELECT 'digraph dag {{' UNION ALL SELECT '}}'"""
    sql["path_steps"] = f"""WITH RECURSIVE {_LINKS}, {_NAMED}, {_DAG}, {_walk('g.dst')},
      s AS (SELECT rank, string_split(path, '>') AS p FROM r WHERE rank < 3), t AS (SELECT rank, p, unnest(range(len(p) - 1)) AS step FROM s)
      SELECT rank, step::INT AS step, src, dst, {_FORWARD} AS ref FROM (SELECT rank, step, p[step + 1]::BIGINT AS src, p[step + 2]::BIGINT AS dst FROM t) JOIN a USING (src, dst)"""
    return sql
