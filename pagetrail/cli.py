"""Command line: index a dump, search and inspect a graph, count XML tags, serve.

  python -m pagetrail.cli index DUMP.xml GRAPH      (a folder, or NAME.graph for a binary file with NAME.metadata beside it)
  python -m pagetrail.cli search GRAPH START FINISH [count|path|paths|edges|dot] [--random] [--skip N] [--max N] [--order id|title|text] [--enumerate recursive|iterative]
  python -m pagetrail.cli inspect GRAPH PAGE
  python -m pagetrail.cli xml-stats FILE...
  python -m pagetrail.cli serve GRAPH [--host H] [--port N] [--static FOLDER] [--base-url URL]
"""

from __future__ import annotations

import argparse
import os
import random
import sys
from itertools import islice

from pyspark.sql import SparkSession

from pagetrail.api import LinkOrder, Reader
from pagetrail.operators.graph import LinkGraph, metadata_beside
from pagetrail.operators.ingest import Ingest
from pagetrail.operators.search import shortest_path
from pagetrail.plans.session import local_session
from pagetrail.sources.graph_file import write_graph
from pagetrail.sources.metadata_db import write_metadata
from pagetrail.sources.wiki_xml import read_dump, tag_statistics


def _natural(text: str) -> int:
    value = int(text)
    if value < 0:
        raise argparse.ArgumentTypeError("must not be negative")
    return value


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="pagetrail")
    commands = parser.add_subparsers(dest="command", required=True)
    index = commands.add_parser("index")
    index.add_argument("dump")
    index.add_argument("graph")
    search = commands.add_parser("search")
    search.add_argument("graph")
    search.add_argument("start")
    search.add_argument("finish")
    search.add_argument("output", nargs="?", choices=("count", "path", "paths", "edges", "dot"))
    search.add_argument("--random", action="store_true")
    search.add_argument("--skip", type=_natural)
    search.add_argument("--max", type=_natural)
    search.add_argument("--order", choices=("id", "title", "text"))
    search.add_argument("--enumerate", choices=("recursive", "iterative"), help="list all paths in one go, or fetch them with a cursor; the output is the same")
    inspect = commands.add_parser("inspect")
    inspect.add_argument("graph")
    inspect.add_argument("page")
    stats = commands.add_parser("xml-stats")
    stats.add_argument("files", nargs="+")
    serving = commands.add_parser("serve")
    serving.add_argument("graph")
    serving.add_argument("--host", default="127.0.0.1")
    serving.add_argument("--port", type=int, default=8001)
    serving.add_argument("--static")
    serving.add_argument("--base-url", default="https://en.wikipedia.org/wiki/")
    return parser


def _open(spark: SparkSession, path: str) -> LinkGraph:
    """A saved graph, or a binary graph file with its metadata file."""
    return LinkGraph.open_files(spark, path) if os.path.isfile(path) else LinkGraph.open(spark, path)


def _search(spark: SparkSession, a: argparse.Namespace) -> int:
    for name, outputs in (("random", ("path",)), ("skip", ("paths",)), ("max", ("paths",)), ("order", ("path", "paths")), ("enumerate", ("path", "paths"))):
        if getattr(a, name) not in (None, False) and a.output not in outputs:
            print(f"--{name} goes with {' or '.join(outputs)} only", file=sys.stderr)
            return 2
    graph = _open(spark, a.graph)
    reader = Reader(graph)
    start, finish = reader.parse_page_argument(a.start), reader.parse_page_argument(a.finish)
    if not (start and finish):
        print(f"Page not found: {a.finish if start else a.start}", file=sys.stderr)
        return 1
    order = LinkOrder(a.order or "id")
    if a.output is None:
        path, stats = shortest_path(graph.adjacency(), start, finish)
        for i, page in enumerate(path):
            print(reader.forward_link_ref(path[i - 1], page) if i else reader.page_ref(page))
        if not path:
            print("No path found!", file=sys.stderr)
    else:
        dag, stats = reader.shortest_path_annotated_dag_with_stats(start, finish)
        listed = lambda most, skip: islice(dag.path_enumerator(skip, order), most) if a.enumerate == "iterative" else dag.iterate(most, skip, order)
        if a.output == "count":
            print(dag.count_paths() if dag else 0)
        elif dag is None:
            if a.output in ("path", "dot"):
                print("No path found!", file=sys.stderr)
        elif a.output == "edges":
            for row in dag.frame.edge_lines().orderBy("src", "dst").toLocalIterator():
                print(row.line)
        elif a.output == "dot":
            for row in dag.frame.dot_lines().orderBy("place").toLocalIterator():
                print(row.line)
        elif a.output == "path":
            skip = 0
            if a.random:
                skip = random.randrange(dag.count_paths())
                print(f"Randomly selected path {skip + 1} of {dag.count_paths()}.", file=sys.stderr)
            for path in listed(1, skip):
                print("\n".join([dag.start.ref, *map(str, path)]))
        else:
            for path in listed(a.max, a.skip or 0):
                print(" -> ".join([dag.start.ref, *map(str, path)]))
    print(f"Search time: {stats.time_taken_ms} ms", f"Vertices reached: {stats.vertices_reached}", f"Vertices expanded: {stats.vertices_expanded}", f"Edges expanded: {stats.edges_expanded}", sep="\n", file=sys.stderr)
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _parser().parse_args(argv)
    spark = spark or local_session()
    if a.command == "index":
        pair = [a.graph, metadata_beside(a.graph)] if a.graph.endswith(".graph") else [a.graph]
        for path in pair:
            if os.path.exists(path):
                print(f"{path} exists", file=sys.stderr)
                return 1
        ingest = Ingest(read_dump(spark, a.dump), ["file", "place"])
        graph = ingest.graph()
        if len(pair) == 2:
            write_graph(graph.edges, graph.vertex_count(), pair[0])
            write_metadata(graph.pages, graph.links, pair[1])
        else:
            graph.save(a.graph)
        c = ingest.counts().first()
        print(f"Included pages: {c.included_pages}", f"Excluded pages: {c.excluded_pages}", f"Total links: {c.total_links}", f"Unique valid links: {c.unique_valid_links}", sep="\n")
    elif a.command == "search":
        return _search(spark, a)
    elif a.command == "inspect":
        graph = _open(spark, a.graph)
        page = graph.resolve(a.page)
        if not page:
            print(f"Page not found: {a.page}", file=sys.stderr)
            return 1
        parts = graph.inspect(page)
        for part, title in (("page", "Page:"), ("out", "Outgoing links:"), ("in", "Incoming links:")):
            print(title)
            for row in parts.filter(f"part = '{part}'").orderBy("place").toLocalIterator():
                print(f"  {row.ref}")
    elif a.command == "xml-stats":
        for row in tag_statistics(spark, a.files).orderBy("path").toLocalIterator():
            print(f"{row.path}: {row['count']}")
    else:
        from pagetrail.server import Service, serve

        serve(Service(_open(spark, a.graph), os.path.basename(a.graph.rstrip("/")), a.base_url, a.static or os.path.join(os.path.dirname(__file__), "web")), a.host, a.port)
    return 0


if __name__ == "__main__":
    sys.exit(main())
