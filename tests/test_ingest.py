import json
import urllib.error
import urllib.request

import pytest

from pagetrail import cli
from pagetrail.operators.graph import LinkGraph
from pagetrail.operators.ingest import Ingest
from pagetrail.server import Service, serve
from pagetrail.sources.graph_file import header, read_graph, write_graph
from pagetrail.sources.metadata_db import read_metadata, write_metadata
from pagetrail.sources.wiki_xml import read_dump, tag_statistics

PAGES = [
    ("Category:Flowers", "14", None, ["x"]),
    ("Oak", "0", None, ["An oak is near a [[pine]] and [[Oak]]. [[Category:Trees]] [[#top]]"]),
    ("Pine", None, None, ["See [[Oak|the oak]], [[Oak|again]] ", "and [[elm (tree)|]]."]),
    ("Fir", "0", "Pine", ["#REDIRECT [[Pine]]"]),
    ("Elm (tree)", " 0", None, ["[[File:E.jpg|[[Oak]] ]] [[Fir]] &amp; [[Pine"]),
    ("Oak", "0", None, ["second [[Pine]]"]),
    ("Ash", "0 ", None, ["[[Oak]]"]),
]


@pytest.fixture(scope="module")
def dump(tmp_path_factory):
    path = tmp_path_factory.mktemp("dump") / "trees.xml"
    parts = []
    for title, ns, redirect, texts in PAGES:
        body = "".join(f"<revision><text>{t}</text></revision>" for t in texts)
        parts.append(f"<page><title>{title}</title>" + (f"<ns>{ns}</ns>" if ns is not None else "") + (f'<redirect title="{redirect}" />' if redirect else "") + body + "</page>")
    path.write_text('<mediawiki xmlns="http://x/"><siteinfo><a/></siteinfo>\n' + "\n".join(parts) + "</mediawiki>")
    return str(path)


@pytest.fixture(scope="module")
def ingest(spark, dump):
    return Ingest(read_dump(spark, dump), ["file", "place"])


def test_pages_links_counts(ingest):
    assert [tuple(r) for r in ingest.pages.orderBy("page_id").collect()] == [(1, "Oak"), (2, "Pine"), (3, "Elm (tree)")]
    assert sorted(map(tuple, ingest.links.collect())) == [(1, 2, None), (2, 1, "the oak"), (2, 3, ""), (3, 1, None)]
    assert tuple(ingest.counts().first()) == (3, 2, 10, 4)


def test_no_records(spark, dump):
    empty = Ingest(read_dump(spark, dump).filter("title = 'none'"), ["file", "place"])
    assert empty.pages.count() == 0 and tuple(empty.counts().first()) == (0, 0, 0, 0)


def test_exchange_files(spark, ingest, tmp_path):
    graph = ingest.graph()
    path = str(tmp_path / "trees.graph")
    write_graph(graph.edges, graph.vertex_count(), path)
    assert header(path) == (4, 4)
    assert sorted(read_graph(spark, path, 3).collect()) == sorted(graph.edges.collect())
    with pytest.raises(FileExistsError):
        write_graph(graph.edges, 4, path)
    (tmp_path / "bad").write_bytes(b"x" * 16)
    with pytest.raises(ValueError):
        header(str(tmp_path / "bad"))
    db = str(tmp_path / "trees.metadata")
    write_metadata(graph.pages, graph.links, db)
    assert sorted(read_metadata(spark, db, "pages").collect()) == sorted(graph.pages.collect())
    assert sorted(map(tuple, read_metadata(spark, db, "links").collect()), key=str) == sorted(map(tuple, graph.links.collect()), key=str)


def test_tag_statistics(spark, dump):
    counts = {r.path: r["count"] for r in tag_statistics(spark, [dump, dump]).collect()}
    assert counts["/mediawiki/page"] == 14 and counts["/mediawiki/page/revision/text"] == 16 and counts["/mediawiki/siteinfo/a"] == 2


def no_path(spark, folder):
    path = folder / "apart"
    if not path.exists():
        pages = spark.createDataFrame([(1, "a"), (2, "b")], "page_id bigint, title string")
        LinkGraph(pages, spark.createDataFrame([(2, 1, None)], "from_page_id bigint, to_page_id bigint, title string")).save(str(path))
    return str(path)


def run(spark, capsys, *argv):
    code = cli.main(list(argv), spark)
    out = capsys.readouterr()
    return code, out.out.splitlines(), out.err


def test_commands(spark, dump, tmp_path, capsys):
    graph = str(tmp_path / "g")
    code, out, _ = run(spark, capsys, "index", dump, graph)
    assert code == 0 and out == ["Included pages: 3", "Excluded pages: 2", "Total links: 10", "Unique valid links: 4"]
    assert run(spark, capsys, "index", dump, graph)[0] == 1
    assert run(spark, capsys, "search", graph, "Elm (tree)", "Pine")[1] == ["#3 (Elm (tree))", "#1 (Oak)", "#2 (Pine)"]
    assert run(spark, capsys, "search", graph, "Oak", "#3", "paths")[1] == ["#1 (Oak) -> #2 (Pine) -> #3 (Elm (tree); displayed as: Elm)"]
    assert run(spark, capsys, "search", graph, "Oak", "#3", "path", "--random")[1][0] == "#1 (Oak)"
    assert run(spark, capsys, "search", graph, "Oak", "#3", "count")[1] == ["1"]
    assert run(spark, capsys, "search", graph, "Oak", "#3", "edges")[1][0] == "#1 (Oak) -> #2 (Pine)"
    assert run(spark, capsys, "search", graph, "Oak", "#3", "dot")[1][0] == "digraph dag {"
    assert run(spark, capsys, "search", graph, "Oak", "Nobody", "count")[0] == 1
    assert run(spark, capsys, "search", graph, "Oak", "#3", "count", "--skip=1")[0] == 2
    assert run(spark, capsys, "search", graph, "Oak", "#3", "paths", "--enumerate=iterative")[1] == ["#1 (Oak) -> #2 (Pine) -> #3 (Elm (tree); displayed as: Elm)"]
    assert run(spark, capsys, "search", graph, "Oak", "#3", "count", "--enumerate=iterative")[0] == 2
    pair = str(tmp_path / "trees.graph")
    assert run(spark, capsys, "index", dump, pair)[0] == 0 and run(spark, capsys, "index", dump, pair)[0] == 1
    assert run(spark, capsys, "search", pair, "Elm (tree)", "Pine")[1] == ["#3 (Elm (tree))", "#1 (Oak)", "#2 (Pine)"]
    for output, shown in (("count", ["0"]), ("paths", []), ("edges", [])):
        assert run(spark, capsys, "search", no_path(spark, tmp_path), "#1", "#2", output)[:2] == (0, shown)
    for output in ("path", "dot"):
        code, out, err = run(spark, capsys, "search", no_path(spark, tmp_path), "#1", "#2", output)
        assert (code, out) == (0, []) and "No path found!" in err
    assert "Outgoing links:" in run(spark, capsys, "inspect", graph, "Oak")[1]
    assert run(spark, capsys, "xml-stats", dump)[1][0] == "/mediawiki: 1"


def get(port, path, method="GET"):
    try:
        with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{port}{path}", method=method)) as r:
            return r.status, r.read()
    except urllib.error.HTTPError as e:
        return e.code, e.read()


def test_service(ingest, tmp_path):
    (tmp_path / "index.html").write_text("<p>hello")
    server = serve(Service(LinkGraph(ingest.pages, ingest.links, clean=True), "trees", "https://w/", str(tmp_path)), port=0, background=True)
    port = server.server_address[1]
    try:
        assert json.loads(get(port, "/api/corpus")[1]) == {"corpus": {"base_url": "https://w/", "graph_filename": "trees", "vertex_count": 4, "edge_count": 4}}
        assert json.loads(get(port, "/api/page?page=Oak")[1]) == {"page": {"id": 1, "title": "Oak"}}
        assert get(port, "/api/page?page=Nobody") == (404, b'{"error": {"message": "Page not found."}}')
        status, body = get(port, "/api/shortest-path?start=Pine&finish=%231")
        assert status == 200 and json.loads(body)["path"] == [{"page": {"id": 2, "title": "Pine"}}, {"page": {"id": 1, "title": "Oak"}, "displayed_as": "the oak"}]
        assert json.loads(get(port, "/api/shortest-path?start=Oak&finish=Oak")[1])["stats"]["vertices_reached"] == 1
        assert get(port, "/api/shortest-path?start=Oak&finish=x")[0] == 404
        assert [get(port, f"/api/page?{q}") for q in ("", "page=a&page=b", "page=%239", "page=%23x")] == [
            (400, b"Missing page argument"), (400, b"Multiple page arguments"), (400, b"Page id out of range"), (400, b"Invalid page id")]
        assert get(port, "/api/page?page=Oak", "HEAD") == (200, b"")
        assert get(port, "/") == (200, b"<p>hello") and get(port, "/../x")[0] == 404
        assert get(port, "/api/corpus", "POST")[0] == 405
    finally:
        server.shutdown()
