import random

import pytest

from pagetrail.operators.dag import AnnotatedDag, LinkOrder, PathEnumerator
from pagetrail.operators.graph import LinkGraph, Residency
from pagetrail.operators.search import SearchStats, _local_dag, distances, shortest_path, shortest_path_dag
from tests.model import all_paths
from tests.model import distances as model_distances

EX1 = [(1, 2, None), (1, 3, None), (2, 1, None), (2, 3, None), (3, 1, None), (3, 2, None), (4, 1, None), (4, 5, "violets"), (5, 6, ""), (6, 3, None)]
EX1_TITLES = ["Red", "Green", "Blue", "Rose", "Violet (flower)", "Violet (color)"]
EX2 = {1: [2, 4], 2: [1, 3, 4, 5], 3: [2, 5], 4: [6], 5: [7, 8], 6: [4, 9], 7: [8, 10], 8: [7, 10], 9: [11, 12, 13], 10: [12, 13], 11: [14, 15], 12: [15], 13: [14, 15], 14: [15], 15: [14]}
EX2_TITLES = "A1 A2 A3 B1 B2 C1 C2 C3 D1 D2 E1 E2 E3 F1 F2".split()
EX2_DAG = [(2, 4), (2, 5), (4, 6), (5, 7), (5, 8), (6, 9), (7, 10), (8, 10), (9, 11), (9, 12), (9, 13), (10, 12), (10, 13), (11, 15), (12, 15), (13, 15)]
EX3 = [(1, 2, None), (1, 3, None), (1, 4, None), (2, 5, "x"), (2, 6, "y"), (3, 5, "y"), (3, 6, "x"), (4, 5, "x"), (4, 6, "y"), (5, 7, None), (6, 7, None), (7, 1, None)]
EX3_TITLES = ["Start", "C", "A", "B", "G", "H", "Finish"]


def make(spark, links, titles):
    pages = spark.createDataFrame(list(enumerate(titles, 1)), "page_id bigint, title string")
    return LinkGraph(pages, spark.createDataFrame(links, "from_page_id bigint, to_page_id bigint, title string"))


@pytest.fixture(scope="module")
def ex1(spark):
    return make(spark, EX1, EX1_TITLES)


@pytest.fixture(scope="module")
def ex2(spark):
    return make(spark, [(v, w, None) for v, ws in EX2.items() for w in ws] + [(12, 12, None)], EX2_TITLES)


@pytest.fixture(scope="module")
def ex3(spark):
    return make(spark, EX3, EX3_TITLES)


def counters(stats: SearchStats):
    return stats.vertices_reached, stats.vertices_expanded, stats.edges_expanded


@pytest.mark.parametrize("rows", [0, 1000])
def test_classic_paths(ex1, rows):
    near = ex1.adjacency()
    assert shortest_path(near, 5, 2, rows)[0] == [5, 6, 3, 2]
    assert shortest_path(near, 4, 4, rows) == ([4], SearchStats(1, 0, 0, 0))
    assert shortest_path(near, 4, 1, rows)[0] == [4, 1]
    path, stats = shortest_path(near, 4, 2, rows)
    assert (path, counters(stats)) == ([4, 1, 2], (4, 2, 3))
    path, stats = shortest_path(near, 1, 4, rows)
    assert (path, counters(stats)) == ([], (4, 2, 2))


@pytest.mark.parametrize("rows", [0, 1000])
def test_dag(ex2, rows):
    near = ex2.adjacency()
    dag, stats = shortest_path_dag(near, 2, 15, local_rows=rows)
    assert sorted((r.src, r.dst) for r in dag.edges.collect()) == EX2_DAG
    assert counters(stats) == (15, 11, 26)
    assert dag.length == 5
    none, stats = shortest_path_dag(near, 15, 2, local_rows=rows)
    assert none is None and counters(stats) == (3, 2, 2)
    same, stats = shortest_path_dag(near, 3, 3, local_rows=rows)
    assert same.edges.count() == 0 and counters(stats) == (1, 0, 0)
    assert shortest_path_dag(near, 2, 15, max_depth=4, local_rows=rows)[0] is None
    assert shortest_path_dag(near, 2, 15, max_depth=5, local_rows=rows)[0] is not None


def test_repeated_links_count_once(spark):
    rows = [(1, 2, None), (1, 2, "x"), (2, 3, None), (2, 3, ""), (1, 1, None), (None, 2, None), (3, 4, "y"), (2, 4, None), (2, 4, None)]
    g = make(spark, rows, list("abcd"))
    near = g.adjacency()
    assert near.repeats and [r.dst for r in g.forward(2).collect()] == [3, 4] and [r.src for r in g.backward(2).collect()] == [1]
    for rows in (0, 1000):
        path, stats = shortest_path(near, 1, 4, rows)
        assert (path, counters(stats)) == ([1, 2, 4], (4, 2, 3)), (rows, path, stats)
        got = distances(near, spark.createDataFrame([(1,)], "start bigint"), local_rows=rows).collect()
        assert sorted((r.page_id, r.distance) for r in got) == [(1, 0), (2, 1), (3, 2), (4, 2)]


def test_a_search_that_outgrows_the_driver_goes_on_as_joins(ex2):
    assert shortest_path(ex2.adjacency(), 2, 15, local_rows=3)[0] == shortest_path(ex2.adjacency(), 2, 15)[0]


@pytest.mark.parametrize(("length", "found"), [(253, True), (254, False)])
def test_depth_of_the_dag(length, found):
    def look(ahead, fringe):
        return {v: [w] if 0 <= (w := v + 1 if ahead else v - 1) <= length else [] for v in fringe}

    edges, size, *_ = _local_dag(look, 0, length, 253)
    assert (edges is not None) == found and (not found or (size == length and [e[:2] for e in edges] == [(i, i + 1) for i in range(length)]))


def test_counts_lookups_and_references(ex1):
    assert (ex1.vertex_count(), ex1.edge_count()) == (7, 10)
    assert [r.dst for r in ex1.forward(1).collect()] == [2, 3]
    assert [r.src for r in ex1.backward(1).collect()] == [2, 3, 4]
    assert ex1.page_by_id(4).title == "Rose" and ex1.page_by_id(99) is None
    assert ex1.page_by_title("Rose").id == 4 and ex1.page_by_title("rose") is None
    assert ex1.link(4, 5).title == "violets" and ex1.link(5, 6).title == "" and ex1.link(4, 1).title is None and ex1.link(4, 6) is None
    refs = {(r.src, r.dst): r for r in ex1.references(ex1.edges).collect()}
    assert [refs[k].text for k in ((4, 1), (4, 5), (5, 6))] == ["Red", "violets", "Violet"]
    assert refs[4, 5].forward_ref == "#5 (Violet (flower); displayed as: violets)"
    assert refs[5, 6].backward_ref == "#5 (Violet (flower); displayed as: Violet)"
    missing = ex1.annotated(ex1.spark.createDataFrame([(1, 4), (1, 77)], "src bigint, dst bigint")).orderBy("dst").collect()
    assert [r.text for r in missing] == ["unknown", "unknown"] and missing[1].dst_title == "untitled"
    assert [r.ref for r in ex1.inspect(6).orderBy("part", "place").collect()] == ["#5 (Violet (flower); displayed as: Violet)", "#3 (Blue)", "#6 (Violet (color))"]


def test_resolving(ex1):
    assert [ex1.resolve(a) for a in ("", "Rose", "#4", "# 4", "#7", "#0", "#x", "Nobody")] == [0, 4, 4, 4, 0, 0, 0, 0]
    assert ex1.resolve("?", seed=1) in (1, 2, 3, 5, 6)
    with pytest.raises(IndexError):
        ex1.check(7)


@pytest.mark.parametrize("residency", list(Residency))
def test_residency(spark, residency):
    pages = spark.createDataFrame([(1, "a"), (2, "b")], "page_id bigint, title string")
    links = spark.createDataFrame([(1, 2, None)], "from_page_id bigint, to_page_id bigint, title string")
    assert LinkGraph(pages, links, residency).edge_count() == 1


def test_saving(spark, ex1, tmp_path):
    ex1.save(str(tmp_path / "g"))
    again = LinkGraph.open(spark, str(tmp_path / "g"))
    assert sorted(again.edges.collect()) == sorted(ex1.edges.collect())
    near = again.adjacency()
    assert near.sorted and sorted(near.backward.collect()) == sorted((r.dst, r.src) for r in ex1.edges.collect())
    assert shortest_path(near, 5, 2)[0] == shortest_path(near, 5, 2, 0)[0] == [5, 6, 3, 2]
    with pytest.raises(Exception, match="(?i)exists"):
        ex1.save(str(tmp_path / "g"))


def _titles(dag, order):
    steps = dag.paths(order=order).orderBy("rank").collect()
    return ["-".join(EX3_TITLES[v - 1] for v in r.path[1:-1]) for r in steps]


def test_orders(ex3):
    dag = AnnotatedDag(ex3, shortest_path_dag(ex3.adjacency(), 1, 7)[0])
    assert dag.count_paths() == 6
    assert _titles(dag, LinkOrder.ID) == "C-G C-H A-G A-H B-G B-H".split()
    assert _titles(dag, LinkOrder.TITLE) == "A-G A-H B-G B-H C-G C-H".split()
    assert _titles(dag, LinkOrder.TEXT) == "A-H A-G B-G B-H C-G C-H".split()
    assert [r.ref for r in dag.page_links(3, LinkOrder.TEXT).orderBy("place").collect()] == ["#6 (H; displayed as: x)", "#5 (G; displayed as: y)"]


def test_pages_of_paths(ex2):
    dag = AnnotatedDag(ex2, shortest_path_dag(ex2.adjacency(), 2, 15)[0])
    every = [r.path for r in dag.paths().orderBy("rank").collect()]
    assert every == all_paths(EX2, 2, 15) and len(every) == dag.count_paths() == 7
    for skip, most in ((2, 2), (5, 9), (7, 1), (-1, 1), (0, 0), (0, -1), (3, 1), (6, 5)):
        got = dag.paths(skip, most).orderBy("rank").collect()
        assert [r.path for r in got] == every[max(0, skip) : max(0, skip) + max(0, most)]
        assert [r["rank"] for r in got] == list(range(max(0, skip), max(0, skip) + len(got)))
    cursor = PathEnumerator(dag, 1, page=2)
    first = next(cursor)
    copy = cursor.copy()
    cursor.advance(1)
    assert [first, next(copy), next(cursor)] == [every[1], every[2], every[4]]
    assert list(PathEnumerator(dag, 5)) == every[5:]
    assert dag.random_path(seed=3).first().path in every
    steps = dag.path_steps(1, 1).orderBy("step").collect()
    assert [steps[0].src] + [s.dst for s in steps] == every[1]


def test_start_is_finish(ex2):
    dag = AnnotatedDag(ex2, shortest_path_dag(ex2.adjacency(), 3, 3)[0])
    assert dag.count_paths() == 1 and [r.path for r in dag.paths().collect()] == [[3]]
    assert dag.paths(1).count() == 0
    assert [r.line for r in dag.dot_lines().orderBy("place").collect()] == ["digraph dag {", "}"]


def test_dot_and_lines(ex3):
    dag = AnnotatedDag(ex3, shortest_path_dag(ex3.adjacency(), 3, 7)[0])
    assert [r.line for r in dag.dot_lines().orderBy("place").collect()] == [
        "digraph dag {", '3 [label="A"];', '5 [label="G"];', '3 -> 5 [label="y"];', '6 [label="H"];', '3 -> 6 [label="x"];',
        '7 [label="Finish"];', "5 -> 7;", "6 -> 7;", "}",
    ]
    assert dag.edge_lines().orderBy("src", "dst").first().line == "#3 (A) -> #5 (G; displayed as: y)"


def test_random_graphs(spark):
    rng = random.Random(5)
    for _ in range(2):
        n = 12
        edges = {(rng.randint(1, n), rng.randint(1, n)) for _ in range(26)}
        out: dict = {}
        for v, w in sorted(edges):
            if v != w:
                out.setdefault(v, []).append(w)
        g = make(spark, [(v, w, None) for v, w in edges], [f"p{i}" for i in range(1, n + 1)])
        near = g.adjacency()
        got = distances(g.edges, spark.createDataFrame([(1,), (2,)], "start bigint")).collect()
        want = {(s, v): d for s in (1, 2) for v, d in model_distances(out, s).items()}
        assert {(r.start, r.page_id): r.distance for r in got} == want
        got = distances(g.edges, spark.createDataFrame([(1,), (2,), (None,)], "start bigint"), local_rows=0).collect()
        assert {(r.start, r.page_id): r.distance for r in got} == want
        for s, f in ((1, 5), (2, 9)):
            paths = all_paths(out, s, f)
            a, b = shortest_path(near, s, f, 0), shortest_path(near, s, f)
            assert a[0] == b[0] and counters(a[1]) == counters(b[1]) and (a[0] in paths if paths else a[0] == [])
            x, y = shortest_path_dag(near, s, f, local_rows=0), shortest_path_dag(near, s, f)
            assert counters(x[1]) == counters(y[1])
            want = {(p[i], p[i + 1], i) for p in paths for i in range(len(p) - 1)}
            for dag in (x[0], y[0]):
                assert (set(map(tuple, dag.edges.collect())) if dag else set()) == want
            if y[0]:
                assert [r.path for r in AnnotatedDag(g, y[0]).paths().orderBy("rank").collect()] == paths
