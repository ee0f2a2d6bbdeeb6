"""Path counts where they pass 64 bits."""

import pandas as pd

from pagetrail.operators.dag import AnnotatedDag
from pagetrail.operators.graph import LinkGraph
from pagetrail.operators.search import PathDag


def test_an_overflowed_successor_makes_a_count_null(spark):
    wide, depth = 160, 9  # 160^9 is beyond 2^63, 160^8 is not
    at = lambda layer, k: 1000 * layer + k
    edges = [(1, at(1, 0), 0), (1, 2, 0), (2, at(2, 0), 1), (2, at(2, 1), 1)]
    edges += [(at(d, i), at(d + 1, j), d) for d in range(1, depth + 1) for i in range(wide if d > 1 else 1) for j in range(wide)]
    edges += [(at(depth + 1, i), 99, depth + 1) for i in range(wide)]
    shape = "src bigint, dst bigint, layer int"
    graph = LinkGraph(spark.createDataFrame([(1, "a")], "page_id bigint, title string"), spark.createDataFrame([(1, 2, None)], "from_page_id bigint, to_page_id bigint, title string"))
    rows = spark.createDataFrame(pd.DataFrame(edges, columns=["src", "dst", "layer"]), shape)
    got = {r.page_id: r.n_paths for r in AnnotatedDag(graph, PathDag(rows, 1, 99, depth + 2)).path_counts().filter("page_id in (1, 2, 99, 1000, 2000)").collect()}
    assert got == {99: 1, 2000: wide ** (depth - 1), 2: 2 * wide ** (depth - 1), 1000: None, 1: None}
