"""A reader over an opened graph: searches, lookups and references as plain Python values."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import functions as F

from pagetrail.operators import dag as dag_frames
from pagetrail.operators.dag import LinkOrder
from pagetrail.operators.graph import Link, LinkGraph, Page, quoted
from pagetrail.operators.search import SearchStats, shortest_path, shortest_path_dag

__all__ = ["AnnotatedDag", "AnnotatedLink", "AnnotatedPage", "GraphReader", "Link", "LinkOrder", "MetadataReader", "Page", "PathEnumerator", "Reader", "SearchStats"]


@dataclass(frozen=True)
class AnnotatedPage:
    """A page of an annotated path DAG."""

    dag: AnnotatedDag = field(compare=False, repr=False)
    id: int = 0
    title: str = ""

    @property
    def ref(self) -> str:
        return f"#{self.id} ({self.title})"

    def links(self, order: LinkOrder = LinkOrder.ID) -> list[AnnotatedLink]:
        """The links of this page that lie on shortest paths, in order."""
        rows = self.dag.frame.page_links(self.id, order).orderBy("place").collect()  # one row a link of this page
        return [AnnotatedLink(self, AnnotatedPage(self.dag, r.dst, r.dst_title), r.text) for r in rows]

    def __str__(self) -> str:
        return self.ref

    def __repr__(self) -> str:
        return f"pagetrail.AnnotatedPage(id={self.id}, title={quoted(self.title)})"


@dataclass(frozen=True)
class AnnotatedLink:
    """A link of an annotated path DAG."""

    src: AnnotatedPage
    dst: AnnotatedPage
    text: str

    def _ref(self, page: AnnotatedPage) -> str:
        return f"#{page.id} ({page.title}" + (f"; displayed as: {self.text})" if self.text != self.dst.title else ")")

    @property
    def forward_ref(self) -> str:
        return self._ref(self.dst)

    @property
    def backward_ref(self) -> str:
        return self._ref(self.src)

    def __str__(self) -> str:
        return self.forward_ref

    def __repr__(self) -> str:
        return f"pagetrail.AnnotatedLink(src={self.src!r}, dst={self.dst!r}, text={quoted(self.text)})"


class AnnotatedDag:
    """All shortest paths between two pages as plain values; ``frame`` has them as DataFrames."""

    def __init__(self, frame: dag_frames.AnnotatedDag):
        self.frame = frame
        ids = {frame.dag.start, frame.dag.finish}
        titles = {r.page_id: r.title for r in frame.graph.pages.filter(F.col("page_id").isin(list(ids))).collect()}
        self.start, self.finish = (AnnotatedPage(self, i, titles.get(i, "untitled")) for i in (frame.dag.start, frame.dag.finish))
        self._count: int | None = None

    def count_paths(self) -> int:
        if self._count is None:
            self._count = self.frame.count_paths()
        return self._count

    __len__ = count_paths

    def iterate(self, maxlen: int | None = None, skip: int = 0, order: LinkOrder = LinkOrder.ID) -> Iterator[list[AnnotatedLink]]:
        """Paths one after the other; only one is held here."""
        if self.frame.dag.length == 0:
            if (maxlen is None or maxlen > 0) and skip <= 0:
                yield []
            return
        path, rank = [], None
        for r in self.frame.path_steps(skip, maxlen, order).orderBy("rank", "step").toLocalIterator():
            if rank is not None and r["rank"] != rank:
                yield path
                path = []
            rank = r["rank"]
            path.append(AnnotatedLink(AnnotatedPage(self, r.src, r.src_title), AnnotatedPage(self, r.dst, r.dst_title), r.text))
        if path:
            yield path

    def paths(self, maxlen: int | None = None, skip: int = 0, order: LinkOrder = LinkOrder.ID) -> list[list[AnnotatedLink]]:
        """Paths as lists of links, all of them unless ``maxlen`` is given."""
        return list(self.iterate(maxlen, skip, order))

    def path_enumerator(self, skip: int = 0, order: LinkOrder = LinkOrder.ID) -> PathEnumerator:
        return PathEnumerator(self, skip, order)


class PathEnumerator(Iterator[list[AnnotatedLink]]):
    """A cursor over paths that fetches one page of ranks at a time."""

    def __init__(self, of: AnnotatedDag | PathEnumerator, skip: int = 0, order: LinkOrder = LinkOrder.ID, page: int = 256):
        """``of`` another enumerator: a copy of it at its place."""
        if isinstance(of, PathEnumerator):
            self.dag, self.order, self.page, self.at, self._from, self._rows = of.dag, of.order, of.page, of.at, of._from, of._rows
        else:
            self.dag, self.order, self.page, self.at, self._from, self._rows = of, order, page, max(0, skip), 0, []

    @property
    def has_path(self) -> bool:
        if not self._from <= self.at < self._from + len(self._rows):
            self._from, self._rows = self.at, self.dag.paths(self.page, self.at, self.order)
        return bool(self._rows)

    __bool__ = has_path.fget

    @property
    def path(self) -> list[AnnotatedLink] | None:
        return self._rows[self.at - self._from] if self.has_path else None

    def advance(self, skip: int = 0) -> None:
        self.at += 1 + max(0, skip)

    def __next__(self) -> list[AnnotatedLink]:
        path = self.path
        if path is None:
            raise StopIteration
        self.advance()
        return path


class GraphReader:
    def __init__(self, graph: LinkGraph):
        self._graph = graph
        self.vertex_count, self.edge_count = graph.vertex_count(), graph.edge_count()

    def _check(self, *ids: int) -> None:
        for page_id in ids:
            if not 0 < page_id < self.vertex_count:
                raise IndexError(f"page id {page_id} is out of range")

    def forward_edges(self, page_id: int) -> list[int]:
        self._check(page_id)
        return [r.dst for r in self._graph.forward(page_id).collect()]

    def backward_edges(self, page_id: int) -> list[int]:
        self._check(page_id)
        return [r.src for r in self._graph.backward(page_id).collect()]

    def shortest_path_with_stats(self, start: int, finish: int) -> tuple[list[int], SearchStats]:
        self._check(start, finish)
        return shortest_path(self._graph.adjacency(), start, finish)

    def shortest_path(self, start: int, finish: int) -> list[int]:
        return self.shortest_path_with_stats(start, finish)[0]

    def shortest_path_dag_with_stats(self, start: int, finish: int) -> tuple[list[tuple[int, int]] | None, SearchStats]:
        self._check(start, finish)
        dag, stats = shortest_path_dag(self._graph.adjacency(), start, finish)
        return (None if dag is None else [(r.src, r.dst) for r in dag.edges.orderBy("src", "dst").collect()]), stats

    def shortest_path_dag(self, start: int, finish: int) -> list[tuple[int, int]] | None:
        return self.shortest_path_dag_with_stats(start, finish)[0]


class MetadataReader:
    def __init__(self, graph: LinkGraph):
        self._graph = graph

    def get_page_by_id(self, page_id: int) -> Page | None:
        return self._graph.page_by_id(page_id)

    def get_page_by_title(self, title: str) -> Page | None:
        return self._graph.page_by_title(title)

    def get_link(self, from_page_id: int, to_page_id: int) -> Link | None:
        return self._graph.link(from_page_id, to_page_id)


class Reader:
    """Graph and metadata together. Pages may be given by id or by '#id', '?' or title."""

    def __init__(self, graph: LinkGraph, collation: str = "UNICODE"):
        self._graph, self.collation = graph, collation
        self.graph, self.metadata = GraphReader(graph), MetadataReader(graph)

    def is_valid_page_id(self, page_id: int) -> bool:
        return 0 < page_id < self.graph.vertex_count

    def random_page_id(self, seed: int | None = None) -> int:
        return self._graph.random_page_id(seed)

    def parse_page_argument(self, argument: str) -> int:
        return self._graph.resolve(argument)

    def page_title(self, page_id: int) -> str:
        page = self._graph.page_by_id(page_id)
        return page.title if page else "untitled"

    def page_ref(self, page_id: int) -> str:
        return f"#{page_id} ({self.page_title(page_id)})"

    def _reference(self, src: int, dst: int):
        pair = self._graph.spark.createDataFrame([(src, dst)], "src bigint, dst bigint")
        return self._graph.references(pair).first()

    def link_text(self, src: int, dst: int) -> str:
        return self._reference(src, dst).text

    def forward_link_ref(self, src: int, dst: int) -> str:
        return self._reference(src, dst).forward_ref

    def backward_link_ref(self, src: int, dst: int) -> str:
        return self._reference(src, dst).backward_ref

    def shortest_path_annotated_dag_with_stats(self, start: int | str, finish: int | str) -> tuple[AnnotatedDag | None, SearchStats]:
        a, b = (self.parse_page_argument(x) if isinstance(x, str) else x for x in (start, finish))
        if not (self.is_valid_page_id(a) and self.is_valid_page_id(b)):
            return None, SearchStats(0, 0, 0)
        dag, stats = shortest_path_dag(self._graph.adjacency(), a, b)
        return (None if dag is None else AnnotatedDag(dag_frames.AnnotatedDag(self._graph, dag, self.collation))), stats

    def shortest_path_annotated_dag(self, start: int | str, finish: int | str) -> AnnotatedDag | None:
        return self.shortest_path_annotated_dag_with_stats(start, finish)[0]


def displayed(graph: LinkGraph, path: list[int]) -> list[dict]:
    """The pages of a path, each with what the link before it shows where that differs from the title."""
    if not path:
        return []
    spark = graph.spark
    steps = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(path, path[1:]))], "step int, src bigint, dst bigint")
    texts = {r.step: (r.dst_title, r.text) for r in graph.annotated(steps).collect()}
    titles = {r.page_id: r.title for r in graph.pages.filter(F.col("page_id").isin(path)).collect()}
    out = [{"page": {"id": path[0], "title": titles[path[0]]}}]
    for i, page_id in enumerate(path[1:]):
        page: dict = {"page": {"id": page_id, "title": titles[page_id]}}
        if texts[i][1] != titles[page_id]:
            page["displayed_as"] = texts[i][1]
        out.append(page)
    return out
