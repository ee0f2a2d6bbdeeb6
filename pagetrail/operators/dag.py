"""Counting, ordering, listing and drawing the shortest paths of a path DAG.

Paths have ranks. With the number of paths from each page to the finish, and a running sum over the links
of a page in the chosen order, every partial path knows the interval of ranks it leads to. Skipping and limiting
are interval tests on partial paths, so nothing outside the asked ranks is built.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from enum import Enum

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetrail.functions import wikitext as W
from pagetrail.operators.graph import LinkGraph
from pagetrail.operators.search import PathDag
from pagetrail.plans.scratch import Scratch


class LinkOrder(Enum):
    ID = "id"
    TITLE = "title"
    TEXT = "text"


class AnnotatedDag:
    def __init__(self, graph: LinkGraph, dag: PathDag, collation: str = "UTF8_BINARY"):
        """``collation`` orders titles and texts; ids break ties."""
        self.graph, self.dag, self.collation = graph, dag, collation
        self.scratch = Scratch(graph.spark)
        self.links = self.scratch.write(graph.annotated(dag.edges), "links")
        self._counts: DataFrame | None = None
        self._ranked: dict[LinkOrder, DataFrame] = {}

    def path_counts(self) -> DataFrame:
        """(page_id, n_paths): how many shortest paths lead from a page to the finish; null beyond 64 bits."""
        if self._counts is None:
            spark = self.graph.spark
            if self.dag.local is not None:
                count = {self.dag.finish: 1}
                for src, dst, _ in sorted(self.dag.local, key=lambda e: -e[2]):
                    count[src] = count.get(src, 0) + count[dst]
                rows = [(page, n if n < 1 << 63 else None) for page, n in count.items()]
                self._counts = spark.createDataFrame(rows, "page_id bigint, n_paths bigint")
                return self._counts
            now = spark.range(1).select(F.lit(self.dag.finish).cast("bigint").alias("page_id"), F.lit(1).cast("bigint").alias("n_paths"))
            parts = [now]
            for layer in range(self.dag.length - 1, -1, -1):
                step = self.dag.edges.filter(F.col("layer") == layer).join(now, self.dag.edges.dst == now.page_id)
                total = F.when(F.count_if(F.col("n_paths").isNull()) == 0, F.try_sum("n_paths"))  # a sum alone would skip nulls
                now = self.scratch.write(step.groupBy(F.col("src").alias("page_id")).agg(total.alias("n_paths")), f"count{layer}")
                parts.append(now)
            out = parts[0]
            for part in parts[1:]:
                out = out.unionByName(part)
            self._counts = out
        return self._counts

    def count_paths(self) -> int:
        row = self.path_counts().filter(F.col("page_id") == self.dag.start).first()
        return row.n_paths if row else 0

    def _key(self, order: LinkOrder) -> list[Column]:
        if order is LinkOrder.ID:
            return [F.col("dst")]
        name = "dst_title" if order is LinkOrder.TITLE else "text"
        return [F.collate(F.col(name), self.collation), F.col("dst")]

    def page_links(self, page_id: int, order: LinkOrder = LinkOrder.ID) -> DataFrame:
        """(place, src, dst, text, ref) of the links of one page that lie on shortest paths."""
        mine = self.links.filter(F.col("src") == page_id)
        place = F.row_number().over(Window.partitionBy("src").orderBy(*self._key(order))) - 1
        ref = W.link_ref(F.col("dst"), F.col("dst_title"), F.col("text"), F.col("dst_title"))
        return mine.select(place.alias("place"), "src", "dst", "dst_title", "text", ref.alias("ref"))

    def _ranks(self, order: LinkOrder) -> DataFrame:
        """(src, dst, layer, n_paths, before), written once for each order, so that results already handed out stay readable."""
        if order not in self._ranked:
            counts = self.path_counts().withColumnRenamed("page_id", "dst")
            before = F.coalesce(F.sum("n_paths").over(Window.partitionBy("src").orderBy(*self._key(order)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            ranked = self.links.join(counts, "dst").select("src", "dst", "layer", "n_paths", before.alias("before"))
            self._ranked[order] = self.scratch.write(ranked, f"ranked-{order.value}")
        return self._ranked[order]

    def close(self) -> None:
        """Drop the written tables; results not yet collected can't be read any more."""
        self.scratch.drop(*list(self.scratch.paths))
        self._ranked = {}

    def paths(self, skip: int = 0, maximum: int | None = None, order: LinkOrder = LinkOrder.ID) -> DataFrame:
        """(rank, path): paths in the order of their links, ranks from ``skip`` on, at most ``maximum``.

        ``path`` lists all page ids. A negative skip counts as 0; a maximum of 0 or less gives nothing.
        """
        skip = max(0, skip)
        spark = self.graph.spark
        ranked = self._ranks(order)
        end = None if maximum is None else skip + max(0, maximum)
        inside = lambda n: (F.col("rank") + n > skip) if end is None else (F.col("rank") < end) & (F.col("rank") + n > skip)
        now = spark.range(1).select(F.lit(0).cast("bigint").alias("rank"), F.array(F.lit(self.dag.start).cast("bigint")).alias("path"))
        if self.dag.length == 0:
            return now.filter(inside(F.lit(1)))
        for layer in range(self.dag.length):
            step = ranked.filter(F.col("layer") == layer).drop("layer")
            joined = now.withColumn("src", F.element_at("path", -1)).join(step, "src")
            now = joined.withColumn("rank", F.col("rank") + F.col("before")).filter(inside(F.col("n_paths")))
            now = now.select("rank", F.concat("path", F.array("dst")).alias("path"))
        return now

    def path_steps(self, skip: int = 0, maximum: int | None = None, order: LinkOrder = LinkOrder.ID) -> DataFrame:
        """(rank, step, src, dst, text, ref) of the links of ``paths``."""
        paths = self.paths(skip, maximum, order)
        pairs = F.arrays_zip(F.expr("slice(path, 1, size(path) - 1)").alias("src"), F.expr("slice(path, 2, size(path) - 1)").alias("dst"))
        steps = paths.select("rank", F.posexplode(pairs).alias("step", "p")).select("rank", "step", "p.src", "p.dst")
        named = steps.join(self.links.select("src", "src_title", "dst", "dst_title", "text"), ["src", "dst"])
        return named.select("rank", "step", "src", "src_title", "dst", "dst_title", "text", W.link_ref(F.col("dst"), F.col("dst_title"), F.col("text"), F.col("dst_title")).alias("ref"))

    def random_path(self, seed: int | None = None, order: LinkOrder = LinkOrder.ID) -> DataFrame:
        """(rank, path) of one path, every path being equally likely."""
        return self.paths(random.Random(seed).randrange(max(1, self.count_paths())), 1, order)

    def edge_lines(self) -> DataFrame:
        """(src, dst, line): each edge as text."""
        refs = self.graph.references(self.dag.edges.select("src", "dst"))
        return refs.select("src", "dst", F.concat("page_ref", F.lit(" -> "), "forward_ref").alias("line"))

    def dot_lines(self) -> DataFrame:
        """(place, line): the graph in DOT; order by place. Nodes come before the edge that first shows them."""
        link = self.links
        edge_at = F.struct(F.col("src").alias("a"), F.col("dst").alias("b"))
        nodes = link.select(F.explode(F.array(F.struct(edge_at.alias("at"), F.lit(0).alias("k"), F.col("src").alias("id"), F.col("src_title").alias("t")), F.struct(edge_at.alias("at"), F.lit(1).alias("k"), F.col("dst").alias("id"), F.col("dst_title").alias("t")))).alias("n"))
        first = nodes.groupBy("n.id").agg(F.min(F.struct("n.at", "n.k", "n.t")).alias("f"))
        node = first.select(F.col("f.at").alias("at"), F.col("f.k").alias("k"), F.concat(F.col("id").cast("string"), F.lit(" [label="), W.dot_quote(F.col("f.t")), F.lit("];")).alias("line"))
        label = F.when(F.col("text") != F.col("dst_title"), F.concat(F.lit(" [label="), W.dot_quote(F.col("text")), F.lit("]"))).otherwise(F.lit(""))
        edge = link.select(edge_at.alias("at"), F.lit(2).alias("k"), F.concat(F.col("src").cast("string"), F.lit(" -> "), F.col("dst").cast("string"), label, F.lit(";")).alias("line"))
        ends = self.graph.spark.range(2).select(
            F.struct(F.when(F.col("id") == 0, F.lit(-1)).otherwise(F.lit((1 << 63) - 1)).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b")).alias("at"),
            F.lit(0).alias("k"), F.when(F.col("id") == 0, F.lit("digraph dag {")).otherwise(F.lit("}")).alias("line"),
        )
        return node.unionByName(edge).unionByName(ends).select(F.struct("at", "k").alias("place"), "line")


class PathEnumerator(Iterator[list[int]]):
    """A cursor over the paths of a DAG that fetches one page of ranks at a time."""

    def __init__(self, dag: AnnotatedDag, skip: int = 0, order: LinkOrder = LinkOrder.ID, page: int = 256):
        self.dag, self.order, self.page = dag, order, page
        self.at = max(0, skip)
        self._from, self._rows = 0, []

    def copy(self) -> PathEnumerator:
        return PathEnumerator(self.dag, self.at, self.order, self.page)

    def has_path(self) -> bool:
        if not self._from <= self.at < self._from + len(self._rows):
            self._from = self.at
            self._rows = [r.path for r in self.dag.paths(self.at, self.page, self.order).orderBy("rank").collect()]  # at most one page
        return bool(self._rows)

    def path(self) -> list[int]:
        if not self.has_path():
            raise StopIteration
        return self._rows[self.at - self._from]

    def advance(self, skip: int = 0) -> None:
        self.at += 1 + max(0, skip)

    def __next__(self) -> list[int]:
        path = self.path()
        self.advance()
        return path
