"""The link graph: pages, links, edges, lookups and references."""

from __future__ import annotations

import random
import threading
from dataclasses import dataclass, replace
from enum import Enum

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetrail.functions import wikitext as W
from pagetrail.operators.search import Adjacency, ranged
from pagetrail.sources.tables import distinct_links, edges_of


#: Pages drawn at random before all degrees are counted.
DRAWS = 20


def metadata_beside(graph_file: str) -> str:
    """The name of the metadata file that belongs to a graph file: its last extension is replaced."""
    stem, dot, _ = graph_file.rpartition(".")
    return (stem if dot and "/" not in graph_file[len(stem) :] else graph_file) + ".metadata"


class Residency(Enum):
    """How much of the adjacency is brought into memory when a graph is opened."""

    NONE = "none"
    FOREGROUND = "foreground"
    BACKGROUND = "background"
    POPULATE = "populate"


def quoted(text: str | None) -> str:
    """A string as it is written in a representation: backslash, double quote and control characters escaped."""
    if text is None:
        return "None"
    return '"' + "".join("\\" + c if c in '\\"' else f"\\x{ord(c):02x}" if ord(c) < 32 else c for c in text) + '"'


@dataclass(frozen=True)
class Page:
    id: int
    title: str

    def __repr__(self) -> str:
        return f"pagetrail.Page(id={self.id}, title={quoted(self.title)})"


@dataclass(frozen=True)
class Link:
    from_page_id: int
    to_page_id: int
    title: str | None

    def __repr__(self) -> str:
        return f"pagetrail.Link(from_page_id={self.from_page_id}, to_page_id={self.to_page_id}, title={quoted(self.title)})"


class LinkGraph:
    """Pages and links, and the edges between them.

    ``edges`` holds no loops and no repeats. Traversal joins a frontier to it, so the frontier is what moves as
    long as it is small.
    """

    def __init__(self, pages: DataFrame, links: DataFrame, residency: Residency = Residency.NONE, clean: bool = False, adjacency: Adjacency | None = None):
        """``links`` are reduced to one row per pair unless they are known to be ``clean``."""
        self.spark = pages.sparkSession
        self.pages = pages.select("page_id", "title")
        self.links = links.select("from_page_id", "to_page_id", "title") if clean else distinct_links(links)
        self.edges = edges_of(self.links)
        self._adjacency = adjacency or self._as_they_are(links, clean)
        if residency is not Residency.NONE:
            kept = [df.persist(StorageLevel.MEMORY_AND_DISK) for df in (self._adjacency.forward, self._adjacency.backward)]
            load = lambda: [df.count() for df in kept]
            if residency is Residency.BACKGROUND:
                threading.Thread(target=load, daemon=True).start()
            else:
                try:
                    load()
                except Exception:
                    if residency is Residency.FOREGROUND:
                        raise

    @staticmethod
    def _as_they_are(links: DataFrame, clean: bool) -> Adjacency:
        near = Adjacency.of(edges_of(links.filter("from_page_id IS NOT NULL AND to_page_id IS NOT NULL AND from_page_id <> to_page_id")))
        return replace(near, repeats=not clean)

    @classmethod
    def open(cls, spark: SparkSession, path: str, residency: Residency = Residency.NONE) -> LinkGraph:
        """A saved graph; opening writes nothing."""
        pages, links, forward, backward = (spark.read.parquet(f"{path}/{part}") for part in ("pages", "links", "forward", "backward"))
        return cls(pages, links, residency, clean=True, adjacency=Adjacency(forward, backward, True))

    @classmethod
    def open_files(cls, spark: SparkSession, graph_file: str, partitions: int = 8, residency: Residency = Residency.NONE) -> LinkGraph:
        """A graph from a binary adjacency file and the metadata file of the same name beside it."""
        from pagetrail.sources.graph_file import read_graph
        from pagetrail.sources.metadata_db import read_metadata

        edges = read_graph(spark, graph_file, partitions)
        metadata = metadata_beside(graph_file)
        return cls(read_metadata(spark, metadata, "pages"), read_metadata(spark, metadata, "links"), residency, clean=True, adjacency=Adjacency.of(edges))

    def save(self, path: str) -> None:
        """Write ``pages``, ``links`` and the edges in both sort orders below ``path``; nothing existing is overwritten."""
        self.pages.write.mode("errorifexists").parquet(f"{path}/pages")
        self.links.repartitionByRange("from_page_id").sortWithinPartitions("from_page_id", "to_page_id").write.mode("errorifexists").parquet(f"{path}/links")
        near = Adjacency.of(edges_of(self.spark.read.parquet(f"{path}/links")))
        ranged(near.forward).write.mode("errorifexists").parquet(f"{path}/forward")
        ranged(near.backward).write.mode("errorifexists").parquet(f"{path}/backward")

    def adjacency(self) -> Adjacency:
        """Both directions of the edges: the sorted tables of a saved graph, else the edges as they are."""
        return self._adjacency

    # -- counts ----------------------------------------------------------------------------------

    def vertex_count(self) -> int:
        """Pages and the reserved page 0."""
        return (self.pages.agg(F.max("page_id")).first()[0] or 0) + 1

    def edge_count(self) -> int:
        return self.edges.count()

    def counts(self) -> DataFrame:
        pages = self.pages.agg((F.coalesce(F.max("page_id"), F.lit(0)) + 1).cast("bigint").alias("vertex_count"), F.count(F.lit(1)).alias("page_count"))
        edges = self.edges.agg(F.count(F.lit(1)).alias("edge_count"))
        return pages.withColumn("k", F.lit(1)).join(edges.withColumn("k", F.lit(1)), "k").drop("k")

    def degrees(self) -> DataFrame:
        """(page_id, out_degree, in_degree) of every page."""
        ends = self.edges.select(F.explode(F.array(F.struct(F.col("src").alias("page_id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("page_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
        sums = ends.groupBy("e.page_id").agg(F.sum("e.o").alias("o"), F.sum("e.i").alias("i"))
        return self.pages.select("page_id").join(sums, "page_id", "left").select(
            "page_id", F.coalesce("o", F.lit(0)).cast("bigint").alias("out_degree"), F.coalesce("i", F.lit(0)).cast("bigint").alias("in_degree")
        )

    # -- lookups -----------------------------------------------------------------------------------

    def is_valid_page_id(self, page_id: int) -> bool:
        return 0 < page_id < self.vertex_count()

    def check(self, page_id: int) -> None:
        if not self.is_valid_page_id(page_id):
            raise IndexError(f"page id {page_id} is out of range")

    def page_by_id(self, page_id: int) -> Page | None:
        row = self.pages.filter(F.col("page_id") == page_id).first()
        return Page(row.page_id, row.title) if row else None

    def page_by_title(self, title: str) -> Page | None:
        row = self.pages.filter(F.col("title") == title).first()
        return Page(row.page_id, row.title) if row else None

    def link(self, from_page_id: int, to_page_id: int) -> Link | None:
        row = self.links.filter((F.col("from_page_id") == from_page_id) & (F.col("to_page_id") == to_page_id)).first()
        return Link(row.from_page_id, row.to_page_id, row.title) if row else None

    def forward(self, page_id: int) -> DataFrame:
        return self._adjacency.forward.filter(F.col("v") == page_id).select(F.col("w").alias("dst")).distinct().orderBy("dst")

    def backward(self, page_id: int) -> DataFrame:
        return self._adjacency.backward.filter(F.col("v") == page_id).select(F.col("w").alias("src")).distinct().orderBy("src")

    def reversed_edges(self) -> DataFrame:
        return self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))

    def resolve(self, argument: str, seed: int | None = None) -> int:
        """A page id from '#id', '?' (any page) or a title; 0 for what names no page."""
        if not argument:
            return 0
        if argument.startswith("#"):
            text = argument[1:].lstrip(W.SPACE)
            digits = text[1:] if text[:1] in ("+", "-") else text
            if not (digits.isascii() and digits.isdigit()):
                return 0
            return int(text) if self.is_valid_page_id(int(text)) else 0
        if argument == "?":
            return self.random_page_id(seed)
        page = self.page_by_title(argument)
        return page.id if page else 0

    def random_page_id(self, seed: int | None = None) -> int:
        """A page with links in both directions if there is one, else any page; 0 in an empty graph."""
        top = self.vertex_count()
        rng = random.Random(seed)
        for _ in range(DRAWS if top > 1 else 0):  # two lookups a draw; most pages have both
            drawn = rng.randrange(1, top)
            if not self.forward(drawn).isEmpty() and not self.backward(drawn).isEmpty():
                return drawn
        both = self.degrees().withColumn("r", F.rand(seed) if seed is not None else F.rand())
        row = both.orderBy(~((F.col("out_degree") > 0) & (F.col("in_degree") > 0)), "r").select("page_id").first()
        return row.page_id if row else 0

    # -- references --------------------------------------------------------------------------------

    def annotated(self, pairs: DataFrame) -> DataFrame:
        """(src, dst) with src_title, dst_title and the text that the link shows."""
        src = self.pages.select(F.col("page_id").alias("src"), F.col("title").alias("src_title"))
        dst = self.pages.select(F.col("page_id").alias("dst"), F.col("title").alias("dst_title"))
        link = self.links.select(F.col("from_page_id").alias("src"), F.col("to_page_id").alias("dst"), F.col("title").alias("link_title"), F.lit(True).alias("linked"))
        joined = pairs.join(src, "src", "left").join(dst, "dst", "left").join(link, ["src", "dst"], "left")
        text = W.link_text(F.coalesce("linked", F.lit(False)), F.col("link_title"), F.col("dst_title"))
        return joined.withColumn("text", text).drop("link_title", "linked").withColumns(
            {"src_title": W.page_title(F.col("src_title")), "dst_title": W.page_title(F.col("dst_title"))}
        )

    def references(self, pairs: DataFrame) -> DataFrame:
        """(src, dst, page_ref, forward_ref, backward_ref, text) of the links in ``pairs``."""
        a = self.annotated(pairs)
        return a.select(
            *pairs.columns,
            W.page_ref(F.col("src"), F.col("src_title")).alias("page_ref"),
            W.link_ref(F.col("dst"), F.col("dst_title"), F.col("text"), F.col("dst_title")).alias("forward_ref"),
            W.link_ref(F.col("src"), F.col("src_title"), F.col("text"), F.col("dst_title")).alias("backward_ref"),
            "text",
        )

    def inspect(self, page_id: int) -> DataFrame:
        """(part, place, ref): the page, its outgoing links and its incoming links."""
        self_ref = self.pages.filter(F.col("page_id") == page_id).select(
            F.lit("page").alias("part"), F.lit(0).cast("bigint").alias("place"), W.page_ref(F.col("page_id"), F.col("title")).alias("ref")
        )
        out = self.references(self.edges.filter(F.col("src") == page_id)).select(F.lit("out").alias("part"), F.col("dst").alias("place"), F.col("forward_ref").alias("ref"))
        into = self.references(self.edges.filter(F.col("dst") == page_id)).select(F.lit("in").alias("part"), F.col("src").alias("place"), F.col("backward_ref").alias("ref"))
        return self_ref.unionByName(out).unionByName(into)
