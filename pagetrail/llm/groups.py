"""Consolidate pairwise matches into groups: seed-tree pruning.

Every round does two things. Minimum selection: each vertex u finds m(u), the smallest vertex of its
neighbourhood with itself, and tells m(u) to all of that neighbourhood. Pruning: each vertex links
the smallest minimum it was told to the others it was told; a vertex that nobody, itself included, chose as
a minimum leaves the graph and hangs below its smallest minimum in the propagation forest. The graph shrinks
until it has no edges; what is left are the seeds, the smallest vertex of every component. The forest is
then walked from the last round to the first, so each vertex takes the seed of its parent.

All steps are aggregates and equi-joins over (vertex, vertex) rows. A vertex with a third of all edges is one
row per task after the map-side combine; in the join its rows are split by adaptive execution. Each round
ends in a written table, so no plan grows and no lost executor costs more than one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrail.functions.wikitext import link_target
from pagetrail.plans.scratch import Scratch


def connected_groups(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, group_id) for every vertex of ``edges``; group_id is its component's smallest vertex.

    Rows with a null end are left out. Loops make a vertex known and link nothing; repeated rows and
    either direction of a pair are the same edge. Without edges the result is empty.
    """
    scratch = Scratch(edges.sparkSession)
    pairs = edges.select(F.col(a).cast("bigint").alias("u"), F.col(b).cast("bigint").alias("v")).dropna()
    pairs = scratch.write(pairs.distinct(), "pairs")
    graph, rows = scratch.write_counted(_both_ways(pairs.filter("u <> v")), "graph")
    rounds: list[DataFrame] = []
    while rows:
        low = graph.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        told = scratch.write(graph.join(low, "u").select(F.col("v").alias("u"), "m").unionByName(low), "told")
        chosen = told.groupBy("u").agg(F.min("m").alias("least"), F.max(F.col("m") == F.col("u")).alias("stays"))
        chosen = scratch.write(chosen, f"round{len(rounds)}")
        rounds.append(chosen)
        links = told.join(chosen, "u").filter("m <> least").select(F.col("least").alias("u"), F.col("m").alias("v"))
        graph, rows = scratch.write_counted(_both_ways(links), "graph")
    forest = [r.filter("not stays").select(F.col("u").alias("vertex"), F.col("least").alias("parent")) for r in rounds]
    vertices = pairs.select(F.explode(F.array("u", "v")).alias("vertex")).distinct()
    if not forest:
        return vertices.select("vertex", F.col("vertex").alias("group_id"))
    hung = forest[0].select("vertex")
    for tree in forest[1:]:
        hung = hung.unionByName(tree.select("vertex"))
    seeds = vertices.join(hung, "vertex", "left_anti")
    named = scratch.write(seeds.select("vertex", F.col("vertex").alias("group_id")), "named")
    for k in range(len(forest) - 1, -1, -1):  # a parent left the graph later than its child, or never
        below = forest[k].join(named.withColumnRenamed("vertex", "parent"), "parent").select("vertex", "group_id")
        named = named.unionByName(scratch.write(below, f"named{k}"))
    scratch.drop("pairs", "graph", "told", *(f"round{i}" for i in range(len(rounds))))
    return named


def _both_ways(pairs: DataFrame) -> DataFrame:
    ends = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    return pairs.select(F.explode(ends).alias("e")).select("e.u", "e.v").distinct()


def title_links(raw_pages: DataFrame) -> DataFrame:
    """(a, b): every record with the first record of its title, and with the first record its redirect names.

    Linking to a title's smallest id instead of to all records of the title keeps the same groups with at
    most two edges a record. Null and empty titles, and redirects to a title no record has, link nothing.
    """
    record = raw_pages.select(
        "raw_id",
        F.when(F.col("title") != "", F.col("title")).alias("title"),
        link_target(F.col("redirect._title")).alias("target"),
    )
    first = record.filter("title is not null").groupBy("title").agg(F.min("raw_id").alias("b"))
    names = F.array(F.col("title"), F.col("target"))
    named = record.select(F.col("raw_id").alias("a"), F.explode(names).alias("title")).filter("title is not null and title <> ''")
    return named.join(first, "title").select("a", "b")


def record_groups(raw_pages: DataFrame) -> DataFrame:
    """(raw_id, group_id) for every record; a record that nothing links is its own group.

    A record without raw_id is left out. Other columns are ignored.
    """
    named = connected_groups(title_links(raw_pages))
    records = raw_pages.select("raw_id").filter("raw_id is not null")
    return records.join(named, records.raw_id == named.vertex, "left").select(
        "raw_id", F.coalesce("group_id", "raw_id").alias("group_id")
    )


def linked_groups(raw_pages: DataFrame) -> DataFrame:
    """The records of ``record_groups`` whose group has at least two."""
    named = connected_groups(title_links(raw_pages)).withColumnRenamed("vertex", "raw_id")
    shared = named.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("group_id")
    return named.join(shared, "group_id").select("raw_id", "group_id")
