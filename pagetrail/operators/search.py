"""Shortest paths by bidirectional breadth-first search, one layer per step.

Inside a layer the order in which a queue would visit vertices is the lexicographic order of their paths,
so a vertex carries its smallest path instead of a place in a queue, and one minimum over a layer's
expansions says where a sequential search would have stopped. The smaller fringe is expanded, forward on ties.

A search begins on the driver: as long as all neighbours it has fetched are at most ``local_rows``, a layer is one
lookup of the fringe in the adjacency: in a saved graph a table sorted for it, so that most row groups are skipped, else a filter on the edges. A search that
needs more starts over as joins, with the same result. There a layer is one join of the fringe with the edges. The fringe's size is known from the step before; below
``BROADCAST_ROWS`` it is broadcast, so the edges are read once and not moved. Every layer is a written table.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrail.plans.scratch import Scratch

BROADCAST_ROWS = 200_000
#: So many neighbours may be fetched to the driver in one search.
LOCAL_ROWS = 200_000
GATHER = 16


@dataclass(frozen=True)
class Adjacency:
    """Both directions of the edges as (v, w), v being where a step starts.

    ``sorted``: each is a table sorted by v, so a lookup skips most row groups; else lookups filter the edges as they are.
    ``repeats``: an edge may come several times; a lookup, a single scan, then drops repeats where it has fetched them.
    """

    forward: DataFrame
    backward: DataFrame
    sorted: bool = False
    repeats: bool = False

    @classmethod
    def of(cls, edges: DataFrame) -> Adjacency:
        return cls(edges.select(F.col("src").alias("v"), F.col("dst").alias("w")), edges.select(F.col("dst").alias("v"), F.col("src").alias("w")))

    @classmethod
    def stored(cls, edges: DataFrame, scratch: Scratch) -> Adjacency:
        """Written in both sort orders, for lookups that skip most of the data."""
        plain = cls.of(edges)
        return cls(scratch.write(ranged(plain.forward), "forward"), scratch.write(ranged(plain.backward), "backward"), True)

    def settled(self, scratch: Scratch) -> Adjacency:
        """This adjacency in written tables, for a search that joins it layer by layer."""
        if self.sorted:
            return self
        once = lambda df: df.distinct() if self.repeats else df
        return Adjacency(scratch.write(ranged(once(self.forward)), "forward"), scratch.write(ranged(once(self.backward)), "backward"), True)


def ranged(df: DataFrame) -> DataFrame:
    return df.repartitionByRange("v").sortWithinPartitions("v", "w")


def adjacency(edges: DataFrame | Adjacency) -> Adjacency:
    return edges if isinstance(edges, Adjacency) else Adjacency.of(edges)


class _TooLarge(Exception):
    pass


class _Lookup:
    """Neighbours of a fringe, fetched to the driver as long as the search stays within its rows."""

    def __init__(self, near: Adjacency, rows: int):
        self.near, self.left = near, rows

    def __call__(self, ahead: bool, fringe: list[int]) -> dict[int, list[int]]:
        table = self.near.forward if ahead else self.near.backward
        if len(fringe) <= 1000:
            found = table.filter(F.col("v").isin(fringe))
        else:
            ids = table.sparkSession.createDataFrame([(v,) for v in fringe], "v bigint")
            found = table.join(F.broadcast(ids), "v")
        rows = found.limit(self.left + 1).collect()
        self.left -= len(rows)
        if self.left < 0:
            raise _TooLarge
        out: dict[int, list[int]] = {v: [] for v in fringe}
        for v, w in sorted(set(map(tuple, rows))):
            out[v].append(w)
        return out


@dataclass(frozen=True)
class SearchStats:
    vertices_reached: int
    vertices_expanded: int
    edges_expanded: int
    time_taken_ms: int = 0


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _local_path(look: _Lookup, start: int, finish: int) -> tuple[list[int], int, int, int]:
    parents: tuple[dict[int, int], dict[int, int]] = ({start: 0}, {finish: 0})
    fringes = [[start], [finish]]
    reached, expanded, crossed = 2, 0, 0
    while all(fringes):
        k = 0 if len(fringes[0]) <= len(fringes[1]) else 1
        mine, other, new = parents[k], parents[1 - k], []
        near = look(k == 0, fringes[k])
        for v in fringes[k]:
            expanded += 1
            for w in near[v]:
                crossed += 1
                if w in other:
                    halves = []
                    for tree, at in zip((mine, other), (v, w)):
                        half = []
                        while at:
                            half.append(at)
                            at = tree[at]
                        halves.append(half)
                    path = halves[0][::-1] + halves[1]
                    return (path if k == 0 else path[::-1]), reached, expanded, crossed
                if w not in mine:
                    mine[w] = v
                    new.append(w)
                    reached += 1
        fringes[k] = new
    return [], reached, expanded, crossed


def _local_dag(look: _Lookup, start: int, finish: int, max_depth: int) -> tuple[list[tuple[int, int, int]] | None, int, int, int, int]:
    """(edges with layers or None, path length, reached, expanded, crossed)."""
    layers = ([{start}], [{finish}])
    seen = ({start}, {finish})
    links: list[list[dict[int, list[int]]]] = [[], []]
    reached, expanded, crossed = 2, 0, 0
    while layers[0][-1] and layers[1][-1]:
        if len(layers[0]) + len(layers[1]) - 2 >= max_depth:
            break
        k = 0 if len(layers[0][-1]) <= len(layers[1][-1]) else 1
        near = look(k == 0, sorted(layers[k][-1]))
        links[k].append(near)
        expanded += len(near)
        crossed += sum(map(len, near.values()))
        ends = set().union(*near.values()) if near else set()
        new = ends - seen[0] - seen[1]
        reached += len(new)
        if ends & seen[1 - k]:
            break
        seen[k].update(new)
        layers[k].append(new)
    else:
        return None, 0, reached, expanded, crossed
    if not ends & seen[1 - k] if expanded else True:
        return None, 0, reached, expanded, crossed
    meet = {(v, w) for v, ws in near.items() for w in ws if w in seen[1 - k]}
    if k == 1:
        meet = {(w, v) for v, w in meet}
    depth = len(layers[0]) - 1
    edges = {(v, w, depth) for v, w in meet}
    now = {v for v, _ in meet}
    for d in range(depth - 1, -1, -1):
        step = {(v, w, d) for v in layers[0][d] for w in links[0][d].get(v, ()) if w in now}
        edges |= step
        now = {v for v, _, _ in step}
    now = {w for _, w in meet}
    for i, d in enumerate(range(len(layers[1]) - 2, -1, -1)):
        step = {(v, w, depth + 1 + i) for w in layers[1][d] for v in links[1][d].get(w, ()) if v in now}
        edges |= step
        now = {w for _, w, _ in step}
    return sorted(edges), depth + len(layers[1]), reached, expanded, crossed


class _Side:
    """One direction of the search: its edges as (v, w), its layers, its fringe."""

    def __init__(self, edges: DataFrame, scratch: Scratch, name: str, root: int, with_path: bool):
        self.edges, self.scratch, self.name = edges, scratch, name
        start = edges.sparkSession.range(1).select(F.lit(root).cast("bigint").alias("v"))
        if with_path:
            start = start.withColumn("path", F.array("v"))
        self.layers = [scratch.write(start, f"{name}0")]
        self.sizes = [1]

    @property
    def fringe(self) -> DataFrame:
        return self.layers[-1]

    @property
    def size(self) -> int:
        return self.sizes[-1]

    def expand(self) -> tuple[DataFrame, int]:
        return self.scratch.write_counted(self.edges.join(_small(self.fringe, self.size), "v"), f"{self.name}-out")

    def labels(self) -> DataFrame:
        out = self.layers[0]
        for layer in self.layers[1:]:
            out = out.unionByName(layer)
        return out

    def push(self, layer: DataFrame) -> None:
        written, rows = self.scratch.write_counted(layer, f"{self.name}{len(self.layers)}")
        self.layers.append(written)
        self.sizes.append(rows)


def _sides(near: Adjacency, scratch: Scratch, start: int, finish: int, with_path: bool) -> tuple[_Side, _Side]:
    return _Side(near.forward, scratch, "f", start, with_path), _Side(near.backward, scratch, "b", finish, with_path)


def shortest_path(edges: DataFrame | Adjacency, start: int, finish: int, local_rows: int = LOCAL_ROWS) -> tuple[list[int], SearchStats]:
    """One shortest path as a list of page ids with both ends, [] when there is none, and the counters."""
    began = time.monotonic()
    ms = lambda: int((time.monotonic() - began) * 1000)
    if start == finish:
        return [start], SearchStats(1, 0, 0, ms())
    near = adjacency(edges)
    if local_rows:
        try:
            path, *counts = _local_path(_Lookup(near, local_rows), start, finish)
            return path, SearchStats(*counts, ms())
        except _TooLarge:
            pass
    scratch = Scratch(near.forward.sparkSession)
    ahead, behind = _sides(near.settled(scratch), scratch, start, finish, True)
    reached, expanded, crossed = 2, 0, 0
    while ahead.size and behind.size:
        side, other = (ahead, behind) if ahead.size <= behind.size else (behind, ahead)
        out, rows = side.expand()
        known = other.labels().select(F.col("v").alias("w"), F.col("path").alias("rest"))
        cut = out.join(known, "w").agg(F.min(F.struct("path", "w", "rest")).alias("cut")).first().cut
        kept = out
        if cut is not None:
            limit = F.struct(F.array(*(F.lit(v).cast("bigint") for v in cut.path)).alias("path"), F.lit(cut.w).cast("bigint").alias("w"))
            kept = out.filter(F.struct("path", "w") <= limit)
            expanded += side.fringe.filter(F.col("path") <= limit.getField("path")).count()
            rows = kept.count()
        else:
            expanded += side.size
        crossed += rows
        old = ahead.labels().select(F.col("v").alias("w")).unionByName(behind.labels().select(F.col("v").alias("w")))
        new = kept.join(old, "w", "left_anti").groupBy(F.col("w").alias("v")).agg(F.min(F.concat("path", F.array("w"))).alias("path"))
        side.push(new)
        reached += side.size
        if cut is not None:
            path = [*cut.path, *reversed(cut.rest)]
            return (path if side is ahead else path[::-1]), SearchStats(reached, expanded, crossed, ms())
    return [], SearchStats(reached, expanded, crossed, ms())


@dataclass(frozen=True)
class PathDag:
    """The edges on any shortest path: (src, dst, layer), layer being the distance of src from the start.

    ``local``: the same edges as rows, where the search stayed on the driver.
    """

    edges: DataFrame
    start: int
    finish: int
    length: int
    local: tuple[tuple[int, int, int], ...] | None = None


def shortest_path_dag(
    edges: DataFrame | Adjacency, start: int, finish: int, max_depth: int = 253, local_rows: int = LOCAL_ROWS
) -> tuple[PathDag | None, SearchStats]:
    """All shortest paths as a graph, None when there are none within ``max_depth`` edges, and the counters.

    The layer in which the sides meet is completed. Start and finish being the same gives a graph
    without edges, whose one path is empty.
    """
    began = time.monotonic()
    ms = lambda: int((time.monotonic() - began) * 1000)
    near = edges if isinstance(edges, Adjacency) or start == finish else adjacency(edges)
    spark = near.forward.sparkSession if isinstance(near, Adjacency) else near.sparkSession
    shape = "src bigint, dst bigint, layer int"
    if start == finish:
        return PathDag(spark.createDataFrame([], shape), start, finish, 0), SearchStats(1, 0, 0, ms())
    if local_rows:
        try:
            found, length, *counts = _local_dag(_Lookup(near, local_rows), start, finish, max_depth)
            dag = None if found is None else PathDag(spark.createDataFrame(found, shape), start, finish, length, tuple(found))
            return dag, SearchStats(*counts, ms())
        except _TooLarge:
            pass
    scratch = Scratch(spark)
    ahead, behind = _sides(near.settled(scratch), scratch, start, finish, False)
    reached, expanded, crossed = 2, 0, 0
    while ahead.size and behind.size:
        if len(ahead.layers) + len(behind.layers) - 2 >= max_depth:
            return None, SearchStats(reached, expanded, crossed, ms())
        side, other = (ahead, behind) if ahead.size <= behind.size else (behind, ahead)
        out, rows = side.expand()
        expanded += side.size
        crossed += rows
        meet = scratch.write(out.join(other.labels().withColumnRenamed("v", "w"), "w", "left_semi"), "meet")
        met = not meet.isEmpty()
        old = ahead.labels().select(F.col("v").alias("w")).unionByName(behind.labels().select(F.col("v").alias("w")))
        side.push(out.join(old, "w", "left_anti").select(F.col("w").alias("v")).distinct())
        reached += side.size
        if met:
            side.layers.pop()
            side.sizes.pop()
            break
    else:
        return None, SearchStats(reached, expanded, crossed, ms())
    if side is behind:
        meet = meet.select(F.col("w").alias("v"), F.col("v").alias("w"))
    depth = len(ahead.layers) - 1
    length = depth + len(behind.layers)
    parts = [meet.select(F.col("v").alias("src"), F.col("w").alias("dst"), F.lit(depth).alias("layer"))]
    now = scratch.write(meet.select("v").distinct(), "now")
    for d in range(depth - 1, -1, -1):
        into = behind.edges.join(_small(now, now.count()), "v").join(ahead.layers[d].withColumnRenamed("v", "w"), "w", "left_semi")
        step = scratch.write(into.select(F.col("w").alias("src"), F.col("v").alias("dst"), F.lit(d).alias("layer")), f"dag{d}")
        parts.append(step)
        now = scratch.write(step.select(F.col("src").alias("v")).distinct(), "now")
    now = scratch.write(meet.select(F.col("w").alias("v")).distinct(), "now")
    for k, d in enumerate(range(len(behind.layers) - 2, -1, -1)):
        onto = ahead.edges.join(_small(now, now.count()), "v").join(behind.layers[d].withColumnRenamed("v", "w"), "w", "left_semi")
        step = scratch.write(onto.select(F.col("v").alias("src"), F.col("w").alias("dst"), F.lit(depth + 1 + k).alias("layer")), f"dag{depth + 1 + k}")
        parts.append(step)
        now = scratch.write(step.select(F.col("dst").alias("v")).distinct(), "now")
    dag = parts[0]
    for part in parts[1:]:
        dag = dag.unionByName(part)
    dag = scratch.write(dag, "dag")
    scratch.drop(*(n for n in list(scratch.paths) if n != "dag"))
    return PathDag(dag, start, finish, length), SearchStats(reached, expanded, crossed, ms())


def _local_distances(look: _Lookup, starts: list[int], max_depth: int | None) -> list[tuple[int, int, int]]:
    near: dict[int, list[int]] = {}
    rows = [(s, s, 0) for s in starts]
    seen = {(s, s) for s in starts}
    fringe, depth = sorted(seen), 0
    while fringe and (max_depth is None or depth < max_depth):
        depth += 1
        asked = sorted({v for _, v in fringe} - near.keys())
        if asked:
            near |= look(True, asked)
        new = sorted({(s, w) for s, v in fringe for w in near[v]} - seen)
        look.left -= len(new)
        if look.left < 0:
            raise _TooLarge
        seen.update(new)
        rows += [(s, w, depth) for s, w in new]
        fringe = new
    return rows


def distances(edges: DataFrame | Adjacency, starts: DataFrame, max_depth: int | None = None, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """(start, page_id, distance) of everything that each start reaches, or within ``max_depth`` edges of it.

    ``starts``: a column ``start``. All searches advance together, one join a layer, until no search finds a new page. Layers are
    gathered into one table every ``GATHER`` layers, so a deep search doesn't read ever more tables. As with a path, the
    driver keeps the search as long as it fetches and finds at most ``local_rows`` rows.
    """
    sides = adjacency(edges)
    spark = starts.sparkSession
    if local_rows:
        first = starts.select(F.col("start").cast("bigint").alias("start")).dropna().distinct().limit(local_rows + 1).collect()
        try:
            rows = _local_distances(_Lookup(sides, local_rows - len(first)), sorted(r.start for r in first), max_depth)
            return spark.createDataFrame(rows, "start bigint, page_id bigint, distance int")
        except _TooLarge:
            pass
    scratch = Scratch(spark)
    near = sides.forward if sides.sorted else scratch.write(ranged(sides.forward.distinct() if sides.repeats else sides.forward), "edges")
    near = near.select(F.col("v").alias("src"), F.col("w").alias("dst"))
    starts = starts.dropna(subset=["start"])
    fringe = starts.select(F.col("start").cast("bigint").alias("start"), F.col("start").cast("bigint").alias("page_id")).distinct()
    fringe, rows = scratch.write_counted(fringe.withColumn("distance", F.lit(0)), "d0")
    seen, depth = fringe, 0
    while rows and (max_depth is None or depth < max_depth):
        depth += 1
        out = near.join(_small(fringe, rows), near.src == fringe.page_id).select("start", F.col("dst").alias("page_id")).distinct()
        new = out.join(seen.select("start", "page_id"), ["start", "page_id"], "left_anti")
        fringe, rows = scratch.write_counted(new.withColumn("distance", F.lit(depth)), f"d{depth}")
        seen = seen.unionByName(fringe)
        if depth % GATHER == 0:
            seen = scratch.write(seen, "seen")
            scratch.drop(*(f"d{d}" for d in range(depth)))  # the fringe stays
    return seen
