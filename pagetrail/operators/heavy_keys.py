"""Per-key results over tables where a few keys hold most rows.

Rows are first combined to distinct (side, key, neighbour) triples with their multiplicity; the map side
combines repeats, so a triple repeated in a third of all rows is one row per task. The triples are then
range partitioned on the composite (side, key, neighbour). Spark samples the quantiles of that composite,
so a heavy key is cut into as many ranges as its share of the triples asks for, and no task holds more
than its share of rows whatever the keys look like. Each range yields partial states, one for a key; only
a range's first and last key can continue elsewhere, so stitching moves one row per key plus two per range.

Nulls: a null key belongs to no group and its row is left out; a null neighbour counts as a row, and as no
neighbour. Repeated rows count in ``n_rows`` and once in ``n_neighbours``. An empty table gives no rows.
Columns other than the named ones are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrail.plans.scratch import Scratch, partitions

CHUNK = 1024


def _triples(df: DataFrame, left: str, right: str) -> DataFrame:
    """(side, key, neighbour, n): both directions of the table, combined before the shuffle."""
    pair = df.select(F.col(left).cast("bigint").alias("l"), F.col(right).cast("bigint").alias("r"))
    both = F.array(
        F.struct(F.lit("from").alias("side"), F.col("l").alias("key"), F.col("r").alias("neighbour")),
        F.struct(F.lit("to").alias("side"), F.col("r").alias("key"), F.col("l").alias("neighbour")),
    )
    return (
        pair.groupBy("l", "r")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.explode(both).alias("t"), "n")
        .select("t.side", "t.key", "t.neighbour", "n")
        .filter(F.col("key").isNotNull())
    )


def _ranges(df: DataFrame, left: str, right: str) -> DataFrame:
    return _triples(df, left, right).repartitionByRange(partitions(df.sparkSession), "side", "key", "neighbour")


def key_degrees(df: DataFrame, left: str = "from_page_id", right: str = "to_page_id") -> DataFrame:
    """(side, page_id, n_rows, n_neighbours) for every key of either column.

    The first half of the aggregate runs inside each range and leaves one partial state per key; the
    second half stitches the keys that a range boundary cuts.
    """
    return (
        _ranges(df, left, right)
        .groupBy("side", F.col("key").alias("page_id"))
        .agg(F.sum("n").alias("n_rows"), F.count("neighbour").alias("n_neighbours"))
    )


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut a sorted range into chunks of one key each, with places counted from the range's own start."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    place: dict[tuple, int] = {}
    first: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        side = np.asarray(batch.column("side").to_pylist(), dtype=object)
        key, near = batch.column("key").to_numpy(), batch.column("neighbour").to_numpy()
        cut = np.flatnonzero((side[1:] != side[:-1]) | (key[1:] != key[:-1])) + 1
        starts, ends = np.r_[0, cut], np.r_[cut, len(key)]
        out: dict[str, list] = {k: [] for k in ("side", "page_id", "part", "leads", "place", "n", "neighbours")}
        for a, b in zip(starts.tolist(), ends.tolist()):
            k = (side[a], int(key[a]))
            first = first or k
            at = place.get(k, 0)
            for lo in range(a, b, CHUNK):
                hi = min(b, lo + CHUNK)
                for name, value in zip(out, (k[0], k[1], part, k == first, at + lo - a, hi - lo, near[lo:hi])):
                    out[name].append(value)
            place = {k: at + b - a}
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(out["side"], pa.string()),
                pa.array(out["page_id"], pa.int64()),
                pa.array(out["part"], pa.int32()),
                pa.array(out["leads"], pa.bool_()),
                pa.array(out["place"], pa.int64()),
                pa.array(out["n"], pa.int32()),
                pa.array(out["neighbours"], pa.list_(pa.int64())),
            ],
            names=list(out),
        )


def neighbour_chunks(df: DataFrame, left: str = "from_page_id", right: str = "to_page_id") -> DataFrame:
    """(side, page_id, first_place, n, neighbours): the ascending distinct neighbours of every key.

    A list is cut into chunks of at most 1,024, so no row and no task grows with a key; ``first_place`` is the
    0-based place of the chunk's first neighbour in the key's whole list. Only the leading key of a range
    can have begun in an earlier one, so the offsets to add are at most one for each range: that small table
    is the stitched state, and its size is bounded by the number of partitions.
    """
    scratch = Scratch(df.sparkSession)
    ranges = _ranges(df, left, right).filter(F.col("neighbour").isNotNull()).sortWithinPartitions("side", "key", "neighbour")
    schema = "side string, page_id bigint, part int, leads boolean, place bigint, n int, neighbours array<bigint>"
    chunks = scratch.write(ranges.select("side", "key", "neighbour").mapInArrow(_chunks, schema), "chunks")
    edge = F.max(F.struct("side", "page_id"))
    ends = chunks.groupBy("part").agg(edge.alias("last"))
    states = (
        chunks.join(F.broadcast(ends), "part")
        .filter(F.col("leads") | (F.struct("side", "page_id") == F.col("last")))
        .groupBy("side", "page_id", "part")
        .agg(F.sum("n").alias("n"), F.max("leads").alias("leads"))
        .orderBy("part")
        .collect()
    )  # at most two rows a partition
    before: dict[tuple, int] = {}
    offsets = []
    for row in states:
        k = (row.side, row.page_id)
        if row.leads and before.get(k):
            offsets.append((row.part, before[k]))
        before[k] = before.get(k, 0) + row.n
    offset = df.sparkSession.createDataFrame(offsets, "part int, carried bigint")
    carried = F.when(F.col("leads"), F.coalesce("carried", F.lit(0))).otherwise(F.lit(0))
    return chunks.join(F.broadcast(offset), "part", "left").select(
        "side", "page_id", (F.col("place") + carried).alias("first_place"), "n", "neighbours"
    )


def heavy_keys(df: DataFrame, one_in: int = 50, left: str = "from_page_id", right: str = "to_page_id") -> DataFrame:
    """(side, page_id): keys that hold at least 1/``one_in`` of all rows, null keys counting among the rows."""
    total = df.count()
    return key_degrees(df, left, right).filter(F.col("n_rows") * one_in >= total).select("side", "page_id")
