"""The binary adjacency file as a Python data source, for exchange with other tools.

The file is an array of 32-bit words in host order: a magic word, a zero, the number of vertices, the number of edges,
then for each direction an index of vertices + 1 offsets and the neighbours in ascending order.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Fixed value: the word that begins a file.
MAGIC = 0x68707247
WORD = 4


@dataclass
class Vertices(InputPartition):
    low: int
    high: int


def header(path: str) -> tuple[int, int]:
    """(vertices, edges); raises ValueError for what is no such file."""
    words = np.fromfile(path, np.uint32, 4)
    if len(words) < 4 or int(words[0]) != MAGIC:
        raise ValueError(f"{path} is no graph file")
    vertices, edges = int(words[2]), int(words[3])
    if os.path.getsize(path) != WORD * (4 + 2 * (vertices + 1) + 2 * edges):
        raise ValueError(f"{path} has a wrong size")
    return vertices, edges


class _Reader(DataSourceReader):
    def __init__(self, path: str, parts: int):
        self.path, self.parts = path, parts
        self.vertices, self.edges = header(path)

    def partitions(self):
        step = max(1, -(-self.vertices // self.parts))
        return [Vertices(a, min(self.vertices, a + step)) for a in range(0, self.vertices, step)]

    def read(self, part):
        index = np.memmap(self.path, np.uint32, "r", WORD * 4, (self.vertices + 1,))
        near = np.memmap(self.path, np.uint32, "r", WORD * (4 + self.vertices + 1), (self.edges,)) if self.edges else np.zeros(0, np.uint32)
        bounds = index[part.low : part.high + 1].astype(np.int64)
        for a in range(0, part.high - part.low, 65_536):
            b = min(part.high - part.low, a + 65_536)
            src = np.repeat(np.arange(part.low + a, part.low + b, dtype=np.int64), np.diff(bounds[a : b + 1]))
            dst = near[bounds[a] : bounds[b]].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], names=["src", "dst"])


class GraphFile(DataSource):
    """``spark.read.format("pagetrail-graph").load(path)`` -> (src, dst)."""

    @classmethod
    def name(cls) -> str:
        return "pagetrail-graph"

    def schema(self) -> str:
        return "src bigint, dst bigint"

    def reader(self, schema):
        return _Reader(self.options["path"].removeprefix("file:"), int(self.options.get("partitions", "8")))


def read_graph(spark: SparkSession, path: str, partitions: int = 8) -> DataFrame:
    spark.dataSource.register(GraphFile)
    return spark.read.format(GraphFile.name()).option("partitions", partitions).load(path)


def write_graph(edges: DataFrame, vertices: int, path: str) -> None:
    """Write one file. It is filled range by range; each range of sorted neighbours passes the driver once."""
    if os.path.exists(path):
        raise FileExistsError(path)
    count = edges.count()
    out = np.memmap(path, np.uint32, "w+", shape=(4 + 2 * (vertices + 1) + 2 * count,))
    out[:4] = (MAGIC, 0, vertices, count)
    base = 4
    for key, value in (("src", "dst"), ("dst", "src")):
        degree = np.zeros(vertices + 1, np.int64)
        at = base + vertices + 1
        for row in edges.select(key, value).orderBy(key, value).toLocalIterator():
            degree[row[0] + 1] += 1
            out[at] = row[1]
            at += 1
        out[base : base + vertices + 1] = np.cumsum(degree)
        base += vertices + 1 + count
    out.flush()
