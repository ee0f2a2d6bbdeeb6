"""MediaWiki XML dumps as tables of page records, and tag statistics of any XML file."""

from __future__ import annotations

import bz2
import gzip
import xml.etree.ElementTree as ET
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetrail.sources.tables import RAW_PAGE


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, title, ns, redirect, revision) of every page of the dump files at ``path``.

    One file is one partition, whose order is the document order; several files are read in parallel and
    come in the order of their names.
    """
    reader = spark.read.format("xml").option("rowTag", "page").option("ignoreSurroundingSpaces", "false")
    pages = reader.schema(RAW_PAGE).load(path)
    return pages.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("place"), *RAW_PAGE.names)


def _opened(path: str):
    return bz2.open(path) if path.endswith(".bz2") else gzip.open(path) if path.endswith(".gz") else open(path, "rb")


def tag_counts(path: str) -> Iterator[tuple[str, int]]:
    """(path of the element, count) in one streaming pass; memory holds one branch of the tree."""
    counts: Counter[str] = Counter()
    stack: list[ET.Element] = []
    names: list[str] = []
    with _opened(path) as file:
        for event, element in ET.iterparse(file, events=("start", "end")):
            if event == "start":
                names.append(element.tag.rpartition("}")[2])
                stack.append(element)
                counts["/" + "/".join(names)] += 1
            else:
                names.pop()
                stack.pop()
                if stack:
                    stack[-1].remove(element)
    yield from sorted(counts.items())


def tag_statistics(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, count) of the elements of all files, each file being read by one task."""
    files = spark.createDataFrame([(p,) for p in paths], "name string").repartition(max(1, len(paths)), "name")

    def scan(frames):
        import pandas as pd

        for frame in frames:
            for name in frame.name:
                yield pd.DataFrame(list(tag_counts(name)), columns=["path", "count"])

    found = files.mapInPandas(scan, "path string, count bigint")
    return found.groupBy("path").agg(F.sum("count").alias("count"))
