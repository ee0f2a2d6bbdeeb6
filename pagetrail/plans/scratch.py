"""Lineage cuts that survive the loss of executors.

A cut is a Parquet table below the folder that ``spark.checkpoint.dir`` names. Every executor shares
that folder, so a later stage can read the table whichever executors are alive. Where the setting is
missing (tests, a laptop) and all runs in one process, a temporary folder takes its place.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_local: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names, or a local one when it names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\[\]]*\])?", master):  # executors of their own may not share a local folder
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="pagetrail-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return _local[0]


def drop_table(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def clear(spark: SparkSession) -> None:
    """Drop every written table of this application; call it when no result is needed any more."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{spark.sparkContext.applicationId}-*")
    files = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in files.globStatus(pattern) or []:
        files.delete(status.getPath(), True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is run inside drops its shuffle files at its end; otherwise they stay until the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


class Scratch:
    """Written tables of one operator run; superseded ones are dropped at once."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the table read back; an older table of that name is dropped."""
        path = f"{self.base}/{name}-{uuid.uuid4().hex[:8]}"
        with shuffles_dropped(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        old = self.paths.get(name)
        self.paths[name] = path
        if old:
            drop_table(self.spark, old)
        return self.spark.read.schema(df.schema).parquet(path)

    def write_counted(self, df: DataFrame, name: str) -> tuple[DataFrame, int]:
        """``write``, and the number of rows, counted on the way."""
        seen = Observation()
        written = self.write(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
        return written, seen.get["n"]

    def drop(self, *names: str) -> None:
        for name in names:
            if path := self.paths.pop(name, None):
                drop_table(self.spark, path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
