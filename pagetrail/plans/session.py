"""Session for local work; on a cluster the caller brings its own."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g", scratch: str | None = None) -> SparkSession:
    """``scratch``: the folder for intermediate tables, else a temporary one."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pagetrail")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("PAGETRAIL_MEMORY", memory))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    if scratch:
        spark.conf.set("spark.checkpoint.dir", scratch)
    return spark
