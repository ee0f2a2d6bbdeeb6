"""Link graphs from tables of pages and links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_PAGE = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("ns", T.StringType()),
        T.StructField("redirect", T.StructType([T.StructField("_title", T.StringType())])),
        T.StructField("revision", T.ArrayType(T.StructType([T.StructField("text", T.StringType())]))),
    ]
)
PAGES = T.StructType([T.StructField("page_id", T.LongType(), False), T.StructField("title", T.StringType(), False)])
LINKS = T.StructType(
    [T.StructField("from_page_id", T.LongType(), False), T.StructField("to_page_id", T.LongType(), False), T.StructField("title", T.StringType())]
)


def distinct_links(links: DataFrame) -> DataFrame:
    """One row per (from, to): without nulls and loops, with the title seen first.

    First means the smallest ``seen_at`` where there is one, nulls last, then the smallest title, null first.
    """
    kept = links.filter("from_page_id IS NOT NULL AND to_page_id IS NOT NULL AND from_page_id <> to_page_id")
    seen = F.col("seen_at") if "seen_at" in links.columns else F.lit(None).cast("timestamp_ntz")
    order = F.struct(seen.isNull().alias("none"), seen.alias("at"), F.col("title").isNotNull().alias("some"), F.col("title").alias("title"))
    return kept.groupBy("from_page_id", "to_page_id").agg(F.min(order).alias("first")).select("from_page_id", "to_page_id", "first.title")


def edges_of(links: DataFrame) -> DataFrame:
    return links.select(F.col("from_page_id").alias("src"), F.col("to_page_id").alias("dst"))
