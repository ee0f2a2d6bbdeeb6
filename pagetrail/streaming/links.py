"""Page records that arrive as a stream: link extraction, and a running index of first titles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrail.functions import wikitext as W
from pagetrail.operators.ingest import inclusion, with_links


def streamed_links(records: DataFrame, late: str = "1 day") -> DataFrame:
    """(title, target, link_title) of the links of included records, each record once within the watermark.

    ``records`` is a streaming table like raw_pages; ``fetched_at`` is its event time. A record without
    a time is not dropped as a repeat and passes as it comes.
    """
    kept = records.filter(inclusion(F.col("title"), F.col("ns"), F.col("redirect._title")).isNull())
    slim = kept.select("raw_id", "title", "fetched_at", W.page_text(F.col("revision")).alias("text"))
    timed = slim.withWatermark("fetched_at", late).dropDuplicatesWithinWatermark(["raw_id"])
    links = with_links(timed).select("title", F.explode("links").alias("l")).select("title", "l.target", F.col("l.title").alias("link_title"))
    return links.filter((F.col("target") != "") & (F.col("target") != F.col("title")))


def windowed_counts(records: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(start, n_records, n_redirects) for windows of the event time; records later than ``late`` are left out."""
    timed = records.filter("fetched_at IS NOT NULL").withWatermark("fetched_at", late)
    counts = timed.groupBy(F.window("fetched_at", window).alias("w")).agg(
        F.count(F.lit(1)).alias("n_records"), F.count_if(F.coalesce(F.col("redirect._title"), F.lit("")) != "").alias("n_redirects")
    )
    return counts.select(F.col("w.start").alias("start"), "n_records", "n_redirects")
