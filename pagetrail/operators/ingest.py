"""From page records to pages, links and counters."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from pagetrail.functions import wikitext as W
from pagetrail.operators.graph import LinkGraph
from pagetrail.plans.scratch import Scratch


def parse_link(text: str) -> tuple[str, str | None, str | None]:
    """(target, anchor, title) of the inside of a link; anchor and title are None where not written."""
    body, bar, title = text.removeprefix(":").partition("|")
    target, mark, anchor = body.partition("#")
    if "a" <= target[:1] <= "z":
        target = target[0].upper() + target[1:]
    return target, anchor if mark else None, title if bar else None


def extract_links(text: str | None) -> list[tuple[int, str, str | None, str | None]]:
    """(place, target, anchor, title) of every closed link, in the order in which they close.

    Links nest; an inner one closes first. A closing mark without an open link is text, as is an opening one
    that is never closed.
    """
    out: list[tuple[int, str, str | None, str | None]] = []
    if not text or "[[" not in text:
        return out
    opened: list[int] = []
    at = 0
    while True:
        a, b = text.find("[[", at), text.find("]]", at)
        if b < 0:
            return out
        if 0 <= a < b:
            opened.append(a + 2)
            at = a + 2
            continue
        if opened:
            out.append((len(out), *parse_link(text[opened.pop() : b])))
        at = b + 2


_LINK = pa.struct([("place", pa.int32()), ("target", pa.string()), ("anchor", pa.string()), ("title", pa.string())])


#: Bytes of text that are taken out of a batch at once; a longer text is taken alone.
PORTION = 1 << 24


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(whole.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < whole.num_rows or not whole.num_rows:
            end = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + PORTION, "right")))
            batch = whole.slice(start, end - start)
            found = [[dict(zip(("place", "target", "anchor", "title"), link)) for link in extract_links(t)] for t in batch.column("text").to_pylist()]
            batch = batch.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(_LINK))], names=[*batch.schema.names, "links"])
            start = end
            if not whole.num_rows:
                break


def with_links(pages: DataFrame, text: str = "text") -> DataFrame:
    """Replace the text column by ``links``: an array of (place, target, anchor, title)."""
    others = [c for c in pages.columns if c != text]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*others).schema.fields)
    shape = "links array<struct<place: int, target: string, anchor: string, title: string>>"
    return pages.select(*others, F.col(text).alias("text")).mapInArrow(_links, f"{fields}, {shape}")


def inclusion(title: Column, ns: Column, redirect: Column) -> Column:
    """Why a record is left out, tested in this order: 'title', 'redirect', 'ns' (unparsable), 'namespace'; null if included."""
    number = W.namespace_number(ns)
    return (
        F.when(F.coalesce(title, F.lit("")) == "", "title")
        .when(F.coalesce(redirect, F.lit("")) != "", "redirect")
        .when(number.isNull(), "ns")
        .when(number != 0, "namespace")
    )


class Ingest:
    """Index a table of page records.

    ``records``: title, ns, redirect STRUCT<_title>, revision ARRAY<STRUCT<text>>, and the columns that give
    their document order. Pages get the ids 1, 2, ... in that order. Dense numbering takes the size of each
    range of records first and adds the offsets, so no task sees all records.
    """

    def __init__(self, records: DataFrame, order: list[str], page_id: str | None = None):
        """``page_id`` names a column of ids to keep instead of numbering anew."""
        self.spark = records.sparkSession
        self.scratch = Scratch(self.spark)
        left_out = inclusion(F.col("title"), F.col("ns"), F.col("redirect._title"))
        flat = records.select(*order, *([page_id] if page_id else []), "title", left_out.alias("left_out"), W.page_text(F.col("revision")).alias("text"))
        self.flat = flat
        included = flat.filter("left_out IS NULL")
        lead = F.min(F.struct(*order, *([page_id] if page_id and page_id not in order else []))).alias("lead")
        first = included.groupBy("title").agg(lead).select("lead.*", "title")
        numbered = first.withColumn("page_id", F.col(page_id)) if page_id else self._number(first, order)
        self.numbered = self.scratch.write(numbered.select(*order, "page_id", "title"), "pages")
        self.pages = self.numbered.select("page_id", "title")
        self._included, self._order = included, order

    @cached_property
    def raw_links(self) -> DataFrame:
        """(page_id, title, links) of every indexed page, all closed links in order."""
        found = with_links(self._included.select(*self._order, "text"))  # texts stay where they are; their links move
        keyed = found.join(self.numbered, self._order).select("page_id", "title", "links")
        return self.scratch.write(keyed, "raw")

    @cached_property
    def links(self) -> DataFrame:
        each = self.raw_links.select("page_id", F.col("title").alias("page_title"), F.explode("links").alias("l")).select("page_id", "page_title", "l.*")
        real = each.filter((F.col("target") != "") & (F.col("target") != F.col("page_title")))
        kept = real.groupBy("page_id", "target").agg(F.min(F.struct("place", "title")).alias("first"))
        to = self.pages.select(F.col("page_id").alias("to_page_id"), F.col("title").alias("target"))
        links = kept.join(to, "target").select(F.col("page_id").alias("from_page_id"), "to_page_id", F.col("first.title").alias("title"))
        return self.scratch.write(links, "links")

    def _number(self, rows: DataFrame, order: list[str]) -> DataFrame:
        ranged = self.scratch.write(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "ranged")
        sizes = {r.part: r.n for r in ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a partition
        offsets, total = [], 0
        for part in sorted(sizes):
            offsets.append((part, total))
            total += sizes[part]
        offset = self.spark.createDataFrame(offsets, "part int, before bigint")
        place = F.row_number().over(Window.partitionBy("part").orderBy(*order))
        return ranged.join(F.broadcast(offset), "part").withColumn("page_id", (place + F.col("before")).cast("bigint"))

    def counts(self) -> DataFrame:
        """One row: included_pages, excluded_pages, total_links, unique_valid_links.

        Records with an unparsable namespace and repeated titles are in neither of the first two.
        """
        left = self.flat.select(F.count_if(F.col("left_out").isin("title", "redirect", "namespace")).alias("excluded_pages"))
        seen = self.raw_links.select(F.count(F.lit(1)).alias("included_pages"), F.coalesce(F.sum(F.size("links")), F.lit(0)).cast("bigint").alias("total_links"))
        valid = self.links.select(F.count(F.lit(1)).alias("unique_valid_links"))
        one = F.lit(1).alias("k")
        return (
            seen.select("*", one).join(left.select("*", one), "k").join(valid.select("*", one), "k")
            .select("included_pages", "excluded_pages", "total_links", "unique_valid_links")
        )

    def graph(self) -> LinkGraph:
        return LinkGraph(self.pages, self.links, clean=True)
