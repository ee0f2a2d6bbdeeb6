"""Filling containers: vector bin packing by the dot-product heuristic.

An item has three sizes: tokens, segments (one for each text) and loss-bearing tokens, those after its prompt.
A container has a limit on each. It is filled with the item whose sizes, in shares of the limits, have
the largest dot product with what the container has left, each dimension weighted by its average demand,
until nothing fits; then the next one is opened. Items of equal sizes are one kind with a count.

A text longer than the capacity gives full pieces, each a container of its own, and a last piece that
is packed; no other text is split. Items are spread over shards of about ``shard`` items by a
hash of their id, so shards don't grow with the data or with a key. A container is done when it is filled to ``refill`` in one
of the three respects, or has less room than the smallest item of its shard takes. The others are opened again once and packed together
with those of fifteen other shards; then all are closed. So no task ever holds more than 16 shards.

An item whose own loss exceeds the limit on loss is not split for it: it counts as much as the limit, so no other
loss-bearing item joins it, and its true loss is given.

Null and empty texts have no tokens and get no container. Repeated ids are separate items.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrail.llm.tokens import VOCABULARY, token_sizes
from pagetrail.plans.scratch import Scratch

SHARD = 4096
#: A container takes one segment for so many tokens of capacity, and this share of them as loss-bearing tokens.
SEGMENT_TOKENS, LOSS_SHARE = 16, 0.9
#: Shards whose badly filled containers are packed together.
TOGETHER = 16
#: Groups that one task packs one after the other, in the mean.
A_TASK = 4


def fill(sizes: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The container number of every item; ``sizes`` (items x dimensions) fit ``limits`` one by one."""
    out = np.full(len(sizes), -1, np.int64)
    if not len(sizes):
        return out
    kinds, back, left = np.unique(sizes, axis=0, return_inverse=True, return_counts=True)
    back = back.reshape(-1)
    members = np.argsort(back, kind="stable")
    ends = np.cumsum(left)
    taken = ends - left
    share = kinds / limits
    weight = (share * left[:, None]).mean(axis=0)
    weight = weight / max(weight.sum(), 1e-300)
    weighted = share * weight
    box, rest = 0, limits.astype(float)
    live = np.ones(len(kinds), bool)
    kind_rows, open_rows = kinds.astype(float), np.flatnonzero(live)
    remaining = len(sizes)
    while remaining:
        fits = open_rows[(kind_rows[open_rows] <= rest).all(axis=1)]
        if not len(fits):
            box, rest = box + 1, limits.astype(float)
            open_rows = np.flatnonzero(left > 0)
            continue
        open_rows = fits  # what doesn't fit now will not fit into this container later
        best = fits[np.argmax(weighted[fits] @ (rest / limits))]
        out[members[taken[best]]] = box
        taken[best] += 1
        left[best] -= 1
        remaining -= 1
        rest = rest - kind_rows[best]
        if not left[best]:
            open_rows = open_rows[open_rows != best]
    return out


def _packer(refill: float, last: bool):
    def pack(key: tuple, table: pa.Table) -> pa.Table:
        return _pack(key, table, refill, last)

    return pack


def _pack(key: tuple, table: pa.Table, refill: float, last: bool) -> pa.Table:
    limits = np.array([table.column(c)[0].as_py() for c in ("max_tokens", "max_segments", "max_loss")])
    tokens, losses = table.column("tokens").to_numpy(), table.column("loss_tokens").to_numpy()
    order = np.lexsort((table.column("piece").to_numpy(), table.column("doc_id").to_numpy()))  # rows come in any order
    sizes = np.stack([tokens, np.ones(len(tokens), np.int64), np.minimum(losses, limits[2])], axis=1)[order]
    box = np.empty(len(order), np.int64)
    number = fill(sizes, limits)
    box[order] = number
    used = np.stack([np.bincount(number, sizes[:, d]) for d in range(3)], axis=1)
    # full in one respect, or with less room than any item here would take
    done = np.ones(len(used), bool) if last else ((used >= refill * limits) | (limits - used < sizes.min(axis=0))).any(axis=1)
    shard = key[1].as_py()
    table = table.drop_columns(["container_id", "packed"])
    return table.append_column("container_id", pa.array(shard * (1 << 24) + box)).append_column("packed", pa.array(done[box]))


FIELDS = "pack_name string, shard bigint, doc_id bigint, piece bigint, start bigint, tokens bigint, loss_tokens bigint, max_tokens bigint, max_segments bigint, max_loss bigint"


def containers(
    documents: DataFrame,
    packs: DataFrame,
    vocabulary: str = VOCABULARY,
    shard: int = SHARD,
    segment_tokens: int = SEGMENT_TOKENS,
    loss_share: float = LOSS_SHARE,
    refill: float = 0.98,
) -> DataFrame:
    """(pack_name, container_id, doc_id, piece, start, tokens, loss_tokens): every text in every size of container.

    ``packs``: pack_name and max_tokens, a small table. A container takes ``max_tokens`` tokens,
    one segment for every ``segment_tokens`` of them and ``loss_share`` of them as loss-bearing tokens. Packs with a null or non-positive capacity are left out.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark)
    sizes = scratch.write(token_sizes(documents, vocabulary).filter("tokens > 0"), "sizes")
    shards = max(1, -(-sizes.count() // shard))
    limits = [
        (r.pack_name, int(r.max_tokens), max(1, int(r.max_tokens) // segment_tokens), max(1, int(r.max_tokens * loss_share)))
        for r in packs.filter("max_tokens > 0").select("pack_name", "max_tokens").collect()  # one row a capacity
    ]
    names = ("pack_name", "max_tokens", "max_segments", "max_loss")
    each = [F.struct(*(F.lit(v).cast("bigint" if i else "string").alias(n) for i, (n, v) in enumerate(zip(names, row)))) for row in limits]
    none = F.array().cast("array<struct<pack_name: string, max_tokens: bigint, max_segments: bigint, max_loss: bigint>>")
    n_full = F.floor(F.col("tokens") / F.col("max_tokens"))
    whole = sizes.withColumn("pack", F.explode(F.array(*each) if each else none)).select("*", "pack.*")
    pieces = whole.withColumn("full", n_full).withColumn(
        "piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full") - F.when(F.col("full") * F.col("max_tokens") == F.col("tokens"), 1).otherwise(0)))
    )
    start = F.col("piece") * F.col("max_tokens")
    size = F.least("max_tokens", F.col("tokens") - start)
    pieces = pieces.select(
        "pack_name",
        F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard"),
        "doc_id",
        "piece",
        start.alias("start"),
        size.alias("tokens"),
        F.greatest(F.lit(0), size - F.greatest(F.lit(0), F.col("prompt_tokens") - start)).alias("loss_tokens"),
        "max_tokens",
        "max_segments",
        "max_loss",
    )
    out = ["pack_name", "container_id", "doc_id", "piece", "start", "tokens", "loss_tokens"]
    alone = pieces.filter("tokens = max_tokens").withColumn(
        "container_id", -1 - F.pmod(F.xxhash64("doc_id", "piece"), F.lit(1 << 62))
    )
    todo = pieces.filter("tokens < max_tokens")
    done = []
    for level, last in enumerate((False, True)):
        todo = todo.withColumn("container_id", F.lit(0).cast("bigint")).withColumn("packed", F.lit(False))
        # a task for a few groups: packing takes long for its few bytes, so merging tasks by their bytes would be wrong
        groups = len(limits) * (-(-shards // TOGETHER) if last else shards)
        spread = todo.repartition(max(1, -(-groups // A_TASK)), "pack_name", "shard")
        packed = spread.groupBy("pack_name", "shard").applyInArrow(_packer(refill, last), FIELDS + ", container_id bigint, packed boolean")
        packed = scratch.write(packed, f"level{level}")
        done.append(packed.filter("packed").withColumn("container_id", F.col("container_id") + (level << 56)))
        todo = packed.filter("not packed").drop("container_id", "packed").withColumn("shard", F.floor(F.col("shard") / TOGETHER))
    result = alone.select(out)
    for part in done:
        result = result.unionByName(part.select(out))
    return result


def boxes(placed: DataFrame, packs: DataFrame, segment_tokens: int = SEGMENT_TOKENS, loss_share: float = LOSS_SHARE) -> DataFrame:
    """One row a container of ``containers``: its sums, its limits, and its largest item's loss."""
    limits = packs.filter("max_tokens > 0").select(
        "pack_name", F.col("max_tokens").cast("bigint").alias("max_tokens"), F.greatest(F.lit(1), F.floor(F.col("max_tokens") / segment_tokens)).alias("max_segments"), F.greatest(F.lit(1), F.floor(F.col("max_tokens") * loss_share)).alias("max_loss")
    )
    sums = placed.groupBy("pack_name", "container_id").agg(
        F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("segments"), F.sum("loss_tokens").alias("loss"), F.max("loss_tokens").alias("own_loss")
    )
    return sums.join(F.broadcast(limits), "pack_name")  # one row a capacity


def report(placed: DataFrame, packs: DataFrame) -> DataFrame:
    """One row a capacity: containers, the least number any packing needs, mean fill, and what the fullest one holds."""
    least = F.greatest(*(F.ceil(F.sum(F.least(size, limit)) / F.first(limit)) for size, limit in ((F.col("tokens"), F.col("max_tokens")), (F.col("segments"), F.col("max_segments")), (F.col("loss"), F.col("max_loss")))))
    return boxes(placed, packs).groupBy("pack_name").agg(
        F.count(F.lit(1)).alias("containers"),
        least.alias("least_containers"),
        (F.sum("tokens") / F.sum("max_tokens")).alias("mean_fill"),
        F.sum("tokens").alias("tokens"),
        F.max("tokens").alias("most_tokens"),
        F.max("segments").alias("most_segments"),
        F.max("loss").alias("most_loss"),
        F.count_if(F.col("tokens") >= 0.98 * F.col("max_tokens")).alias("full_by_tokens"),
        F.count_if(F.col("segments") == F.col("max_segments")).alias("full_by_segments"),
        F.count_if(F.col("loss") >= 0.98 * F.col("max_loss")).alias("full_by_loss"),
    )


def rules(placed: DataFrame, packs: DataFrame) -> DataFrame:
    """One row a capacity: texts placed, and how often each rule is broken, which is never.

    A container's sums keep its limits (loss: or it is one item's own); a text that fits is one piece; the pieces of a text follow each other
    without a gap, and all but the last fill a container.
    """
    broken = boxes(placed, packs).groupBy("pack_name").agg(
        F.count_if(F.col("tokens") > F.col("max_tokens")).alias("over_tokens"),
        F.count_if(F.col("segments") > F.col("max_segments")).alias("over_segments"),
        F.count_if(F.col("loss") > F.greatest("max_loss", "own_loss")).alias("over_loss"),
    )
    text = placed.groupBy("pack_name", "doc_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("pieces"), F.max(F.col("start") + F.col("tokens")).alias("reach"))
    text = text.join(F.broadcast(packs.select("pack_name", "max_tokens")), "pack_name")
    split = text.groupBy("pack_name").agg(
        F.count(F.lit(1)).alias("texts"),
        F.count_if((F.col("tokens") <= F.col("max_tokens")) & (F.col("pieces") > 1)).alias("wrongly_split"),
        F.count_if((F.col("reach") != F.col("tokens")) | (F.col("pieces") != F.ceil(F.col("tokens") / F.col("max_tokens")))).alias("gaps"),
    )
    return split.join(broken, "pack_name")
