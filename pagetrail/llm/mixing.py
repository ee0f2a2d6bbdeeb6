"""Mixing sources to target weights: cube-method balanced sampling.

The total is the largest one whose shares every source can serve within its repeats. A source then has
to contribute r times its tokens: each of its documents is taken floor(r) times for certain and once more with
probability r - floor(r). Which ones is drawn by the cube method. The flight phase moves the vector of
inclusion probabilities along the null space of the constraints, here a source's token total and its number of
documents, until a coordinate reaches 0 or 1, again and again; both totals stay as they are in every step, so
at most two documents of a block are left undecided. Blocks have a bounded size; what they leave undecided is
put together into new blocks, down to one per source. The landing decides its last two documents so that
the tokens come closest. A long document would be among those last two, so documents of more than
``GIANT`` times a source's mean are decided first, and the probability of all others makes up for the tokens
by which the giants' landing missed.

Null ids, null or unlisted sources and texts without tokens take no part; a target with a null or
non-positive share, or without repeats, takes none. A target without documents can
give nothing; the others keep their proportions, and the report shows its 0. Source names are compared trimmed and in lower case; where a target is
listed twice, the shares add up and the lower number of repeats holds.
"""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrail.llm.tokens import VOCABULARY, token_sizes
from pagetrail.plans.scratch import Scratch

BLOCK = 2048
GIANT = 4
TINY = 1e-9


def flight(p: list[float], size: list[int], rng: random.Random) -> list[float]:
    """Move p to where at most two coordinates lie strictly between 0 and 1, keeping sum p and sum p * size."""
    p = list(p)
    active: list[int] = []
    for k in range(len(p)):
        if TINY < p[k] < 1 - TINY:
            active.append(k)
        while len(active) == 3:
            i, j, m = active
            u = (size[m] - size[j], size[i] - size[m], size[j] - size[i])
            if not any(u):
                u = (1, -1, 0)
            up = min((1 - p[a]) / d if d > 0 else -p[a] / d for a, d in zip(active, u) if d)
            down = min(p[a] / d if d > 0 else (p[a] - 1) / d for a, d in zip(active, u) if d)
            step = up if rng.random() * (up + down) < down else -down
            for a, d in zip(active, u):
                p[a] = min(1.0, max(0.0, p[a] + step * d))
            active = [a for a in active if TINY < p[a] < 1 - TINY]
    return [0.0 if x <= TINY else 1.0 if x >= 1 - TINY else x for x in p]


def landing(p: list[float], size: list[int]) -> list[float]:
    """Decide the undecided (at most two) so the token total comes closest to its expectation."""
    left = [k for k, x in enumerate(p) if 0 < x < 1]
    want = sum(p[k] * size[k] for k in left)
    best = min(range(1 << len(left)), key=lambda bits: (abs(sum(size[k] for i, k in enumerate(left) if bits >> i & 1) - want), bits))
    out = list(p)
    for i, k in enumerate(left):
        out[k] = float(best >> i & 1)
    return out


def _flier(last: bool, seed: int):
    def fly(key: tuple, table: pa.Table) -> pa.Table:
        return _fly(key, table, last, seed)

    return fly


def _fly(key: tuple, table: pa.Table, last: bool, seed: int) -> pa.Table:
    rows = table.sort_by([("doc_id", "ascending"), ("tokens", "ascending")])  # rows come in any order
    rng = random.Random(f"{seed} {key[0].as_py()} {key[1].as_py()}")
    order = list(range(rows.num_rows))
    rng.shuffle(order)
    rows = rows.take(pa.array(order))
    size = rows.column("tokens").to_pylist()
    p = flight(rows.column("p").to_pylist(), size, rng)
    if last:
        p = landing(p, size)
    return rows.set_column(rows.schema.get_field_index("p"), "p", pa.array(p, pa.float64()))


class Mixture:
    """``rows``: (doc_id, source, tokens, copies); ``report``: what each source was to give and gave."""

    def __init__(self, documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, block: int = BLOCK, seed: int = 0):
        spark = documents.sparkSession
        scratch = Scratch(spark)
        wanted = (
            targets.select(F.lower(F.trim("source")).alias("source"), F.col("target_share").alias("share"), F.col("max_repeats").alias("most"))
            .filter("source is not null and share > 0 and most > 0")
            .groupBy("source")
            .agg(F.sum("share").alias("share"), F.min("most").alias("most"))
        )
        sizes = token_sizes(documents, vocabulary).filter("tokens > 0 and doc_id is not null").drop("prompt_tokens")
        sizes = scratch.write(sizes.join(F.broadcast(wanted.select("source")), "source"), "sizes")
        have = sizes.groupBy("source").agg(F.sum("tokens").alias("have"), F.count(F.lit(1)).alias("docs"))
        plan = wanted.join(have, "source", "left").collect()  # one row a target
        given = [r for r in plan if r.have]
        listed = sum(r.share for r in plan) or 1.0
        weight = sum(r.share for r in given) or 1.0
        self.total = min((r.most * r.have * weight / r.share for r in given), default=0.0)
        rates = []
        for r in given:
            rate = self.total * r.share / weight / r.have
            base = int(rate + TINY)
            rates.append((r.source, base, rate - base if rate - base > TINY else 0.0, -(-r.docs // block), GIANT * r.have / r.docs))
        table = spark.createDataFrame(rates, "source string, base int, p double, blocks bigint, giant double")
        most = max((r[3] for r in rates), default=1)
        units = sizes.join(F.broadcast(table), "source").withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("blocks")))
        sure, open_ = units.filter("p = 0"), units.filter("p > 0")
        columns = ("doc_id", "source", "tokens", "base", "p", "block")
        giants = self._decide(scratch, open_.filter("tokens > giant").select(*columns), most, block, seed, "giants")
        missed = {r.source: r.n for r in giants.groupBy("source").agg(F.sum(F.col("tokens") * F.col("p")).alias("n")).collect()}
        rest = open_.filter("tokens <= giant")
        totals = open_.groupBy("source").agg(F.sum(F.when(F.col("tokens") > F.col("giant"), F.col("tokens")).otherwise(0)).alias("giants"), F.sum("tokens").alias("all"))
        shift = []
        for t in totals.collect():  # one row a target
            p = next(r[2] for r in rates if r[0] == t.source)
            shift.append((t.source, (p * t.giants - missed.get(t.source, 0.0)) / max(t.all - t.giants, 1)))
        moved = rest.join(F.broadcast(spark.createDataFrame(shift, "source string, shift double")), "source")
        moved = moved.withColumn("p", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("p") + F.col("shift"))))
        others = self._decide(scratch, moved.select(*columns), most, block, seed, "others")
        rows = sure.select(*columns).unionByName(giants).unionByName(others)
        rows = rows.withColumn("copies", (F.col("base") + F.col("p")).cast("int")).filter("copies > 0")
        self.rows = scratch.write(rows.select("doc_id", "source", "tokens", "copies"), "rows")
        given = self.rows.groupBy("source").agg(
            F.count(F.lit(1)).alias("documents"), F.sum("copies").alias("copies"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("repeats")
        )
        total = self.rows.agg(F.sum(F.col("tokens") * F.col("copies"))).first()[0] or 0
        self.report = wanted.join(given, "source", "left").select(
            "source",
            (F.col("share") / listed).alias("target_share"),
            (F.coalesce("tokens", F.lit(0)) / F.lit(float(total or 1))).alias("actual_share"),
            F.coalesce("documents", F.lit(0)).alias("documents"),
            F.coalesce("copies", F.lit(0)).alias("copies"),
            F.coalesce("tokens", F.lit(0)).alias("tokens"),
            F.col("most").alias("max_repeats"),
            F.coalesce("repeats", F.lit(0)).alias("repeats"),
        )

    @staticmethod
    def _decide(scratch: Scratch, todo: DataFrame, most: int, block: int, seed: int, name: str) -> DataFrame:
        """The units with p at 0 or 1: flights over blocks, then over what they leave undecided."""
        schema, level, parts = todo.schema, 0, []
        while True:
            last = most == 1
            flown = scratch.write(todo.groupBy("source", "block").applyInArrow(_flier(last, seed), schema), f"{name}{level}")
            parts.append(flown.filter("p = 0 or p = 1"))
            if last:
                break
            todo = flown.filter("p > 0 and p < 1").withColumn("block", F.floor(F.col("block") / (block // 2)))
            most, level = -(-most // (block // 2)), level + 1
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out
