"""Items that appear together: exact pair counts against a bipartite configuration null.

Counts are exact. Items too rare to reach the least count, or too frequent to reach the least lift, are
dropped before pairs are made, which removes no pair of the result. Where baskets hold at most ``max_basket`` items
by definition, a basket's pairs are bounded; they are combined within each batch, so only
partial counts reach the shuffle.

Without ``max_basket`` all baskets count, and the pairs of a large one don't fit in a task. Items are then hashed into blocks of
about ``BLOCK``, and two blocks make a tile. A basket sends each tile the items it has in the two blocks, so a basket of k items
sends the smaller of k^2 and k times the number of blocks, and a pair is counted in one tile alone: no pair is shuffled.

The null model is the bipartite configuration model: item i is in basket b with probability
x_i y_b / (1 + x_i y_b), independently, and the x and y are fitted so every item has its observed number of
baskets and every basket its observed size in expectation. Items of one frequency share their x and baskets of
one size their y, so the fit works on two histograms. Under the null the count of a pair is Poisson-binomial; its
upper tail comes from the saddlepoint of the exact cumulant function, with the lattice correction. The
Benjamini-Hochberg procedure over all pairs of items gives each pair a q value; it runs on a histogram
of log p whose bins err on the safe side by at most a factor 10^(1/64).

Nulls and rows whose ends are equal are ignored, repeated rows count once; an empty table gives no pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrail.plans.scratch import Scratch, partitions

#: Numbers of the probability table that are held at once.
CELLS = 1 << 22
BIN = 64
#: Items of a block, in the mean. A tile's counts are an array of the square of it.
BLOCK = 1024
#: Items that a tile gathers before it adds them to its counts.
PORTION = 1 << 20


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, na, nb, c): the pairs of each batch of baskets, already counted."""
    corners: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        items = batch.column("items")
        flat = items.flatten()
        ids, ns = flat.field("item").to_numpy(), flat.field("n").to_numpy()
        offsets = items.offsets.to_numpy() - items.offsets[0].as_py()
        known, at = np.unique(ids, return_index=True)
        code, width, freq = np.searchsorted(known, ids), len(known), ns[at]
        packed: list[np.ndarray] = []
        size = 0
        sums: list[tuple[np.ndarray, np.ndarray]] = []
        for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            k = hi - lo
            if k < 2:
                continue
            if k not in corners:
                corners[k] = np.triu_indices(k, 1)
            own = np.sort(code[lo:hi])
            i, j = corners[k]
            packed.append(own[i] * width + own[j])
            size += len(i)
            if size > 2_000_000:
                sums.append(np.unique(np.concatenate(packed), return_counts=True))
                packed, size = [], 0
        if packed:
            sums.append(np.unique(np.concatenate(packed), return_counts=True))
        for pair, c in sums:
            a, b = pair // width, pair % width
            yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)) for v in (known[a], known[b], freq[a], freq[b], c)], names=["a", "b", "na", "nb", "c"])


_PART = "tile bigint, a array<bigint>, na array<bigint>, b array<bigint>, nb array<bigint>"


def _spread(batches: Iterator[pa.RecordBatch], blocks: int) -> Iterator[pa.RecordBatch]:
    """For every two blocks in which a basket has items, those items; b is empty within one block."""
    names = ["tile", "a", "na", "b", "nb"]
    kinds = [pa.int64()] + [pa.list_(pa.int64())] * 4
    out: list[list] = [[] for _ in names]
    held = 0
    for batch in batches:
        items = batch.column("items")
        flat = items.flatten()
        block, ids, ns = (flat.field(k).to_numpy() for k in ("block", "item", "n"))
        offsets = items.offsets.to_numpy() - items.offsets[0].as_py()
        for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            order = np.argsort(block[lo:hi], kind="stable") + lo
            own, item, n = block[order], ids[order], ns[order]
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]).tolist()
            parts = [(int(own[f]), item[f:e], n[f:e]) for f, e in zip(first, [*first[1:], hi - lo])]
            for i, (p, a, na) in enumerate(parts):
                for q, b, nb in parts[i:]:
                    if p == q and len(a) < 2:
                        continue
                    within = p == q
                    for column, value in zip(out, (p * blocks + q, a, na, b[:0] if within else b, nb[:0] if within else nb)):
                        column.append(value)
                    held += len(a) + len(b)
                    if held > PORTION:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)
                        out, held = [[] for _ in names], 0
    if out[0]:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)


class _Tile:
    """The counts of one tile; rows and columns grow with the items that come."""

    def __init__(self) -> None:
        self.items: list[np.ndarray] = [np.empty(0, np.int64)] * 2
        self.ns: list[np.ndarray] = [np.empty(0, np.int64)] * 2
        self.counts = np.zeros((0, 0), np.int32)
        self.waiting: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> None:
        self.waiting.append((a, na, b, nb) if len(b) else (a, na, a, na))
        self.held += len(a) + len(b)
        if self.held > PORTION:
            self.fold()

    def fold(self) -> None:
        if not self.waiting:
            return
        places = []
        for side in (0, 1):
            come = np.concatenate([w[2 * side] for w in self.waiting])
            n = np.concatenate([w[2 * side + 1] for w in self.waiting])
            known, at = np.unique(np.concatenate([self.items[side], come]), return_index=True)
            old = np.searchsorted(known, self.items[side])
            self.ns[side] = np.concatenate([self.ns[side], n])[at]
            self.items[side] = known
            places.append((old, np.searchsorted(known, come)))
        grown = np.zeros((len(self.items[0]), len(self.items[1])), np.int32)
        grown[np.ix_(places[0][0], places[1][0])] = self.counts
        i = j = 0
        for a, _, b, _ in self.waiting:
            grown[places[0][1][i : i + len(a), None], places[1][1][j : j + len(b)]] += 1
            i, j = i + len(a), j + len(b)
        self.counts, self.waiting, self.held = grown, [], 0

    def rows(self, within: bool) -> Iterator[pa.RecordBatch]:
        self.fold()
        step = max(1, (1 << 16) // max(1, self.counts.shape[1]))
        for lo in range(0, len(self.counts), step):
            some = self.counts[lo : lo + step]
            i, j = np.nonzero(some)
            c, i = some[i, j].astype(np.int64), i + lo
            a, b, na, nb = self.items[0][i], self.items[1][j], self.ns[0][i], self.ns[1][j]
            if within:
                a, b, na, nb, c = (v[a < b] for v in (a, b, na, nb, c))
            turn = a > b
            a, b, na, nb = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, nb, na), np.where(turn, na, nb)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (a, b, na, nb, c)], names=["a", "b", "na", "nb", "c"])


def _count_tiles(batches: Iterator[pa.RecordBatch], blocks: int) -> Iterator[pa.RecordBatch]:
    """(a, b, na, nb, c) of whole tiles; the parts of a tile follow each other."""
    now, tile = None, _Tile()
    for batch in batches:
        lists = []
        for name in ("a", "na", "b", "nb"):
            column = batch.column(name)
            lists.append((column.flatten().to_numpy(), (column.offsets.to_numpy() - column.offsets[0].as_py()).tolist()))
        for k, at in enumerate(batch.column("tile").to_pylist()):
            if at != now:
                if now is not None:
                    yield from tile.rows(now // blocks == now % blocks)
                now, tile = at, _Tile()
            tile.add(*(flat[ends[k] : ends[k + 1]] for flat, ends in lists))
    if now is not None:
        yield from tile.rows(now // blocks == now % blocks)


class Null:
    """The fitted model over classes of item frequency and of basket size."""

    def __init__(self, frequency: dict[int, int], size: dict[int, int]):
        d = np.array(sorted(frequency), float)
        m = np.array([frequency[int(k)] for k in d], float)
        self.degree = d
        self.sizes = np.array(sorted(size), float)
        self.baskets = np.array([size[int(k)] for k in self.sizes], float)
        total = max((m * d).sum(), 1.0)
        x, y = d / math.sqrt(total), self.sizes / math.sqrt(total)
        step = max(1, CELLS // max(1, len(y)))
        for _ in range(2000):
            old, x = x, np.empty_like(x)
            mass = np.zeros_like(y)
            for at in range(0, len(x), step):  # rows of the table one portion after the other, never the whole
                part = slice(at, at + step)
                x[part] = d[part] / np.maximum((self.baskets * y / (1 + old[part, None] * y)).sum(axis=1), 1e-300)
                mass += ((m[part] * x[part])[:, None] / (1 + x[part, None] * y)).sum(axis=0)
            y = self.sizes / np.maximum(mass, 1e-300)
            if np.max(np.abs(x - old) / np.maximum(x, 1e-300), initial=0) < 1e-10:
                break
        self.x, self.y = x, y

    def rows(self, n: np.ndarray) -> np.ndarray:
        """The probabilities of items with frequencies n, by basket class."""
        xy = self.x[np.searchsorted(self.degree, n)][:, None] * self.y
        return xy / (1 + xy)

    def surprise(self, na: np.ndarray, nb: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(expected count, log10 of the probability of c or more) for each pair."""
        q = np.minimum(self.rows(na) * self.rows(nb), 1 - 1e-12)
        return (q * self.baskets).sum(axis=1), tail(q, self.baskets, c.astype(float))


def tail(q: np.ndarray, times: np.ndarray, c: np.ndarray) -> np.ndarray:
    """log10 P(X >= c), X a sum of ``times``[k] Bernoulli variables with q[row, k] each."""
    mean = (q * times).sum(axis=1)
    var = np.maximum((q * (1 - q) * times).sum(axis=1), 1e-300)
    third = (q * (1 - q) * (1 - 2 * q) * times).sum(axis=1)
    top = times.sum()
    x = np.clip(c, 1e-9, top - 1e-9)
    s = np.log(x / np.maximum(mean, 1e-300))
    low, high = np.full(len(s), -60.0), np.full(len(s), 700.0)
    for _ in range(60):
        e = np.exp(np.minimum(s, 650))[:, None]
        r = q * e / (1 - q + q * e)
        k1, k2 = (r * times).sum(axis=1), (r * (1 - r) * times).sum(axis=1)
        low, high = np.where(k1 < x, s, low), np.where(k1 >= x, s, high)
        step = s - (k1 - x) / np.maximum(k2, 1e-300)
        new = np.where((step > low) & (step < high), step, (low + high) / 2)
        if np.max(np.abs(new - s), initial=0) < 1e-10:
            s = new
            break
        s = new
    e = np.exp(np.minimum(s, 650))[:, None]
    r = q * e / (1 - q + q * e)
    k0 = (np.log1p(q * (e - 1)) * times).sum(axis=1)
    k2 = np.maximum((r * (1 - r) * times).sum(axis=1), 1e-300)
    w = np.sign(s) * np.sqrt(np.maximum(2 * (s * x - k0), 0))
    u = -np.expm1(-s) * np.sqrt(k2)
    with np.errstate(divide="ignore", invalid="ignore"):
        inner = _mills(w) + 1 / u - 1 / w
        log = -0.5 * w * w - 0.5 * math.log(2 * math.pi) + np.log(np.maximum(inner, 1e-300))
    near = np.abs(s) < 1e-4
    middle = 0.5 - third / (6 * math.sqrt(2 * math.pi) * var**1.5) + 0.5 / np.sqrt(2 * math.pi * var)
    log = np.where(near, np.log(np.clip(middle, 1e-300, 1)), log)
    return np.where(c <= 0, 0.0, np.minimum(log, 0.0) / math.log(10))


def _mills(w: np.ndarray) -> np.ndarray:
    """(1 - Phi(w)) / phi(w)."""
    out = np.empty_like(w)
    far = w > 12
    z = 1 / np.square(w[far])
    out[far] = (1 - z * (1 - 3 * z * (1 - 5 * z * (1 - 7 * z)))) / w[far]
    rest = np.maximum(w[~far], -37)
    out[~far] = [0.5 * math.erfc(v / math.sqrt(2)) * math.sqrt(2 * math.pi) * math.exp(0.5 * v * v) for v in rest.tolist()]
    return out


def _score(batches: Iterator[pa.RecordBatch], model: Broadcast) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        na, nb, c = (batch.column(k).to_numpy() for k in ("na", "nb", "c"))
        lo, hi = np.minimum(na, nb), np.maximum(na, nb)
        kinds, back = np.unique(np.stack([lo, hi, c], axis=1), axis=0, return_inverse=True)
        back = back.reshape(-1)
        expected, log = (np.empty(len(kinds)) for _ in range(2))
        step = max(1, min(20_000, CELLS // max(1, len(model.value.y))))
        for at in range(0, len(kinds), step):
            expected[at : at + step], log[at : at + step] = model.value.surprise(*kinds[at : at + step].T)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(expected[back]), pa.array(log[back])], names=[*batch.schema.names, "expected", "log10_p"])


class TogetherCounts:
    def __init__(self, links: DataFrame, basket: str = "from_page_id", item: str = "to_page_id", max_basket: int | None = 200):
        """``max_basket``: larger baskets are left out; None takes all."""
        self.spark = links.sparkSession
        self.scratch = Scratch(self.spark)
        pair = links.select(F.col(basket).cast("bigint").alias("basket"), F.col(item).cast("bigint").alias("item"))
        pair = pair.dropna().filter("basket <> item").distinct()
        size = pair.groupBy("basket").agg(F.count(F.lit(1)).alias("size"))
        if max_basket is not None:
            size = size.filter(F.col("size") <= max_basket)
        self.bounded = max_basket is not None
        self.pairs = self.scratch.write(pair.join(size, "basket"), "members")
        self.items = self.scratch.write(self.pairs.groupBy("item").agg(F.count(F.lit(1)).alias("n")), "items")
        sizes = self.pairs.groupBy("size").agg((F.count(F.lit(1)) / F.col("size")).cast("bigint").alias("n")).collect()
        self.sizes = {r["size"]: r.n for r in sizes}  # at most max_basket rows, else the root of twice the memberships
        self.n_baskets = sum(self.sizes.values())

    def counts(self, min_count: int = 2, min_lift: float = 0.0) -> DataFrame:
        """(a, b, na, nb, c), a < b, for every pair in at least ``min_count`` baskets."""
        able = self.items.filter((F.col("n") >= min_count) & (F.col("n") * min_lift <= self.n_baskets))
        if not self.bounded:
            return self._tiled(able).filter((F.col("c") >= min_count) & (F.col("c") * self.n_baskets >= F.col("na") * F.col("nb") * min_lift))
        sets = self.pairs.join(able, "item").groupBy("basket").agg(F.collect_list(F.struct("item", "n")).alias("items"))
        sets = sets.filter(F.size("items") > 1).select("items")
        made = sets.mapInArrow(_count_pairs, "a bigint, b bigint, na bigint, nb bigint, c bigint")
        total = made.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.sum("c").alias("c"))
        return total.filter((F.col("c") >= min_count) & (F.col("c") * self.n_baskets >= F.col("na") * F.col("nb") * min_lift))

    def _tiled(self, able: DataFrame) -> DataFrame:
        blocks = max(1, -(-self.items.count() // BLOCK))
        block = F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block")
        sets = self.pairs.join(able, "item").groupBy("basket").agg(F.collect_list(F.struct(block, "item", "n")).alias("items"))
        parts = sets.filter(F.size("items") > 1).select("items").mapInArrow(lambda it: _spread(it, blocks), _PART)
        tiles = parts.repartition(max(partitions(self.spark), blocks * (blocks + 1) // 32), "tile").sortWithinPartitions("tile")
        return tiles.mapInArrow(lambda it: _count_tiles(it, blocks), "a bigint, b bigint, na bigint, nb bigint, c bigint")

    def surprising(self, min_count: int = 2, min_lift: float = 0.0) -> DataFrame:
        """``counts`` with lift, expected, log10_p and q_value.

        Pairs that are not counted (fewer than ``min_count``, or less than ``min_lift``) take part in the number of
        tests and in no rank, so q values are never too small.
        """
        # different frequencies: at most the root of twice the memberships
        frequency = {r.n: r.m for r in self.items.groupBy("n").agg(F.count(F.lit(1)).alias("m")).collect()}
        model = self.spark.sparkContext.broadcast(Null(frequency, self.sizes)) if frequency else None
        fields = "a bigint, b bigint, na bigint, nb bigint, c bigint, expected double, log10_p double"
        if model is None:
            return self.spark.createDataFrame([], fields + ", lift double, q_value double")
        scored = self.counts(min_count, min_lift).mapInArrow(lambda it: _score(it, model), fields)
        scored = self.scratch.write(scored.withColumn("bin", F.least(F.floor(-F.col("log10_p") * BIN), F.lit(1 << 15)).cast("int")), "scored")
        items = sum(frequency.values())
        tests, rank, best, q = items * (items - 1) / 2, 0, 1.0, {}
        bins = {r.bin: r.n for r in scored.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 2^15 + 1 rows
        ranks = {}
        for b in sorted(bins, reverse=True):
            rank += bins[b]
            ranks[b] = rank
        for b in sorted(bins):
            best = min(best, 10 ** (-b / BIN) * tests / ranks[b])
            q[b] = best
        table = self.spark.createDataFrame(list(q.items()), "bin int, q_value double")
        lift = F.col("c") * F.lit(self.n_baskets).cast("double") / (F.col("na") * F.col("nb"))
        return scored.withColumn("lift", lift).join(F.broadcast(table), "bin").drop("bin")
