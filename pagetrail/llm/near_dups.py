"""Near-duplicate records: size-banded tiles with hashed bitmap signatures.

A record is the set of hashes of its runs of consecutive words. Two records with Jaccard similarity t or
more share one of the first n - ceil(t n) + 1 hashes of either set under any fixed order, so records that
share such a hash, and only those, meet. The order puts frequent runs last, which keeps tiles small: frequency is
estimated over all records by one table of ``SLOTS`` counters, so it has a fixed size at every scale. The result doesn't
depend on it.

The records that share such a hash lie sorted by size, so their size bands (a factor 1/t wide) follow each other as tiles; a record
is compared with the rest of its own band and with the adjoining one, as far as t reaches. The hash alone decides the bucket: with
the band in the routing key every hash would have to travel twice, to its own band and to the neighbour. The number of buckets follows the
number of hashes, so a task's share doesn't grow with the input. Among many buckets a record has hardly two hashes in one, so a hash
travels with little more than its place and the record's id and size. A hash far above the usual frequency has its records split into
blocks, and each pair of blocks has tiles of its own. The places of the first common hash of two records bound their overlap.

Candidates are decided where each record comes once for many of its pairs: all candidates around the same smallest
partner share a place, in blocks of ``BLOCK`` records. A pair is first bounded from its two bitmaps, which the first pass
keeps: every hash toggles one bit, so the number of differing bits is at most the size of the symmetric difference, which
bounds the overlap from above. A bitmap has two to four bits for every hash; the wider one of a pair is folded to the width of
the other. Only what is left travels with its hash arrays and is decided by the exact intersection of the two (sorted, 40 bits a hash).

Records whose words are the same in the same order are one class from the first pass on and meet once. ``groups`` doesn't
compare all records of a group: a first round compares each record of a tile with the tile's smallest one only, a second
one compares what is still in different groups.

Nulls and empty texts: no words, no partner. Fewer words than a run: the whole text is the one run.
Ties in size or hash don't matter; repeated ids count as copies of one another and pair with other ids only.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from pagetrail.functions.wikitext import page_text
from pagetrail.llm.batches import portions
from pagetrail.llm.groups import connected_groups
from pagetrail.plans.scratch import Scratch, partitions

WORD = re.compile(r"\w+")
#: The least and the largest width of a bitmap.
BITS, MOST_BITS = 256, 1 << 16
#: Counters that estimate how frequent a run is, and how many of them travel in one row.
SLOTS, SLOT_BLOCK = 1 << 22, 1 << 16
#: Hashes a bucket holds on average, and the frequency above the median from which a tile is split.
BUCKET, SPLIT = 200_000, 20_000
#: Records of one kind that meet in one place when candidates are decided.
BLOCK = 1024
#: Bits of the filters that spare texts without a candidate the last reading, and records without a copy their copy hash; a full one spares none.
FILTER_BITS = 1 << 23
#: Parts of the buckets that can be worked on one after the other, and the number of buckets from which the first part shows how many follow at once.
PARTS, MANY = 16, 256
#: Characters that are cut into words at once.
CHUNK = 1 << 18
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)
_BASE = 0x5851F42D4C957F2D


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def _finish(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(29))


@cache
def _characters() -> np.ndarray:
    """A 64-bit value for every character that belongs to words, 0 for the others."""
    word = np.fromiter((chr(c).isalnum() or c == 95 for c in range(0x110000)), bool, 0x110000)
    return np.where(word, _finish(np.arange(1, 0x110001, dtype=np.uint64) * _MIX[0]) | np.uint64(1), np.uint64(0))


_powers_cache: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2^64."""
    if not _powers_cache or len(_powers_cache[0]) < n:
        size = max(n, 2 * CHUNK)
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        _powers_cache[:] = out
    return _powers_cache[0][:n], _powers_cache[1][:n]


def _word_hashes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of a lower-cased text, and where the words begin."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    value = _characters()[code]
    inside = np.zeros(len(code) + 2, bool)
    np.not_equal(value, 0, out=inside[1:-1])
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = turns[::2], turns[1::2]
    up, down = _powers(len(code))
    total = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(value * up, out=total[1:])
    return _finish((total[ends] - total[starts]) * down[starts] if len(starts) else np.zeros(0, np.uint64)), starts


def _long_word_hashes(text: str) -> np.ndarray:
    """``_word_hashes`` of a long text, cut where no word is."""
    out, start = [], 0
    while start < len(text):
        end = min(len(text), start + CHUNK)
        end = WORD.match(text, end).end() if end < len(text) and WORD.match(text, end) else end
        out.append(_word_hashes(text[start:end])[0])
        start = end
    return np.concatenate(out)


def _words(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, words of a stretch of texts, words in each): stretches of about CHUNK characters."""
    lower = [t.lower() if t else "" for t in texts]
    i = 0
    while i < len(lower):
        if len(lower[i]) > CHUNK:
            words = _long_word_hashes(lower[i])
            yield i, words, np.array([len(words)])
            i += 1
            continue
        j, size = i, 0
        while j < len(lower) and len(lower[j]) <= CHUNK and size <= CHUNK:
            size += len(lower[j]) + 1
            j += 1
        words, starts = _word_hashes("\n".join(lower[i:j]))
        ends = np.cumsum(np.array([len(t) + 1 for t in lower[i:j]]))
        at = np.searchsorted(starts, np.r_[0, ends])
        yield i, words, np.diff(at)
        i = j


class Runs:
    """The distinct hashed runs of a batch of texts.

    ``place``: where each text with enough words is in the batch; ``copy``: the hash of its word sequence;
    ``n``: its number of distinct runs; ``hashes``: the runs, text by text and sorted inside; ``ends``: where each text's end.
    """

    def __init__(self, texts: list[str | None], size: int, min_words: int):
        place, copies, parts, counts = [], [], [], []
        for first, words, lengths in _words(texts):
            ends = np.cumsum(lengths)
            kept = np.flatnonzero((lengths >= min_words) & (lengths > 0))
            place.append(first + kept)
            if not len(kept):
                continue
            h = np.zeros(len(words), np.uint64)
            for j in range(min(size, len(words))):
                h[: len(words) - j] += words[j:] * _MIX[j % 5] + np.uint64(j // 5)
                h = (h << np.uint64(13)) | (h >> np.uint64(51))
            h = _finish(h)
            for i in kept.tolist():
                a, b = int(ends[i] - lengths[i]), int(ends[i])
                copies.append(xxhash.xxh3_64_intdigest(words[a:b].tobytes()))
                if b - a < size:  # a text shorter than a run is one run
                    own = np.array([xxhash.xxh3_64_intdigest(words[a:b].tobytes(), b - a)], np.uint64)
                else:
                    own = h[a : b - size + 1]
                    own.sort()
                parts.append(own)
                counts.append(len(own))
        self.place = np.concatenate(place) if place else np.zeros(0, np.int64)
        self.copy = np.array(copies, np.uint64).view(np.int64)
        flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        count = np.array(counts, np.int64)
        once = np.ones(len(flat), bool)
        once[1:] = flat[1:] != flat[:-1]
        ends = np.cumsum(count)
        once[ends[:-1]] = True
        self.hashes = flat[once]
        upto = np.r_[0, np.cumsum(once)]
        self.ends = upto[ends]
        self.n = self.ends - upto[ends - count]

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n)), self.n)

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.ends[i] - self.n[i] : self.ends[i]]


def prefix_length(n: np.ndarray, t: float) -> np.ndarray:
    return n - np.ceil(t * n - 1e-9).astype(np.int64) + 1


def widths(n: np.ndarray) -> np.ndarray:
    return np.clip(1 << np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64), BITS, MOST_BITS)


def signatures(runs: Runs) -> list[bytes]:
    """A bitmap for each text, of the width its size asks for: every hash toggles one bit."""
    out = []
    for i, w in enumerate(widths(runs.n).tolist()):
        bit = (runs.of(i) & np.uint64(w - 1)).astype(np.int64)
        out.append(np.packbits((np.bincount(bit, minlength=w) & 1).astype(np.uint8), bitorder="little").tobytes())
    return out


def packed(runs: Runs) -> list[bytes]:
    """The upper 40 bits of each text's hashes, ascending, in five bytes each."""
    flat = np.ascontiguousarray((runs.hashes >> np.uint64(24)).view(np.uint8).reshape(-1, 8)[:, :5])
    return [flat[a:b].tobytes() for a, b in zip((runs.ends - runs.n).tolist(), runs.ends.tolist())]


def unpacked(blob: bytes) -> np.ndarray:
    wide = np.zeros((len(blob) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(blob, np.uint8).reshape(-1, 5)
    return wide.view(np.uint64).reshape(-1)


class Bitmaps:
    """Bitmaps of records by width; narrower ones are folded from wider ones when asked for."""

    def __init__(self, n: np.ndarray, packed: list[bytes]):
        self.width = widths(n)
        self.levels: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        order = np.argsort(self.width, kind="stable")
        for w in np.unique(self.width).tolist():
            mine = order[np.searchsorted(self.width[order], w) : np.searchsorted(self.width[order], w, "right")]
            row = np.full(len(n), -1)
            row[mine] = np.arange(len(mine))
            self.levels[w] = row, np.frombuffer(b"".join(packed[i] for i in mine.tolist()), np.uint64).reshape(len(mine), w // 64)

    def _at(self, own: np.ndarray, w: int) -> np.ndarray:
        """The bitmaps of records ``own``, all of width w or more, folded to w."""
        out = np.empty((len(own), w // 64), np.uint64)
        for level in np.unique(self.width[own]).tolist():
            row, bits = self.levels[level]
            mine = self.width[own] == level
            found = bits[row[own[mine]]]
            while found.shape[1] > w // 64:
                half = found.shape[1] // 2
                found = found[:, :half] ^ found[:, half:]
            out[mine] = found
        return out

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """At most the size of the symmetric difference of each pair."""
        out = np.empty(len(a), np.int64)
        width = np.minimum(self.width[a], self.width[b])
        for w in np.unique(width).tolist():
            mine = np.flatnonzero(width == w)
            for part in np.array_split(mine, max(1, len(mine) * w >> 28)):
                out[part] = np.bitwise_count(self._at(a[part], w) ^ self._at(b[part], w)).sum(axis=1, dtype=np.int64)
        return out


# --- frequency of runs -------------------------------------------------------------------------------------------


def _slots(hashes: np.ndarray) -> np.ndarray:
    return ((hashes >> np.uint64(34)) & np.uint64(SLOTS - 1)).astype(np.int64)


def _coded(count: np.ndarray) -> np.ndarray:
    """Counts as eighths of their logarithm, in a byte; 0 stays 0."""
    return np.where(count > 0, np.minimum(255, 1 + np.rint(8 * np.log2(np.maximum(count, 1)))), 0).astype(np.uint8)


_DECODED = np.r_[0.0, 2.0 ** (np.arange(255) / 8)]


def _counter_rows(count: np.ndarray) -> pa.RecordBatch:
    blocks = [(b, _coded(part).tobytes()) for b, part in enumerate(count.reshape(-1, SLOT_BLOCK)) if part.any()]
    ids, none = np.array([b for b, _ in blocks], np.int64), np.zeros(len(blocks), np.int64)
    return _first_rows(1, ids, none, none, [blob for _, blob in blocks])


def _first_rows(kind: int, a: np.ndarray, b: np.ndarray, n: np.ndarray, blob: list[bytes | None]) -> pa.RecordBatch:
    columns = [pa.array(np.full(len(a), kind, np.int32)), *(pa.array(x, pa.int64()) for x in (a, b, n)), pa.array(blob, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["kind", "a", "b", "n", "blob"])


def _first_pass(batches: Iterator[pa.RecordBatch], size: int, t: float, min_words: int) -> Iterator[pa.RecordBatch]:
    """kind 0: (id, copy hash, n, bitmap); kind 1: (block of counters, -, -, counts); kind 2: (places of hashes that will travel, -, -, -)."""
    count = np.zeros(SLOTS, np.uint32)
    travel = 0
    for batch in portions(batches, "text"):
        batch = batch.filter(batch.column("id").is_valid())
        runs = Runs(batch.column("text").to_pylist(), size, min_words)
        yield _first_rows(0, batch.column("id").to_numpy()[runs.place], runs.copy, runs.n, signatures(runs))
        count += np.bincount(_slots(runs.hashes), minlength=SLOTS).astype(np.uint32)
        travel += int(prefix_length(runs.n, t).sum())
    yield _counter_rows(count)
    yield _first_rows(2, np.array([travel]), np.zeros(1, np.int64), np.zeros(1, np.int64), [None])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for a, blob in zip(batch.column("a").to_pylist(), batch.column("blob").to_pylist()):
            total[a] = total.get(a, 0.0) + _DECODED[np.frombuffer(blob, np.uint8)]
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([_coded(v).tobytes() for v in total.values()], pa.binary())], names=["a", "blob"])


# --- tiles ---------------------------------------------------------------------------------------------------------

#: One row a batch and bucket; entries of one record lie together. The low 32 bits of a hash stand for it inside a bucket; a chance
#: agreement costs one comparison. Ids count from the smallest one. Copy hashes travel only for records that may have copies.
_BLOBS = ("hashes", "spots", "counts", "ids", "sizes", "copied", "copies", "inside")
_KEYS = f"bucket int, base bigint, {', '.join(f'{c} binary' for c in _BLOBS)}"
_ROLE = np.uint32(1 << 31)


def _narrow(x: np.ndarray) -> bytes:
    """Non-negative integers in the least of one, two, four or eight bytes each that holds them all."""
    most = int(x.max()) if len(x) else 0
    return x.astype(next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(k).max)).tobytes()


def _wide(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, f"u{len(blob) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def _keys(
    batches: Iterator[pa.RecordBatch], size: int, t: float, min_words: int, buckets: int, usual: float, counts: Broadcast, copied: Broadcast, parts: range
) -> Iterator[pa.RecordBatch]:
    """The hashes of every class that may be the first common ones, with their places, by bucket; those of the buckets in ``parts`` of PARTS."""
    codes, filled = np.frombuffer(counts.value, np.uint8), np.frombuffer(copied.value, np.uint8)
    for batch in portions(batches, "text"):
        batch = batch.filter(batch.column("id").is_valid())
        runs = Runs(batch.column("text").to_pylist(), size, min_words)
        if not len(runs.n):
            continue
        ids = batch.column("id").to_numpy()[runs.place]
        slot = (runs.copy.view(np.uint64) & np.uint64(FILTER_BITS - 1)).astype(np.int64)
        again = ((filled[slot >> 3] >> (slot & 7)) & 1).astype(bool)
        order = np.lexsort((ids, runs.copy))  # copies within a batch are one record from here on, the one with the smallest id
        first = np.sort(order[np.r_[True, runs.copy[order][1:] != runs.copy[order][:-1]]])
        inside = batch.column("inside").to_numpy(zero_copy_only=False)[runs.place] if "inside" in batch.schema.names else None
        # ascending: rare runs first, hashes in order among equally rare ones
        ordered = (codes[_slots(runs.hashes)].astype(np.uint64) << np.uint64(56)) | (runs.hashes >> np.uint64(8))
        length = prefix_length(runs.n, t)
        lists = []
        for i in first.tolist():
            own = ordered[runs.ends[i] - runs.n[i] : runs.ends[i]]
            own.sort()
            lists.append(own[: length[i]])
        key = np.concatenate(lists)
        own = np.repeat(first, length[first])
        spot = np.arange(len(key)) - np.repeat(np.cumsum(length[first]) - length[first], length[first])
        near = np.minimum(spot * 256 // runs.n[own], 255).astype(np.uint8)  # never beyond the true place
        role = np.zeros(len(key), np.int64)
        tile = key & np.uint64((1 << 56) - 1)
        often = np.ceil((_DECODED[(key >> np.uint64(56)).astype(np.int64)] - usual) / SPLIT)
        hot = np.flatnonzero(often > 1)
        if len(hot):
            many = often[hot].astype(np.int64)
            copy = np.repeat(hot, many)
            other = np.arange(len(copy)) - np.repeat(np.cumsum(many) - many, many)
            mine = (runs.copy[own[copy]].view(np.uint64) % np.repeat(many, many).astype(np.uint64)).astype(np.int64)
            pair = np.minimum(mine, other) * (1 << 24) + np.maximum(mine, other)
            split = _finish(tile[copy] ^ _finish(pair.astype(np.uint64) * _MIX[1])) >> np.uint64(8)
            rest = np.flatnonzero(often <= 1)
            tile = np.r_[tile[rest], split]
            role = np.r_[role[rest], mine > other]
            own, near = np.r_[own[rest], own[copy]], np.r_[near[rest], near[copy]]
        bucket = ((tile >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        if len(parts) < PARTS:
            here = np.flatnonzero((bucket % PARTS >= parts.start) & (bucket % PARTS < parts.stop))
            bucket, tile, own, near, role = bucket[here], tile[here], own[here], near[here], role[here]
        used = own * 2 + role  # two records for one class where a split tile has it in either role
        order = np.lexsort((used, bucket)) if len(hot) else np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
        bucket, tile, used, near = bucket[order], tile[order].astype(np.uint32), used[order], near[order]
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else np.zeros(1, np.int64)
        lead = np.flatnonzero(np.r_[True, (used[1:] != used[:-1]) | (bucket[1:] != bucket[:-1])]) if len(bucket) else np.zeros(0, np.int64)
        count, at = np.diff(np.r_[lead, len(used)]), np.searchsorted(lead, cuts)
        who, role = used[lead] // 2, used[lead] % 2
        sizes = runs.n[who] + role * int(_ROLE)
        out: list[list] = [[] for _ in range(2 + len(_BLOBS))]
        for a, b, i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), at[:-1].tolist(), at[1:].tolist()):
            some, many = ids[who[i:j]], again[who[i:j]]
            out[0].append(int(bucket[a]))
            out[1].append(base := int(some.min()))
            out[2].append(tile[a:b].tobytes())
            out[3].append(near[a:b].tobytes())
            out[4].append(_narrow(count[i:j]))
            out[5].append(_narrow((some - base).view(np.uint64)))
            out[6].append(_narrow(sizes[i:j]))
            out[7].append(_narrow(flagged := np.flatnonzero(many)))
            out[8].append(runs.copy[who[i:j][flagged]].tobytes())
            out[9].append(inside[who[i:j]].astype(np.int64).tobytes() if inside is not None else b"")
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), *(pa.array(c, pa.binary()) for c in out[2:])], names=["bucket", "base", *_BLOBS])


def _gathered(parts: list[tuple]) -> tuple[np.ndarray, ...]:
    """(hash, owner, place) of every entry; (class, size, inside) of every owner. A class is known by the smallest id of its records."""
    keys, owners, spots, classes, sizes, insides, at, copies, base = [], [], [], [], [], [], [], [], 0
    for least, tile, spot, count, some, size, copied, copy, inside in parts:
        keys.append(np.frombuffer(tile, np.uint32))
        spots.append(np.frombuffer(spot, np.uint8))
        copies.append(np.frombuffer(copy, np.int64))
        # the narrowest width that fits was taken, so the number of owners follows from the counts
        count = next(c for k in ("u1", "u2", "u4", "u8") if len(count) % int(k[1]) == 0 and int((c := np.frombuffer(count, k).astype(np.int64)).sum()) == len(keys[-1]))
        owners.append(np.repeat(np.arange(base, base + len(count)), count))
        at.append(_wide(copied, len(copies[-1])) + base)
        classes.append(_wide(some, len(count)) + least)
        sizes.append(_wide(size, len(count)))
        insides.append(np.frombuffer(inside, np.int64) if inside else classes[-1])
        base += len(count)
    keys, owners, spots, classes, sizes, insides, at, copies = (np.concatenate(x) for x in (keys, owners, spots, classes, sizes, insides, at, copies))
    if len(at):
        known, number = np.unique(copies, return_inverse=True)
        least = np.full(len(known), np.iinfo(np.int64).max)
        np.minimum.at(least, number, classes[at])
        classes[at] = least[number]
    return keys, owners, spots, classes, sizes, insides


def _tiles(batches: Iterator[pa.RecordBatch], t: float, star: bool) -> Iterator[pa.RecordBatch]:
    parts: dict[int, list] = {}
    for batch in batches:
        for b, *row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "base", *_BLOBS))):
            parts.setdefault(b, []).append(row)
    for b in list(parts):
        key, own, spot, cls, size, inside = _gathered(parts.pop(b))
        role, n = (size >= int(_ROLE))[own], (size & int(~_ROLE))[own]
        order = np.argsort((key.astype(np.uint64) << np.uint64(32)) | n.astype(np.uint64), kind="stable")
        shared = np.zeros(len(key), bool)
        same = key[order][1:] == key[order][:-1]
        shared[1:] |= same
        shared[:-1] |= same
        order = order[shared]
        if not len(order):
            continue
        key, own, spot, role, n = key[order], own[order], spot[order], role[order], n[order]
        # one entry a class and tile: copies show all their hashes at the same places
        which = cls[own]
        order = np.lexsort((which, n, key))
        key, own, spot, role, n, which = key[order], own[order], spot[order], role[order], n[order], which[order]
        once = np.r_[True, (key[1:] != key[:-1]) | (which[1:] != which[:-1]) | (role[1:] != role[:-1])]
        key, own, spot, role, n, which = key[once], own[once], spot[once], role[once], n[once], which[once]
        lead = np.r_[True, key[1:] != key[:-1]]
        number = np.cumsum(lead) - 1
        crossed = np.logical_or.reduceat(role, np.flatnonzero(lead))[number]
        room = n - (spot.astype(np.int64) * n + 255) // 256  # at least what is left from the place on
        found: list[np.ndarray] = []
        for a, b in _star(key, n, t, lead) if star else _near(key, n, t):
            ok = (which[a] != which[b]) & (~crossed[a] | (role[a] != role[b])) & (inside[own[a]] != inside[own[b]] if not star else True)
            ok &= np.minimum(room[a], room[b]) * (1 + t) >= t * (n[a] + n[b]) - 1e-9
            a, b = a[ok], b[ok]
            found.append(np.sort(np.stack([which[a], which[b]], axis=1), axis=1))
            if sum(map(len, found)) > 1_000_000:
                found = [np.unique(np.concatenate(found), axis=0)]
                if len(found[0]) > 500_000:
                    yield _pairs(found.pop())
        if found:
            yield _pairs(np.unique(np.concatenate(found), axis=0))


def _near(key: np.ndarray, n: np.ndarray, t: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Entries of one tile or of adjoining size bands, within reach of each other; entries come sorted by (key, n)."""
    alive, step = np.arange(len(key) - 1), 1
    while len(alive):
        alive = alive[alive + step < len(key)]
        other = alive + step
        near = (key[alive] == key[other]) & (n[alive] >= t * n[other] - 1e-9)
        alive, other = alive[near], other[near]  # sizes ascend: what is out of reach stays out of reach
        for lo in range(0, len(alive), 1 << 18):
            yield alive[lo : lo + (1 << 18)], other[lo : lo + (1 << 18)]
        step += 1


def _star(key: np.ndarray, n: np.ndarray, t: float, lead: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each entry with the smallest one of its tile and band, and that one with the smallest of the band below."""
    band = np.floor(np.log(np.maximum(n, 1)) / np.log(1 / t)).astype(np.int64) if t < 1 else n
    first = lead.copy()
    first[1:] |= band[1:] != band[:-1]
    at = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
    entry = np.flatnonzero(~first)
    yield at[entry], entry
    entry = np.flatnonzero(first & ~lead)
    yield at[entry - 1], entry


def _pairs(pairs: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


# --- decision ------------------------------------------------------------------------------------------------------


def _sets(batches: Iterator[pa.RecordBatch], size: int, min_words: int, wanted: Broadcast) -> Iterator[pa.RecordBatch]:
    """(id, n, hashes) of the records that the filter lets through."""
    bits = np.frombuffer(wanted.value, np.uint8)
    for batch in portions(batches, "text"):
        slot = batch.column("slot").to_numpy()
        batch = batch.filter(pa.array((bits[slot >> 3] >> (slot & 7)) & 1 == 1))
        runs = Runs(batch.column("text").to_pylist(), size, min_words)
        ids = batch.column("id").to_numpy()[runs.place]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(runs.n, pa.int64()), pa.array(packed(runs), pa.binary())], names=["id", "n", "blob"])


def _decide(batches: Iterator[pa.RecordBatch], t: float, test: Callable) -> Iterator[pa.RecordBatch]:
    """Rows come by place: first its records (a: id), then its pairs. What has been read of a place stays until it ends."""
    sizes: list[int] = []
    blobs: list[bytes] = []
    at: dict[int, int] = {}
    now = None
    for batch in batches:
        place = batch.column("place").to_numpy()
        cuts = np.flatnonzero(np.r_[True, place[1:] != place[:-1], True])
        columns = [batch.column(c) for c in ("a", "b", "n", "blob")]
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if place[lo] != now:
                now = place[lo]
                at, sizes, blobs = {}, [], []
            a, b, n, blob = (c.slice(lo, hi - lo).to_pylist() for c in columns)
            split = next((i for i, x in enumerate(b) if x is not None), hi - lo)
            for i in range(split):
                if a[i] not in at:
                    at[a[i]] = len(at)
                    sizes.append(n[i])
                    blobs.append(blob[i])
            if split == hi - lo:
                continue
            a, b = a[split:], b[split:]
            keep = test(np.array([at[i] for i in a]), np.array([at[i] for i in b]), np.array(sizes), blobs, t)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(a)[keep]), pa.array(np.array(b)[keep])], names=["a", "b"])


def _possible(x: np.ndarray, y: np.ndarray, n: np.ndarray, signs: list[bytes], t: float) -> np.ndarray:
    """Pairs that their bitmaps don't exclude."""
    return (n[x] + n[y] - Bitmaps(n, signs).apart(x, y)) // 2 * (1 + t) >= t * (n[x] + n[y]) - 1e-9


def _reached(x: np.ndarray, y: np.ndarray, n: np.ndarray, blobs: list[bytes], t: float) -> np.ndarray:
    """Pairs whose hash arrays reach the threshold."""
    keep = np.zeros(len(x), bool)
    sets: dict[int, np.ndarray] = {}
    for k in range(len(x)):
        i, j = (x[k], y[k]) if n[x[k]] <= n[y[k]] else (y[k], x[k])
        for v in (i, j):
            if v not in sets:
                sets[v] = unpacked(blobs[v])
        small, large = sets[i], sets[j]
        both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
        keep[k] = both >= t * (len(small) + len(large) - both) - 1e-9
    return keep


class NearDuplicates:
    """Similar pairs of class representatives (``pairs``: a < b), and every record's class (``classes``)."""

    def __init__(self, docs: DataFrame, size: int = 5, threshold: float = 0.8, min_words: int = 1):
        """``docs``: id BIGINT and text STRING; ids are taken to be unique, other columns are ignored."""
        self.spark = spark = docs.sparkSession
        self.size, self.threshold, self.min_words = size, threshold, min_words
        self.scratch = scratch = Scratch(spark)
        self.docs = docs.select(F.col("id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text")).filter("id IS NOT NULL")
        first = scratch.write(self.docs.mapInArrow(lambda it: _first_pass(it, size, threshold, min_words), "kind int, a bigint, b bigint, n bigint, blob binary"), "first")
        self.signs = first.filter("kind = 0").select(F.col("a").alias("id"), "n", "blob")
        copies = first.filter("kind = 0").select(F.col("a").alias("id"), F.col("b").alias("copy"))
        self.leads = copies.groupBy("copy").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n_copies"))
        self.classes = copies.join(self.leads, "copy").select("id", "class_id", "n_copies")
        counters = first.filter("kind = 1").select("a", "blob").mapInArrow(_added, "a bigint, blob binary").repartition(SLOTS // SLOT_BLOCK, "a")
        codes = np.zeros(SLOTS, np.uint8)
        for row in counters.mapInArrow(_added, "a bigint, blob binary").collect():  # SLOTS bytes in all
            codes[row.a * SLOT_BLOCK : (row.a + 1) * SLOT_BLOCK] = np.frombuffer(row.blob, np.uint8)
        self.usual = float(_DECODED[int(np.median(codes))])
        self.counts = spark.sparkContext.broadcast(codes.tobytes())
        self.copied = self._filter(self.leads.filter("n_copies > 1").select(F.pmod("copy", F.lit(FILTER_BITS)).alias("slot")))
        self.travel = first.filter("kind = 2").agg(F.sum("a").alias("n")).first().n or 0
        self.buckets = max(1, -(-self.travel // BUCKET))

    def _filter(self, slots: DataFrame) -> Broadcast:
        words = slots.groupBy((F.col("slot") / 32768).cast("int").alias("at")).agg(F.bitmap_construct_agg(F.col("slot") % 32768).alias("bits"))
        out = bytearray(FILTER_BITS // 8)
        for row in words.collect():  # FILTER_BITS / 8 bytes in all
            out[row.at * 4096 : row.at * 4096 + len(row.bits)] = row.bits
        return self.spark.sparkContext.broadcast(bytes(out))

    def _candidates(self, name: str, star: bool = False, inside: DataFrame | None = None) -> DataFrame:
        """(a, b) of class representatives that neither the bounds of the tiles nor the bitmaps exclude; a < b.

        ``star``: only each record with the smallest of its tile. ``inside`` (id, inside): pairs with equal ``inside`` are left out.
        A tile that shares many hashes of a pair finds it as often, so what the tiles of all buckets find can exceed the texts. Where
        there are many buckets, a part of them shows how much that is, and the others follow in as many rounds as keep it below half the
        number of hashes that travel, each round with a reading of the texts of its own.
        """
        docs = self.docs
        if inside is not None:
            docs = docs.join(inside, "id").select("id", "text", "inside")
        if self.buckets < MANY:
            return self._round(docs, name, star, range(PARTS))[0]
        first, found = self._round(docs, f"{name}-0", star, range(1))
        done, step = [first], max(1, min(PARTS - 1, self.travel // max(2 * found, 1)))
        for start in range(1, PARTS, step):
            done.append(self._round(docs, f"{name}-{start}", star, range(start, min(PARTS, start + step)))[0])
        out = done[0]
        for more in done[1:]:
            out = out.unionByName(more)
        out = self.scratch.write(out.distinct(), name)
        self.scratch.drop(*(f"{name}-{start}" for start in (0, *range(1, PARTS, step))))
        return out

    def _round(self, docs: DataFrame, name: str, star: bool, parts: range) -> tuple[DataFrame, int]:
        """The candidates of some parts of the buckets, and how many there were before repeated ones were dropped."""
        size, t, least, buckets, usual, counts, copied = self.size, self.threshold, self.min_words, self.buckets, self.usual, self.counts, self.copied
        keyed = docs.mapInArrow(lambda it: _keys(it, size, t, least, buckets, usual, counts, copied, parts), _KEYS)
        seen = Observation()
        met = keyed.repartitionById(buckets, F.col("bucket")).mapInArrow(lambda it: _tiles(it, t, star), "a bigint, b bigint")
        met = self.scratch.write(met.observe(seen, F.count(F.lit(1)).alias("n")).distinct(), f"{name}-met")
        out = self._at_places(met, name, lambda _: self.signs, _possible)
        self.scratch.drop(f"{name}-met")
        return out, seen.get["n"]

    def _decided(self, candidates: DataFrame, name: str) -> DataFrame:
        """The candidates that reach the threshold."""
        size, least = self.size, self.min_words

        def sets(low: DataFrame) -> DataFrame:
            bits = self._filter(low.select(F.pmod(F.xxhash64("a"), F.lit(FILTER_BITS)).alias("slot")))
            slot = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)).cast("int")
            return self.docs.withColumn("slot", slot).mapInArrow(lambda it: _sets(it, size, least, bits), "id bigint, n bigint, blob binary")

        return self._at_places(candidates, name, sets, _reached)

    def _at_places(self, candidates: DataFrame, name: str, blobs: Callable[[DataFrame], DataFrame], test: Callable) -> DataFrame:
        """The candidates that ``test`` keeps where the ``blobs`` (id, n, blob) of their records meet."""
        t = self.threshold
        ends = candidates.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e"))
        low = ends.select("e.u", "e.v").groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("a"), F.least("u", "v").alias("low"))
        low = self.scratch.write(low, f"{name}-low")
        blocks = low.groupBy("low").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
        block = lambda c: F.pmod(F.xxhash64(c), F.col("blocks"))
        pairs = candidates.join(low.join(blocks, "low"), "a").select("a", "b", F.xxhash64("low", block("a"), block("b")).alias("place"))
        pairs = self.scratch.write(pairs, f"{name}-placed")
        goes = pairs.select("place", F.explode(F.array("a", "b")).alias("id")).distinct()
        records = goes.join(blobs(low), "id").select("place", F.col("id").alias("a"), F.lit(None).cast("bigint").alias("b"), "n", "blob")
        both = records.unionByName(pairs.select("place", "a", "b", F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("binary").alias("blob")))
        placed = both.repartition(partitions(self.spark), "place").sortWithinPartitions("place", F.col("b").asc_nulls_first())
        out = self.scratch.write(placed.mapInArrow(lambda it: _decide(it, t, test), "a bigint, b bigint"), name)
        self.scratch.drop(f"{name}-low", f"{name}-placed")
        return out

    @cached_property
    def pairs(self) -> DataFrame:
        """(a, b): similar pairs of class representatives; a < b."""
        out = self._decided(self._candidates("candidates"), "sure")
        self.scratch.drop("candidates")
        return out

    def record_pairs(self) -> DataFrame:
        """(a, b): all similar pairs of records, copies written out; a < b."""
        member = self.classes.select("id", "class_id")
        left = member.select(F.col("id").alias("x"), F.col("class_id").alias("a"))
        right = member.select(F.col("id").alias("y"), F.col("class_id").alias("b"))
        across = self.pairs.join(left, "a").join(right, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        copied = self.classes.filter("n_copies > 1").select("id", "class_id")
        within = copied.withColumnRenamed("id", "x").join(copied.withColumnRenamed("id", "y"), "class_id").filter("x < y")
        return across.unionByName(within.select(F.col("x").alias("a"), F.col("y").alias("b")))

    def groups(self, docs: DataFrame | None = None) -> DataFrame:
        """(id, group_id): records joined directly or over others; a record without partner is its own group.

        With ``docs`` (a column ``id``), its records that have fewer than ``min_words`` words, or none, come out too, each as its own group.
        Pairs inside a group that the first round has joined are not compared.
        """
        near = self._decided(self._candidates("stars", star=True), "joined")
        joined = self.scratch.write(connected_groups(near), "joined-groups").select(F.col("vertex").alias("class_id"), F.col("group_id").alias("g"))
        leads = self.leads.select("class_id")
        inside = leads.join(joined, "class_id", "left").select(F.col("class_id").alias("id"), F.coalesce("g", "class_id").alias("inside"))
        rest = self._decided(self._candidates("apart", inside=inside), "rest")
        named = connected_groups(near.unionByName(rest)).select(F.col("vertex").alias("class_id"), "group_id")
        out = self.classes.join(named, "class_id", "left")
        if docs is not None:
            out = docs.select(F.col("id").cast("bigint").alias("id")).filter("id IS NOT NULL").join(out, "id", "left")
        return out.select("id", F.coalesce("group_id", "class_id", "id").alias("group_id"))


def page_docs(raw_pages: DataFrame, redirects: bool = False) -> DataFrame:
    """(id, text) of the records without a redirect title, or of all with ``redirects``."""
    kept = raw_pages if redirects else raw_pages.filter(F.coalesce(F.col("redirect._title"), F.lit("")) == "")
    return kept.select(F.col("raw_id").alias("id"), page_text(F.col("revision")).alias("text"))
