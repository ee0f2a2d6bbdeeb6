import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from pagetrail.llm import groups as G
from pagetrail.llm import near_dups as N
from pagetrail.llm import together as T

WORDS = [f"w{i}" for i in range(400)]


def _texts(rng):
    base = [" ".join(rng.choices(WORDS, k=rng.choice([3, 8, 30, 60, 200]))) for _ in range(40)]
    out = []
    for text in base:
        words = text.split()
        out.append(text)
        for _ in range(rng.randint(0, 3)):
            copy = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 20))):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            out.append(" ".join(copy))
    out += ["the same text for a third of all rows"] * 60 + [None, "", "  ", "!!", "one", "One.", "x" * 200_000]
    return list(enumerate(out))


@pytest.mark.parametrize(("size", "t"), [(3, 0.5), (5, 0.8)])
def test_near_duplicates_against_brute_force(spark, size, t):
    rows = _texts(random.Random(size))
    docs = spark.createDataFrame(rows, "id bigint, text string").selectExpr("id", "text", "1 AS n", "'x' AS copy", "id AS class_id").repartition(3)
    found = N.NearDuplicates(docs, size, t)
    runs = {}
    for i, text in rows:
        words = N.words_of(text)
        if words:
            k = min(size, len(words))
            runs[i] = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)}
    want = {(a, b) for a, b in combinations(sorted(runs), 2) if len(runs[a] & runs[b]) >= t * len(runs[a] | runs[b]) - 1e-9}
    got = [tuple(r) for r in found.record_pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == want
    groups = {r.id: r.group_id for r in found.groups().collect()}
    assert set(groups) == set(runs)
    assert all(groups[a] == groups[b] for a, b in want)


def test_near_duplicates_of_nothing(spark):
    for rows in ([], [(1, None), (None, "a b c d e f")], [(1, "only one text")]):
        found = N.NearDuplicates(spark.createDataFrame(rows, "id bigint, text string"))
        assert found.record_pairs().count() == 0
        assert found.groups().count() == sum(1 for i, t in rows if i and t)


def test_a_large_cluster_is_grouped_without_all_its_pairs(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(1000):
        words = list(base)
        words[rng.randrange(120)] = f"v{i}"
        rows.append((i, " ".join(words)))
    rows += [(5000 + i, " ".join(f"x{i}_{j}" for j in range(50))) for i in range(20)]
    found = N.NearDuplicates(spark.createDataFrame(rows, "id bigint, text string"), 3, 0.8)
    sizes = []
    monkeypatch.setattr(found.scratch, "write", lambda df, name, write=found.scratch.write: sizes.append((name, (out := write(df, name)).count())) or out)
    groups = {r.id: r.group_id for r in found.groups().collect()}
    assert all(groups[i] == 0 for i in range(1000)) and all(groups[5000 + i] == 5000 + i for i in range(20))
    assert max(n for _, n in sizes) < 150_000, sizes  # all pairs would be 499,500


@pytest.mark.parametrize("split", [20_000, 5])
def test_split_tiles_lose_nothing(spark, monkeypatch, split):
    monkeypatch.setattr(N, "SPLIT", split)
    monkeypatch.setattr(N, "BUCKET", 300)
    monkeypatch.setattr(N, "BLOCK", 4)
    rng = random.Random(11)
    common = [f"c{i}" for i in range(12)]
    rows = [(i, " ".join(common + rng.choices(WORDS, k=rng.choice([1, 2, 3, 8])))) for i in range(60)]
    rows += [(100 + i, rows[3][1]) for i in range(30)]
    docs = spark.createDataFrame(rows, "id bigint, text string").repartition(4)
    runs = {i: set(zip(w := text.split(), w[1:], w[2:])) for i, text in rows}
    want = {(a, b) for a, b in combinations(sorted(runs), 2) if len(runs[a] & runs[b]) >= 0.5 * len(runs[a] | runs[b])}
    got = [tuple(r) for r in N.NearDuplicates(docs, 3, 0.5).record_pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_words_as_the_pattern_finds_them():
    texts = ["", None, "Σ ΑΣ ΑΣ. İx", "ß é_1 \u0301x", "x" * (N.CHUNK * 2 + 5) + " y", " ".join(f"w{i}" for i in range(80_000)), "a\nb\x00c d", "\ud800 a"]
    seen = {}
    for first, words, lengths in N._words(texts):
        for k, end in enumerate(np.cumsum(lengths).tolist()):
            own = N.words_of(texts[first + k])
            assert len(own) == lengths[k]
            for word, h in zip(own, words[end - lengths[k] : end].tolist()):
                assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_bitmap_bound_holds():
    rng = random.Random(2)
    texts = [" ".join(rng.choices(WORDS, k=n)) for n in (5, 90, 120, 150, 300, 500, 900)]
    runs = N.Runs(texts, 3, 1)
    maps = N.Bitmaps(runs.n, N.signatures(runs))
    sets = [set(runs.hashes[runs.owner == i].tolist()) for i in range(len(texts))]
    a, b = (np.array(x) for x in zip(*combinations(range(len(texts)), 2)))
    assert all(m <= len(sets[i] ^ sets[j]) for m, i, j in zip(maps.apart(a, b).tolist(), a, b))


def _components(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {v: find(v) for v in list(parent)}


def test_groups_against_union_find(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(1000, 1040)]
    star = [(5000, 5000 + i) for i in range(1, 200)]
    noise = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)]
    edges = chain + star + noise + [(9, 9), (9, 9), (7777, 7777)]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges + [(None, 1), (2, None)], "a bigint, b bigint").selectExpr("a", "b", "a AS u", "'v' AS v")
    got = [tuple(r) for r in G.connected_groups(df).collect()]
    assert dict(got) == _components(edges) and len(got) == len(dict(got))
    assert G.connected_groups(df.filter("a < 0")).count() == 0


def test_record_groups(spark):
    rows = [(1, "A", None), (2, "A", None), (3, "B", ":a#x"), (4, None, "b"), (5, "", "Nowhere"), (6, "C", ""), (7, None, None), (None, "A", None), (8, "b", None)]
    df = spark.createDataFrame([(i, t, (r,) if r is not None else None) for i, t, r in rows], "raw_id bigint, title string, redirect struct<_title: string>").selectExpr("*", "1 AS a", "2 AS vertex")
    got = {r.raw_id: r.group_id for r in G.record_groups(df).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6, 7: 7, 8: 8}
    assert {r.raw_id: r.group_id for r in G.linked_groups(df).collect()} == {1: 1, 2: 1, 3: 1, 4: 1}
    assert G.record_groups(df.limit(0)).count() == 0


def test_together_counts(spark):
    rng = random.Random(4)
    rows = [(b, rng.choice([rng.randrange(20), 3, 4])) for b in range(100, 160) for _ in range(rng.randint(1, 8))]
    rows += [(50, i) for i in range(20)] + [(1, 1), (None, 2), (2, None)] + rows[:40]
    df = spark.createDataFrame(rows, "from_page_id bigint, to_page_id bigint").selectExpr("*", "1 AS n", "2 AS item", "3 AS basket")
    baskets = {}
    for b, i in rows:
        if b is not None and i is not None and b != i:
            baskets.setdefault(b, set()).add(i)
    baskets = {b: s for b, s in baskets.items() if len(s) <= 10}
    n = Counter(i for s in baskets.values() for i in s)
    c = Counter(p for s in baskets.values() for p in combinations(sorted(s), 2))
    counts = T.TogetherCounts(df, max_basket=10)
    got = {(r.a, r.b): (r.c, r.na, r.nb) for r in counts.counts(2).collect()}
    assert got == {p: (k, n[p[0]], n[p[1]]) for p, k in c.items() if k >= 2}
    lifted = {(r.a, r.b) for r in counts.surprising(2, 1.5).collect()}
    assert lifted == {p for p, k in c.items() if k >= 2 and k * len(baskets) >= 1.5 * n[p[0]] * n[p[1]]}
    empty = T.TogetherCounts(df.limit(0))
    assert empty.counts().count() == empty.surprising().count() == 0


def test_null_fit_and_tails():
    null = T.Null({2: 30, 5: 10, 20: 2}, {3: 20, 8: 10, 10: 1})
    degree = (null.rows(np.array([2, 5, 20])) * null.baskets).sum(axis=1)
    assert np.allclose(degree, [2, 5, 20], rtol=1e-6)
    rng = np.random.default_rng(1)
    q, times = rng.uniform(0.001, 0.3, (4, 5)), np.array([30, 10, 5, 20, 7.0])
    for row in q:
        pmf = np.array([1.0])
        for k, p in enumerate(row):
            for _ in range(int(times[k])):
                pmf = np.convolve(pmf, [1 - p, p])
        for c in (0, 1, 4, 9, 16, 30, 45):
            assert T.tail(row[None], times, np.array([float(c)]))[0] == pytest.approx(np.log10(pmf[c:].sum()), abs=0.02)


def test_every_frequency_has_its_own_fit(monkeypatch):
    monkeypatch.setattr(T, "CELLS", 1 << 14)
    null = T.Null({n: 3 for n in range(1, 9000)}, {10: 4_000_000, 40: 1_000_000, 1000: 41_498})
    assert len(null.x) == 8999
    some = np.array([1, 17, 4500, 8999])
    assert np.allclose((null.rows(some) * null.baskets).sum(axis=1), some, rtol=1e-4)


def test_false_discoveries_stay_rare(spark):
    """Of pairs called at q = 0.1 in baskets without structure, hardly any; the planted ones all."""
    rng = random.Random(8)
    rows = [(b, i) for b in range(600) for i in rng.sample(range(150), 6)]
    rows += [(5000 + 40 * k + j, 1000 + 2 * k + side) for k in range(20) for j in range(8) for side in (0, 1)]
    got = T.TogetherCounts(spark.createDataFrame(rows, "from_page_id bigint, to_page_id bigint")).surprising(min_count=1).filter("q_value <= 0.1").collect()
    planted = {(1000 + 2 * k, 1001 + 2 * k) for k in range(20)}
    called = {(r.a, r.b) for r in got}
    assert planted <= called and len(called - planted) <= 4


def test_planted_pair_is_surprising(spark):
    rng = random.Random(6)
    rows = [(b, i) for b in range(1000, 1400) for i in rng.sample(range(100), 5)] + [(b, i) for b in range(2000, 2015) for i in (500, 501, rng.randrange(100))]
    got = T.TogetherCounts(spark.createDataFrame(rows, "from_page_id bigint, to_page_id bigint")).surprising().orderBy("log10_p").collect()
    assert (got[0].a, got[0].b) == (500, 501) and got[0].q_value < 1e-6
    assert sum(r.q_value < 0.05 for r in got[1:]) <= 3
