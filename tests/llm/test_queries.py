"""Registered queries over small tables, whole results against plain Python."""

from collections import Counter
from itertools import combinations

import pyarrow as pa
import pytest

from pagetrail.llm import queries as Q
from pagetrail.llm import together


def _save(spark, folder, **tables):
    for name, (rows, shape) in tables.items():
        spark.createDataFrame(rows, shape).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("block", [1024, 32])
def test_all_baskets_and_pairs_count(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(together, "BLOCK", block)
    sets = {1: set(range(1000, 1230)), 2: set(range(1200, 1240)), 3: {1000, 1235}, 4: {1001}, 5: {1228, 1229}}
    links = [(b, i) for b, items in sets.items() for i in items] + [(3, 1000), (3, 3), (None, 1000), (3, None)]
    sf = _save(spark, tmp_path, links=(links, "from_page_id bigint, to_page_id bigint"))
    n = Counter(i for items in sets.values() for i in items)
    c = Counter(p for items in sets.values() for p in combinations(sorted(items), 2))
    want = {(a, b, k, n[a], n[b]) for (a, b), k in c.items()}
    got = [tuple(r) for r in Q.p4_counts(spark, sf).collect()]
    assert len(got) == len(want) and set(got) == want
    scored = Q.p4_surprise(spark, sf).collect()
    assert len(scored) == len(want) and {tuple(r)[:5] for r in scored} == want
    assert all(r.lift == pytest.approx(r.n_together * len(sets) / (r.n_a * r.n_b)) for r in scored)


def test_tiles_in_portions(monkeypatch):
    monkeypatch.setattr(together, "PORTION", 40)
    sets = [list(range(0, 50)), list(range(30, 90)), [3, 70], [5]] * 3
    n = Counter(i for items in sets for i in items)
    items = pa.array([[{"block": i * 7 % 3, "item": i, "n": n[i]} for i in s] for s in sets], pa.list_(pa.struct({"block": pa.int64(), "item": pa.int64(), "n": pa.int64()})))
    parts = pa.Table.from_batches(together._spread(iter([pa.RecordBatch.from_arrays([items], names=["items"])]), 3))
    batches = parts.sort_by("tile").combine_chunks().to_batches(max_chunksize=4)
    got = [tuple(r.values()) for b in together._count_tiles(iter(batches), 3) for r in b.to_pylist()]
    c = Counter(p for s in sets for p in combinations(s, 2))
    assert len(got) == len(c) and set(got) == {(a, b, n[a], n[b], k) for (a, b), k in c.items()}


def test_every_record_has_a_group(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None, text), (2, "", text + " more"), (3, "Red", "#REDIRECT [[Red]]"), (4, "Red", "#REDIRECT [[Red]]"), (5, None, ""), (6, None, None), (7, "Blue", "!!"), (8, "Blue", text)]
    raw = [(i, (r,) if r is not None else None, [(t,)] if t is not None else None) for i, r, t in rows]
    sf = _save(spark, tmp_path, raw_pages=(raw, "raw_id bigint, redirect struct<_title: string>, revision array<struct<text: string>>"))
    got = [tuple(r) for r in Q.p1_groups(spark, sf).collect()]
    assert sorted(got) == [(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 6), (7, 7), (8, 1)]


def test_targets_and_titles_come_out_in_one_form(spark, tmp_path):
    titles = ["Red rose", "Caf\u00e9", "Atlas"]
    targets = ["Red\u00a0rose", "Cafe\u0301", "\u0410tlas", "Atlas", "\uff2eowhere\u200b at all", "", None, "Red rose"]
    sf = _save(
        spark, tmp_path,
        pages=(list(enumerate(titles)), "page_id bigint, title string"),
        parsed_links=(list(enumerate(targets)), "link_id bigint, target string"),
    )
    got = [tuple(r) for r in Q.queries()["p6_canonical_targets"](spark, sf).collect()]
    assert sorted(got) == list(enumerate(["Red rose", "Caf\u00e9", "Atlas", "Atlas", "Nowhere at all", "", None, "Red rose"]))
    assert [r.canonical_title for r in Q.p6_canonical_titles(spark, sf).orderBy("page_id").collect()] == titles
