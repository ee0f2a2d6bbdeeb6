import random
import time
from itertools import combinations

from pagetrail.llm import near_dups as N


def _clusters(rng, clusters, members, words=100):
    rows = []
    for c in range(clusters):
        base = [f"w{rng.randrange(20_000)}" for _ in range(words)]
        for _ in range(members):
            own = list(base)
            own[rng.randrange(words)] = f"v{rng.randrange(20_000)}"
            rows.append((len(rows) * 70_000 - 5, " ".join(own)))
    return rows + [(-9_000_000_000 + i, rows[7][1]) for i in range(3)]


def _shuffled(spark):
    """Bytes of shuffle files that are there."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(f.length() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_"))


def test_a_step_leaves_no_shuffle_files(spark):
    rows = _clusters(random.Random(4), 60, 4)
    found = N.NearDuplicates(spark.createDataFrame(rows, "id bigint, text string").repartition(3), 3, 0.5)
    before = _shuffled(spark)
    assert found.pairs.count() > 60
    most, until = sum(len(t) for _, t in rows) // 10, time.time() + 5
    while _shuffled(spark) - before > most and time.time() < until:  # files go in the background
        time.sleep(0.2)
    assert _shuffled(spark) - before <= most


def test_rounds_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(N, "MANY", 1)
    monkeypatch.setattr(N, "BUCKET", 100)
    rows = _clusters(random.Random(5), 12, 6)
    runs = {i: set(zip(w := text.split(), w[1:], w[2:])) for i, text in rows}
    want = {(a, b) for a, b in combinations(sorted(runs), 2) if len(runs[a] & runs[b]) >= 0.5 * len(runs[a] | runs[b])}
    found = N.NearDuplicates(spark.createDataFrame(rows, "id bigint, text string").repartition(3), 3, 0.5)
    names = []
    write = found.scratch.write
    found.scratch.write = lambda df, name: (names.append(name), write(df, name))[1]
    got = [tuple(r) for r in found.record_pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert 3 <= sum(name.endswith("-met") for name in names) <= N.PARTS


def test_a_hash_travels_in_few_bytes(spark):
    rows = _clusters(random.Random(6), 1000, 1)
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows[:1000])], "id bigint, text string").coalesce(1)
    found = N.NearDuplicates(docs, 3, 0.5)
    keyed = found.docs.mapInArrow(
        lambda it, a=(3, 0.5, 1, 700, found.usual, found.counts, found.copied, range(N.PARTS)): N._keys(it, *a), N._KEYS
    ).toArrow()
    hashes = sum(len(x) for x in keyed.column("hashes").to_pylist()) // 4
    blobs = sum(len(x) for c in N._BLOBS for x in keyed.column(c).to_pylist())
    assert hashes > 45_000 and blobs <= 10.5 * hashes  # 17 with a copy hash and a number for each
