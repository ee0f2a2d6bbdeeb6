import random
from collections import Counter

from pagetrail.operators import heavy_keys as H
from pagetrail.streaming.links import streamed_links, windowed_counts

SCHEMA = "from_page_id bigint, to_page_id bigint, side string, page_id int, key string, n int"


def _rows(rng, many):
    rows = [(7, i % 5000, "x", 1, None, None) for i in range(many)]
    rows += [(rng.choice([None, *range(50)]), rng.choice([None, *range(50)]), None, None, "k", 1) for _ in range(many)]
    rows += [(3, 4, "same", 0, "same", 0)] * many
    return rows


def test_against_brute_force(spark):
    rows = _rows(random.Random(1), 6000)
    df = spark.createDataFrame(rows, SCHEMA)
    want = {}
    for r in rows:
        for side, key, near in (("from", r[0], r[1]), ("to", r[1], r[0])):
            if key is not None:
                want.setdefault((side, key), []).append(near)
    got = {(r.side, r.page_id): (r.n_rows, r.n_neighbours) for r in H.key_degrees(df).collect()}
    assert got == {k: (len(v), len(set(v) - {None})) for k, v in want.items()}
    heavy = {(r.side, r.page_id) for r in H.heavy_keys(df, 50).collect()}
    assert heavy == {k for k, v in want.items() if len(v) * 50 >= len(rows)}
    lists = {}
    for r in H.neighbour_chunks(df).collect():
        assert len(r.neighbours) == r.n <= H.CHUNK
        for i, near in enumerate(r.neighbours):
            lists[r.side, r.page_id, r.first_place + i] = near
    flat = {(s, k, i): near for (s, k), v in want.items() for i, near in enumerate(sorted(set(v) - {None}))}
    assert lists == flat
    assert Counter(k[:2] for k in lists)["from", 7] == 5000


def test_empty_and_null(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert H.key_degrees(none).count() == H.heavy_keys(none).count() == H.neighbour_chunks(none).count() == 0
    nulls = spark.createDataFrame([(None, None, None, None, None, None)], SCHEMA)
    assert H.key_degrees(nulls).count() == 0
    assert H.neighbour_chunks(spark.createDataFrame([(1, None, None, None, None, None)], SCHEMA)).count() == 0


def test_streams(spark, tmp_path):
    batch = spark.sql(
        """SELECT * FROM VALUES (1L, 'A', '0', named_struct('_title', CAST(NULL AS STRING)), array(named_struct('text', '[[B]] [[A]]')), TIMESTAMP_NTZ '2024-01-01 00:10:00'),
        (2L, 'C', '4', NULL, array(named_struct('text', '[[B]]')), TIMESTAMP_NTZ '2024-01-01 00:20:00'), (3L, 'D', '0', named_struct('_title', 'A'), NULL, NULL)
        AS t(raw_id, title, ns, redirect, revision, fetched_at)"""
    )
    batch.selectExpr("*").withColumn("fetched_at", batch.fetched_at.cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    for name, df in (("found", streamed_links(stream)), ("counted", windowed_counts(stream))):
        mode = "append" if name == "found" else "complete"
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        query.processAllAvailable()
        query.stop()
    assert [tuple(r) for r in spark.table("found").collect()] == [("A", "B", None)]
    assert [(r.n_records, r.n_redirects) for r in spark.table("counted").collect()] == [(2, 0)]
