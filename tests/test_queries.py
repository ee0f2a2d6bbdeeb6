"""Registered queries over small tables, whole results against plain Python."""

from urllib.parse import quote

from pagetrail import queries as Q
from pagetrail.operators import search


def _save(spark, folder, **tables):
    for name, (rows, shape) in tables.items():
        spark.createDataFrame(rows, shape).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_distances_have_no_bound(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "GATHER", 4)
    far = 14
    chain = [Q.START, *range(1001, 1001 + far)]
    links = [(a, b, None, None) for a, b in zip(chain, chain[1:])] + [(chain[5], chain[2], None, None), (1, Q.START, None, None)]
    sf = _save(
        spark, tmp_path,
        pages=([(p, f"p{p}") for p in [1, *chain]], "page_id bigint, title string"),
        links=(links, "from_page_id bigint, to_page_id bigint, title string, seen_at timestamp_ntz"),
        core_pages=([(Q.START, "a", "index"), (chain[-1], "b", "hub")], "page_id bigint, title string, role string"),
    )
    assert {r.page_id: r.distance for r in Q.distance_from_page(spark, sf).collect()} == {p: d for d, p in enumerate(chain)}
    assert {r.distance: r.n for r in Q.bfs_layers(spark, sf).collect()} == dict.fromkeys(range(far + 1), 1)
    assert [tuple(r) for r in Q.distance_pairs(spark, sf).collect()] == [(Q.START, chain[-1], far)]


def test_wiki_url_of_every_title(spark, tmp_path):
    titles = ["Red (color)", "Café", "Île-de-France", "Москва", "Ωμέγα", "O'Hare, Chicago", "A+B=C", "100%", "%2B", "a/b?c#d", '"x"', "[y]", "😀", ""]
    sf = _save(spark, tmp_path, pages=(list(enumerate(titles)), "page_id bigint, title string"))
    want = {i: "https://wiki.example/" + quote(t, safe=";,/?:@&=+$-_.!~*'()#") for i, t in enumerate(titles)}
    assert {r.page_id: r.url for r in Q.wiki_url(spark, sf).collect()} == want
