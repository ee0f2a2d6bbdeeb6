import pytest
from pyspark.sql import functions as F

from pagetrail.functions import wikitext as W
from pagetrail.operators.ingest import extract_links, parse_link

PIPE = {
    "": "", "Foo Bar": "Foo Bar", "Pipe (computing)": "Pipe", "Phoenix, Arizona": "Phoenix", "Wikipedia:Verifiability": "Verifiability",
    "Yours, Mine and Ours (1968 film)": "Yours, Mine and Ours", ":es:Wikipedia:Políticas": "Wikipedia:Políticas",
    "Il Buono, il Brutto, il Cattivo": "Il Buono", "Wikipedia:Manual of Style (Persian)": "Manual of Style", ":Test": "Test",
    "\t Whitespace \n": "Whitespace", "Test (foo) (bar) (baz)": "Test (foo) (bar)",
}


def apply(spark, values, column):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x string").select("i", column(F.col("x")).alias("y"))
    return [r.y for r in rows.orderBy("i").collect()]


def test_pipe_trick(spark):
    assert apply(spark, PIPE, W.pipe_trick) == list(PIPE.values())


def test_first_upper(spark):
    assert apply(spark, ["foo", "émile", "Foo", "", None, "1a"], W.first_upper) == ["Foo", "émile", "Foo", "", None, "1a"]


def test_link_target(spark):
    assert apply(spark, [":foo#bar", "::a", "#x", "Foo", None, ""], W.link_target) == ["Foo", ":a", "", "Foo", None, ""]


def test_namespace_number(spark):
    assert apply(spark, [None, "", "0", " 0", "0 ", "+4", "-2", "x1", "1.5", "9" * 30], W.namespace_number) == [0, 0, 0, 0, None, 4, -2, None, None, None]


def test_dot_and_url(spark):
    assert apply(spark, ['a"b', "c"], W.dot_quote) == ['"a\\"b"', '"c"']
    url = apply(spark, ["A b/c (d)", "ü?"], lambda c: W.wiki_url("w/", c))
    assert url == ["w/A%20b/c%20(d)", "w/%C3%BC?"]


@pytest.mark.parametrize(
    ("text", "links"),
    [
        ("[[foo#bar|baz]]", [("Foo", "bar", "baz")]),
        ("[[:Foo]]", [("Foo", None, None)]),
        ("[[#x]] [[|z]]", [("", "x", None), ("", None, "z")]),
        ("[[A|1]] [[A|2]]", [("A", None, "1"), ("A", None, "2")]),
        ("[[File:X|[[A]] [[B|b]]]]", [("A", None, None), ("B", None, "b"), ("File:X", None, "[[A]] [[B|b]]")]),
        ("]] [[A]]", [("A", None, None)]),
        ("[[A", []),
        ("[[[A]]]", [("[A", None, None)]),
        ("[[émile]]", [("émile", None, None)]),
        ("[[Foo|]]", [("Foo", None, "")]),
        (None, []),
    ],
)
def test_links(text, links):
    assert [link[1:] for link in extract_links(text)] == links


def test_parse_link():
    assert parse_link("a#b#c|d|e") == ("A", "b#c", "d|e")
