import random
import time
from collections import defaultdict

import numpy as np
import pytest

from pagetrail.llm import lookalikes as L
from pagetrail.llm import markup as M
from pagetrail.llm import mixing as X
from pagetrail.llm import packing as P
from pagetrail.llm import pii
from pagetrail.llm.pii_labels import labelled
from tests.llm.pii_texts import parsed
from pagetrail.llm.tokens import encoder, token_sizes, VOCABULARY


def kinds(text):
    return [k for k, _ in M.classify([text], M.trained())[0] if k in M.KINDS]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("'''A''' text.\n== Head ==\n* a\n** b\n#c\nHere <math>x</math>.", "heading list_item list_item list_item formula"),
        ("'''A''' text <!-- == no == --> <nowiki>* no</nowiki>\n{{box\n| a = $x$\n* no\n}}\n{|\n| <math>x</math>\n|}\n<pre>\n== no ==\n</pre>", "code"),
        ("Some **bold** text.\n\n## Head\n\n- a\n  - b\n1. c\n\nTitle\n-----\n\n```c\n# no\n```\n\nPay $4 or $5 now. Here $x+1$ holds.\n\n$$\ny\n$$", "heading list_item list_item list_item heading code formula formula"),
        ("<p>A <b>b</b>.</p>\n<H2 id=x>Head</H2>\n<ul>\n<li>a\n<li>b</li>\n</ul>\n<pre><code>&lt;h2>no</code></pre>\n\\[x\\]", "heading list_item list_item code formula"),
        ("\\section*{Head} \n\\begin{itemize}\n\\item a\n\\end{itemize}\nCosts \\$4, \\emph{or} $x$.\n\\begin{verbatim}\n\\item no\n\\end{verbatim}\n\\begin{equation}\nx\n\\end{equation}", "heading list_item formula code formula"),
        ("#REDIRECT [[A]]", ""),
        ("# Title\n\nSome text.\n", "heading"),
        ("# My Project\n\nThis project does **things**.\n\n## Usage\n\n```sh\nrun\n```\n", "heading heading code"),
        ("# Recipe\n\n- eggs\n- milk\n\n1. mix\n2. bake\n", "heading list_item list_item list_item list_item"),
        ("#Heading\n\nText with [link](http://a.b).\n", "heading"),
        ("# A\n## B\ntext\n### C\n- x\n", "heading heading heading list_item"),
        ("Title\n=====\n\ntext here\n\nSub\n---\n\n* a\n* b\n", "heading heading list_item list_item"),
        ("# Notes\n\nSee code:\n\n    x = 1\n\n    y = 2\n\nDone.\n", "heading code"),
        ("> # Quoted head\n>\n> - a\n> - b\n", "heading list_item list_item"),
        ("# Guide to the City\n\nThe city has many *parks*.\n\n## Parks\n\n* Central\n* East\n\n| a | b |\n|---|---|\n| 1 | 2 |\n", "heading heading list_item list_item"),
        ("# TODO\n* [ ] one\n* [x] two\n", "heading list_item list_item"),
        ("'''X''' is a [[y]].\n:* a\n:* b\n::# c\n: reply", "list_item list_item list_item"),
        ("'''X''' is a [[y]].\n# One\n# Two\n", "list_item list_item"),
        ("<pre> never closed\n== Head ==\n[[a]] ''b''", "heading"),
        ("", ""),
        ("0 odd", ""),
    ],
)
def test_pieces(text, want):
    assert kinds(text) == want.split()


def test_markup_tables(spark):
    rows = [(1, None, [("== A ==\n'''b''' [[c|d]]",), (None,), ("\n* e [[f (g)|]]",)]), (2, ("X",), [("== B ==",)]), (3, None, None), (4, None, []), (5, None, [("<math>" + "x" * 100_000 + "</math> == " * 1000,)])]
    df = spark.createDataFrame(rows, "raw_id bigint, redirect struct<_title: string>, revision array<struct<text: string>>").selectExpr("*", "1 AS id", "2 AS text")
    got = sorted(map(tuple, M.pieces(df).collect()))
    assert got == [(1, "heading", 1), (1, "list_item", 1), (5, "formula", 1)]
    clean = {r.raw_id: r.clean_text for r in M.clean_text(df).collect()}
    assert clean[1] == "## A\nb d\n- e f (g)" and clean[2] == "## B" and clean[3] == clean[4] == ""
    assert M.pieces(df.limit(0)).count() == 0


@pytest.mark.parametrize("opener", ["\\begin{verbatim} ", "<!-- a ", "<pre> a ", "<math>", "```x\n", "$$ a ", "\\[ a ", "<nowiki>", "=a", "'", "<a>", "<ref>", "[http://", "`a", "{{", "[[File:", "<li>"])
def test_unclosed_openers_take_linear_time(opener):
    text = opener * (1_000_000 // len(opener))
    begin = time.process_time()
    M.render([("text", b) for b in M.blocks_of(text)[0]])
    assert time.process_time() - begin < 4


def test_very_nested_templates_take_linear_time():
    assert M._without_nested("{{" * 50_000 + "x" + "}}" * 50_000 + "y") == "y"
    assert M._without_nested("a {{ b }} }} c {| d") == "a  }} c {| d"


SAME = [("Fifth war", "Ｆifth war"), ("Fifth war", "F͏ifth war"), ("Café", "Café"), ("Copa", "Сора"), ("ﬁn", "fin"), ("A-b", "A‑b"), ("K", "K"), ("ë", "ё"), ("a　b", "a b")]
DIFFER = [("Cafe", "Café"), ("abc", "ABC"), ("O1", "01"), ("l", "1"), ("x²", "x2"), ("a_b", "a b"), ("a!", "a"), ("a  b", "a b")]


def test_shapes():
    assert all(L.by_table(a) == L.by_table(b) for a, b in ((x.replace(" ", " ").replace("　", " "), y.replace(" ", " ").replace("　", " ")) for x, y in SAME))
    assert all(L.by_table(a) != L.by_table(b) for a, b in DIFFER)


def test_letters_of_other_scripts():
    same = ["ρp", "αa", "υu", "ҮY", "ӏl", "ѵv", "ԌG", "ցg", "ᎪA", "ᏚS", "𝐏P", "ⅤV", "ɡg", "ɑa", "ꓮA", "ⅣIV", "ĳij"]
    assert all(L.by_table(x[0]) == L.by_table(x[1:]) for x in same), [x for x in same if L.by_table(x[0]) != L.by_table(x[1:])]
    # a missing dot, a missing ascender, a curl and a raised place can be seen
    assert all(L.by_table(x[0]) != x[1:] for x in ("ιi", "ıi", "κk", "’'", "²2", "ⁿn", "0O", "−-"))
    for script in ("CYRILLIC", "GREEK", "ARMENIAN", "CHEROKEE", "LISU", "OTHER", "NEAR"):
        assert len(getattr(L, script)) == len(getattr(L, script + "_AS")), script


def test_costs_and_budget(spark):
    trie = L.Trie()
    for w in ("it's", "it’s", "kilo", "κılo"):
        trie.add(w, 1)
    assert set(trie.look_alikes("it's")) == {"it's"} and set(trie.look_alikes("it‘s")) == set()
    assert set(trie.look_alikes("it's", 0.25)) == {"it's", "it’s"}
    assert set(trie.look_alikes("kilo", 0.25)) == {"kilo"} and set(trie.look_alikes("kilo", 0.5)) == {"kilo", "κılo"}
    assert set(trie.look_alikes("kile", 0.9)) == set()
    one = spark.createDataFrame([("it’s a kıIo",), ("ıt's",)], "text string")
    given = spark.createDataFrame([("it's",), ("it's a kilo",)], "text string")
    assert {r.text: r.form for r in L.canonical_forms(one, given, 0.5).collect()} == {"it’s a kıIo": "it's a kıIo", "ıt's": "it's"}
    assert {r.text: r.form for r in L.canonical_forms(one, given).collect()} == {"it’s a kıIo": "it’s a kıIo", "ıt's": "ıt's"}


def test_trie_agrees_with_the_table():
    rng = random.Random(1)
    alphabet = "aоoехеё́é​cсｃ­-‑fiﬁ1l"
    words = {"".join(rng.choices(alphabet, k=rng.randint(1, 5))) for _ in range(400)}
    trie = L.Trie()
    for w in words:
        trie.add(w, 1)
    by_shape = defaultdict(set)
    for w in words:
        by_shape[L.shapes(w)].add(w)
    for w in [*words, *("".join(rng.choices(alphabet, k=4)) for _ in range(200))]:
        assert set(trie.look_alikes(w)) == by_shape.get(L.shapes(w), set())


def test_look_alike_links(spark):
    titles = [(1, "Fifth war"), (2, "Fіfth war"), (3, "Café"), (None, None), (4, ""), (5, "Copa  x")]
    links = [(1, "Fifth war"), (2, "Ｆifth war"), (3, "Café"), (4, "Cafe"), (5, None), (6, ""), (7, "Сора  x"), (8, "Copa x"), (9, "​")]
    p = spark.createDataFrame(titles, "page_id bigint, title string").selectExpr("*", "1 AS text", "2 AS form")
    q = spark.createDataFrame(links, "link_id bigint, target string").selectExpr("*", "1 AS page_id", "2 AS token")
    assert sorted(map(tuple, L.look_alike_links(q, p).collect())) == [(1, 2), (2, 1), (2, 2), (3, 3), (7, 5)]
    assert L.look_alike_links(q.limit(0), p).count() == L.look_alike_links(q, p.limit(0)).count() == 0
    forms = {r.text: r.form for r in L.canonical_forms(q.select(q.target.alias("text")), p.select(p.title.alias("text"))).collect()}
    assert forms["Ｆifth war"] == forms["Fifth war"] == "Fifth war" and forms[""] == "" and forms["Сора  x"] == "Copa  x"


def test_fill_keeps_limits():
    rng = np.random.default_rng(1)
    sizes = np.stack([rng.integers(1, 100, 500), np.ones(500, int), rng.integers(0, 60, 500)], axis=1)
    limits = np.array([100, 6, 70])
    box = P.fill(sizes, limits)
    for d in range(3):
        assert (np.bincount(box, sizes[:, d]) <= limits[d]).all()
    assert box.min() == 0 and len(np.unique(box)) == box.max() + 1
    least = max(sizes[:, d].sum() / limits[d] for d in range(3))
    assert box.max() + 1 <= 1.25 * least + 1
    assert len(P.fill(sizes[:0], limits)) == 0


def test_containers(spark):
    rng = random.Random(2)
    texts = [" ".join(["word"] * rng.choice([1, 5, 40, 90])) for _ in range(300)] + ["tale " * 700, "a b\nc d", None, "", "same text"] + ["same text"] * 20
    docs = spark.createDataFrame([(i, "s", t, 0) for i, t in enumerate(texts)], "doc_id bigint, source string, text string, piece int")
    packs = spark.createDataFrame([("p", 64), ("q", 200), ("none", 0), ("null", None)], "pack_name string, max_tokens int")
    rows = P.containers(docs, packs, shard=64).collect()
    encode = encoder(VOCABULARY).encode_ordinary
    sizes = {i: len(encode(t or "")) for i, t in enumerate(texts)}
    for pack, capacity in (("p", 64), ("q", 200)):
        mine = [r for r in rows if r.pack_name == pack]
        boxes = defaultdict(list)
        pieces = defaultdict(list)
        for r in mine:
            boxes[r.container_id].append(r)
            pieces[r.doc_id].append(r)
        assert all(sum(r.tokens for r in b) <= capacity and len(b) <= max(1, capacity // 16) for b in boxes.values())
        assert {i: sum(r.tokens for r in p) for i, p in pieces.items()} == {i: n for i, n in sizes.items() if n}
        assert all(len(p) == -(-sizes[i] // capacity) for i, p in pieces.items())
        for p in pieces.values():
            at = 0
            for r in sorted(p, key=lambda r: r.piece):
                assert r.start == at and 0 <= r.loss_tokens <= r.tokens
                at += r.tokens
    assert {r.pack_name for r in rows} == {"p", "q"}
    assert P.containers(docs.limit(0), packs).count() == P.containers(docs, packs.limit(0)).count() == 0


def test_groups_of_shards_stay_bounded(spark):
    docs = spark.createDataFrame([(i, "s", "one two" if i % 3 else "word " * 40) for i in range(6000)], "doc_id bigint, source string, text string")
    packs = spark.createDataFrame([("p", 64)], "pack_name string, max_tokens int")
    rows = P.containers(docs, packs, shard=64)
    groups = defaultdict(int)
    for r in rows.collect():
        groups[r.container_id >> 24] += 1
    assert max(groups.values()) <= 16 * 64 * 2 and len(groups) > 90
    found = P.report(rows, packs).first()
    assert found.most_segments <= 4 and found.most_tokens <= 64 and 2000 <= found.containers <= 2010  # no two long ones fit together
    assert tuple(P.rules(rows, packs).drop("pack_name").first()) == (6000, 0, 0, 0, 0, 0)


def test_loss_binds_and_is_not_shortened(spark):
    rows = [(i, "s", "head\n" + "word " * 20) for i in range(40)] + [(100 + i, "s", "word " * 30 + "\nx") for i in range(40)] + [(500, "s", "word " * 60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    packs = spark.createDataFrame([("p", 64)], "pack_name string, max_tokens int")
    got = P.containers(docs, packs, loss_share=0.5).collect()
    alone = next(r for r in got if r.doc_id == 500)
    assert alone.loss_tokens == alone.tokens >= 60
    boxes = defaultdict(int)
    for r in got:
        boxes[r.container_id] += r.loss_tokens
    assert boxes.pop(alone.container_id) == alone.loss_tokens and 20 < max(boxes.values()) <= 32


def test_flight_keeps_totals():
    rng = random.Random(3)
    size = [rng.randint(1, 50) for _ in range(400)]
    p = [rng.random() for _ in size]
    q = X.flight(p, size, rng)
    assert sum(0 < x < 1 for x in q) <= 2
    assert sum(q) == pytest.approx(sum(p)) and sum(a * b for a, b in zip(q, size)) == pytest.approx(sum(a * b for a, b in zip(p, size)))
    assert set(X.landing(q, size)) <= {0.0, 1.0}
    share = [sum(X.flight([0.3] * 8, [1] * 8, random.Random(i))[0] == 1 for i in range(400)) / 400]
    assert 0.15 < share[0] < 0.45


def test_mixture(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "A ", "b", "c", "other", None]), "word " * rng.randint(1, 60)) for i in range(3000)] + [(9000, "a", None), (9001, "a", ""), (None, "a", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string").selectExpr("*", "1 AS tokens", "2 AS p", "3 AS copies")
    targets = spark.createDataFrame([("a", 0.5, 1), (" B", 0.3, 2), ("c", 0.2, 3), ("gone", 0.0, 1), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    mix = X.Mixture(docs, targets, block=200)
    report = {r.source: r for r in mix.report.collect()}
    assert set(report) == {"a", "b", "c"}
    for r in report.values():
        assert r.actual_share == pytest.approx(r.target_share, abs=0.005) and r.repeats <= r.max_repeats
    got = mix.rows.collect()
    assert len({r.doc_id for r in got}) == len(got)
    again = X.Mixture(docs.repartition(7), targets, block=200).rows.collect()
    assert sorted(got) == sorted(again)
    assert X.Mixture(docs.limit(0), targets).rows.count() == 0 and X.Mixture(docs, targets.limit(0)).rows.count() == 0


def test_token_sizes(spark):
    docs = spark.createDataFrame([(1, " A ", "one\ntwo three"), (2, None, None)], "doc_id bigint, source string, text string")
    got = {r.doc_id: r for r in token_sizes(docs).collect()}
    assert got[1].source == "a" and 0 < got[1].prompt_tokens < got[1].tokens and got[2].tokens == 0


def test_personal_data_on_held_out_texts():
    model = pii.trained()
    hit = wrong = missed = 0
    for (_, spans), found in zip(sample := labelled(400, 99), model.find([t for t, _ in sample])):
        got = {(k, a, b) for a, b, k in found}
        hit, wrong, missed = hit + len(got & set(spans)), wrong + len(got - set(spans)), missed + len(set(spans) - got)
    assert hit / (hit + wrong) > 0.97 and hit / (hit + missed) > 0.96


def test_personal_data_in_texts_written_by_hand():
    rows = parsed()
    hit, missed, wrong = (defaultdict(int) for _ in range(3))
    for (text, items), spans in zip(rows, pii.trained().find([t for t, _ in rows])):
        got, want = {(k, text[a:b]) for a, b, k in spans}, set(items)
        for total, some in ((hit, got & want), (missed, want - got), (wrong, got - want)):
            for kind, _ in some:
                total[kind] += 1
    for kind in pii.KINDS:
        assert hit[kind] >= 0.85 * (hit[kind] + missed[kind]) and hit[kind] >= 0.85 * (hit[kind] + wrong[kind]), (kind, hit, missed, wrong)
    assert sum(hit.values()) >= 0.9 * (sum(hit.values()) + sum(missed.values())) and sum(hit.values()) >= 0.95 * (sum(hit.values()) + sum(wrong.values()))


def test_every_capitalised_run_is_a_candidate():
    for name in ("John Smith", "Ngozi Okafor", "J. R. Smith", "Smith, Mary", "Иван Петров", "Ludwig van Beethoven", "Ἑλένη Παπά"):
        text = f"then {name} left"
        assert ("name", 5, 5 + len(name)) in pii.candidates(text), name


def test_long_emails_are_whole():
    for email in ("bob@" + "x" * 130 + ".com", "a" * 140 + "@mail.example", "a." * 200 + "b@" + "c." * 200 + "example", "jane [AT] mail [DOT] example", "jane <at> mail.example"):
        text = f"Write to {email}, please."
        assert ("email", 9, 9 + len(email)) in pii.candidates(text), email
    begin = time.process_time()
    pii.candidates("a@" * 100_000 + "x at " * 50_000 + " dot " + "A. B " * 50_000 + "1 2 3 4 5 6 " * 20_000)
    assert time.process_time() - begin < 20


def test_personal_data(spark):
    text = "My teacher, Mrs Rosa O'Kestovic, wrote from rosa.kest@mail.example and\nlives at 12 Tanner Road,\nHulmford 20111. Call +44 1632 960001 after six. My SSN: 666-12-3456\n"
    rows = [(1, text), (2, None), (3, ""), (4, "The Rosa Canal and the Milan Quarry were merged. ISSN 1234-5678. See ISBN 978-0-123-456-7, page 3."), (5, "SSN: 666-12-3456 " + "x" * 300_000), (6, "SSN: 666-12-3456\nSSN: 666-12-3456")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS kind", "2 AS found_text")
    got = {(r.doc_id, r.kind, r.found_text) for r in pii.personal_data(df).collect()}
    assert {g for g in got if g[0] == 1} == {
        (1, "name", "Rosa O'Kestovic"), (1, "email", "rosa.kest@mail.example"), (1, "address", "12 Tanner Road,\nHulmford 20111"), (1, "phone", "+44 1632 960001"), (1, "id_number", "666-12-3456")}
    assert {g[0] for g in got} == {1, 5, 6} and sum(g[0] == 6 for g in got) == 1
    clean = {r.doc_id: r.clean_text for r in pii.redacted(df).collect()}
    assert clean[6] == "SSN: [ID_NUMBER]\nSSN: [ID_NUMBER]" and clean[2] is None and clean[4] == rows[3][1] and "[ADDRESS]. Call [PHONE]" in clean[1]
    assert pii.personal_data(df.limit(0)).count() == 0
