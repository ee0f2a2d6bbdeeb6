"""One consistent form for text that looks the same.

Tokens (what stands between spaces of any kind) are looked up in a trie of the vocabulary, the tokens of a
reference column. The walk is a weighted edit automaton: replacing a letter by one of equal shape, and
inserting or deleting a character nobody sees, cost nothing; a nearly equal letter (dotless i, a curly apostrophe) costs ``NEAR_COST``, any
other edit 1. The budget is 0 unless given. All vocabulary tokens reached within it look like the token; the plainest of them, then the most
frequent, then the first by code point, is the canonical spelling of all. A token that reaches none is
normalized by the same table. Both tries and tokens are taken after compatibility decomposition of
width forms and ligatures and canonical decomposition of accents, so how an accent is encoded makes no difference.

Only distinct tokens travel. They meet the vocabulary by the first shapes of their spelling, the last one and their number: look-alikes
always have them in common, so every trie is small and lives for one group of rows, and many tokens with one beginning are spread.

Nulls stay null and empty texts empty. A text's number of spaces is kept, their kind becomes U+0020.
Case, accents, digits against letters, superscripts and underscores stay as they are.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters of other scripts and the Latin letter of equal shape.
CYRILLIC = "АВЕІЈКМНОРЅСТУХаеіјорѕсухԁһԛԝҮүѴѵԌԚԜӀӏӔӕӘәҪҫ"
CYRILLIC_AS = "ABEIJKMHOPSCTYXaeijopscyxdhqwYyVvGQWIlÆæƏəÇç"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧνοαρυ"
GREEK_AS = "ABEZHIKMNOPTYXvoapu"
ARMENIAN = "ՕՍՏօսցոհզյ"
ARMENIAN_AS = "OUSougnhqj"
CHEROKEE = "ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᏔᏃ"
CHEROKEE_AS = "ABCDEGHJKLMPRSTVWZ"
LISU = "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ"
LISU_AS = "BPDTGKJCZFMNLSRVHWXYAEIOU"
OTHER = "‐‑ϲϹϳϺɡɑ"
OTHER_AS = "--cCjMga"
# What a reader can tell apart but may take for the other; a budget below 1 lets some of them pass.
NEAR = "ιıκ’‘ʼ−–γϒ"
NEAR_AS = "iik'''--yY"
SHAPE = dict(zip(CYRILLIC + GREEK + ARMENIAN + CHEROKEE + LISU + OTHER, CYRILLIC_AS + GREEK_AS + ARMENIAN_AS + CHEROKEE_AS + LISU_AS + OTHER_AS))
COARSE = dict(zip(NEAR, NEAR_AS))
#: What replacing a letter by one that is nearly equal costs; any other edit that shows costs 1.
NEAR_COST = 0.25

#: So many leading shapes, the last one and their number say which tokens can meet.
ROUTE = 6


def _unseen(ch: str) -> bool:
    """Format characters, joiners, fillers and variation selectors."""
    o = ord(ch)
    return (
        unicodedata.category(ch) == "Cf"
        or o in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0)
        or 0x180B <= o <= 0x180F
        or 0xFE00 <= o <= 0xFE0F
        or 0xE0100 <= o <= 0xE01EF
    )


def _spread(ch: str) -> str:
    """Width forms, Latin ligatures, Roman numerals and other typefaces to what they stand for; anything else stays, superscripts too."""
    o = ord(ch)
    if 0xFF01 <= o <= 0xFFEE or 0xFB00 <= o <= 0xFB06 or o == 0x3000 or 0x2160 <= o <= 0x217F or o in (0x132, 0x133):
        return unicodedata.normalize("NFKC", ch)
    if 0x2100 <= o <= 0x214F or 0x1D400 <= o <= 0x1D7FF:  # letters and digits in another typeface
        return unicodedata.normalize("NFKC", ch) if unicodedata.decomposition(ch).startswith("<font>") else ch
    return ch


class _Table(dict):
    """Characters' decompositions without the shape step, filled as they come."""

    def __missing__(self, ch: str) -> str:
        out = self[ch] = unicodedata.normalize("NFD", _spread(ch))
        return out


_UNITS, _UNSEEN = _Table(), {}


def unseen(ch: str) -> bool:
    if ch not in _UNSEEN:
        _UNSEEN[ch] = _unseen(ch)
    return _UNSEEN[ch]


def units(token: str) -> str:
    """The token as the automaton reads it: decomposed, with look-alikes and unseen characters as they are."""
    if token.isascii():
        return token
    return unicodedata.normalize("NFD", "".join(map(_UNITS.__getitem__, token)))


class _Shapes(dict):
    """What each character's place shows, filled as they come."""

    def __missing__(self, o: int) -> str | None:
        ch = chr(o)
        out = self[o] = None if unseen(ch) else SHAPE.get(ch, ch)
        return out


_SHAPES, _ROUGH = _Shapes(), str.maketrans(NEAR, NEAR_AS)


def shapes(token: str) -> str:
    """The token's visible shapes, decomposed."""
    if token.isascii():
        return token
    return unicodedata.normalize("NFD", units(token).translate(_SHAPES))


def by_table(token: str) -> str:
    return token if token.isascii() else unicodedata.normalize("NFC", shapes(token))


class Trie:
    """Vocabulary of one group, walked by the automaton."""

    def __init__(self) -> None:
        self.root: dict = {}
        self.hidden = False  # whether any spelling holds an unseen character

    def add(self, token: str, count: int) -> None:
        node = self.root
        for ch in units(token):
            node = node.setdefault(ch, {})
            self.hidden = self.hidden or unseen(ch)
        node.setdefault("", {})[token] = node.get("", {}).get(token, 0) + count

    def look_alikes(self, token: str, budget: float = 0.0) -> dict[str, int]:
        """Every vocabulary token within the budget, with its count."""
        states = self._closure({id(self.root): (0.0, self.root)})
        for ch in units(token):
            if unseen(ch):
                continue  # deleting it costs nothing
            want = SHAPE.get(ch, ch)
            rough = COARSE.get(want, want)
            step: dict[int, tuple[float, dict]] = {}
            for cost, node in states.values():
                for c, child in node.items():
                    shape = SHAPE.get(c, c)
                    if not c or (shape != want and not budget) or unseen(c):
                        continue
                    total = cost if shape == want else cost + NEAR_COST if budget and COARSE.get(shape, shape) == rough else 2 + budget
                    if total <= budget and (id(child) not in step or total < step[id(child)][0]):
                        step[id(child)] = total, child
            if not step:
                return {}
            states = self._closure(step)
        found: dict[str, int] = {}
        for _, node in states.values():
            found.update(node.get("", {}))
        return found

    def _closure(self, states: dict[int, tuple[float, dict]]) -> dict[int, tuple[float, dict]]:
        """The states and those behind unseen characters, whose insertion costs nothing."""
        if not self.hidden:
            return states
        todo = list(states.values())
        while todo:
            cost, node = todo.pop()
            for ch, child in node.items():
                if ch and not ch.isascii() and unseen(ch) and (id(child) not in states or cost < states[id(child)][0]):
                    states[id(child)] = cost, child
                    todo.append((cost, child))
        return states


def canonical(found: dict[str, int]) -> str:
    """The plainest spelling, then the most frequent, then the first."""

    def key(item: tuple[str, int]) -> tuple:
        token, count = item
        odd = sum(ch in SHAPE or unseen(ch) or _spread(ch) != ch for ch in token)
        return odd + abs(len(unicodedata.normalize("NFC", token)) - len(token)), -count, token

    return min(found.items(), key=key)[0]


def _route(token: str) -> str:
    """Equal for tokens that can reach each other within any budget below 1."""
    shape = token if token.isascii() else shapes(token).translate(_ROUGH)
    return f"{shape[:ROUTE]}{shape[-1:]}{len(shape)}"


def _routes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        route = pa.array([_route(t) for t in batch.column("token").to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([route, *batch.columns], names=["route", *batch.schema.names])


def _walk(batches: Iterator[pa.RecordBatch], budget: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (route, kind): a route's vocabulary (kind 0) comes before its tokens (kind 1)."""
    words, trie, plain, at = {}, None, True, None
    for batch in batches:
        tokens, forms = [], []
        for route, kind, token, n in zip(*(batch.column(c).to_pylist() for c in ("route", "kind", "token", "n"))):
            if route != at:
                words, trie, plain, at = {}, None, True, route
            if kind == 0:
                words[token] = words.get(token, 0) + n
                plain = plain and token.isascii()
                trie = None
                continue
            if plain and not budget and token.isascii():  # two spellings in ASCII never look the same
                found = {token: words[token]} if token in words else {}
            else:
                if trie is None:
                    trie = Trie()
                    for word, count in words.items():
                        trie.add(word, count)
                found = trie.look_alikes(token, budget)
            tokens.append(token)
            forms.append(by_table(token) if not found else canonical(found) if len(found) > 1 else next(iter(found)))
        yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), pa.array(forms, pa.string())], names=["token", "form"])


def _tokens(text: Column) -> Column:
    return F.split(text, r"\p{Zs}", -1)


def canonical_forms(texts: DataFrame, vocabulary: DataFrame, budget: float = 0.0) -> DataFrame:
    """(text, form): every distinct non-null text of ``texts.text`` in its canonical form.

    ``budget`` (below 1): how much a token may cost; 0 takes only what a reader can't tell apart, each ``NEAR_COST`` more lets one
    nearly equal letter pass. ``vocabulary.text`` gives the spellings to choose from. Other columns of both are ignored.
    """
    distinct = texts.select("text").dropna().distinct()
    pieces = distinct.select("text", F.posexplode(_tokens(F.col("text"))).alias("at", "token"))
    asked = pieces.select("token").distinct().select(F.lit(1).alias("kind"), "token", F.lit(0).cast("bigint").alias("n"))
    given = vocabulary.select(F.explode(_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    both = asked.unionByName(given.select(F.lit(0).alias("kind"), "token", "n")).filter("token <> ''")
    routed = both.mapInArrow(_routes, "route string, kind int, token string, n bigint")
    forms = routed.repartition("route").sortWithinPartitions("route", "kind").mapInArrow(lambda it: _walk(it, budget), "token string, form string")
    spelt = pieces.join(forms, "token", "left").select("text", F.struct("at", F.coalesce("form", "token").alias("form")).alias("p"))
    whole = spelt.groupBy("text").agg(F.sort_array(F.collect_list("p")).alias("p"))  # as many pieces as the text has
    return whole.select("text", F.array_join(F.col("p.form"), " ").alias("form"))


def look_alike_links(parsed_links: DataFrame, pages: DataFrame) -> DataFrame:
    """(link_id, page_id): targets and titles that look the same and differ in their bytes.

    Null and empty targets find nothing; a target that looks like several titles comes out with each.
    """
    targets = parsed_links.select("link_id", F.col("target").alias("text")).filter("text <> ''")
    titles = pages.select("page_id", F.col("title").alias("text")).filter("text <> ''")
    forms = canonical_forms(targets.select("text").unionByName(titles.select("text")), titles)
    named = titles.join(forms, "text").select("page_id", F.col("text").alias("title"), "form")
    same = forms.join(named, "form").filter("text <> title").select("text", "page_id")
    return targets.join(same, "text").select("link_id", "page_id")
