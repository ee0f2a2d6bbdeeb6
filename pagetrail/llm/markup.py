"""Markup to clean text with its structure: flat blocks classified by a decision tree.

A text is cut into flat blocks: lines, HTML elements that start a block, and the spans whose inside is no
markup (code, formulas). Comments, templates and tables leave before. A block is described by its
leading marker, the words and the link density of itself and its two neighbours, whether the neighbours have
the same marker, and which of four markup languages the text's own signs speak for. A decision tree that is
trained on a small labelled table (``markup_labels``) gives each block its kind: heading, list_item, code,
formula, text, or none for page furniture. Whole texts are read, in time linear in their length.

Null and empty texts have no block. Unclosed spans are ordinary text.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrail.functions.wikitext import page_text
from pagetrail.llm.batches import portions
from pagetrail.llm.markup_labels import LABELLED
from pagetrail.llm.trees import DecisionTree

OPEN, CLOSE = "\ue000", "\ue001"
KINDS = ("heading", "list_item", "code", "formula")

_TEXT_ENVS = r"verbatim\*?|lstlisting|minted|Verbatim"
_MATH_ENVS = r"equation\*?|align\*?|displaymath|math|gather\*?|multline\*?|eqnarray\*?"
#: Where a span that holds no markup of its own may begin.
_OPENER = re.compile(
    rf"""(?=[<`~\\$])(?:(?P<comment><!--)|(?P<nowiki><nowiki>)|<(?P<tag>pre|syntaxhighlight|source|math)\b[^<>]*(?<!/)>
    |(?:\A|(?<=\n)|(?<=\n[ ])|(?<=\n[ ]{{2}})|(?<=\n[ ]{{3}}))(?P<fence>`{{3,}}|~{{3,}})[^\n`]*\n
    |\\begin\{{(?P<env>{_TEXT_ENVS}|{_MATH_ENVS})\}}
    |(?<!\\)(?:(?P<dd>\$\$)|\\(?P<bracket>[\[(]))
    |(?<![\\$\w])\$(?P<dollar>[^\s$](?:[^$\n]*[^\s$\\])?)\$(?![\d$])
    |(?<!`)(?P<ticks>`{{1,2}})(?!`)(?P<inline>[^`\n]+)(?P=ticks)(?!`))""",
    re.X | re.I,
)
_HINT = re.compile(r"<!--|<nowiki>|<pre|<syntaxhighlight|<source|<math|```|~~~|\\begin|\\\[|\\\(|\$|`", re.I)
_NEST = re.compile(r"\{\{|\}\}|\{\||\|\}(?!\})|<table\b[^<>]*>|</table\s*>", re.I)
_BREAK = re.compile(r"(?i)(?=<(?:h[1-6]|li|ul|ol|dl|p|div|table)\b)|(?<=</h[1-6]>)|(?<=</li>)|(?<=</p>)|(?<=</ul>)|(?<=</ol>)")
_CODE_IN_PRE = re.compile(r"\s*<code\b[^<>]*>(.*)</code>\s*", re.S | re.I)
_SPAN = re.compile(f"{OPEN}(\\d+){CLOSE}")
_LINK = re.compile(r"\[\[([^\[\]]*)\]\]|\[([^\[\]]*)\]\([^()\s]*\)|<a\b[^<>]*>((?:[^<]|<(?!/?a\b))*)</a>", re.I)
_FURNITURE = re.compile(
    r"\[\[(?:Category|File|Image)\s*:[^\[\]]*(?:\[\[[^\[\]]*\]\][^\[\]]*)*\]\]\s*$|__[A-Z]+__|\\(?:label|begin|end|maketitle|tableofcontents|usepackage|documentclass)\b|\||!|</?(?:ul|ol|dl|table|div)\b[^<>]*>\s*$|#redirect\b", re.I
)
_HTML_H = re.compile(r"<h([1-6])\b[^<>]*>", re.I)
_SECTION = re.compile(r"\\(part|chapter|section|subsection|subsubsection|paragraph)\*?\s*\{")
_NUMBER = re.compile(r"\d{1,9}[.)]\s+\S")
#: For each language: what must occur at all, and the pattern that is then counted (None: the text itself is).
_SIGNS: tuple[tuple[tuple[str, re.Pattern | None], ...], ...] = (
    (
        *((t, None) for t in ("[[", "{{", "{|", "<ref", "<nowiki>", "<syntaxhighlight", "<source ", "<math")),
        ("''", re.compile(r"(?<![\w'])''++(?=\w)")),
        ("=", re.compile(r"^=+[^=\n]+=+[ \t]*$", re.M)),
        ("__", re.compile(r"__[A-Z]+__")),
    ),
    (("<", re.compile(r"<(?:p|h[1-6]|li|ul|ol|b|i|em|strong|a|table|div)\b[^<>]*>", re.I)),),
    (
        ("```", re.compile(r"^```", re.M)),
        ("~~", re.compile(r"^~~~|~~[^~\n]+~~", re.M)),
        ("**", re.compile(r"\*\*[^\s*][^*\n]*\*\*")),
        ("](http", None),
        ("#", re.compile(r"^#{1,6} +[A-Z][^\n]*\n(?:\n|\Z)", re.M)),
        ("|-", re.compile(r"^\|[-:| ]+\|[ \t]*$", re.M)),
        ("- ", re.compile(r"^ *- +\S", re.M)),
        ("+ ", re.compile(r"^ *\+ +\S", re.M)),
        (". ", re.compile(r"^\d{1,9}[.)] ", re.M)),
        ("\n===", re.compile(r"^[^\s=\-#*|<][^\n]*\n={4,}[ \t]*$", re.M)),
        ("\n---", re.compile(r"^[^\s=\-#*|<][^\n]*\n-{4,}[ \t]*$", re.M)),
        ("`", re.compile(r"(?<!`)`[^`\n]+`(?!`)")),
        ("\\*", None),
        ("_", re.compile(r"(?<!\w)_[^\s_][^_\n]*_(?!\w)")),
    ),
    (("\\", re.compile(r"\\(?:section|subsection|begin|item|textbf|emph|cite|label|footnote|documentclass|textit)\b|\\[$%&]|~\\")),),
)
MARKERS = (
    "none", "equals", "hash", "hash_tight", "star", "star_tight", "dash", "number", "html_h", "html_li", "section", "item",
    "underlined", "code", "formula", "dollar", "furniture", "rule", "colon_list", "indented",
)
_M = {name: i for i, name in enumerate(MARKERS)}


_LISTS = frozenset(("dash", "number", "star", "star_tight", "html_li", "item", "colon_list"))


class Block:
    __slots__ = ("marker", "depth", "body", "words", "density", "span_of", "gap")

    def __init__(self, marker: str, body: str, depth: int = 0, words: int = 0, density: float = 0.0, span_of: int = -1):
        self.marker, self.depth, self.body, self.words, self.density, self.span_of = marker, depth, body, words, density, span_of
        self.gap = False  # an empty line before it


def _without_nested(text: str) -> str:
    """Drop templates and tables; what is not closed, or closes nothing, stays."""
    if "{{" not in text and "{|" not in text and "<table" not in text.lower():
        return text
    close = {"}}": "{{", "|}": "{|", "</": "<t"}
    stack: list[tuple[str, int]] = []
    cuts: list[tuple[int, int]] = []
    for m in _NEST.finditer(text):
        kind = m[0][:2].lower()
        if kind in ("{{", "{|", "<t"):
            stack.append((kind, m.start()))
        elif stack and stack[-1][0] == close[kind]:
            start = stack.pop()[1]
            while cuts and cuts[-1][0] > start:
                cuts.pop()
            cuts.append((start, m.end()))
    out, at = [], 0
    for a, b in cuts:
        out.append(text[at:a])
        at = b
    out.append(text[at:])
    return "".join(out)


@cache
def _closer(key: str) -> re.Pattern:
    """What ends a span of this kind."""
    if key in ("pre", "syntaxhighlight", "source", "math"):
        return re.compile(rf"</{key}\s*>", re.I)
    if key[0] in "`~":
        return re.compile(rf"^[ ]{{0,3}}{key}[`~]*[ \t]*$", re.M)
    return re.compile(re.escape(key), re.I)


def _protected(text: str, spans: list[tuple[str, str]]) -> str:
    """The text with every span whose inside is no markup replaced by its number in ``spans``; comments are dropped.

    One scan: where the end of a span was looked for in vain, no later span of that kind ends either.
    """
    out: list[str] = []
    never: set[str] = set()
    done = at = 0
    while (m := _OPENER.search(text, at)) is not None:
        g = m.lastgroup
        at = m.start() + 1
        if g == "inline" or g == "dollar":
            found, body, end = "plain" if g == "inline" else "dollar", m[g], m.end()
        else:
            key = {"comment": "-->", "nowiki": "</nowiki>", "dd": "$$"}.get(g) or (m[g].lower() if g in ("tag", "env") else m[g])
            key = {"[": r"\]", "(": r"\)"}.get(key, key) if g == "bracket" else rf"\end{{{key}}}" if g == "env" else key
            if key in never:
                continue
            close = _closer(key).search(text, m.end())
            if close is None:
                never.add(key)
                continue
            body, end = text[m.end() : close.start()], close.end()
            if g == "dd" and ("$" in body or not body):  # the next sign is a single one
                continue
            if g == "bracket" and not body:
                continue
            code = g == "fence" or (g == "tag" and key != "math") or (g == "env" and re.fullmatch(_TEXT_ENVS, m[g], re.I))
            found = "comment" if g == "comment" else "plain" if g == "nowiki" else "code" if code else "formula"
            if g == "tag" and (inner := _CODE_IN_PRE.fullmatch(body)):
                body = html.unescape(inner[1])
        out.append(text[done : m.start()])
        if found != "comment":
            out.append(f"{OPEN}{len(spans)}{CLOSE}")
            spans.append((found, body))
        done = at = end
    out.append(text[done:])
    return "".join(out)


def blocks_of(text: str) -> tuple[list[Block], list[int]]:
    """The flat blocks of a text in order, and how strongly its signs speak for wiki, HTML, Markdown and TeX."""
    spans: list[tuple[str, str]] = []

    if OPEN in text or CLOSE in text:
        text = text.replace(OPEN, "\ufffd").replace(CLOSE, "\ufffd")
    plain = _protected(text, spans) if _HINT.search(text) else text
    signs = [0, 0, 0, 0]
    for k, language in enumerate(_SIGNS):
        for gate, pattern in language:
            if gate in text:
                signs[k] += plain.count(gate) if pattern is None else len(pattern.findall(plain))
    if "<" in text:  # tags whose inside is protected
        signs[0] += sum(text.count(t) for t in ("<math", "<syntaxhighlight", "<source ", "<nowiki>"))
    signs[2] += text.count("\n```") + text.count("\n~~~")
    if "\\begin{" in text and "```" not in text and "<source " not in text:
        signs[3] += 2 * text.count("\\begin{")
    plain = _without_nested(plain)
    if "<" in plain:
        plain = "\n".join(p for p in _BREAK.split(plain) if p)
    raw = plain.split("\n")
    lines = [line.strip() for line in raw]
    may_indent = signs[2] >= max(signs)
    code: list[str] = []
    out: list[Block] = []
    gap = True
    for i, bare in enumerate(lines):
        if bare[:1] == ">":
            bare = bare.lstrip("> \t")
        if not bare or bare in ("<p>", "</p>", "</li>", "<br>", "<br />"):
            gap = gap or not bare
            continue
        if may_indent and raw[i].startswith(("    ", "\t")) and bare[0] not in "<\\" and OPEN not in bare:
            if code or (gap and (not out or out[-1].marker not in _LISTS)):
                code += [""] * (gap and bool(code)) + [raw[i].removeprefix("\t").removeprefix("    ")]
                gap = False
                continue
        if code:
            out.append(_indented(code))
            code = []
        line_no = len(out)
        found = _line(bare, lines[i + 1] if i + 1 < len(lines) else "", spans)
        if found is not None:
            found.gap = gap
            out.append(found)
        gap = False
        if OPEN in bare:
            for m in _SPAN.finditer(bare):
                kind, body = spans[int(m[1])]
                if kind != "plain":
                    out.append(Block(kind, body, words=body.count(" ") + 1, span_of=line_no if found is not None else -1))
    if code:
        out.append(_indented(code))
    for block in out:
        if OPEN in block.body:
            block.body = _SPAN.sub(lambda m: spans[int(m[1])][1] if spans[int(m[1])][0] == "plain" else f"{OPEN}{m[1]}{CLOSE}", block.body)
    return out, signs


def _indented(lines: list[str]) -> Block:
    block = Block("indented", "\n".join(lines), words=sum(line.count(" ") + 1 for line in lines))
    block.gap = True
    return block


def _line(bare: str, following: str, spans: list) -> Block | None:
    """The block of one line; None for a line that is only code or a formula."""
    if bare[0] == OPEN and _SPAN.sub("", bare).strip(" .,;") == "" and all(spans[int(m[1])][0] != "plain" for m in _SPAN.finditer(bare)):
        return None
    marker, depth, body, first = "none", 0, bare, bare[0]
    if first == "=" == bare[-1] and bare.strip("= \t"):
        before, after = (min(6, len(bare) - len(bare.lstrip("="))), min(6, len(bare) - len(bare.rstrip("="))))
        marker, depth, body = "equals", min(before, after), bare[before : len(bare) - after].strip()
    elif first in "=-" and len(bare) > 2 and bare.strip(first) == "":
        return Block("rule", "", words=0)
    elif _FURNITURE.match(bare):
        marker = "furniture"
    elif first == "#":
        rest = bare.lstrip("#")
        depth = len(bare) - len(rest)
        marker, body = ("hash" if rest[:1].isspace() else "hash_tight"), rest.strip().rstrip("#").rstrip()
        body = body.lstrip("*#:").strip()
    elif first == ":" and bare.lstrip(":")[:1] in ("*", "#"):
        rest = bare.lstrip("*#:")
        depth, marker, body = len(bare) - len(rest), "colon_list", rest.strip()
    elif first == "*":
        rest = bare.lstrip("*#:")
        depth = len(bare) - len(rest)
        marker, body = ("star" if depth == 1 and rest[:1].isspace() else "star_tight"), rest.strip()
    elif first in "-+" and len(bare) > 2 and bare[1].isspace():
        marker, body = "dash", bare[2:].strip()
    elif first.isdigit() and _NUMBER.match(bare):
        marker, body = "number", bare.split(None, 1)[1]
    elif first == "<":
        low = bare[:4].lower()
        if m := _HTML_H.match(bare):
            marker, depth, body = "html_h", int(m[1]), bare[m.end() :]
        elif low[:3] == "<li" and (low[3:] in (">", " ")):
            marker, body = "html_li", bare[bare.find(">") + 1 :]
    elif first == "\\":
        if m := _SECTION.match(bare):
            marker, depth, body = "section", {"section": 1, "subsection": 2, "subsubsection": 3}.get(m[1], 1), bare[m.end() :].rsplit("}", 1)[0]
        elif bare[:5] == "\\item":
            marker, body = "item", bare[5:].strip()
    elif following and following[0] in "=-" and len(following) > 2 and following.strip(following[0]) == "":
        marker, depth = "underlined", 1 if following[0] == "=" else 2
    words = body.count(" ") + 1 if body else 0
    density = 0.0
    if words and ("[" in body or "<a" in body.lower()):
        density = min(1.0, sum((m[1] or m[2] or m[3] or "").count(" ") + 1 for m in _LINK.finditer(body)) / words)
    return Block(marker, body, depth, words, density)


def features(blocks: list[Block], signs: list[int]) -> list[tuple]:
    """One row a block: marker, depth, words and density of itself and its neighbours, and the text's language."""
    total = sum(signs) or 1
    tongue = tuple(s / total for s in signs)
    best = max(range(4), key=lambda k: (signs[k], -k))
    main = tuple(float(k == best) for k in range(4))
    rows = []
    n = len(blocks)
    for i, b in enumerate(blocks):
        p = blocks[i - 1] if i else None
        q = blocks[i + 1] if i + 1 < n else None
        rows.append((
            _M[b.marker], b.depth, b.words, b.density, p.words if p else 0, p.density if p else 0.0, q.words if q else 0, q.density if q else 0.0,
            p is not None and p.marker == b.marker, q is not None and q.marker == b.marker, q is not None and q.marker == "rule",
            b.marker == "hash" and b.body[:1].isupper(), b.body[:1].isdigit(), b.span_of >= 0, b.gap, q is None or q.gap, i == 0, *tongue, *main,
        ))
    return rows


def matrix(rows: list[tuple]) -> np.ndarray:
    raw = np.array(rows, float).reshape(len(rows), -1)
    return np.hstack([raw[:, 1:], np.eye(len(MARKERS))[raw[:, 0].astype(int)]])


def _variants(parts: list[tuple[str, str]], rng: random.Random, times: int) -> Iterator[tuple[str, str]]:
    """The labelled text, then versions with its pieces in other orders, some left out, and other lengths.

    Lists stay together, as do a title and its underline. So order and length tell the tree what they really
    tell and no more.
    """
    yield "\n".join(t for t, _ in parts), " ".join(k for _, k in parts)
    chunks: list[list[tuple[str, str]]] = []
    for part in parts:
        if not part[0]:
            continue
        tail = chunks[-1][-1] if chunks else ("", "")
        together = (part[1] == "list_item" == tail[1] and (rng.random() < 0.8 or "<li" in part[0] or "\\item" in part[0])) or part[0].strip("-=") == ""
        if together:
            chunks[-1].append(part)
        else:
            chunks.append([part])
    for _ in range(times):
        pick = [c for c in chunks if rng.random() < 0.8]
        rng.shuffle(pick)
        texts = ["\n".join(_longer(t, k, rng) for t, k in c) for c in pick]
        yield "\n\n".join(texts), " ".join(k for c in pick for _, k in c)


def _longer(text: str, kind: str, rng: random.Random) -> str:
    if kind in ("code", "formula", "none") or len(text) < 5:
        return text
    more = rng.randrange(40) if kind.startswith("text") else rng.choice((0, 0, 1, 2, 3, 6))
    return re.sub(r"(?<![\w<\\/])([A-Za-z]{3,})(?=[ \w]*)(?![^<]*>)(?!\{)", lambda m: m[0] + " word" * more, text, count=1)


@cache
def trained() -> DecisionTree:
    """The tree, fitted to the labelled table and its variants (some thousand blocks)."""
    rows: list[tuple] = []
    labels: list[str] = []
    rng = random.Random(0)
    for parts in LABELLED:
        for i, (text, want) in enumerate(_variants(parts, rng, 40)):
            blocks, signs = blocks_of(text)
            kinds = want.split()
            if len(blocks) != len(kinds):
                if i:
                    continue
                raise ValueError(f"{len(blocks)} blocks, {len(kinds)} labels: {[(b.marker, b.body) for b in blocks]} {kinds}")
            rows += features(blocks, signs)
            labels += kinds
    return DecisionTree(least=3).fit(matrix(rows), labels)


def classify(texts: list[str | None], tree: DecisionTree) -> list[list[tuple[str, Block]]]:
    """(kind, block) of every block of every text; the tree sees the batch at once."""
    every, rows = [], []
    for text in texts:
        blocks, signs = blocks_of(text) if text else ([], [0] * 4)
        every.append(blocks)
        rows += features(blocks, signs)
    kinds = [tree.classes[k] for k in tree.predict(matrix(rows))] if rows else []
    out, at = [], 0
    for blocks in every:
        out.append(list(zip(kinds[at : at + len(blocks)], blocks)))
        at += len(blocks)
    return out


_STRIP = (
    (re.compile(r"<ref\b[^<>]*/>|<ref\b[^<>]*>(?:[^<]|<(?!/?ref\b))*</ref>", re.I), ""),
    (re.compile(r"\[\[(?:File|Image|Category)\s*:[^\[\]]*(?:\[\[[^\[\]]*\]\][^\[\]]*)*\]\]", re.I), ""),
    (re.compile(r"\[\[[^\[\]|]*\|([^\[\]|]+)\]\]"), r"\1"),
    (re.compile(r"\[\[:?([^\[\]|#]*)(?:#[^\[\]|]*)?\|?\]\]"), r"\1"),
    (re.compile(r"\[([^\[\]]*)\]\([^()\s]*\)"), r"\1"),
    (re.compile(r"\[https?://[^\s\[\]]+ ([^\[\]]*)\]"), r"\1"),
    (re.compile(r"'{2,5}|~~(?=\S)|(?<=\S)~~|\*\*"), ""),
    (re.compile(r"(?<![\w_])_([^\s_][^_\n]*)_(?![\w_])"), r"\1"),
    (re.compile(r"~?\\(?:cite|footnote|label|ref)\s*\{[^{}]*\}"), ""),
    (re.compile(r"\\(?:textbf|textit|emph|texttt|underline)\s*\{([^{}]*)\}"), r"\1"),
    (re.compile(r"</?[A-Za-z][^<>]*>"), ""),
    (re.compile(r"\\([$%&#_{}*])"), r"\1"),
)


def _inline(body: str) -> str:
    for pattern, by in _STRIP:
        body = pattern.sub(by, body)
    return re.sub(r"[ \t\xa0]+", " ", html.unescape(body)).strip()


def render(parts: list[tuple[str, Block]]) -> str:
    """Plain text: '# ' before headings, '- ' before list items, ``` around code, $ around formulas."""
    out: list[str] = []
    spans: dict[int, list[tuple[str, Block]]] = {}
    for kind, block in parts:
        if block.span_of >= 0:
            spans.setdefault(block.span_of, []).append((kind, block))
    for i, (kind, block) in enumerate(parts):
        if block.span_of >= 0 or block.marker == "rule":
            continue
        mine = iter(spans.get(i, ()))

        def put(m: re.Match) -> str:
            k, b = next(mine, ("text", Block("none", "")))
            return f"${b.body.strip()}$" if b.marker in ("formula", "dollar") else f"`{b.body.strip()}`"

        body = block.body
        if kind == "code":
            out.append(f"```\n{body.strip(chr(10))}\n```")
        elif kind == "formula":
            out.append(f"${body.strip()}$")
        elif kind != "none":
            clean = _SPAN.sub(put, _inline(body))
            if clean:
                out.append(f"{'#' * max(1, block.depth)} {clean}" if kind == "heading" else f"- {clean}" if kind == "list_item" else clean)
    return "\n".join(out)


def _pieces(batches: Iterator[pa.RecordBatch], tree: DecisionTree) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches, "text"):
        ids, kinds, places = [], [], []
        for i, parts in zip(batch.column("id").to_pylist(), classify(batch.column("text").to_pylist(), tree)):
            seen = dict.fromkeys(KINDS, 0)
            for kind, _ in parts:
                if kind in seen:
                    seen[kind] += 1
                    ids.append(i)
                    kinds.append(kind)
                    places.append(seen[kind])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array(places, pa.int32())], names=["raw_id", "piece", "seq"])


def _clean(batches: Iterator[pa.RecordBatch], tree: DecisionTree) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches, "text"):
        texts = [render(parts) for parts in classify(batch.column("text").to_pylist(), tree)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=["raw_id", "clean_text"])


def _docs(raw_pages: DataFrame) -> DataFrame:
    return raw_pages.select(F.col("raw_id").alias("id"), page_text(F.col("revision")).alias("text"))


def pieces(raw_pages: DataFrame) -> DataFrame:
    """(raw_id, piece, seq): the structural pieces of the records without a redirect title."""
    kept = raw_pages.filter(F.coalesce(F.col("redirect._title"), F.lit("")) == "")
    tree = trained()
    return _docs(kept).mapInArrow(lambda it: _pieces(it, tree), "raw_id bigint, piece string, seq int")


def clean_text(raw_pages: DataFrame) -> DataFrame:
    """(raw_id, clean_text) of every record; '' where there is no text."""
    tree = trained()
    return _docs(raw_pages).mapInArrow(lambda it: _clean(it, tree), "raw_id bigint, clean_text string")
