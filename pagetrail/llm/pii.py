"""Personal information in free text: candidate spans, boosted trees, calibrated thresholds.

Generators with high recall propose spans, which may overlap: email addresses (also disguised ones), phone
numbers, identity numbers, street addresses, person names. Each candidate is described by its format (length,
digits, separators, known shapes, known given names, kinds of street words) and its context (cue
words before and after, what it touches). Gradient-boosted trees, trained here on a bounded number of labelled
sentences (``pii_labels``), score it; per kind a threshold calibrated on held-out sentences selects, and of
overlapping selected spans the one with the best score stays, the longer one on a tie. Whole texts are read.

Null and empty texts contain nothing and come out as they are. Found text stands as in the text.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrail.llm.batches import portions
from pagetrail.llm.pii_labels import FAMILY, GIVEN, labelled
from pagetrail.llm.trees import BoostedTrees

KINDS = ("email", "phone", "id_number", "address", "name")
#: Labelled texts for fitting and for the thresholds.
FIT, HELD_OUT = 6000, 1500

#: Capitals of every script that has them.
_UP = "A-ZÀ-ÖØ-Þ" + "".join(chr(c) for c in (*range(0x100, 0x590), *range(0x10A0, 0x1100), *range(0x1E00, 0x2000)) if chr(c).isupper() or chr(c).istitle())
_MARK = "̀-ͯ"
_L = rf"[\w{_MARK}]"
_AT = r"(?:[ ]?[(\[{<][ ]?(?:at|AT|ät)[ ]?[)\]}>][ ]?|[ ](?:at|AT)[ ]|@)"
_DOT = r"(?:[ ]?[(\[{][ ]?(?:dot|DOT|punkt|point|punto)[ ]?[)\]}][ ]?|[ ](?:dot|DOT)[ ]|\.)"
_LOCAL = rf"(?<![\w.+\-@]){_L}[\w.+\-'{_MARK}]*+"
_LOCAL_START = re.compile(rf"(?<![\w.+\-@]){_L}")
_TOP = r"[^\W\d_][\w\-]*"
#: By the sign between name and host: plain, in brackets, in words.
_EMAILS = {
    "@": re.compile(rf"{_LOCAL}@(?:[\w\-]+\.)*[\w\-]+(?<![-\d])"),
    "(": re.compile(rf"{_LOCAL}(?:{_DOT}[\w+\-]+)*?[ ]?[(\[{{<][ ]?(?:at|AT|ät)[ ]?[)\]}}>][ ]?(?:[\w\-]+{_DOT})+{_TOP}"),
    " ": re.compile(rf"{_LOCAL}[ ](?:at|AT)[ ](?:[\w\-]+[ ](?:dot|DOT)[ ])+{_TOP}"),
}
_PHONES = [
    re.compile(p)
    for p in (
        r"(?<![\w.+/\-])(?:\+?1[ .\-]?)?(?:\(\d{3}\)[ ]?|\d{3}[ .\-])\d{3}[ .\-]\d{4}(?![\w]|[-./]\d)",
        r"(?<![\w.+/\-])\+\d{7,14}(?!\w)",
        r"(?<![\w.+/\-])\+\d{1,3}(?:[ .\-/]{1,3}(?:\(\d{1,5}\)|\d{1,8})){1,6}(?![\w]|[-./]\d)",
        r"(?<![\w.+/\-])00\d{2}(?:[ .\-/]{1,3}(?:\(\d{1,5}\)|\d{1,8})){1,6}(?![\w]|[-./]\d)",
        r"(?<![\w.+/\-])(?:\(0\d{1,5}\)|0\d{1,5})[ /\-]{1,3}\d{3,8}(?:[ \-]\d{2,5}){0,2}(?![\w]|[-./]\d)",
        r"(?<![\w.+/\-])\d{2,4}(?:([ .])\d{2,3})(?:\1\d{2,3}){1,3}(?![\w]|[-./]\d)",
        r"(?<![\w.+/\-])\d{3}[ ]\d{1,2}[ ]\d{2}(?!\w)",
        r"(?<![\w.+/\-])\d{9,11}(?!\w)",
    )
]
_IDS = [
    re.compile(p)
    for p in (
        r"(?<![\w.+/\-])\d{3}([ \-])\d{2}\1\d{4}(?![\w]|[-./]\d)",
        r"(?<![\w.+/\-])\d{6}[\-+]\d{4}(?![\w]|[-./]\d)",
        r"(?<![\w.+/\-])\d{2,3}/\d{3}/\d{4,5}(?![\w]|[-./]\d)",
        r"(?<![\w.+/\-])[A-Z]{2}[ ]?\d{2}[ ]?\d{2}[ ]?\d{2}[ ]?[A-Z](?!\w)",
        r"(?<![\w.+/\-])\d{2}-\d{3}-\d{3}-[A-Z](?!\w)",
        r"(?<![\w.+/\-])[A-Z]{1,2}\d{6,9}(?!\w)",
        r"(?<![\w.+/\-])\d{8}-?[A-Z](?!\w)",
        r"(?<![\w.+/\-])\d{3}-\d-\d{3}-\d{3}-\d(?!\w)",
        r"(?<![\w.+/\-])\d{4}-\d{4}(?![\w]|[-./]\d)",
        r"(?<![\w.+/\-])\d{3}[ \-]\d{3}[ \-]\d{4}(?![\w]|[-./]\d)",
        r"(?<![\w.+/\-])[12][ ]\d{2}[ ]\d{2}[ ]\d{2}[ ]\d{3}[ ]\d{3}(?:[ ]\d{2})?(?!\w)",
        r"(?<![\w.+/\-])\d{2}[ ]\d{3}[ ]\d{3}[ ]\d{3}(?!\w)",
        r"(?<![\w.+/\-])\d{2}[ ]\d{6}[ ][A-Z][ ]\d{3}(?!\w)",
        r"(?<![\w.+/\-])\d{9,11}(?!\w)",
    )
]
#: Bank accounts and document numbers of letters and digits.
_CODES = re.compile(r"(?<![\w.+/\-])(?:[A-Z]{2}\d{2}(?:[ ]?[A-Z\d]{4}){2,7}(?:[ ]?[A-Z\d]{1,3})?|[A-Z](?=[A-Z]{0,9}\d)[A-Z\d]{7,9})(?!\w)")
_GAP = r"(?:,?[ ]|,?\n|,?[ ]\n)"
_TOWN = rf"(?:(?:Bad|San|Santa|Saint|Sankt|St\.|New|Old|Upper|Lower|North|South|East|West|Le|La|Los|Las)[ ])?[{_UP}][\w'’\-{_MARK}]+"
_ROAD = r"(?:Road|Highway|Hwy\b\.?|Rd\b\.?|Street|St\b\.?|Avenue|Ave\b\.?|Lane|Ln\b\.?|Close|Court|Ct\b\.?|Boulevard|Blvd\b\.?|Drive|Dr\b\.?|Way|Place|Pl\b\.?|Square|Terrace|Row|Crescent|Hill|Grove|Parade)"
_CODE = r"(?:[A-Z]{1,2}\d[A-Z\d]?[ ]\d[A-Z]{2}|\d{5}(?:-\d{4})?|[A-Z]{2}[ ]\d{5}(?:-\d{4})?)"
_TAIL = rf"(?:[ ](?:NW|NE|SW|SE|N|S|E|W)\b\.?)?{_GAP}(?:(?:D-|F-|E-)?\d{{4,5}}(?:[ ][A-Z]{{2}})?[ ]{_TOWN}|{_TOWN}(?:,?[ ]{_CODE})?)"
_ADDRESSES = [
    re.compile(p)
    for p in (
        rf"(?<![\w\-/.])(?:(?:Flat|Apt\.?|Apartment|Unit|Suite|Room)[ ]\d+[a-z]?,[ ])?\d{{1,5}}[a-z]?[ ](?:[{_UP}][\w'’\-]+[ ]){{1,3}}{_ROAD}(?:{_TAIL})?(?!\w)",
        rf"(?<![\w\-/.])(?:P\.[ ]?O\.|PO|P\.O)[ ]Box[ ]\d+(?:{_TAIL})?(?!\w)",
        rf"(?<![\w\-/.])[{_UP}][\w'’\-]*(?:straße|strasse|str\.|gasse|platz|allee|weg|ring|ufer|damm)[ ]\d{{1,4}}(?:[ ]?[a-z]\b)?(?:{_TAIL})?(?!\w)",
        rf"(?<![\w\-/.])\d{{1,4}}(?:[ ](?:bis|ter))?,?[ ](?:rue|avenue|boulevard|impasse|chemin|place|allée|quai|route|cours)[ ](?:(?:de|du|des|la|le|les|l['’])[ ]?){{0,2}}[{_UP}][\w'’\-]+(?:[ ][{_UP}][\w'’\-]+)?(?:{_TAIL})?(?!\w)",
        rf"(?<![\w\-/.])(?:Via|Viale|Corso|Piazza|Largo)[ ](?:(?:di|del|della|dei|delle|degli|al|alla)[ ])?[{_UP}][\w'’\-]+(?:[ ][{_UP}][\w'’\-]+)?,?[ ]\d{{1,4}}(?:/?[a-z]\b)?(?:{_TAIL})?(?!\w)",
        rf"(?<![\w\-/.])[{_UP}][\w'’\-]*(?:straat|laan|plein|gracht|kade|dijk|steeg|gatan|vägen|vej|gade)[ ]\d{{1,4}}(?:[ \-]?[a-zA-Z]\b)?(?:{_TAIL})?(?!\w)",
        rf"(?<![\w\-/.])[{_UP}][\w'’\-]+[ ](?:Straße|Strasse|Str\.|Allee|Weg|Platz|Ring|Ufer|Damm|Markt)[ ]\d{{1,4}}(?:[ ]?[a-z]\b)?(?:{_TAIL})?(?!\w)",
        rf"(?<![\w\-/.])(?:Calle|C/|Plaza|Paseo|Avenida|Avda\.|Camino|Ronda)[ ](?:(?:de|del|la|las|los|el)[ ]){{0,2}}[{_UP}][\w'’\-]+(?:[ ][{_UP}][\w'’\-]+)?,?[ ]\d{{1,4}}(?:,[ ](?:bajo|\d{{1,2}}\.[ºª°](?:[ ][A-Z]\b)?))?(?:{_TAIL})?(?!\w)",
    )
]
_W = rf"[{_UP}][\w'’{_MARK}]+(?:-[{_UP}][\w'’{_MARK}]+)*"
_PARTICLE = r"(?:van(?:[ ](?:der|den|de))?|von(?:[ ](?:der|dem))?|zu|de(?:[ ](?:la|los|las))?|del|della|di|da|dos|du|bin|ibn|al|el|ten|ter|af|y)"
#: A compass letter behind a decimal number is no initial.
_DEGREES = re.compile(r"\d\.\d+°?[ ]?[NESW]$")
_PARTICLE_BEFORE = re.compile(rf"(?<!\w){_PARTICLE}[ ]$")
_PARTICLE_STARTS = frozenset("vzdbaety")
#: A unit of a name with what stands before it: a capitalised word, or an initial.
_UNIT_OF_NAME = re.compile(rf"(?P<gap>,?(?:[ ]|\n(?!\n))|(?<=\.))?(?P<of>{_PARTICLE}[ ])?(?P<word>(?P<initial>[{_UP}]\.)|{_W})")
#: Words that are capitalised at the start of a sentence and begin no name.
_STARTERS = frozenset(
    """the this that these those then there they we he she it its i in on at of to for from with and but or if as by after before when where while who how what why not no yes
    all some many most each every one two three our my your his her their is are was were be see der die das ein eine einer im am an auf aus bei mit nach von vor zu und oder aber wenn wie
    was wo wer sie er es ich wir ihr sein seine ihre nicht kein le la les un une des du de et ou mais dans sur sous avec pour par sans ce cette ces il elle on nous vous ils elles je que qui el los las una uno unos
    del en con por para sin y o pero como cuando donde su sus este esta estos mein meine meinem meiner dein deine unser unsere ihre mon ma mes notre votre leur mi mis tu tus nuestro nuestra""".split()
)
_THINGS = frozenset(
    """river island canal quarry bridge road street mount lake valley tower museum park school hall church hospital station university library
    house court castle port harbour market square field forest hill bay coast peak avenue lane close garden gate mill company award prize law effect method
    theorem map ship class mountains falls county city town village district province page box archiv archive seite weiterleitung artikel turm kanal
    hafen markt bahnhof tunnel garten jahr flat unit apt""".split()
)
_CUES = {
    "name": frozenset(
        """to ask am by subject mr mrs ms miss dr prof dame sir herr herrn frau m mme mlle monsieur madame sr sra señor señora don doña contact signed signé firmado gruß grüße
        gruss -- bin suis soy an à a teacher thanks danke merci gracias regards yours author from von par por gezeichnet kontakt demandez pregunte bitte""".split()
    ),
    "phone": frozenset("call ring tel phone number telephone telefon teléfono téléphone tél fax mobile unter appelez llame al le desk archiv musée museo or oder ou o handy".split()),
    "id_number": frozenset("ssn security insurance ni tax id passport code citizen identity card number no personal dni nie pass steuer nummer numéro número is ist est es".split()),
    "address": frozenset("at from to address anschrift adresse dirección wohne habite vivo book live contact an au a sent".split()),
    "email": frozenset("to at mailto contact kontakt contacto e-mail email mail write reach address adresse correo is ist est es".split()),
}
_BAD = frozenset(
    "catalogue isbn issn revision version vertex vol page score ratio bug template dump md5 file coordinates item model part serial order invoice room lot the der die das la le el los las les".split()
)
_AFTER = frozenset("wrote asked before and for holds last et und y near or avant antes fragen schrieb a".split())
_UNIT = frozenset("bytes links pages revisions clicks edges users mb kb words is was were has have".split())
_WORD = re.compile(r"[\w'’@&/\-]+")
_PERSON_VERBS = frozenset(
    """said says wrote writes lives lived works worked was is has had moved came told explained called asked reported died drew joined sagte sagt schrieb schreibt wohnt wohnte arbeitet arbeitete
    kam erklärte war ist hat dit écrit habite travaille est a vient expliqué dijo dice escribió escribe vive trabaja vino es explicó""".split()
)
_BEFORE_NAME = frozenset("by with met and told und mit von laut wie sprach et avec par selon y con por según de e dear hi hello lieber liebe estimado estimada cher chère patient name yesterday gestern hier ayer according then hat".split())
_TITLES = frozenset("mr mrs ms miss dr prof dame sir herr herrn frau m mme mlle monsieur madame sr sra señor señora don doña signed signé firmado gruß dear regards architect architekt architecte arquitecta teacher doctor ärztin nurse neighbour author editor".split())
_CYRILLIC = dict(zip("абвгдезийклмнопрстуфхыэ", "abvgdeziyklmnoprstufhye")) | {"ж": "zh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sch", "ю": "yu", "я": "ya", "ь": "", "ъ": "", "ё": "e"}
#: What must occur in a text for the address pattern of the same place to be tried.
_GATES = (
    ("Road", "Rd", "Street", "St", "Ave", "Lane", "Ln", "Close", "Court", "Ct", "Boulevard", "Blvd", "Drive", "Dr", "Way", "Place", "Pl", "Square", "Terrace", "Row", "Crescent", "Hill", "Grove", "Parade"),
    (" Box ",),
    ("straße ", "strasse ", "str. ", "gasse ", "platz ", "allee ", "weg ", "ring ", "ufer ", "damm "),
    ("rue ", "avenue ", "boulevard ", "impasse ", "chemin ", "place ", "allée ", "quai ", "route ", "cours "),
    ("Via ", "Viale ", "Corso ", "Piazza ", "Largo "),
    ("straat ", "laan ", "plein ", "gracht ", "kade ", "dijk ", "steeg ", "gatan ", "vägen ", "vej ", "gade "),
    (" Straße ", " Strasse ", " Str. ", " Allee ", " Weg ", " Platz ", " Ring ", " Ufer ", " Damm ", " Markt "),
    ("Calle ", "C/ ", "Plaza ", "Paseo ", "Avenida ", "Avda. ", "Camino ", "Ronda "),
)
_NUMERIC = re.compile(r"\d(?:[\d.\-/()]|[ ]/[ ]|[ ](?=[\d(+]))+")
_NUMBERED = re.compile(r"\d{1,5}[a-z]?,?[ ](?:bis,?[ ]|ter,?[ ])?[^\W\d_]")
_CAPITAL = re.compile(rf"[{_UP}][\w'’{_MARK}]*(?:-[{_UP}][\w'’{_MARK}]+)*")
#: What a text with an at sign of any kind holds.
_AT_SIGNS = ("@", " dot ", " DOT ", *(b + g + w for b in "([{<" for g in ("", " ") for w in ("at", "AT", "ät")))
_AT_SIGN = re.compile(r"[(\[{<][ ]?(?:at|AT|ät)[ ]?[)\]}>]|[ ](?:at|AT)[ ]|@")


@lru_cache(200_000)
def _plain(word: str) -> str:
    low = word.lower()
    if not low.isascii():
        low = "".join(c for c in unicodedata.normalize("NFD", "".join(_CYRILLIC.get(c, c) for c in low)) if not unicodedata.combining(c))
    return low


_GIVEN_PLAIN = frozenset(_plain(g) for g in GIVEN) | {"mariya", "olga", "sergey", "dmitriy", "aleksey", "elena"}
_FAMILY_PLAIN = frozenset(_plain(g) for g in FAMILY)


@lru_cache(200_000)
def is_given(word: str) -> bool:
    plain = _plain(word)
    return plain in _GIVEN_PLAIN or plain.split("-")[0] in _GIVEN_PLAIN


def candidates(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of everything that might be personal information.

    Each generator starts at places a single scan of the text finds: at signs, runs of digits, capitals.
    """
    out: set[tuple[str, int, int]] = set()
    if any(map(text.__contains__, _AT_SIGNS)):
        done = 0
        spelt = " dot " in text or " DOT " in text
        for at in _AT_SIGN.finditer(text):
            if at[0][0] == " " and not spelt:
                continue
            pattern = _EMAILS[at[0][0] if at[0][0] in "@ " else "("]
            for word in _LOCAL_START.finditer(text, _word_start(text, at.start(), done), at.start()):
                m = pattern.match(text, word.start())
                if m is not None and m.end() > at.start():
                    out.add(("email", m.start(), m.end()))
                    break
            done = at.end()
    for run in _NUMERIC.finditer(text):
        a, b = run.start(), run.end()
        if a and text[a - 1].isupper():  # a number that begins with letters
            first = a - 1
            while first and a - first < 3 and text[first - 1].isupper():
                first -= 1
            if m := _CODES.match(text, first):
                out.add(("id_number", m.start(), m.end()))
        if b - a < 6 or sum(map(str.isdigit, run[0])) < 6:
            continue
        for kind, patterns in (("phone", _PHONES), ("id_number", _IDS)):
            for pattern in patterns:
                for m in pattern.finditer(text, max(0, a - 5), min(len(text), b + 6)):
                    out.add((kind, m.start(), m.end()))
    for gate, pattern in zip(_GATES, _ADDRESSES):
        if any(map(text.__contains__, gate)):
            if gate is _GATES[0] or gate is _GATES[3]:
                for n in _NUMBERED.finditer(text):
                    if m := pattern.match(text, n.start()):
                        out.add(("address", m.start(), m.end()))
                    if m := _FLAT.search(text, max(0, n.start() - 16), n.start()):
                        if m := pattern.match(text, m.start()):
                            out.add(("address", m.start(), m.end()))
            else:
                for m in pattern.finditer(text):
                    out.add(("address", m.start(), m.end()))
    out.update(_names(text))
    return sorted(out, key=lambda c: (c[1], c[2], c[0]))


def _names(text: str) -> Iterator[tuple[str, int, int]]:
    """Two to four units of every run of capitalised words and initials; 'Family, Given' too."""
    at = 0
    while (word := _CAPITAL.search(text, at)) is not None:
        start, at = word.span()
        more = text[at : at + 3]
        if more[:1] in " \n" and not (more[1:2].isupper() or more[1:2] in _PARTICLE_STARTS) or more[:1] == "," and not more[2:3].isupper() and not more[1:2].isupper() or more[:1] not in " \n,.":
            continue  # no second unit follows
        if start and (text[start - 1].isalnum() or text[start - 1] in "'’@./_-") and not text[start - 2 : start] == "--":
            continue
        run: list[tuple[int, int, str, bool]] = []  # start without particle, end, what stands before, initial
        end, again = start, 0
        while (m := _UNIT_OF_NAME.match(text, end)) is not None and (m.end() > end) and (not run or m["gap"] is not None):
            if run and "," in (m["gap"] or "") and "," in "".join(u[2] for u in run[-2:]):
                again = run[-1][0]  # the word between two commas begins a run of its own
                break
            run.append((m.start("word"), m.end(), m["gap"] or "", m["initial"] is not None))
            end = m.end()
        at = again if again > start else max(at, end)
        for i, (begin, _, _, first_initial) in enumerate(run[:-1]):
            if text[begin : run[i][1]].lower() in _STARTERS or (first_initial and _DEGREES.search(text, max(0, begin - 12), begin + 1)):
                continue
            commas = 0
            for j in range(i + 1, min(len(run), i + 4)):
                commas += "," in run[j][2]
                last = run[j]
                if text[last[1] : last[1] + 1].isalnum() or text[last[1] : last[1] + 1] == "@":
                    continue
                if commas == 0 and last[3]:
                    continue  # 'Given I.' goes on, or is no name
                if commas and ("," not in run[i + 1][2] or j > i + 2 or (first_initial and not last[3])):
                    break  # 'Family, Given' or 'Family, G. I.'
                yield "name", begin, last[1]
                if commas and i == 0 and (m := _PARTICLE_BEFORE.search(text, max(0, begin - 9), begin)):
                    yield "name", m.start(), last[1]


_FLAT = re.compile(r"(?:Flat|Apt\.?|Apartment|Unit|Suite|Room)[ ]\d+[a-z]?,[ ]$")


def _word_start(text: str, at: int, least: int) -> int:
    """Where the run of address characters before ``at`` begins, at ``least`` or later."""
    start = at
    while start > least and text[start - 1] not in "\n<>;:,":
        start -= 1
    return start


def _before(text: str, start: int) -> list[str]:
    return [w.lower() for w in _WORD.findall(text[max(0, start - 48) : start])][-5:]


_NONE = (0,) * 24


def _capital_before(text: str, start: int) -> bool:
    """Whether the word right before is capitalised."""
    at = start - 1
    while at and (text[at - 1].isalnum() or text[at - 1] in "'’-"):
        at -= 1
    return text[at].isupper()


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format first, then context."""
    span = text[start:end]
    letters = sum(c.isalpha() for c in span)
    digits = sum(c.isdigit() for c in span)
    words = span.replace(",", " ").split()
    before = _before(text, start)
    last = before[-1] if before else ""
    after = text[end : end + 24]
    nxt = _WORD.search(after)
    following = nxt[0].lower() if nxt and nxt.start() < 4 else ""
    left, right = text[start - 1 : start] if start else "", after[:1]
    cue = _CUES[kind]
    row = [float(kind == k) for k in KINDS]
    row += [
        len(span), digits, letters, len(words), span.count(" "), span.count("-"), span.count("."), span.count("/"), span.count("\n"),
        "(" in span, span[0] in "+(", span[:2] == "00", span[0] == "0", span[:2].isupper() and span[2:4].isdigit(), span[0].isalpha(), span[-1].isalpha(), span.isupper(),
        last in cue, sum(w in cue for w in before), any(w in _BAD for w in before[-2:]), last in _BAD, following in _AFTER, following in _UNIT,
        left in ("", "\n"), left == "(", left == "<", left == "#", right in ("", "\n"), right in ",.;", right == ")", right == "<" or after[:2] == " <", after[:2] == " (", after[:1] == "," and after[2:3].isdigit(),
        text[max(0, start - 3) : start] == "-- ",
    ]
    if kind == "name":
        comma = "," in span
        core = [w.strip(",") for w in words]
        given = core[-1] if comma else core[0]
        initial = [w for w in core if w.endswith(".")]
        if comma and core[-1].endswith(".") and len(core) > 2:
            given = core[1]
        family = core[0] if comma else core[-1]
        parts = re.split(r"[-]", family)
        row += [
            comma, is_given(given), is_given(family), len(initial), given.endswith("."), any(_plain(w) in _THINGS for w in core), following in _THINGS, _plain(family) in _FAMILY_PLAIN or _plain(parts[-1]) in _FAMILY_PLAIN,
            bool(before) and last in ("the", "mount", "der", "die", "das", "lake", "la", "le", "el"), len(family), core[0].lower() in cue or core[0].lower() in _BAD, len(parts) > 1, "'" in family or "’" in family,
            following in _PERSON_VERBS, last in _BEFORE_NAME, last in _TITLES or (len(before) > 1 and before[-2] in _TITLES), nxt is not None and nxt.start() == 1 and nxt[0][:1].isupper(), bool(last) and text[start - 1 : start] == " " and text[start - 2 : start - 1].isalnum() and _capital_before(text, start),
            any(w.lower() in _STARTERS for w in core), last[-1:].isdigit(), sum(w[:1].isupper() for w in core), core[0].lower() in _TITLES, min(len(w) for w in core), span.isascii(),
        ]
    elif kind == "address":
        tail = re.search(r"\d{4,5}|[A-Z]{1,2}\d", span[-12:]) is not None
        head = span[:1].isdigit() or span[:2] in ("Fl", "Ap", "Un", "PO", "P.")
        row += [tail, head, "Box" in span, span.count(","), any(c.isdigit() for c in span), text[end : end + 1] == " " and text[end + 1 : end + 2].isdigit(), text[end : end + 2] in (", ", ",\n") and text[end + 2 : end + 3].isupper(), text[end : end + 1] == "\n" and text[end + 1 : end + 2].isupper(), _FLAT.search(text, max(0, start - 16), start) is not None, *_NONE[:15]]
    elif kind == "email":
        domain = re.split(_AT, span)[-1]
        row += ["." in domain, "@" in span, "dot" in span.lower(), domain.count("."), any(c in span for c in "([{"), " AT " in span or " at " in span, *_NONE[:18]]
    else:
        shape = re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "9", span))
        groups = [len(g) for g in re.findall(r"9+", shape)]
        row += [
            shape in ("999-99-9999", "999 99 9999"), shape == "999999-9999", shape.count("/") == 2, shape[:2] == "aa", shape[:1] == "a", shape[-2:] == "-a",
            groups[0] if groups else 0, groups[-1] if groups else 0, len(groups), max(groups, default=0), shape == "9999-99-99", shape == "9999-9999", len(groups) == 1,
            shape.startswith("aa99"), "iban" in before, "nhs" in before, any(w in ("dni", "nie", "steuer-id", "passport", "sécurité", "personalausweis") for w in before), *_NONE[:7],
        ]
    return [float(v) for v in row]


def _rows(texts: list[str | None]) -> tuple[list[tuple[int, str, int, int]], np.ndarray]:
    found, rows = [], []
    for i, text in enumerate(texts):
        if text:
            for kind, start, end in candidates(text):
                found.append((i, kind, start, end))
                rows.append(features(text, kind, start, end))
    return found, np.array(rows, float) if rows else np.zeros((0, 1))


class Model:
    def __init__(self, trees: BoostedTrees, thresholds: dict[str, float]):
        self.trees, self.thresholds = trees, thresholds

    def find(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        """The selected (start, end, kind) of every text, in order, without overlap."""
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        found, rows = _rows(texts)
        if not found:
            return out
        score = self.trees.score(rows)
        by_text: dict[int, list] = {}
        for (i, kind, start, end), s in zip(found, score.tolist()):
            if s >= self.thresholds[kind]:
                by_text.setdefault(i, []).append((-round(s, 3), start - end, start, end, kind))
        for i, spans in by_text.items():
            taken: list[tuple[int, int, str]] = []
            for _, _, start, end, kind in sorted(spans):
                at = bisect(taken, (start, end, kind))
                if (at == 0 or taken[at - 1][1] <= start) and (at == len(taken) or end <= taken[at][0]):
                    taken.insert(at, (start, end, kind))
            out[i] = taken
        return out


@cache
def trained(seed: int = 0) -> Model:
    """Trees on FIT labelled texts, thresholds of the best F1 on HELD_OUT others."""
    sample = labelled(FIT + HELD_OUT, seed)

    def table(part: list) -> tuple[list, np.ndarray, np.ndarray]:
        found, rows = _rows([t for t, _ in part])
        truth = [set(spans) for _, spans in part]
        return found, rows, np.array([(kind, start, end) in truth[i] for i, kind, start, end in found])

    _, x, y = table(sample[:FIT])
    trees = BoostedTrees(rounds=60, depth=5, rate=0.25, ridge=3.0).fit(x, y)
    found, x, y = table(sample[FIT:])
    score = trees.score(x)
    thresholds = {}
    for kind in KINDS:
        mine = np.array([f[1] == kind for f in found])
        s, t = score[mine], y[mine]
        total = max(t.sum(), 1)
        best = (0.0, 0.5)
        for cut in np.linspace(0.1, 0.9, 17):
            hit = (s >= cut) & t
            f1 = 2 * hit.sum() / max((s >= cut).sum() + total, 1)
            best = max(best, (f1 - abs(cut - 0.5) * 1e-4, float(cut)))
        thresholds[kind] = best[1]
    return Model(trees, thresholds)


def _found(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches, "text"):
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        rows = [(i, kind, text[a:b]) for i, text, spans in zip(ids, texts, model.find(texts)) for a, b, kind in spans]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.string()) for k in (1, 2))], names=["doc_id", "kind", "found_text"]
        )


def _redacted(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches, "text"):
        texts = batch.column("text").to_pylist()
        out = []
        for text, spans in zip(texts, model.find(texts)):
            for a, b, kind in reversed(spans):
                text = f"{text[:a]}[{kind.upper()}]{text[b:]}"
            out.append(text)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "clean_text"])


def personal_data(documents: DataFrame) -> DataFrame:
    """(doc_id, kind, found_text), distinct, of all documents."""
    model = trained()
    slim = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return slim.mapInArrow(lambda it: _found(it, model), "doc_id bigint, kind string, found_text string").distinct()


def redacted(documents: DataFrame) -> DataFrame:
    """(doc_id, clean_text): every text with typed placeholders such as [EMAIL]."""
    model = trained()
    slim = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return slim.mapInArrow(lambda it: _redacted(it, model), "doc_id bigint, clean_text string")
