"""Column functions for link targets, link texts and references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of the C locale.
SPACE = " \t\n\x0b\x0c\r"


def first_upper(text: Column) -> Column:
    """Upper-case the first letter if it is one of a-z; other alphabets stay as they are."""
    return F.when(text.rlike("^[a-z]"), F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30))).otherwise(text)


def link_target(text: Column) -> Column:
    """One leading ':' dropped, cut at the first '#', first letter upper-cased."""
    return first_upper(F.substring_index(F.regexp_replace(text, "^:", ""), "#", 1))


def pipe_trick(text: Column) -> Column:
    """The text shown for ``[[title|]]``: no prefix, no bracketed suffix (or comma part), trimmed."""
    colon = F.locate(":", text, 2)
    rest = F.when(colon > 0, text.substr(colon + 1, F.lit(1 << 30))).otherwise(F.regexp_replace(text, "^:", ""))
    bracket = F.contains(rest, F.lit("("))
    cut = F.when(bracket, F.substring_index(rest, "(", -1)).otherwise(F.lit(None))
    body = F.when(bracket, rest.substr(F.lit(1), F.length(rest) - F.length(cut) - 1)).otherwise(F.substring_index(rest, ",", 1))
    return F.regexp_replace(F.regexp_replace(body, r"^[ \t\n\x0B\f\r]+", ""), r"[ \t\n\x0B\f\r]+\z", "")


def namespace_number(ns: Column) -> Column:
    """The namespace of a page record; nothing or '' is 0, text that is no whole number is null."""
    whole = F.regexp_replace(ns, r"^[ \t\n\x0B\f\r]+", "")
    return F.when(F.coalesce(ns, F.lit("")) == "", F.lit(0).cast("bigint")).when(
        whole.rlike(r"^[+-]?[0-9]+\z"), whole.try_cast("bigint")
    )


def page_text(revision: Column) -> Column:
    """The texts of all revisions joined in order; null revisions count as ''."""
    return F.coalesce(F.array_join(revision.getField("text"), ""), F.lit(""))


def page_title(title: Column) -> Column:
    return F.coalesce(title, F.lit("untitled"))


def page_ref(page_id: Column, title: Column) -> Column:
    return F.concat(F.lit("#"), page_id.cast("string"), F.lit(" ("), page_title(title), F.lit(")"))


def link_text(linked: Column, title: Column, to_title: Column) -> Column:
    """What a reader sees: the written text, else the target's title (by the pipe trick for '')."""
    return (
        F.when(~linked, F.lit("unknown"))
        .when(title.isNull(), page_title(to_title))
        .when(title == "", pipe_trick(page_title(to_title)))
        .otherwise(title)
    )


def link_ref(page_id: Column, title: Column, text: Column, to_title: Column) -> Column:
    """A reference to ``page_id`` that names the shown text where it differs from the target's title."""
    shown = F.when(text != page_title(to_title), F.concat(F.lit("; displayed as: "), text)).otherwise(F.lit(""))
    return F.concat(F.lit("#"), page_id.cast("string"), F.lit(" ("), page_title(title), shown, F.lit(")"))


def dot_quote(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('\\"')), F.lit('"'))


def wiki_url(base: str, title: Column) -> Column:
    """Base address and title, escaped the way a browser's whole-address escape does it."""
    kept = "%3A:%2F/%3F?%23#%40@%21!%24$%26&%27'%28(%29)%2A*%2B+%2C,%3B;%3D=%7E~"
    out = F.replace(F.url_encode(title), F.lit("+"), F.lit("%20"))
    for i in range(0, len(kept), 4):
        out = F.replace(out, F.lit(kept[i : i + 3]), F.lit(kept[i + 3]))
    return F.concat(F.lit(base), out)
